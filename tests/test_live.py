"""Live streams against whole ones: any chunks, any batches, blocks, gaps and silence."""

import json
import random
import time

import pytest

from palisade.operators import detectors as d
from palisade.streaming import events, live

TOKEN, SECRET = "__PII_email_0123456789ab__", 'a"b@corp.com'
OTHER = "__PII_custom_ffffffffffff__"
SECRETS = {TOKEN: SECRET, OTHER: "x"}
SCHEMA = "stream string, seq long, chunk binary, last boolean"


def event(i, text, end="\n\n"):
    return f"data: {json.dumps({'i': i, 'd': text})}{end}".encode()


def made_up(rng):
    """A stream whose text holds placeholders, split over events at random."""
    text = "".join(rng.choice([TOKEN, OTHER, "__PII_email_999999999999__", " word ", "__P", "é", "_"]) for _ in range(rng.randrange(12)))
    cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randrange(6))))
    out = [event(rng.choice((1, 1, 1, 2)), text[a:b], rng.choice(("\n\n", "\r\n\r\n", "\r\r"))) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    for i in range(len(out)):
        if rng.random() < 0.3:
            out[i] += rng.choice((b": ping\n\n", b"event: x\r\n\r\n", b"data: [DONE]\n\n", b"data: a\ndata: b\n\n"))
    return b"".join(out) + rng.choice((b"", b"data: tail", b": end"))


def chunks_of(rng, raw, stream):
    cuts = sorted(rng.randrange(len(raw) + 1) for _ in range(rng.randrange(8)))
    parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
    return [(stream, i, p, i == len(parts) - 1) for i, p in enumerate(parts)]


@pytest.fixture
def run(spark, tmp_path):
    """Run batches of chunks through a query; the bytes, restored numbers and refusals of each stream."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)

    def go(batches, rules=(), secrets=SECRETS):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        told = spark.createDataFrame([(s, k, v) for s in {r[0] for b in batches for r in b} for k, v in secrets.items()], "stream string, placeholder string, secret string")
        query = live.restored_chunks(source, told, rules, idle_ms=None).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        out = {}
        for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r["stream"], r["nth"])):
            own = out.setdefault(r["stream"], [b"", 0, None, -1])
            assert r["nth"] == own[3] + 1 and own[2] is None
            own[0], own[1], own[2], own[3] = own[0] + bytes(r["data"]), own[1] + r["n_restored"], r["refused"], r["nth"]
        return {k: tuple(v[:3]) for k, v in out.items()}

    yield go
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_any_split_gives_the_whole_stream(run):
    rng = random.Random(3)
    raws = {f"s{i}": made_up(rng) for i in range(40)}
    batches = [[] for _ in range(3)]
    for k, raw in raws.items():
        for row in chunks_of(rng, raw, k):
            batches[rng.randrange(3)].append(row)  # chunks may come early
    batches[2] += [r for r in batches[0] if rng.random() < 0.3]  # and again
    for b in batches:
        rng.shuffle(b)
    got = run(batches)
    for k, raw in raws.items():
        assert got[k] == (*events.stitched(raw, SECRETS.get), None), (k, raw)


def test_a_block_drops_what_is_held(run):
    held = event(1, f"to {TOKEN[:9]}")
    raws = {"after": event(1, "fine") + held + event(1, "stop now") + event(1, "later"), "first": event(1, "stop"), "none": event(1, f"{TOKEN} stopp") + b"data: stop\n\n", "split": event(2, TOKEN)}
    rng = random.Random(1)
    batches = [[], []]
    for k, raw in raws.items():
        for i, at in enumerate(range(0, len(raw), 17)):
            batches[i % 2].append((k, i, raw[at : at + 17], at + 17 >= len(raw)))
    rules = [d.regex_rule("halt", r"\bstop\b", action="block", scope="response"), d.keyword_rule("mild", ["fine"], action="warn", scope="both"), d.BUILTIN[1]]
    rng.shuffle(batches[0])
    got = run(batches, rules)
    assert got["after"] == (event(1, "fine") + live.refusal("halt"), 0, "halt") and got["first"] == (live.refusal("halt"), 0, "halt")
    # only JSON is judged
    assert got["none"] == (*events.stitched(raws["none"], SECRETS.get), None) and got["split"] == (event(2, SECRET), 1, None)


def test_bounds(run, monkeypatch):
    raw = event(1, "x" * 1500 + TOKEN) + event(1, "small " + TOKEN) + event(1, TOKEN[:8]) + b": ping\n\n" * 200 + event(1, TOKEN[8:])
    monkeypatch.setattr(events, "MOST_HELD", 1000)
    want = events.stitched(raw, SECRETS.get)
    assert want[1] == 1 and want[0].count(TOKEN.encode()) == 1
    big = b"data: " + b"y" * (300 << 10) + b"\ndata: " + TOKEN.encode() + b"\n\n" + event(1, TOKEN)
    rows = [("big", i, big[a : a + 50_000], a + 50_000 >= len(big)) for i, a in enumerate(range(0, len(big), 50_000))]
    gap = [("gap", i, b"z" * 100_000, False) for i in range(1, 5)]
    got = run([rows[:4] + gap, rows[4:], [("gap", 0, b"late", True)]])
    monkeypatch.undo()
    assert got["big"] == (*events.stitched(big, SECRETS.get), None) and got["big"][1] == 1
    assert got["gap"] == (live.refusal("stream_gap"), 0, "stream_gap")


def test_silence_ends_a_stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    raw = event(1, f"a {TOKEN}") + event(1, f"b {TOKEN[:7]}") + b"data: not ended"
    spark.createDataFrame([("s", 0, raw, False)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    told = spark.createDataFrame([("s", TOKEN, SECRET)], "stream string, placeholder string, secret string")
    query = live.restored_chunks(source, told, idle_ms=1500).writeStream.format("memory").queryName("silent").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="500 milliseconds").start()
    try:
        want, _ = events.stitched(raw, SECRETS.get)
        end = time.time() + 120
        while time.time() < end and b"".join(bytes(r["data"]) for r in spark.table("silent").orderBy("nth").collect()) != want:
            time.sleep(1)
        assert b"".join(bytes(r["data"]) for r in spark.table("silent").orderBy("nth").collect()) == want
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
