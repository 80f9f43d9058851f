"""Walks, escapes, event streams, rule documents and stream restoring on small inputs."""

import gzip
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from palisade.functions import spans
from palisade.operators import detectors, policy, requests, tokens
from palisade.plans import rules
from palisade.sources import bodies, sse
from palisade.streaming import restore


def test_walk_order_duplicates_and_encoded():
    inner = json.dumps({"deep": "x"})
    body = json.dumps({"a": "1", "b": [1, "2", None], "c": inner}).encode()
    assert [(x.path, x.value, x.encoded) for x in bodies.walk(body)] == [("/a", b"1", False), ("/b/1", b"2", False), ("/c/deep", b"x", True)]
    assert [x.value for x in bodies.walk(b'{"a":"x","a":"y"}')] == [b"x", b"y"]
    assert [x.path for x in bodies.walk(b'{"a/b~c":"x"}')] == ["/a~1b~0c"]


@pytest.mark.parametrize(("body", "reason"), [(b'{"a":', "malformed_json"), (b'{"a":1} x', "trailing_data"), (b'"\xff"', "invalid_utf8"), (b"[" * 10_001, "max_depth"), (b"[1,]", "malformed_json"), (b"01", "trailing_data"), (b"", "malformed_json")])
def test_walk_errors(body, reason):
    with pytest.raises(bodies.WalkError, match=reason):
        bodies.walk(body)


def test_rewrite_at_depth():
    inner = json.dumps({"note": 'say "hi" to ann@corp.com'})
    body = json.dumps({"m": inner, "n": "é ann@corp.com"}, ensure_ascii=True).encode()
    found = bodies.walk(body)
    edits = []
    for i, x in enumerate(found):
        at = x.value.index(b"ann@corp.com")
        edits.append((i, at, at + 12, 'T"1'))
    out, n = bodies.rewrite(body, edits)
    assert n == 2
    back = json.loads(out)
    assert json.loads(back["m"])["note"] == 'say "hi" to T"1' and back["n"] == 'é T"1'


def test_members_and_identities():
    body = json.dumps({"n": 1, "a": [2, "x", None, "y"], "k": json.dumps(["v", {"m": "w"}]), "s": json.dumps("root"), "z": True, "t": "end"}).encode()
    found = bodies.walk(body)
    assert [(x.path, x.key) for x in found] == [("/a/1", None), ("/a/3", None), ("/k/0", None), ("/k/1/m", "m"), ("/s", None), ("/t", "t")]
    u = bodies.UNIT
    assert bodies.identities(found) == [u.join(x) for x in (("/a/1", "n=1", "0=2", "0"), ("/a/3", "n=1", "0=2", "2=null", "0"), ("/k/0", "n=1", "0"), ("/k/1/m", "n=1", "0"), ("/s", "n=1", "0"), ("/t", "n=1", "z=true", "0"))]
    assert bodies.identities(bodies.walk(b'{"a":"1","a":"2"}')) == [f"/a{u}0", f"/a{u}1"]
    assert bodies.identities(bodies.walk(b'{"n":%s,"a":"1"}' % (b"9" * 2000))) == [None]
    wide = b"{" + b",".join(b'"k%d":%d,"s%d":"x"' % (i, i, i) for i in range(30_000)) + b"}"
    start = time.time()
    assert sum(x is None for x in bodies.identities(bodies.walk(wide))) > 29_000 and time.time() - start < 5


@pytest.mark.parametrize("levels", [1, 2, 3, 4])
def test_encoded_up_to_the_limit(monkeypatch, levels):
    monkeypatch.setattr(bodies, "MOST_ENCODED", 3)
    deep = {"a": "v"}
    for _ in range(levels):
        deep = {"k": json.dumps(deep)}
    (leaf,) = bodies.walk(json.dumps(deep).encode())
    assert leaf.encoded is (levels < 3) and leaf.path == "/k" * min(levels, 3) + ("/a" if levels <= 3 else "/k")


def test_request_path(spark):
    rules_ = [detectors.BUILTIN[1], detectors.keyword_rule("stop", ("stop",), action="block")]
    rows = [(1, '{"Token":"ann@corp.com allowed","a":["ann@corp.com"]}'), (2, '{"token":"allowed"}'), (3, '{"a":"please stop ann@corp.com"}'), (4, "no json ann@corp.com"), (5, '["ann@corp.com"]'), (6, None), (7, "{}")]
    df = spark.createDataFrame(rows, "k int, body string")
    made = requests.evaluated(bodies.walked(df), rules_, sensitive=("TOKEN",), allowlist=("allowed",))
    got = {r["k"]: (r["action"], r["refusal"], r["rule_ids"], [(f["leaf_index"], f["value"]) for f in r["backing"]]) for r in made.collect()}
    assert got == {
        1: ("redact", None, ["sensitive_key", "email"], [(0, "ann@corp.com allowed"), (1, "ann@corp.com")]), 2: ("allow", None, [], []), 3: ("block", None, ["stop"], [(0, "stop")]),
        4: ("block", "malformed_json", [], []), 5: ("redact", None, ["email"], [(0, "ann@corp.com")]), 6: ("block", "malformed_json", [], []), 7: ("allow", None, [], [])}
    assert {r["k"]: (r["status"], json.loads(r["body"])) for r in policy.refusals(made, "k").collect()} == {3: (403, {"error": "rule_blocked", "rule_id": "stop"}), 4: (400, {"error": "malformed_json"}), 6: (400, {"error": "malformed_json"})}
    minted = tokens.vault(requests.secrets_of(made), b"s" * 32)
    done = requests.redacted(made, b"s" * 32, "k")
    assert {r["k"]: r["applied"] for r in done.collect()} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0}
    back = requests.restored(done.withColumnRenamed("redacted", "body"), minted, "k")
    assert {r["k"]: r["restored"] and bytes(r["restored"]).decode() for r in back.collect()} == dict(rows)
    late = requests.evaluated(bodies.walked(spark.createDataFrame([(1, b'{"a":"\xff"}'), (2, b"no json"), (3, b'{"a":"b"}')], "k int, body binary")), rules_, phase="response")
    assert {r["k"]: (r["action"], r["walk_skip"]) for r in late.collect()} == {1: ("allow", 1), 2: ("allow", 0), 3: ("allow", 0)}


def test_restore_at_depth_in_keys_and_plain(spark):
    token, secret = "__PII_custom_0123456789ab__", 'say "hi"\\ \n'
    other = "__PII_custom_ffffffffffff__"
    minted = spark.createDataFrame([(token, secret), ("__PII_email_0123456789ab__", "ann@corp.com")], "placeholder string, secret string")
    body = json.dumps({"a": f"x {token}", token: json.dumps({"in": f"{token}{token} {other}"}), "e": "__PII_email_0123456789ab__"})
    df = spark.createDataFrame([(1, body), (2, f"plain {token} {other}"), (3, "none"), (4, None)], "k int, body string")
    out = {r["k"]: (r["restored"] and bytes(r["restored"]).decode(), r["n_restored"]) for r in requests.restored(df, minted, "k").collect()}
    back = json.loads(out[1][0])
    assert back["a"] == f"x {secret}" and json.loads(back[secret])["in"] == f"{secret}{secret} {other}" and back["e"] == "ann@corp.com" and out[1][1] == 5
    assert out[2] == (f"plain {secret} {other}", 1) and out[3] == ("none", 0) and out[4] == (None, 0)
    left = requests.restored(df, minted, "k", exclusions=minted.where("secret LIKE 'ann%'").select("secret")).where("k = 1").first()
    assert b"__PII_email_0123456789ab__" in bytes(left["restored"]) and left["n_restored"] == 4


def test_floor_and_switches():
    def pack(**doc):
        return rules.compile_document(json.dumps({"schema_version": 2, **doc}))

    rule = {"id": "r", "type": "email", "action": "warn"}
    weak = [{"detectors": {"high_entropy": False}}, {"detectors": {"email": False}}, {"disabled_categories": ["high_entropy"]}, {"rules": [{"id": "r", "type": "keyword", "keywords": ["x"], "action": "allow", "category": "mine"}]},
            {"rules": [{**rule, "options": {"email": {"suffixes": ["corp"], "replace": True}}}]}]
    for doc in weak:
        with pytest.raises(rules.RuleError):
            rules.check_floor(pack(**doc))
        rules.check_floor(rules.compile_document(json.dumps({"schema_version": 2, **doc}), origin="builtin"))
    rules.check_floor(pack(rules=[{**rule, "options": {"email": {"suffixes": ["corp"]}}}], detectors={"email": True}, disabled_categories=["mine"]))
    assert [r.id for r in rules.builtin()] == ["prefix", "email", "luhn", "jwt", "private_key"] and [r.id for r in rules.builtin({"email": False, "high_entropy": True})][-1] == "high_entropy"
    assert pack(rules=[{"id": "c", "type": "command", "action": "warn", "verbs": ["x"]}]).commands == ("c",)
    for doc in ({"rules": [{"id": "c", "type": "command", "action": "warn", "verbs": ["x"] * 17}]}, {"rules": [rule, rule]}):
        with pytest.raises(rules.RuleError):
            pack(**doc)
    with pytest.raises(rules.RuleError):
        rules.builtin({"nothing": True})


def test_inflated_within_cap(spark):
    df = spark.createDataFrame([(1, gzip.compress(b"0" * 10_000), "gzip"), (2, gzip.compress(gzip.compress(b"0" * 900)), "gzip, gzip"), (3, gzip.compress(b"0" * 600) * 2, "gzip")], "k int, body binary, content_encoding string")
    assert {r["k"]: r["refused"] for r in bodies.inflated(df, cap=1000).collect()} == {1: True, 2: False, 3: True}


def test_sse_is_linear():
    d, start = sse.Decoder(), time.time()
    events = sum(1 for i in range(40_000) for _ in d.feed(b"data: x" + b"y" * (i % 3) + b"\n\n")) + sum(1 for _ in d.feed(b"data: a\n" * 100_000 + b"\n"))
    for _ in range(20_000):
        events += sum(1 for _ in d.feed(b"long "))
    assert events == 40_001 and time.time() - start < 5


def test_leaves_and_errors(spark):
    df = spark.createDataFrame([(1, b'{"a":"x"}'), (2, b"nope"), (3, None)], "k int, body binary")
    got = {r["k"]: r for r in bodies.leaves(df, "k").collect()}
    assert got[1]["value"] == "x" and got[1]["member"] and got[2]["error"] == "malformed_json" and got[3]["error"] == "malformed_json"


def test_inflated(spark):
    df = spark.createDataFrame([(1, gzip.compress(b"hi"), "gzip"), (2, b"hi", "identity"), (3, b"hi", "br"), (4, b"hi", "gzip")], "k int, body binary, content_encoding string")
    got = {r["k"]: (r["body"], r["refused"]) for r in bodies.inflated(df).collect()}
    assert got == {1: (b"hi", False), 2: (b"hi", False), 3: (None, True), 4: (None, True)}


def test_sse_any_split():
    raw = b": c\r\nevent: e\rdata: a\ndata:b\r\n\r\nid: 7\ndata: c\n\nretry: 1\n\ndata: tail"
    whole = [*(d := sse.Decoder()).feed(raw), *d.close()]
    assert whole == [("e", b"a\nb", "", False, ""), ("message", b"c", "7", True, ""), ("message", b"tail", "7", True, "")]
    for i in range(len(raw)):
        d = sse.Decoder()
        assert [*d.feed(raw[:i]), *d.feed(raw[i:]), *d.close()] == whole


def test_rule_documents():
    doc = {"schema_version": 1, "rules": [{"id": "b", "type": "regex", "action": "warn", "pattern": "[0-9]{4}"}, {"id": "a", "type": "keyword", "action": "block", "scope": "both", "priority": 1, "keywords": ["Boom"]}]}
    pack = rules.compile_document(json.dumps(doc))
    assert [(r.id, r.category, r.priority, r.confidence) for r in pack.rules] == [("a", "custom", 1, 0.9), ("b", "custom", 100, 0.9)]
    for fault in ({"x": 1}, {"rules": [{"id": "A", "type": "regex", "action": "warn", "pattern": "x"}]}, {"rules": [{"id": "a", "type": "regex", "action": "warn", "pattern": "x*"}]}, {"rules": [{"id": "a", "type": "keyword", "action": "redact", "scope": "both", "keywords": ["x"]}]}):
        with pytest.raises(rules.RuleError):
            rules.compile_document(json.dumps({"schema_version": 1, **fault}))
    with pytest.raises(rules.RuleError):
        rules.check_floor(rules.compile_document(json.dumps({"schema_version": 1, "detectors": {"email": False}})))
    with pytest.raises(rules.RuleError):
        rules.register(detectors.BUILTIN, detectors.BUILTIN[:1])


def test_allowlist_and_vault(spark):
    df = spark.createDataFrame([(1, "mail ann@corp.com or bob@corp.com é ann@corp.com"), (2, ""), (3, None)], "k int, text string")
    rows = detectors.with_findings(df, [detectors.BUILTIN[1]], allowlist=("bob@corp.com",))
    found = detectors.findings(df, [detectors.BUILTIN[1]], allowlist=("bob@corp.com",))
    assert {r["value"] for r in found.collect()} == {"ann@corp.com"}
    salt = b"s" * 32
    minted = tokens.vault(found, salt)
    done = tokens.redact(rows, salt, minted)
    back = {r["k"]: (r["restored"], r["n_restored"]) for r in tokens.restore(done, minted, "k").collect()}
    assert back == {1: ("mail ann@corp.com or bob@corp.com é ann@corp.com", 2), 2: ("", 0), 3: (None, 0)}
    assert [(r["k"], r["action"], r["n_findings"]) for r in policy.decided(rows).orderBy("k").collect()] == [(1, "redact", 2), (2, "allow", 0), (3, "allow", 0)]
    again = tokens.redact(detectors.with_findings(done.select("k", F.col("redacted").alias("text")), [detectors.BUILTIN[1]], allowlist=("bob@corp.com",)), salt, minted)
    assert again.where("NOT (redacted <=> text)").count() == 0


def test_ladder(spark, monkeypatch):
    monkeypatch.setattr(tokens, "LADDER", (1, 2, 64))
    secrets = [f"user{i}@corp.com" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(secrets)), (2, secrets[3] + " and " + secrets[3])], "k int, text string")
    salt = b"s" * 32
    rows = detectors.with_findings(df, [detectors.BUILTIN[1]])
    found = detectors.findings(df, [detectors.BUILTIN[1]])
    minted = tokens.vault(found, salt)
    names = {r["secret"]: r["placeholder"] for r in minted.collect()}
    assert set(names) == set(secrets) and len(set(names.values())) == 40 and {len(x.rsplit("_", 3)[1]) for x in names.values()} == {1, 2}
    monkeypatch.setattr(tokens, "TOKEN", r"__PII_[a-z0-9_]{1,16}?_[0-9a-f]{1,64}__")
    done = tokens.redact(rows, salt, minted)
    assert {r["k"]: r["redacted"] for r in done.collect()} == {1: " ".join(names[x] for x in secrets), 2: f"{names[secrets[3]]} and {names[secrets[3]]}"}
    assert {r["k"]: r["restored"] for r in tokens.restore(done, minted, "k").collect()} == {r["k"]: r["text"] for r in df.collect()}
    # an earlier vault keeps its placeholders, whatever else comes
    early = tokens.vault(found.where("k = 2"), salt)
    later = {r["secret"]: r["placeholder"] for r in tokens.vault(found, salt, known=early).collect()}
    assert later[secrets[3]] == early.first()["placeholder"] and len(set(later.values())) == 40


def test_too_many_findings(spark, monkeypatch):
    monkeypatch.setattr(policy, "MOST_FINDINGS", 3)
    rows = spark.createDataFrame([(1, "boom " * 3), (2, "boom " * 4)], "k int, text string")
    made = policy.decided(detectors.with_findings(rows, [detectors.keyword_rule("b", ("boom",), action="warn")]))
    assert [(r["k"], r["action"], r["refusal"], r["n_findings"]) for r in made.orderBy("k").collect()] == [(1, "warn", None, 3), (2, "block", "budget", 0)]
    refused = policy.refusals(made, "k").collect()
    assert [r["k"] for r in refused] == [2] and json.loads(refused[0]["body"]) == {"error": "plugin_failure", "reason": "budget"} and refused[0]["status"] == 403
    assert policy.counters(made.withColumn("applied", F.lit(0))).first().asDict() == {"requests": 2, "redactions": 0, "content_policy_blocks": 1, "rule_blocks": 0, "walk_skips": 0}


def test_email_scan_is_the_pattern(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab.@-_% é\n") for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a@b.comc_d@e.org", "x@y@z.com", "a@b.co@c.de", "a@b.com" * 5]
    want = [[(len(t[: m.start()].encode()), m.group()) for m in re.finditer(detectors.EMAIL, t)] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", spans.matches(F.col("text"), detectors.EMAIL_SCAN, "@").alias("m"))
    assert [[(x["start"], x["value"]) for x in r["m"]] for r in df.orderBy("k").collect()] == want
    assert sum(map(len, want)) > 20


@pytest.mark.parametrize("text", ["a" * 200_000, "a." * 100_000 + "@", "a@b" * 60_000, "sk-" * 60_000, "1 " * 100_000, "a.b" * 60_000, "-----BEGIN PRIVATE KEY-----" * 4000, "-----BEGIN " + "A" * 200_000, "a1@b.com " * 16_000])
def test_adversarial_texts(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(F.size(detectors.found(F.col("text"), [*detectors.BUILTIN, detectors.HIGH_ENTROPY])).alias("n"))
    df.collect()
    start = time.time()
    df.collect()
    assert time.time() - start < 5


def test_budget_on_character_borders(spark):
    text = "é" * 10 + " ann@corp.com boom"
    df = spark.createDataFrame([(n, text) for n in range(1, 40)], "n int, text string")
    for n in (1, 2, 19, 33, 34):
        cut = df.select(detectors.cut_to(F.col("text"), n).alias("t")).first()["t"]
        assert cut == text.encode()[:n].decode(errors="ignore")
    rules = [detectors.BUILTIN[1], detectors.keyword_rule("b", ("boom",))]
    assert [r["rule_id"] for r in detectors.findings(df.limit(1), rules, budget=24).collect()] == ["b"]


def test_stream_restore(spark, tmp_path):
    vault = spark.createDataFrame([("email", "ann@corp.com", "__PII_email_0123456789ab__")], "kind string, secret string, placeholder string")
    text = "to __PII_email_0123456789ab__ and __PII_x end_"
    parts = [(f"s{k}", i, text[a:b], b == len(text)) for k in (3, 5) for i, (a, b) in enumerate(zip(range(0, len(text), k), [*range(k, len(text), k), len(text)], strict=True))]
    spark.createDataFrame(parts[::-1], "stream_id string, seq long, chunk string, last boolean").repartition(3).write.parquet(f"{tmp_path}/in")
    chunks = spark.readStream.schema("stream_id string, seq long, chunk string, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    restore.restored_stream(chunks, vault, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "restored"))).alias("r")).collect()
    assert {r["stream_id"]: "".join(x["restored"] for x in r["r"]) for r in rows} == {s: "to ann@corp.com and __PII_x end_" for s in ("s3", "s5")}


def test_inflated_reads_all_members(spark):
    import gzip

    from palisade.sources import bodies

    two = gzip.compress(b"first ") + gzip.compress(b"second")
    df = spark.createDataFrame([(0, two, "gzip"), (1, two + b"x", "gzip"), (2, gzip.compress(b"one"), "gzip"), (3, b"", "gzip")], "i int, body binary, content_encoding string")
    got = {r["i"]: (r["body"] and bytes(r["body"]), r["refused"]) for r in bodies.inflated(df).collect()}
    assert got == {0: (b"first second", False), 1: (None, True), 2: (b"one", False), 3: (None, True)}
