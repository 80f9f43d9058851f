"""Placeholders in event streams: whole, split over envelopes, foreign, ambiguous."""

import json
import random

import pytest

from palisade.streaming import events

TOKEN, SECRET = "__PII_email_0123456789ab__", 'a"b@corp.com'
KNOWN = {TOKEN: SECRET, "__PII_custom_ffffffffffff__": "x"}.get


def stream(*values, end="\n\n"):
    return "".join(f"data: {v if isinstance(v, str) else json.dumps(v)}{end}" for v in values).encode()


def values(raw):
    return [json.loads(x[6:]) for x in raw.decode().split("\n\n") if x.startswith("data: {")]


@pytest.mark.parametrize("cut", range(1, len(TOKEN)))
def test_split_anywhere(cut):
    raw = stream({"i": 1, "d": f"to {TOKEN[:cut]}"}) + b": ping\n\n" + stream({"i": 1, "d": f"{TOKEN[cut:]} end"}, "[DONE]")
    out, n = events.stitched(raw, KNOWN)
    assert values(out) == [{"i": 1, "d": "to "}, {"i": 1, "d": f"{SECRET} end"}] and n == 1 and out.endswith(b"data: [DONE]\n\n") and b": ping\n\n" in out


def test_many_pieces():
    rng = random.Random(1)
    for _ in range(200):
        text = f"say {TOKEN} and {TOKEN}, __PII_x, __PII_email_ffffffffffff__ {TOKEN}"
        cuts = sorted(rng.sample(range(1, len(text)), rng.randrange(1, 12)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        out, n = events.stitched(stream(*({"id": "c", "n": 3, "t": p} for p in parts)), KNOWN)
        assert "".join(v["t"] for v in values(out)) == text.replace(TOKEN, SECRET) and n == 3


def test_what_stays():
    for raw in (stream({"i": 1, "d": TOKEN[:9]}, {"i": 2, "d": TOKEN[9:]}), stream({"d": TOKEN[:9]}, {"d": "other"}), stream({"d": TOKEN[:9]}, "text", {"d": TOKEN[9:]}), stream({"d": "__PII_email_999999999999__"}),
                b": only\r\n\r\nevent: x\r\n\r\n", b"", b"data", b"data: {\"d\":\"" + TOKEN[:9].encode()):
        assert events.stitched(raw, KNOWN) == (raw, 0)
    # several lines of data are no place to write to; a torn document inside keeps its placeholder
    assert events.stitched(b"data: a\ndata: " + TOKEN.encode() + b"\n\n", KNOWN)[1] == 0
    torn = stream({"d": '{"k":"' + TOKEN[:9]}, {"d": TOKEN[9:] + '"}'})
    assert events.stitched(torn, KNOWN) == (torn, 0)


def test_whole_at_depth_and_plain():
    raw = stream({"d": json.dumps({"in": TOKEN})}, f"plain {TOKEN}", {TOKEN: "__PII_custom_ffffffffffff__"}, end="\r\n\r\n")
    out, n = events.stitched(raw, KNOWN)
    lines = out.decode().split("\r\n\r\n")
    assert json.loads(json.loads(lines[0][6:])["d"])["in"] == SECRET and lines[1] == f"data: plain {SECRET}" and json.loads(lines[2][6:])[TOKEN] == "x" and n == 3


def test_too_much_to_hold(monkeypatch):
    monkeypatch.setattr(events, "MOST_HELD", 100)
    raw = stream({"d": "x" * 200 + TOKEN[:9]}, {"d": TOKEN[9:]})
    assert events.stitched(raw, KNOWN) == (raw, 0)


def test_streams(spark):
    minted = spark.createDataFrame([(TOKEN, SECRET)], "placeholder string, secret string")
    rows = [(1, stream({"d": TOKEN[:5]}, {"d": TOKEN[5:]})), (2, stream({"d": "none"})), (3, None)]
    got = {r["stream_id"]: (bytes(r["restored"]), r["n_restored"]) for r in events.restored_streams(spark.createDataFrame(rows, "stream_id int, body binary"), minted).collect()}
    assert got == {1: (stream({"d": ""}, {"d": SECRET}), 1), 2: (rows[1][1], 0), 3: (b"", 0)}
