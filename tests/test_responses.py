"""Buffered responses: the order of refusals, and rows that share keys, have none, or columns of any name."""

import gzip
import json
import zlib

from pyspark.sql import functions as F

from palisade.operators import detectors as d
from palisade.operators import responses, tokens

TOKEN, SECRET = "__PII_email_0123456789ab__", 'a"b@corp.com'
RULES = [d.keyword_rule("mild", ["fine"], action="warn", scope="both"), d.keyword_rule("halt", ["stop"], action="block", scope="response"), d.BUILTIN[1]]
BODY = json.dumps({"t": f"fine {TOKEN}"}).encode()
WANT = json.dumps({"t": f"fine {SECRET}"}).encode()


def run(spark, rows, **more):
    minted = spark.createDataFrame([(TOKEN, SECRET)], "placeholder string, secret string")
    df = spark.createDataFrame([(i, k, 200, b, e) for i, (k, b, e) in enumerate(rows)], "n int, id string, status int, body binary, content_encoding string")
    named = df.selectExpr("*", "'x' AS error", "'y' AS action", "1 AS leaves", "2 AS findings", "3 AS _key", "true AS refused")
    return responses.buffered(named, minted, "id", RULES, **more).select("id", "status", "body", "error", "rule_id", "warnings", "walk_skip", "n_restored")


def facts(r):
    return (r["id"], r["status"], bytes(r["body"]), r["error"], r["rule_id"], r["warnings"], r["walk_skip"], r["n_restored"])


def refusal(code, rule=None):
    return json.dumps({"error": code} | ({"rule_id": rule} if rule else {}), separators=(",", ":")).encode()


def test_every_end(spark):
    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(BODY) + raw.flush()
    rows = [("a", BODY, None), ("a", BODY, "identity"), (None, gzip.compress(BODY), "GZIP"), (None, deflated, "identity , deflate"), ("b", gzip.compress(deflated), "deflate, gzip"), ("c", BODY, ""), ("d", BODY, "br"), ("e", BODY, "gzip"), ("f", gzip.compress(BODY)[:-3], "gzip"),
            ("g", b'{"t":"stop"}', None), ("h", b'{"t":"\xff' + TOKEN.encode() + b'"}', None), ("i", f"stop {TOKEN}".encode(), None), ("j", None, None), ("k", b"x" * 300, "br"), ("l", gzip.compress(b'"' + b"y" * 5000 + b'"'), "gzip")]
    out = sorted(map(facts, run(spark, rows, cap=250).collect()), key=str)
    ok = (200, WANT, None, None, ["mild"], 0, 1)
    code = "undecodable_content_encoding"
    want = [("a", *ok), ("a", *ok), (None, *ok), (None, *ok), ("b", *ok), *((k, 502, refusal(code), code, None, [], 0, 0) for k in "cdefl"), ("g", 502, refusal("rule_blocked", "halt"), "rule_blocked", "halt", [], 0, 0),
            ("h", 200, b'{"t":"\xff' + SECRET.encode() + b'"}', None, None, [], 1, 1), ("i", 200, f"stop {SECRET}".encode(), None, None, [], 0, 1), ("j", 200, b"", None, None, [], 0, 0), ("k", 502, refusal("bad_gateway"), "bad_gateway", None, [], 0, 0)]
    assert out == sorted(want, key=str)


def test_no_rows(spark):
    assert run(spark, []).collect() == []


def test_redact_and_restore_shared_keys(spark):
    mails = ["ann@corp.com", "bo@corp.org"]
    texts = [f"first {mails[0]}", f"the second one {mails[1]} and {mails[0]}", "none", None, f"first {mails[0]}"]
    df = spark.createDataFrame([(k, t) for k, t in zip([1, 1, None, None, None], texts, strict=True)], "k int, text string").withColumn("_edits", F.lit("clash")).withColumn("_text", F.lit(1)).withColumn("_secrets", F.lit(2))
    found = d.with_findings(df, [d.BUILTIN[1]])
    minted = tokens.vault(found.select(F.explode("findings").alias("f")).select("f.*"), b"salt").cache()
    done = tokens.redact(found, b"salt", minted)
    assert done.columns[:5] == df.columns and {r["_edits"] for r in done.collect()} == {"clash"}
    back = tokens.restore(done, minted, "k")
    assert sorted(map(str, back.collect())) == sorted(f"Row(k={k}, restored={t!r}, n_restored={n})" for k, t, n in zip([1, 1, None, None, None], texts, [1, 2, 0, 0, 1], strict=True))
    # what is redacted holds nothing more to redact: a second run changes nothing
    again = tokens.redact(d.with_findings(done.select("k", F.col("redacted").alias("text")), [*d.BUILTIN, d.HIGH_ENTROPY]), b"salt")
    assert [r["applied"] for r in again.collect()] == [0] * 5 and {r["redacted"] for r in again.collect()} == {r["redacted"] for r in done.collect()}
