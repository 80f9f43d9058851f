"""Rules in Python under guard: what they give, how they fail, and that one failure refuses the whole text."""

import time

import pytest
from pyspark.sql import functions as F

from palisade.operators import detectors as d
from palisade.operators import policy, requests
from palisade.sources import bodies


def boom(text):
    yield (0, 1)
    raise ValueError(text)


CASES = [
    (lambda t: [(0, 1), (1, len(t))], ([(0, 1), (1, 5)], None)), (lambda t: (), ([], None)), (lambda t: None, ([], d.ERROR)), (boom, ([], d.PANIC)), (lambda t: 1 / 0, ([], d.PANIC)), (lambda t: 7, ([], d.PANIC)),
    (lambda t: [(0, 1)] * d.MOST_SPANS, ([(0, 1)] * d.MOST_SPANS, None)), (lambda t: [(0, 1)] * (d.MOST_SPANS + 1), ([], d.BUDGET)), (lambda t: iter(lambda: (0, 1), None), ([], d.BUDGET)),
    *((lambda t, x=x: [(0, 1), x], ([], d.MALFORMED)) for x in ((1, 1), (2, 1), (-1, 2), (0, 6), (0.0, 1), (True, 2), (0,), [0, 1], "ab", None, (0, 3))),
]


@pytest.mark.parametrize(("rule", "want"), CASES)
def test_guard(rule, want):
    assert d.guarded(d.python_rule("r", rule), "héyx".encode()) == want if want[1] != d.MALFORMED else d.guarded(d.python_rule("r", rule), "hhé!".encode())[1] == d.MALFORMED


def test_a_slow_call_fails_afterwards():
    assert d.guarded(d.python_rule("r", lambda t: time.sleep(0.05) or [(0, 1)]), b"abc", seconds=0.01) == ([], d.TIMEOUT)


def test_findings_and_failures(spark):
    rules = [d.python_rule("upper", lambda t: [(i, i + 1) for i in range(len(t)) if 65 <= t[i] < 91], action="redact"), d.python_rule("later", lambda t: 1 / 0 if b"bad" in t else [(0, 1)], action="warn", priority=200), d.python_rule("never", lambda t: None, action="block", scope="response"), d.BUILTIN[1]]
    texts = ["aBc", "bad X ann@corp.com", "", None, "éÀ"]
    rows = policy.decided(d.with_findings(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), rules, allowlist=["B"])).orderBy("id").collect()
    assert [(r["action"], r["refusal"], r["rule_ids"]) for r in rows] == [("warn", None, ["later"]), ("block", "panic", []), ("allow", None, []), ("allow", None, []), ("block", "malformed", [])]
    found = d.findings(spark.createDataFrame([("xA",)], "text string"), rules).collect()
    assert sorted((r["start"], r["end"], r["rule_id"], r["value"], r["origin"]) for r in found) == [(0, 1, "later", "x", "plugin"), (1, 2, "upper", "A", "plugin")]
    with pytest.raises(ValueError, match="places"):
        d.found(F.col("text"), rules)


def test_on_json(spark):
    rules = [d.python_rule("q", lambda t: [(0, 1)] if t.startswith(b"q") else None if t == b"no" else [], action="redact")]
    docs = [(1, '{"a": "qx", "b": "{\\"c\\": \\"qy\\"}"}'), (2, '["fine", "no"]'), (3, '["fine"]')]
    made = requests.evaluated(bodies.walked(spark.createDataFrame(docs, "id int, body string")), rules).orderBy("id")
    assert [(r["action"], r["refusal"], [(f["leaf_index"], f["value"]) for f in r["backing"]]) for r in made.collect()] == [("redact", None, [(0, "q"), (1, "q")]), ("block", "error", []), ("allow", None, [])]
    assert policy.refusals(made, "id").head()["body"] == '{"error":"plugin_failure","reason":"error"}'
