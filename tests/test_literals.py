"""Many literals: the automaton against a search for each literal, and rules with many literals against rules with few."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.functions import automaton
from palisade.operators import detectors as d
from palisade.operators import requests
from palisade.plans.rules import compile_document
from palisade.sources import bodies


def plain(texts, owners, overlapping=False):
    out = []
    for row, text in enumerate(texts):
        raw = (text or "").encode()
        for literal, fold, owner in owners:
            hay, needle = (raw.translate(bytes(automaton.FOLD)), literal.translate(bytes(automaton.FOLD))) if fold else (raw, literal)
            at = hay.find(needle)
            while at >= 0:
                out.append((row, at, at + len(needle), owner))
                at = hay.find(needle, at + (1 if overlapping else len(needle)))
    return sorted(out)


@pytest.mark.parametrize("dense", [1 << 22, 0])
@pytest.mark.parametrize("chunk", [1024, 7])
def test_every_occurrence(monkeypatch, dense, chunk):
    monkeypatch.setattr(automaton, "DENSE", dense)
    monkeypatch.setattr(automaton, "CHUNK", chunk)
    monkeypatch.setattr(automaton, "BLOCK_BYTES", chunk * 11)
    rng = random.Random(dense + chunk)
    for letters in ("ab", "abAB", "aé\x00中 "):
        for _ in range(8):
            owners = tuple(("".join(rng.choices(letters, k=rng.randrange(1, 9))).encode(), rng.random() < 0.5, rng.randrange(5)) for _ in range(rng.randrange(1, 40)))
            texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(rng.randrange(1, 30))] + [None, "", "a" * 300]
            for overlapping in (False, True):
                found = automaton.Literals(owners).spans(pa.array(texts), overlapping)
                assert list(zip(*(x.tolist() for x in found), strict=True)) == plain(texts, owners, overlapping)


def test_no_literals_and_no_texts():
    assert [len(x) for x in automaton.Literals(()).spans(pa.array(["a"]))] == [0] * 4
    assert [len(x) for x in automaton.Literals(((b"a", False, 0),)).spans(pa.array([None, ""], pa.string()))] == [0] * 4
    cut = pa.array(["xx", "aXa", None, "a"]).slice(1, 3)
    assert [x.tolist() for x in automaton.Literals(((b"A", True, 3),)).spans(cut)] == [[0, 0, 2], [0, 2, 0], [1, 3, 1], [3, 3, 3]]


def test_a_pack_of_legal_size():
    rng = random.Random(1)
    owners = tuple((bytes(rng.choices(b"abcdefgh", k=250)) + b"%05d" % i, i % 2 == 0, i // 64) for i in range(256 * 64 // 16))
    text = b" ".join(o[0] for o in owners[:300:7]).decode()
    found = automaton.Literals(owners).spans(pa.array([text]))
    assert found[3].tolist() == [o[2] for o in owners[:300:7]]


def words(n):
    return [f"w{i:03d}x" for i in range(n)]


def test_rules_find_what_few_literals_find(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([*words(60), "W001X", "keep w002x on", "ann@corp.com", "ww000xx"], k=rng.randrange(30))) for _ in range(40)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("_places", F.lit("clash"))
    rules = [*d.BUILTIN, d.keyword_rule("a", words(30), action="warn", allow=("keep w002x", "w003x w")), d.keyword_rule("b", words(20), case_sensitive=True), d.blocklist_rule(words(8))]
    allowlist = ["ann@corp.com w", "w005x w005x"]
    many = d.with_findings(df, rules, allowlist=allowlist)
    assert "MapInArrow" in many._jdf.queryExecution().toString()
    got = {r["id"]: r["findings"] for r in many.collect()}
    rows = sorted(map(str, d.findings(df, rules, allowlist=allowlist).collect()))
    monkeypatch.setattr(d, "UNROLLED", 10_000)
    assert got == {r["id"]: r["findings"] for r in d.with_findings(df, rules, allowlist=allowlist).collect()}
    assert rows == sorted(map(str, d.findings(df, rules, allowlist=allowlist).collect())) and many.columns == [*df.columns, "findings"]


def test_rules_on_json_leaves(spark, monkeypatch):
    docs = [(1, '{"a": "w001x W002X", "b": ["w003x", {"c": "{\\"in\\": \\"w004x w004x\\"}"}], "password": "w005x"}'), (2, "no json"), (3, '{"a": "none"}'), (4, "[]"), (5, None)]
    walked = bodies.walked(spark.createDataFrame(docs, "id int, body string"))
    rules = [d.keyword_rule("a", words(30)), d.blocklist_rule(["w003x"])]
    many = requests.evaluated(walked, rules, sensitive=("password",), allowlist=["w001x"]).orderBy("id").collect()
    monkeypatch.setattr(d, "UNROLLED", 10_000)
    assert many == requests.evaluated(walked, rules, sensitive=("password",), allowlist=["w001x"]).orderBy("id").collect()
    assert [r["action"] for r in many] == ["block", "block", "allow", "allow", "block"]


def test_compiled_pack(spark):
    import json

    pack = compile_document(json.dumps({"schema_version": 1, "rules": [{"id": f"r{i}", "type": "keyword", "action": "warn", "keywords": words(64)[i::2]} for i in range(2)]}))
    got = d.findings(spark.createDataFrame([("W000x w001X w100x",)], "text string"), pack.rules).collect()
    assert [(r["start"], r["end"], r["rule_id"], r["value"]) for r in got] == [(0, 5, "r0", "W000x"), (6, 11, "r1", "w001X")]


def test_apart_by_definition():
    sizes = np.array([2, 3])
    start = np.array([0, 1, 2, 3, 0, 2, 3, 6])
    literal, row = np.array([0, 0, 0, 0, 1, 1, 1, 1]), np.zeros(8, int)
    assert automaton.apart(row, start, literal, sizes).tolist() == [True, False, True, False, True, False, True, True]
