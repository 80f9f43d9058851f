"""Repeated sentences against a plain search, on odd tables and unpunctuated passages."""

import random
from collections import defaultdict

import numpy as np
import pytest

from palisade.llm import sentences
from palisade.llm.textvec import utf8


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], "doc_id long, text string, h string, repeated int")


def test_sentences(spark):
    passage = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen. "
    texts = ["Alpha beta. " + passage + "Gamma.", "Delta. " + passage + "Epsilon zeta.", None, "", "No repeats here."]
    got = {r["doc_id"]: r for r in sentences.cleaned(docs_of(spark, texts)).collect()}
    assert set(got) == {1} and got[1]["first_doc_ids"] == [0] and got[1]["text"] == "Delta. Epsilon zeta." and got[1]["n_removed"] == 3


@pytest.mark.parametrize("joint", [" ", ""])
def test_sentences_without_ends(spark, joint):
    rng = random.Random(3)
    word = (lambda: f"v{rng.randrange(10**6)}") if joint else (lambda: chr(rng.randrange(0x4E00, 0x9FA0)))
    texts, planted = [], []
    for _ in range(150):
        passage = [word() for _ in range(51)]
        planted.append(passage)
        for _ in range(2):
            texts.append(joint.join([word() for _ in range(rng.randrange(30, 60))] + passage + [word() for _ in range(rng.randrange(30, 60))]))
    texts += [joint.join(["0"] * 120) for _ in range(2)]
    got = {r["doc_id"]: r for r in sentences.cleaned(docs_of(spark, texts)).collect()}
    assert {d for d in got if d < 300} == set(range(1, 300, 2)) and (not joint or 301 in got)
    for k, passage in enumerate(planted):
        r = got[2 * k + 1]
        assert r["first_doc_ids"] == [2 * k] and 24 <= r["removed_words"] <= 51 and joint.join(passage[15:35]) not in r["text"]
        assert r["text"].startswith(texts[2 * k + 1][: 30 if joint else 10])


def plain(rows, run=sentences.RUN, least=sentences.LEAST_WORDS):
    """The sentences of each (doc_id, text) row that a run with an earlier first occurrence covers; no sentence is long here."""
    parts = {k: [p for p in t.split("|") if p] for k, t in rows}
    where = defaultdict(list)
    for k, own in sorted(parts.items()):
        for i in range(len(own) if len(own) >= run or not own else 1):
            part = own[i : i + run]
            if (len(part) == run or i == 0) and sum(len(p.split()) for p in part) >= least:
                where[" ".join(part).lower()].append((k, i, i + len(part)))
    gone = defaultdict(set)
    for found in where.values():
        for k, a, b in found[1:]:
            gone[k] |= set(range(a, b))
    return {k: [p for i, p in enumerate(parts[k]) if i not in v] for k, v in gone.items()}


def test_against_plain_search(spark):
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(2, 8))) + "." for _ in range(40)]
    rows = [(i, "|".join(pool[rng.randrange(40)] for _ in range(rng.randrange(8))) if i % 5 else "|".join(pool[a : a + 6])) for i in range(120) for a in [rng.randrange(34)]]
    rows += [(200, "|".join(pool[:2])), (201, "|".join(pool[:2]))]
    df = spark.createDataFrame([(i, t.replace("|", " ")) for i, t in rows], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"].split(". ") for r in sentences.cleaned(df).collect()}
    want = plain(rows)
    assert len(want) > 10 and {k: [p.strip().rstrip(".") for p in v if p.strip()] for k, v in got.items()} == {k: [p.rstrip(".") for p in v] for k, v in want.items()}


def test_rows_that_share_an_id(spark):
    passage = "One two three four five six. Seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen. "
    rows = [(2, "Head. " + passage, 1), (2, "A quite different text, that nobody else has. Not at all.", 2), (1, passage, 3), (2, "Head. " + passage, 4), (None, passage, 5), (3, None, 6), (4, "", 7)]
    df = spark.createDataFrame(rows, "doc_id int, text string, left int")
    got = {r["left"]: r["text"] for r in sentences.remove_repeats(df).collect()}
    assert got == {1: "Head. ", 2: rows[1][1], 3: passage, 4: "Head. ", 5: passage, 6: None, 7: ""}
    named = df.selectExpr("*", "'a' AS _id", "'b' AS id", "'c' AS hashed", "'d' AS _h", "1 AS repeated")
    assert {r["left"]: r["text"] for r in sentences.remove_repeats(named).collect()} == got and sentences.remove_repeats(named).columns == named.columns
    assert [(r["doc_id"], r["first_doc_ids"]) for r in sentences.report(df).collect()] == [(2, [1])]
    empty = df.where("false")
    assert sentences.report(empty).count() == 0 and sentences.remove_repeats(empty).count() == 0


def test_long_text(spark):
    text = "Some words that repeat in every sentence of the text number %d. "
    long = "".join(text % i for i in range(60_000))
    got = {r["doc_id"]: r for r in sentences.cleaned(docs_of(spark, [long, "Start. " + text % 7 + text % 8 + text % 9 + "End."])).collect()}
    assert got[1]["text"] == "Start. End." and set(got) == {1}
    assert len(sentences.cut(*utf8(__import__("pyarrow").array([""])))[0]) == 0 and isinstance(sentences.unspaced(np.zeros(0, np.uint8)), np.ndarray)
