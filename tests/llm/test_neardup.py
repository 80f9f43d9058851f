"""Near duplicates and components against plain computation, large groups, odd tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from palisade.llm import graph, neardup

WORDS = [f"w{i}x" for i in range(400)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")


def near_texts():
    base = WORDS[:120]
    out = [" ".join(base), " ".join(base).upper(), None, "", "one", "ONE", "two words"]
    for k in range(30):
        out.append(" ".join(base[:k * 2] + [f"edit{k}"] + base[k * 2 + 1:]))
    out += [" ".join(WORDS[a : a + 60]) for a in range(120, 340, 7)]
    return out


def brute(texts, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    texts = near_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, texts), k, percent).collect()}
    assert got == brute(texts, k, percent)


def test_rows_that_stay(spark):
    rows = [(1, "a b c d e f", 7), (1, "a b c d e f", 8), (1, "z y x", 9), (2, "a b c d e f", 1), (None, "a b c d e f", 2), (None, None, 3), (4, None, 5), (4, "", 6), (5, "q", 1), (9, "z y x", 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _nth int")
    kept = neardup.keep_one(docs).collect()
    assert kept[0].__fields__ == docs.columns and sorted((str(r["doc_id"]), r["_nth"]) for r in kept) == [("1", 9), ("4", 6), ("5", 1), ("None", 2), ("None", 3)]
    # two texts of one doc_id tie their copies together
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 4: 4, 5: 5, 9: 1, None: None}
    clash = docs.selectExpr("doc_id", "text", "_nth AS n_shingles", "1 AS component_id", "2 AS sketch", "true AS kept", "4 AS suspect", "5 AS nth")
    assert neardup.keep_one(clash).columns == clash.columns and neardup.keep_one(clash).count() == 5
    empty = docs.where("false")
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_large_group_and_long_text(spark):
    rng = random.Random(2)
    base = [f"g{i}" for i in range(120)]
    long, texts = " ".join(f"l{i}" for i in range(300_000)), []
    for i in range(5000):
        copy = list(base)
        for p in rng.sample(range(120), 1 + i % 2):
            copy[p] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"o{rng.randrange(10**6)}" for _ in range(60)) for _ in range(300)] + [long, long + " end"]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    # copies with one edit lie within the threshold of each other; all others have some copy near
    assert sum(got[i] == got[0] for i in range(5000)) == 5000
    assert [got[i] for i in range(5000, 5300)] == list(range(5000, 5300)) and got[5301] == got[5300] == 5300


def test_registers_merge():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (300, 40))
    sketch = lambda x: neardup.registers(x, np.array([0]))
    assert (neardup.merge(sketch(a), sketch(b)) == sketch(np.concatenate([a, b]))).all() and (sketch(a) == sketch(np.concatenate([a, a[:50]]))).all()
    near = np.concatenate([a[30:], b])
    got = neardup.likely_jaccard(sketch(a), sketch(near), np.array([300]), np.array([310]))[0]
    assert abs(got - 270 / 340) < 0.12


@pytest.mark.parametrize("shape", ["random", "path", "star", "grid"])
def test_components(spark, monkeypatch, shape):
    monkeypatch.setattr(graph, "CHUNK", 16)
    rng = random.Random(shape)
    links = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "path": [(i, i + 1) for i in range(90)], "star": [(200, i) for i in range(100)],
             "grid": [(10 * a + b, 10 * c + d) for a in range(10) for b in range(10) for c, d in ((a, b + 1), (a + 1, b)) if c < 10 and d < 10]}[shape]
    rng.shuffle(links)
    forest = graph.Forest()
    for a, b in links:
        forest.union(a, b)
    nodes = {x for e in links if e[0] != e[1] for x in e}
    df = spark.createDataFrame([*links, (None, 3), (4, None), (5, 5)], "a long, b long").repartition(3)
    assert {r["id"]: r["component"] for r in graph.components(df).collect()} == {x: forest.root(x) for x in nodes}
    assert graph.components(df.where("false")).count() == 0
