"""Benchmark decontamination against plain windows, on planted paraphrases and odd tables."""

import random

import numpy as np
import pytest

from palisade.llm import decontam

ITEM = "what is the capital of the small island state named after a volcano answer port marlin bay"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, hit int")


def bench_of(spark, items):
    return spark.createDataFrame(list(items), "item_id long, text string")


def test_cases(spark):
    filler = " ".join(f"w{i}x" for i in range(90))
    bench = bench_of(spark, [(7, ITEM), (8, None), (9, ""), (7, "an item of the same id with nine other words"), (None, ITEM.replace("capital", "harbour")), (5, ITEM)])
    texts = [filler + " " + ITEM.upper() + " " + filler, filler, None, "", "the capital of the state", "long words here " * 300_000 + ITEM, ITEM, ITEM]
    docs = docs_of(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(d, i) for d in (0, 5, 6, 7) for i in (7, None, 5)}
    nameless = spark.createDataFrame([(None, ITEM, "x", 1), (None, "clean", "x", 2), (None, None, "x", 3)], docs.schema)
    rows = docs.union(docs).union(nameless)
    kept = decontam.decontaminate(rows, bench).collect()
    assert sorted((r["doc_id"], r["hit"]) for r in kept if r["doc_id"] is None) == [(None, 2), (None, 3)]
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 1, 2, 2, 3, 3, 4, 4] and kept[0].__fields__ == rows.columns
    empty = docs.where("false")
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(docs, bench.where("false")).count() == 0 and decontam.decontaminate(empty, bench).count() == 0


@pytest.mark.parametrize("cosine", [-1.0, decontam.LEAST_COSINE])
@pytest.mark.parametrize("block_words", [decontam.BLOCK_WORDS, 1200])
def test_planted_paraphrases(spark, cosine, block_words):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"x{rng.randrange(4000)}"
    sizes, texts, want = (16, 40, 59, 100, 200), [], []
    items = [[rng.choice(common) if rng.random() < 0.4 else f"i{rng.randrange(10**6)}" for _ in range(n)] for n in sizes for _ in range(3)]
    for k, item in enumerate(items):
        free = list(range(len(item) - max(1, round(len(item) * decontam.ANSWER_SHARE))))
        for place in range(3):
            for kind in ("any", "rare", "common", "more"):
                n = int(0.4 * len(item))
                order = {"rare": lambda p: item[p] in common, "common": lambda p: item[p] not in common}.get(kind, lambda p: rng.random())
                swapped = set(sorted(free, key=order)[: n // 2 if kind == "more" else n])
                copy = [f"o{rng.randrange(10**6)}" if p in swapped else w for p, w in enumerate(item)]
                for _ in range(n // 2 if kind == "more" else 0):
                    copy.insert(rng.randrange(len(free)), word())
                around = [[word() for _ in range(n)] for n in (rng.randrange(150, 170) * (place > 0), rng.randrange(150, 170) * (place < 2))]
                want.append((len(texts), k))
                texts.append(" ".join(around[0] + copy + around[1]))
    clean = len(texts)
    texts += [" ".join(word() for _ in range(300)) for _ in range(60)]
    bench = bench_of(spark, ((k, " ".join(x)) for k, x in enumerate(items)))
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs_of(spark, texts), bench, least_cosine=cosine, block_words=block_words).collect())
    assert got == want and all(d < clean for d, _ in got)


def test_screen_loses_nothing():
    """Every window that may be accepted lies in a stretch that the inverted index gives."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(12)]
    items = [[rng.choice(common) if rng.random() < 0.5 else f"i{rng.randrange(60)}" for _ in range(rng.randrange(4, 70))] for _ in range(40)]
    bench = decontam.Benchmark([(k, " ".join(x)) for k, x in enumerate(items)], np.zeros(0, np.uint64))
    docs = []
    for _ in range(30):
        item = rng.choice(items)
        docs.append([rng.choice(common) for _ in range(rng.randrange(40))] + [w for w in item if rng.random() < 0.75] + [f"i{rng.randrange(60)}" for _ in range(rng.randrange(40))])
    flat, at = [], [0]
    for d in docs:
        hashes, *_ = decontam.tokens(*decontam.utf8(decontam.pa.array([" ".join(d)])))
        flat.append(bench.code(hashes))
        at.append(at[-1] + len(hashes))
    words, at = np.concatenate(flat), np.array(at)
    given = {}
    for d, k, a, b in decontam.stretches(bench, words, at):
        given.setdefault((d, k), []).append((a, b))
    found = 0
    for d in range(len(docs)):
        own = words[at[d] : at[d + 1]]
        for k, item in enumerate(bench.items):
            mask = {}
            for p, w in enumerate(item.tolist()):
                mask[w] = mask.get(w, 0) | 1 << p
            reach = int(bench.reach[k])
            for s in range(max(1, len(own) - reach + 1)):
                if decontam.lcs(mask, len(item), own[s : s + reach].tolist()) >= decontam.PARAPHRASE_COVERAGE * len(item):
                    found += 1
                    assert any(a - reach <= s and min(s + reach, len(own)) <= b + reach for a, b in given.get((d, k), []))
    assert found > 100
