"""Class-conditional Kneser-Ney models against a plain computation of the same formula."""

import math
import random
from collections import Counter

import pytest

from palisade.llm import toxicity

WORDS = [f"w{i}x" for i in range(60)] + ["é", "naïve", "Zo"]


def grams(text):
    folded = "".join(chr(c) for c in (text or "").encode())
    letters = "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in folded)
    padded = " " * 4 + "".join(c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " ") + " "
    return [padded[i : i + 5] for i in range(len(padded) - 4)]


def plain_scores(rows, texts, discount=toxicity.DISCOUNT, shared=toxicity.SHARED_WEIGHT, prior=toxicity.LENGTH_PRIOR):
    n = {c: Counter(g for t, toxic in rows if toxic == c for g in grams(t)) for c in (0, 1)}
    kinds = set(n[0]) | set(n[1])
    levels = {5: Counter(dict.fromkeys(kinds, 1))}
    for k in range(4, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def q(g):
        if not g:
            return 1 / 256
        own = levels[len(g)]
        seen = [c for h, c in own.items() if h[:-1] == g[:-1]]
        return (own[g] - discount + discount * len(seen) * q(g[1:])) / sum(seen)

    def ratio(g):
        ctx = [h for h in kinds if h[:4] == g[:4]]
        if not ctx:
            return 0.0
        weight, own = {}, {}
        for c in (0, 1):
            total = sum(n[c][h] for h in ctx)
            weight[c] = (discount * sum(n[c][h] > 0 for h in ctx) + shared) / (total + shared)
            own[c] = max(n[c][g] - discount, 0) / (total + shared)
        if g not in kinds:
            return math.log(weight[1] / weight[0])
        pooled = (n[0][g] + n[1][g] - discount + discount * len(ctx) * q(g[1:])) / sum(n[0][h] + n[1][h] for h in ctx)
        return math.log((own[1] + weight[1] * pooled) / (own[0] + weight[0] * pooled))

    memo = {}
    return [sum(memo.setdefault(g, ratio(g)) if g not in memo else memo[g] for g in grams(t)) / (len(grams(t)) + prior) for t in texts]


@pytest.mark.parametrize("bits", [((22, 20), (20, 18)), ((5, 3), (4, 2))])
def test_against_plain_kneser_ney(spark, monkeypatch, bits):
    monkeypatch.setattr(toxicity, "GRAM_BITS", bits[0])
    monkeypatch.setattr(toxicity, "CONTEXT_BITS", bits[1])
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(WORDS, k=12)) + (" nit-wit!" if toxic else ""), toxic) for toxic in [0, 1, 0, 0] * 4]
    texts = [*(t for t, _ in rows[:4]), "you nitwit", "quite other wörds, unseen", None, "", "12 34", " ".join(WORDS), rows[0][0]]
    model = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r["raw"] for r in toxicity.raw_scores(df, model, ["doc_id"]).orderBy("doc_id").collect()]
    assert got == pytest.approx(plain_scores(rows, texts), abs=2e-6)


def test_cases(spark):
    rows = [(i, ("you utter nitwit " if i % 3 == 0 else "") + " ".join(WORDS[i % 20 : i % 20 + 30]), "clash") for i in range(150)] + [(150, None, None), (None, "nitwit", ""), (3, "again", ""), (3, "again", "")]
    labels = [(i, int(i % 3 == 0)) for i in range(150)] + [(None, 1), (1, None), (3, 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, score string")
    got = toxicity.held_out_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 154 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 150]
    pairs = [(a["score"], b["score"]) for a in held for b in held if a["doc_id"] % 3 == 0 and b["doc_id"] % 3]
    assert sum(a > b for a, b in pairs) > 0.9 * len(pairs)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.held_out_scores(docs.where("false"), none).count() == 0
    assert {r["score"] for r in toxicity.held_out_scores(docs, none).collect()} == {0.0}
