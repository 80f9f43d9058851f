"""SimHash fingerprints and the permuted block tables against plain computation."""

import hashlib
import random

import numpy as np
import pytest

from palisade.llm import simhash


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")


def apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_next_to(spark):
    texts = ["a b c d e f g", None, "a b c d e f g", "éü " * 5, "", "long words here " * 200_000]
    got = {r["doc_id"]: r for r in simhash.next_to(docs_of(spark, [(i, t, "clash") for i, t in enumerate(texts)]), rows_a_part=2).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        want = simhash.edited(t, plain[(i + 1) % len(plain)])
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[0]["fingerprint"] == got[2]["fingerprint"] and got[1]["fingerprint"] == "0" * (simhash.BITS // 4)
    assert simhash.next_to(docs_of(spark, [])).count() == 0 and simhash.neighbours(docs_of(spark, [])).count() == 0


def prints(n, seed=3):
    rng = random.Random(seed)
    base = [rng.getrandbits(simhash.BITS) for _ in range(6)]
    made = []
    for _ in range(n):
        x = rng.choice(base)
        for b in rng.sample(range(simhash.BITS), rng.randrange(12)):
            x ^= 1 << b
        made.append(x.to_bytes(simhash.BITS // 8).hex())
    return [*made, *made[:5], None]


@pytest.mark.parametrize("radius", [0, 1, 6, 9])
def test_within_against_brute_force(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "MOST_QUERIES", 3)
    rows = [(i, None, p) for i, p in enumerate(prints(150))]
    table, queries = docs_of(spark, rows).repartition(3), docs_of(spark, rows[::4])
    known = {p for _, _, p in rows if p}
    got = simhash.within(queries, table, radius).collect()
    assert sorted(map(tuple, got)) == sorted((q, p, apart(q, p)) for q in {p for _, _, p in rows[::4] if p} for p in known if apart(q, p) <= radius)
    counted = {r["fingerprint"]: (r["n_rows"], r["first"]) for r in simhash.counted_within(queries, table, radius).collect()}
    near = {q: [i for i, _, p in rows if p and apart(q, p) <= radius] for _, _, q in rows[::4] if q}
    assert counted == {q: (len(x), min(x)) for q, x in near.items()}


def test_neighbours(spark):
    rng = random.Random(1)
    base = " ".join(f"word{rng.randrange(500)}" for _ in range(900))
    rows = [(50 * i, base + f" tail{i}" if i % 3 else f"other text number {i} " * 9, None) for i in range(20)] + [(100, "", None), (None, base, None)]
    got = simhash.neighbours(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None or r["doc_id"] % 100:
            assert r["n_within"] is None and r["first_within"] is None
        else:
            near = [x["doc_id"] for x in got if apart(r["fingerprint"], x["fingerprint"]) <= simhash.RADIUS]
            assert r["n_within"] == len(near) - 1 and r["first_within"] == min(x for x in near if x is not None)
    assert any(r["n_within"] for r in got)


def test_votes(spark):
    buf = np.frombuffer(b"one two three one two three", np.uint8)
    a, b = (simhash.fingerprints(buf[:n], np.array([0, n])) for n in (len(buf), 13))
    assert a.shape == b.shape == (1, simhash.BITS // 8) and simhash.likeness(a, a)[0] == 1.0 and 0 <= simhash.likeness(a, b)[0] < 1
