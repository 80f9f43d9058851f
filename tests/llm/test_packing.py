"""Packing: what was cut and where it went, ids against the library, bins against plain sum-of-squares."""

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(sizes, limit):
    """Sum-of-squares from its definition: try every bin, and a new one."""
    fill: list[int] = []
    for n, size in enumerate(sizes):
        least = min(sizes[n + 1 :], default=limit)

        def squares(f, least=least):
            gaps = {}
            for x in f:
                if limit - x >= least:
                    gaps[limit - x] = gaps.get(limit - x, 0) + 1
            return sum(n * n for n in gaps.values())

        choices = {(squares([*fill[:b], f + size, *fill[b + 1 :]]), limit - f) for b, f in enumerate(fill) if f + size <= limit} | {(squares([*fill, size]), limit)}
        gap = min(choices)[1]
        if gap == limit:
            fill.append(size)
        else:
            fill[next(b for b, f in enumerate(fill) if limit - f == gap)] += size
    return sorted(fill)


def test_places_where_squares_are_smallest():
    rng = random.Random(3)
    for limit in (8, 20):
        sizes = [rng.randrange(1, limit) for _ in range(120)]
        _, offsets, fill = packing.placements(sizes, limit)
        assert sorted(fill) == plain(sizes, limit) and max(fill) <= limit
    assert len(packing.placements([700] * 300, 2048)[2]) == 150 and packing.placements([], 9) == ([], [], [])


def check(rows, docs, limit=2048):
    codec = Tokenizer.from_file(PATH)
    codec.no_truncation()
    codec.no_padding()
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r)
    ids = {i: [*codec.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    assert set(per) == set(ids)
    for i, own in per.items():
        own.sort(key=lambda r: r["piece"])
        whole = ids[i]
        sizes = [len(whole)] if len(whole) <= limit else [len(whole) % limit or limit] + [limit] * ((len(whole) - 1) // limit)
        assert [r["piece"] for r in own] == list(range(len(sizes))) and [r["length"] for r in own] == sizes
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(whole[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins), -(-sum(r["length"] for r in rows) // limit)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "straße", "мир", "12345", "x_y", "中", "…", "\n", "  "]
    return [(i, " ".join(rng.choices(words, k=int(rng.lognormvariate(5, 1.3))))) for i in range(n)]


def test_pieces_and_places(spark):
    docs = [*texts(1500), (5001, None), (5002, ""), (5003, "word " * 40_000), (5004, "<|endoftext|> x"), (5005, "x" * 9000), (None, "nameless")]
    # exactly the limit, and one more
    docs += [(6000, " a" * 2047), (6001, " a" * 2048), (6002, " a" * 4095)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("length", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("ids", F.lit(2))
    rows = packing.packed_pieces(df, PATH).collect()
    used, least = check(rows, docs)
    assert used <= least + 3


def test_levels_win_back_what_groups_cost(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(i, rng.randrange(1, 2049)) for i in range(6000)], "row long, length long")
    placed = packing.pack(rows, group=500).collect()
    fill = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    least = -(-sum(r["length"] for r in placed) // 2048)
    assert sorted(r["row"] for r in placed) == list(range(6000)) and max(fill.values()) <= 2048 and len(fill) <= 1.04 * least


def test_odd_tables(spark):
    assert packing.packed_pieces(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    twice = packing.packed_pieces(spark.createDataFrame([(1, "same"), (1, "same"), (None, None)], "doc_id long, text string"), PATH).collect()
    assert len(twice) == 3 and len({r["sequence_id"] for r in twice}) == 1 and sorted(r["offset"] for r in twice)[0] == 0
    # nothing fits beside anything
    wide = packing.pack(spark.createDataFrame([(i, 1500) for i in range(300)], "row long, length long"), group=50).collect()
    assert len({r["sequence_id"] for r in wide}) == 300


def test_sequences_hold_the_ids(spark):
    docs = texts(200, 4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    made = packing.sequences(df, PATH).collect()
    codec, seen = bpe.codec(PATH), {}
    for r in made:
        assert r["length"] == len(r["ids"]) // 4 == sum(d["length"] for d in r["documents"]) <= 2048
        for d in r["documents"]:
            seen[d["doc_id"], d["piece"]] = bytes(r["ids"][4 * d["offset"] : 4 * (d["offset"] + d["length"])])
    for (i, _), x in zip(docs, codec.encode_all([t for _, t in docs]), strict=True):
        assert b"".join(v for (k, _), v in sorted(seen.items()) if k == i) == x + bytes(4)
