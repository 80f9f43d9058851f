"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

Terms are adjacent word pairs (the words as they stand); a term's hash votes +1 or -1 on
each bit, with weight 2 from ``LONG`` bytes on and 1 below, as long pairs tell more.
A fingerprint has a set bit where the votes are positive: equal texts have equal ones.

The search cuts fingerprints into radius + 2 blocks and keeps a table for every two of
them: two fingerprints within the radius differ in at most ``radius`` blocks, so at least
one table holds them under the same key. Nothing is missed, whatever the radius. A pair is
taken from the first table that has it. The rows under a key are split into ``PARTS`` and
its queries into blocks of ``MOST_QUERIES``, so a key that many near copies share is no
task's alone; a bit map of the queries' keys keeps the other rows from being shuffled.

Defined cases: a null text counts as empty and a text without words has fingerprint 0;
rows with one doc_id are ordered by the hash of their text; a null doc_id comes first and
is no query of the search; an empty table gives no rows; a very long text is fingerprinted
whole, in a run of its own; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import has_bits, key_bits
from .staging import stage
from .textvec import map_rows, mix, shingles, slices, utf8, words

BITS = 256
RADIUS = 6  # production radius of the search: 28 tables
LONG = 9
PARTS, MOST_QUERIES = 64, 4096
_SEEDS = np.random.default_rng(11).integers(1, 2**63, BITS // 64, dtype=np.int64).astype(np.uint64)
_CHUNK = 1 << 13


def fingerprints(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of packed bits for each text."""
    hashes, first, last, rows = words(buf, offsets, fold=False)
    terms, at = shingles(hashes, rows, 2)
    n = len(rows) - 1
    votes = np.zeros((n, BITS), np.int64)
    counts = np.diff(at)
    start = np.repeat(rows[:-1] - at[:-1], counts) + np.arange(int(at[-1]))
    end = np.minimum(start + 1, np.repeat(rows[1:], counts) - 1)
    weight = np.where(last[end] - first[start] >= LONG, 2, 1).astype(np.uint64) if len(start) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), counts)
    for a in range(0, len(terms), _CHUNK):
        part = slice(a, a + _CHUNK)
        own = row[part]
        # eight byte counters to a 64-bit word: at most 127 terms of weight 2 fit
        cuts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1])]))
        long = np.concatenate([np.arange(c, e, 127) for c, e in zip(cuts, [*cuts[1:], len(own)], strict=True)])
        bits = np.unpackbits(mix(terms[part][:, None] ^ _SEEDS[None, :]).view(np.uint8), axis=1).view(np.uint64)
        summed = np.add.reduceat(bits * weight[part][:, None], long, axis=0).view(np.uint8)
        group = np.searchsorted(long, cuts)
        votes[own[cuts]] += np.add.reduceat(summed, group, axis=0, dtype=np.int64)
    total = np.bincount(row, weight.astype(np.float64), n).astype(np.int64)
    return np.packbits(2 * votes > total[:, None], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine, 0 to 1, of rows of fingerprints."""
    apart = np.bitwise_count(a ^ b).sum(axis=1)
    return np.where(apart == 0, 1.0, np.clip(np.cos(np.pi * apart / BITS), 0, 1))


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the hex fingerprint of every whole text; a column of that name is replaced."""

    def make(part: pa.RecordBatch):
        return ([x.tobytes().hex() for x in fingerprints(*utf8(part.column("s0")))],)

    return map_rows(df, [c for c in df.columns if c != name], [text], {name: T.StringType()}, make)


def _blocks(prints: np.ndarray, radius: int) -> np.ndarray:
    """radius + 2 blocks of each fingerprint's bits, as 64-bit hashes: equal blocks have equal ones."""
    edges = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    bits, out = np.unpackbits(prints, axis=1), np.zeros((len(prints), radius + 2), np.uint64)
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        padded = np.zeros((len(prints), -(-(b - a) // 64) * 64), np.uint8)
        padded[:, : b - a] = bits[:, a:b]
        for word in np.packbits(padded, axis=1).view(np.uint64).T:
            out[:, i] = mix(out[:, i] * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _keyed(df: DataFrame, radius: int, wanted: np.ndarray | None = None) -> DataFrame:
    """k, t and the columns of ``df``: each fingerprint ``fp`` under its key of every table, without the keys that ``wanted`` surely lacks."""
    names, pairs = df.columns, list(combinations(range(radius + 2), 2))
    sent = df.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                blocks = _blocks(_prints(part.column("fp")), radius)
                for t, (i, j) in enumerate(pairs):
                    k = mix(mix(blocks[:, i] + np.uint64(2 * t + 1)) ^ blocks[:, j])
                    rows = np.arange(len(k)) if sent is None else np.flatnonzero(has_bits(sent.value, k))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(k[rows].view(np.int64)), pa.array(np.full(len(rows), t, np.int32)), *(part.column(c).take(pa.array(rows)) for c in names)], names=["k", "t", *names])

    return df.mapInArrow(run, T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.IntegerType()), *df.schema.fields]))


def _met(queries: DataFrame, table: DataFrame, radius: int) -> DataFrame:
    """k, t, part, block, side, fp and the table's columns: under each key, blocks of queries (side 0) before parts of the table (side 1)."""
    asked = stage(_keyed(queries, radius), "queries")
    own = [c for c in table.columns if c != "fp"]
    held = stage(_keyed(table, radius, key_bits(asked, "k")).withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")), "table")
    many = asked.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MOST_QUERIES)
    blocks = F.coalesce(F.ceil(F.col("m") / MOST_QUERIES), F.lit(1))
    split = asked.join(many, "k", "left").select("k", "t", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"), "fp")
    placed = stage(split.join(held.select("k", "part").distinct(), "k"), "placed")
    right = held.join(placed.select("k", "part", "block").distinct(), ["k", "part"])
    left = placed.select("k", "t", "part", "block", F.lit(0).alias("side"), "fp", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in own])
    both = left.unionByName(right.select("k", "t", "part", "block", F.lit(1).alias("side"), "fp", *own))
    return both.repartition("k", "part", "block").sortWithinPartitions("k", "part", "block", "side")


def _close(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Queries, table rows, and (query, row, distance) of the pairs within ``radius`` that no table before this one has."""
    pairs = np.array(list(combinations(range(radius + 2), 2)))
    mark, queries = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        k, p, b, side, t = (batch.column(c).to_numpy() for c in ("k", "part", "block", "side", "t"))
        change = np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            if mark != (k[low], p[low], b[low]):
                mark, queries = (k[low], p[low], b[low]), []
            if side[low] == 0:
                queries.append(_prints(batch.column("fp").slice(low, high - low)))
                continue
            own = np.concatenate(queries) if queries else np.zeros((0, BITS // 8), np.uint8)
            step = max(1, (1 << 18) // max(len(own), 1))
            for at in range(low, high, step):
                part = batch.slice(at, min(step, high - at))
                prints = _prints(part.column("fp"))
                apart = np.bitwise_count(own.view(np.uint64)[:, None, :] ^ prints.view(np.uint64)[None, :, :]).sum(axis=2)
                q, r = np.nonzero(apart <= radius)
                same = np.cumsum(_blocks(own[q], radius) == _blocks(prints[r], radius), axis=1)
                first = np.stack([(same == 1).argmax(axis=1), (same == 2).argmax(axis=1)], axis=1)
                fits = (first == pairs[t[low]]).all(axis=1)
                yield own, part, q[fits], r[fits], apart[q[fits], r[fits]]


def within(queries: DataFrame, table: DataFrame, radius: int, name: str = "fingerprint") -> DataFrame:
    """query, found, distance: for every distinct fingerprint of ``queries`` all distinct ones of ``table`` within ``radius`` bits."""
    sides = [df.select(F.unhex(F.col(name)).alias("fp")).where("fp IS NOT NULL").distinct() for df in (queries, table)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part, q, r, apart in _close(batches, radius):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes().hex() for x in own[q]], pa.string()), pa.array([x.hex() for x in part.column("fp").take(pa.array(r)).to_pylist()], pa.string()), pa.array(apart.astype(np.int32))], names=["query", "found", "distance"])

    return _met(*sides, radius).mapInArrow(run, "query string, found string, distance int")


def counted_within(queries: DataFrame, table: DataFrame, radius: int, name: str = "fingerprint", key: str = "doc_id") -> DataFrame:
    """``name``, n_rows, first: for every distinct fingerprint of ``queries`` how many rows of ``table`` are within ``radius`` bits, and their smallest ``key``; pairs never leave the tasks."""
    asked = queries.select(F.unhex(F.col(name)).alias("fp")).where("fp IS NOT NULL").distinct()
    held = table.select(F.unhex(F.col(name)).alias("fp"), F.col(key).cast("long").alias("key")).where("fp IS NOT NULL").groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, tuple[int, int | None]] = {}

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1] for s in sums.values()], pa.int64())], names=["fp", "n", "first"])

        for own, part, q, r, _ in _close(batches, radius):
            n, first = part.column("n").to_numpy(), part.column("first").to_pylist()
            for i in np.unique(q).tolist():
                rows = r[q == i]
                ids = [x for x in (first[j] for j in rows.tolist()) if x is not None]
                total, least = sums.get(own[i].tobytes(), (0, None))
                sums[own[i].tobytes()] = (total + int(n[rows].sum()), min([*ids, *([least] if least is not None else [])], default=None))
            if len(sums) > 1 << 16:
                yield flushed()
                sums = {}
        yield flushed()

    made = _met(asked, held, radius).mapInArrow(run, "fp binary, n long, first long")
    return made.groupBy("fp").agg(F.sum("n").alias("n_rows"), F.min("first").alias("first")).select(F.lower(F.hex("fp")).alias(name), "n_rows", "first")


def neighbours(docs: DataFrame, radius: int = RADIUS, every: int = 100) -> DataFrame:
    """``next_to`` of every document, and for those whose doc_id ``every`` divides n_within and first_within: how many other documents have fingerprints within ``radius`` bits, and the smallest doc_id of those and itself."""
    made = stage(next_to(docs), "fingerprints")
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = counted_within(made.where(asks), made, radius)
    none = F.lit(None).cast("long")
    told = made.where(asks).join(found, "fingerprint").select(*made.columns, (F.col("n_rows") - 1).alias("n_within"), F.col("first").alias("first_within"))
    return told.union(made.where(~asks).select(*made.columns, none, none))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def next_to(docs: DataFrame, rows_a_part: int = 2000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprints and likenesses of each document and its successor by doc_id.

    Documents are dealt into ranges of doc_id; the first document of a range is also the
    last of the range before it, so each range is gone through once, in order, holding one
    document. Only the ranges' bounds reach the driver.
    """
    lowest = -(1 << 63)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(lowest))
    ids = plain.select(key.alias("id"))
    count = ids.count()
    parts = max(1, count // rows_a_part)
    marks = [int(x) for x in ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 else []
    cuts = np.unique(np.array(marks, np.int64))
    starts = np.sort(np.array([r["m"] for r in _ranges(ids, cuts).groupBy("part").agg(F.min("id").alias("m")).collect()], np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_of = batch.column("id").to_numpy()
            part = np.searchsorted(starts, id_of, side="right") - 1
            lead = np.flatnonzero(starts[part] == id_of)
            for rows, own, tail in ((np.arange(batch.num_rows), part, 0), (lead, (part[lead] - 1) % max(len(starts), 1), 1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), pa.array(np.full(len(rows), tail, np.int32)), *(batch.column(c).take(pa.array(rows)) for c in ("id", "doc_id", "text"))],
                    names=["part", "tail", "id", "doc_id", "text"])

    schema = "part int, tail int, id long, doc_id long, text string"
    dealt = plain.withColumn("id", key).mapInArrow(deal, schema)
    ordered = dealt.repartition("part").sortWithinPartitions("part", "tail", "id", F.xxhash64("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def emit(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        own, nexts = [t for _, t, _ in rows], [t for _, _, t in rows]
        # the next document is mostly the next row: only those that are not need a fingerprint of their own
        odd = [i for i in range(len(rows)) if i + 1 == len(rows) or nexts[i] is not own[i + 1]]
        mixed = [edited(t, n) for t, n in zip(own, nexts, strict=True)]
        made = []
        for texts in (own, mixed, [nexts[i] for i in odd]):
            column = pa.array(texts, pa.string())
            made.append(np.concatenate([fingerprints(*utf8(s.column(0))) for s in slices(pa.RecordBatch.from_arrays([column], names=["t"]), "t")]))
        f, e, other = made
        n = np.concatenate([f[1:], other[-1:]])
        n[odd] = other
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in mixed]),
            pa.array([x.tobytes().hex() for x in f]), pa.array([x.tobytes().hex() for x in e]), pa.array(likeness(f, e)), pa.array(likeness(f, n))], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int | None, str] | None = None
        ready: list[tuple[int | None, str, str]] = []
        size = 0
        for batch in batches:
            for p, tail, d, t in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
                if held is not None and held[0] == p:
                    ready.append((held[1], held[2], t))
                    size += len(t)
                held = None if tail else (p, d, t)
                if size > 1 << 20:
                    yield emit(ready)
                    ready, size = [], 0
        if ready:
            yield emit(ready)

    return ordered.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _ranges(ids: DataFrame, cuts: np.ndarray) -> DataFrame:
    """part, id: which range between ``cuts`` each id is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, b.column("id").to_numpy(), side="right")), b.column("id")], names=["part", "id"])

    return ids.mapInArrow(run, "part long, id long")
