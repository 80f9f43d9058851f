"""Sum-of-squares packing of token sequences.

A document's tokens, closed by an end id, are one piece, or pieces of the sequence length
where they are longer (the first may be shorter). Pieces are dealt to groups of bounded
size by the hash of their row. In a group they are placed one by one: with N(g) open bins
of residual gap g (open as long as some later piece fits), a piece goes to the gap, or to a new bin, that leaves the sum of N(g)^2
over all gaps smallest (ties: the smallest gap). Both the longest first and a shuffled
order are tried, and the one with fewer bins is kept. The least filled eighth of a group's
bins, and half as many with the shortest pieces, are opened again and their pieces go on
to the next level, where fewer groups meet, until all that is left fits into one group,
whose worst bins are opened and packed again a few times. So a level has at most a fifth
of the bins of the one before, no task holds more than a group, and what group borders
cost is won back.

Defined cases: a null text counts as empty, an empty text is one piece of the end id
alone; repeated rows, null ids and ties are rows of their own; an empty table gives no
rows; a very long text is coded whole; only the columns named are read, so others may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .staging import stage
from .textvec import slices

LIMIT, END_ID = 2048, 0
GROUP = 1 << 14
REOPENED = 8
LAST_ROUNDS, LAST_SHARES = 12, (8, 4, 16, 2)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NEVER = 1 << 60


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (packed 32-bit integers) of every piece of every document."""
    kind = docs.schema[id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                row, number, start, length, ids = [], [], [], [], []
                for i, coded in enumerate(codec(path).encode_all(part.column("text").to_pylist())):
                    raw = coded + end
                    size = len(raw) // 4
                    cuts = [0, *range(size % limit or limit, size + 1, limit)] if size > limit else [0, size]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(b - a)
                        ids.append(raw[4 * a : 4 * b])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once, with a number ``row`` of their own that stays."""
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), name)


def placements(sizes: list[int], limit: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, in this order, and the bins' fill: sum-of-squares over the bins that a later size may still go to."""
    count = np.zeros(limit + 1, np.int64)
    bins_of: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, fill = [], [], []
    later = np.minimum.accumulate(np.array([*sizes[1:], limit], np.int64)[::-1])[::-1].tolist() if sizes else []
    for size, least in zip(sizes, later, strict=True):
        before, after = count[size:], count[: limit + 1 - size]
        cost = np.where(before > 0, 2 * (after - before) + 2, _NEVER)
        cost[-1] = 2 * after[-1] + 1  # a new bin
        # a gap below all later sizes is closed and counts no more
        closed = np.where(before[:least] > 0, 1 - 2 * before[:least], _NEVER)
        cost[:least] = closed
        if limit - size < least:
            cost[-1] = 0
        gap = size + int(cost.argmin())
        if gap == limit:
            bin = len(fill)
            fill.append(0)
        else:
            bin = bins_of[gap].pop()
            count[gap] -= 1
        bins.append(bin)
        offsets.append(fill[bin])
        fill[bin] += size
        if gap - size >= least:
            count[gap - size] += 1
            bins_of[gap - size].append(bin)
        count[:least] = 0
    return bins, offsets, fill


def _placed(lengths: np.ndarray, rows: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the bins' fill: the longest first or in the order of hashed rows, whichever needs fewer bins."""
    best = None
    for order in (np.lexsort((rows, -lengths)), np.argsort(rows.astype(np.uint64) * _MIX, kind="stable")):
        bins, offsets, fill = placements(lengths[order].tolist(), limit)
        if best is None or len(fill) < len(best[2]):
            bin_of, offset_of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            bin_of[order], offset_of[order] = bins, offsets
            best = bin_of, offset_of, np.array(fill, np.int64)
    return best


def _opened(lengths: np.ndarray, bin_of: np.ndarray, fill: np.ndarray, share: int, limit: int) -> np.ndarray:
    """Which bins to open again: one in ``share``, the least filled, and half as many of those with the shortest pieces, to fill gaps with."""
    opened = np.zeros(len(fill), bool)
    worst = np.argsort(fill, kind="stable")[: len(fill) // share]
    opened[worst[fill[worst] < limit]] = True
    if opened.any():
        longest = np.zeros(len(fill), np.int64)
        np.maximum.at(longest, bin_of, lengths)
        longest[opened] = limit
        opened[np.argsort(longest, kind="stable")[: len(fill) // (2 * share)]] = True
    return opened


def _packed(lengths: np.ndarray, rows: np.ndarray, limit: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bin, or -1 where the bin is opened for the next level, and offset of each length; the last level opens bins itself while that saves any."""
    bin_of, offset_of, fill = _placed(lengths, rows, limit)
    if not last:
        bin_of[_opened(lengths, bin_of, fill, REOPENED, limit)[bin_of]] = -1
        return bin_of, offset_of
    for k in range(LAST_ROUNDS):
        opened = _opened(lengths, bin_of, fill, LAST_SHARES[k % len(LAST_SHARES)], limit)
        again = np.flatnonzero(opened[bin_of])
        if not len(again):
            continue
        new_bin, new_offset, new_fill = _placed(lengths[again], rows[again], limit)
        if len(new_fill) <= opened.sum():
            # closed up, so that bins are numbered from 0 without gaps
            number = np.cumsum(~opened) - 1
            bin_of = number[bin_of]
            bin_of[again], offset_of[again] = new_bin + (~opened).sum(), new_offset
            fill = np.concatenate([fill[~opened], new_fill])
    return bin_of, offset_of


def pack(rows: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """``rows`` (a unique long ``row``, a ``length`` of 1 to ``limit``, and any others) with sequence_id and offset.

    Numbers of sequences are unique, not consecutive. ``rows`` should be a written table (:func:`numbered`).
    """
    columns = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    done = [rows.where(F.col("length") == limit).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, level = rows.where(F.col("length") < limit), 0

    def at(level: int, last: bool):
        def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            lengths, own = (table.column(c).to_numpy() for c in ("length", "row"))
            bins, offsets = _packed(lengths, own, limit, last)
            sequence = np.where(bins < 0, -1, bins + (key[0].as_py() << 20) + (level << 56))
            return table.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

        return packed

    while True:
        groups = max(1, -(-rest.count() // group))
        dealt = rest.withColumn("_g", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))
        placed = stage(dealt.groupBy("_g").applyInArrow(at(level, groups == 1), f"{kinds}, sequence_id long, offset long"), f"packed-{level}")
        done.append(placed.where("sequence_id >= 0"))
        if groups == 1:
            break
        rest, level = placed.where("sequence_id < 0").select(*columns), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def sequences(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """sequence_id, length, ids and the documents (doc_id, piece, offset, length) of every packed sequence."""
    made = numbered(pieces(docs, path, limit, end_id, id, text), "pieces")
    placed = pack(made.select("row", "length"), limit).select("row", "sequence_id", "offset")
    parts = made.join(placed, "row").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return parts.select(
        "sequence_id", (F.octet_length(joined) / 4).cast("long").alias("length"), joined.alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("documents"))


def packed_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs``."""
    made = pieces(docs, path).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(numbered(made, "pieces")).drop("row")
