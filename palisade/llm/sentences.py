"""Substring deduplication by sliding sentence spans.

A sentence ends with . ! or ? (also the ideographic ones) or at a line break; one of over
``LONG`` words is also cut after the word of smallest hash in each ``WINDOW`` adjacent
words, so that long unpunctuated passages fall into the same pieces wherever they stand,
but for WINDOW - 1 words at their ends. Every run of ``RUN`` consecutive pieces of at
least ``LEAST_WORDS`` words is hashed; one with a cut inside a sentence goes on until it
has ``LONG`` words, and one more such run ends at the end of each cut sentence. Runs are
joined over all documents, and the pieces covered by any but the first occurrence (by
doc_id, then position) of a run go. So of a shared passage without sentence ends, from
LONG + 4 * (WINDOW - 1) + 1 words on a run is always found. Characters of scripts written
without blanks (Han, kana, Thai, Lao, Khmer, Burmese) are words of their own.

Defined cases: a null or empty text has no sentences; fewer sentences than a run are one
run; A-Z fold and white space is not compared; rows with one doc_id count as one
doc_id are left as they are. Where rows share a doc_id, their texts are told apart by a
hash: equal texts count as one read again, so neither is the other's repeat, and of
different ones the text of lower hash comes first. Empty tables give no rows; very long
texts are cut whole, in a run of their own; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_map, flagged, fresh
from .staging import stage
from .textvec import _power_tables, mix, slices, utf8, words

RUN, LEAST_WORDS, LONG, WINDOW = 3, 12, 24, 6
_END = np.zeros(256, bool)
_END[[0x21, 0x2E, 0x3F]] = True
_WIDE_END = [int.from_bytes(c.encode()) for c in "。！？．｡"]


def unspaced(buf: np.ndarray) -> np.ndarray:
    """The borders of characters of scripts written without blanks."""
    high = np.flatnonzero(buf >= 0xE0)
    if not len(high):
        return high
    after = np.concatenate([buf, np.zeros(2, np.uint8)])
    lead, second, third = buf[high], after[high + 1], after[high + 2]
    three = ((lead >= 0xE3) & (lead <= 0xE9)) | ((lead == 0xEF) & ((second == 0xBC) | (second == 0xBD)))
    three |= (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB)  # Thai, Lao
    three |= (lead == 0xE1) & ((second == 0x80) | (second == 0x81) | ((second == 0x82) & (third < 0xA0)) | (second == 0x9E) | (second == 0x9F))  # Burmese, Khmer
    four = (lead == 0xF0) & (second >= 0xA0) & (second <= 0xB3)
    return np.concatenate([high[three], high[three] + 3, high[four], high[four] + 4])


def cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece hashes, their first bytes, their numbers of words, whether they end inside a sentence, and each row's first piece."""
    hashes, first, last, rows = words(buf, offsets, borders=unspaced(buf))
    n = len(hashes)
    if not n:
        nothing = np.zeros(0, np.int64)
        return hashes, nothing, nothing, np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    breaks = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    final = _END[buf[last - 1]]
    stops = np.flatnonzero((last - first == 3) & (buf[first] >= 0xE0))
    final[stops] |= np.isin(buf[first[stops]].astype(np.int32) << 16 | buf[first[stops] + 1].astype(np.int32) << 8 | buf[first[stops] + 2], _WIDE_END)
    final[:-1] |= breaks[first[1:]] > breaks[last[:-1]]
    final[rows[1:][rows[1:] > 0] - 1] = True
    ends = np.flatnonzero(final) + 1
    sizes = np.diff(np.concatenate([[0], ends]))
    room = np.repeat(ends, sizes) - np.arange(n)
    begin = np.flatnonzero(np.repeat(sizes > LONG, sizes) & (room >= WINDOW))
    least, where = hashes[begin], begin.copy()
    for j in range(1, WINDOW):
        lower = hashes[begin + j] <= least
        least, where = np.where(lower, hashes[begin + j], least), np.where(lower, begin + j, where)
    whole = final.copy()
    final[where] = True
    ends = np.flatnonzero(final) + 1
    starts = np.concatenate([[0], ends[:-1]])
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), first[starts], ends - starts, ~whole[ends - 1], np.searchsorted(starts, rows)


def runs(sizes: np.ndarray, inner: np.ndarray, rows: np.ndarray, run: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first piece and end piece of every run."""
    n = len(sizes)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    low, high = rows[:-1][row], rows[1:][row]
    total, cuts = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, inner))
    start = np.arange(n)
    end = np.minimum(start + run, high)
    end = np.where(cuts[end] > cuts[start], np.maximum(start + run, np.searchsorted(total, total[:-1] + LONG)), start + run)
    end = np.where(start == low, np.minimum(end, high), end)
    ok = end <= high
    # a cut sentence's last pieces
    final = np.flatnonzero(~inner[1:] & inner[:-1]) + 2
    back = np.minimum(np.searchsorted(total, total[final] - LONG, side="right") - 1, final - run)
    inside = back >= low[final - 1] if n else np.zeros(0, bool)
    pairs = np.unique(np.concatenate([np.stack([start[ok], end[ok]]), np.stack([back[inside], final[inside]])], axis=1), axis=1)
    pairs = pairs[:, total[pairs[1]] - total[pairs[0]] >= least_words]
    return row[pairs[0]], pairs[0], pairs[1]


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text) and text of the rows with both."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return plain.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), "text")


def sentence_runs(named: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """r, doc_id, h, at, till: every long enough run of pieces by hash and the indices of its first piece and of the one after it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, sizes, inner, rows = cut(*utf8(part.column("text")))
                row, start, end = runs(sizes, inner, rows, run, least_words)
                up, down = _power_tables(len(hashes) + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
                found = mix((sums[end] - sums[start]) * down[start])
                ids, texts = part.column("doc_id").to_numpy(), part.column("h").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(ids[row]), pa.array(texts[row]), *(pa.array((x - rows[:-1][row]).astype(np.int32)) for x in (start, end))], names=["r", "doc_id", "h", "at", "till"])

    return named.mapInArrow(make, "r long, doc_id long, h long, at int, till int")


def repeats(named: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, h, positions (at, till), first_doc_ids: where runs stand that stand earlier elsewhere, and where."""
    found = stage(sentence_runs(named, run, least_words), "runs")
    place = F.struct("doc_id", "h", "at")
    first = found.groupBy("r").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("r", "first")
    later = found.join(first, "r").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("h") != F.col("first.h")) | (F.col("at") != F.col("first.at")))
    return later.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("at", "till"))).alias("positions"), F.array_sort(F.collect_set("first.doc_id")).alias("first_doc_ids"))


def cleaned(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, h, first_doc_ids, n_sentences, n_removed, removed_words and the remaining text of every document with repeats, once for each text of a doc_id."""
    named = _named(docs)
    hits = stage(repeats(named, run, least_words), "repeats")
    maybe = flagged(named, bit_map(hits, "doc_id", "h"), [F.col("doc_id"), F.col("h")], "repeated").where("repeated").select("doc_id", "h", "text")
    rows = maybe.dropDuplicates(["doc_id", "h"]).join(hits, ["doc_id", "h"])
    kept = ["doc_id", "h", "first_doc_ids"]
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in ("n_sentences", "n_removed", "removed_words")), T.StructField("text", T.StringType())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offsets = utf8(part.column("text"))
                _, first, sizes, _, at = cut(buf, offsets)
                raw, out = buf.tobytes(), []
                for i, positions in enumerate(part.column("positions").to_pylist()):
                    a, b = at[i], at[i + 1]
                    gone = np.zeros(b - a + 1, np.int64)
                    for p in positions:
                        gone[p["at"]] += 1
                        gone[p["till"]] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    bounds = [*first[a:b].tolist(), int(offsets[i + 1])]
                    if b > a:
                        bounds[0] = int(offsets[i])
                    text = b"".join(raw[bounds[j] : bounds[j + 1]] for j in np.flatnonzero(~gone).tolist())
                    out.append((int(b - a), int(gone.sum()), int(sizes[a:b][gone].sum()), text.decode()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=schema.names)

    return rows.mapInArrow(strip, schema)


def remove_repeats(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated sentences removed from ``text``; every row and every other column stays. Only rows with repeats are shuffled."""
    flag, left, id, hashed = (fresh(x, docs.columns) for x in ("repeated", "left", "id", "hashed"))
    made = stage(cleaned(docs, run, least_words).select(F.col("doc_id").alias(id), F.col("h").alias(hashed), F.col("text").alias(left)), "cleaned")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = [F.col("doc_id").cast("long"), F.xxhash64("text")]
    marked = flagged(docs, bit_map(made, id, hashed), own, flag)
    hit = F.col(flag) & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    joined = marked.where(hit).join(made, (own[0] == F.col(id)) & (own[1] == F.col(hashed)), "left")
    changed = joined.select(*[F.coalesce(F.col(left), F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return marked.where(~hit).select(*columns).union(changed)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, first_doc_ids, n_sentences, n_removed, removed_words and text_sha256 of documents with repeats."""
    return cleaned(docs).select("doc_id", "first_doc_ids", "n_sentences", "n_removed", "removed_words", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
