"""Toxicity by class-conditional Kneser-Ney models.

Two byte 5-gram models, toxic and ordinary, are counted over all labelled texts in
Spark. Each discounts its own counts and backs off to one shared Kneser-Ney model, whose order 5 has the pooled
counts and whose orders 4 to 1 the pooled continuation counts, so that an expression
that one class has hardly seen is judged by what both have. A text's score is the mean
difference per byte of its two log-likelihoods, made a probability by an isotonic curve
fitted on labelled rows that the models have not counted.

Counts, continuation counts and backoff weights stay distributed and exact, and so does
every score. Tasks get two tables of fixed size (16 and 4 MB at any input) in which an
n-gram stands with its key; where two meet, the more frequent stays and the other tries
the second table. N-grams that found no room in either, and such contexts, are known by a
bit map; the few of each text that may be among them are looked up by a join. With a
shared backoff the ratio of an unseen 5-gram is that of its context's weights, and of an
unseen context 0.

Defined cases: a null or empty text scores the ratio 0; a document labelled more than
once is toxic if any label says so; null labels are none; without labels of both kinds
every score is the share of toxic labels (0 without labels); an empty table gives no
rows; equal texts get equal scores; very long texts are counted and scored whole, in a run
of their own; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_map, flagged, has_bits, key_bits
from .language import fold_of
from .staging import stage
from .textvec import map_rows, mix, slices, utf8

ORDER = 5
GRAM_BITS, CONTEXT_BITS, REST_BITS = (20, 18), (18, 16), 22
DISCOUNT = 0.75
SHARED_WEIGHT = 100.0
LENGTH_PRIOR = 100
BINS, SPAN = 4000, 2.0
_MERGE_AT = 4_000_000

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of each text's letters; and each row's first one.

    A-Z are folded, every other run of ASCII is one blank, and blanks stand before and
    after each text.
    """
    n, pad = len(offsets) - 1, ORDER - 1
    folded = _FOLD[buf]
    keep = folded != 0x20
    keep[1:] |= folded[:-1] != 0x20
    keep[offsets[:-1][offsets[:-1] < len(buf)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    lengths = np.diff(kept)
    starts = kept[:-1] + (pad + 1) * np.arange(n) + pad
    padded = np.full(kept[-1] + (pad + 1) * n, 0x20, np.uint8)
    padded[np.repeat(starts - kept[:-1], lengths) + np.arange(kept[-1])] = folded[keep]
    wide = padded.astype(np.int64)
    packed = np.zeros(max(len(padded) - pad, 0), np.int64)
    for j in range(ORDER):
        packed = (packed << 8) | wide[j : j + len(packed)]
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    return packed[np.repeat(starts - pad - first[:-1], lengths + 1) + np.arange(first[-1])], first


def _slot(x: np.ndarray, bits: int, level: int = 0) -> np.ndarray:
    return (mix(x.astype(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


def count_grams(labelled: DataFrame) -> DataFrame:
    """g, t, o: each 5-gram's count in toxic and in ordinary texts of (text, toxic) rows."""
    schema = "g long, t long, o long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            g, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return g, *(np.bincount(inverse, np.concatenate([x[k] for x in held]), len(g)).astype(np.int64) for k in (1, 2))

        for batch in batches:
            for part in slices(batch, "text"):
                packed, first = grams(*utf8(part.column("text")))
                toxic = np.repeat(np.array(part.column("toxic").to_pylist(), np.int64), np.diff(first))
                keyed, n = np.unique(packed << 1 | toxic, return_counts=True)
                is_toxic = (keyed & 1).astype(bool)
                held.append((keyed >> 1, np.where(is_toxic, n, 0), np.where(is_toxic, 0, n)))
                if sum(len(x[0]) for x in held) > _MERGE_AT:
                    held = [merged()]
                    if len(held[0][0]) > _MERGE_AT // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["g", "t", "o"])
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["g", "t", "o"])

    return labelled.select("text", "toxic").mapInArrow(run, schema).groupBy("g").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def shared_backoff(counts: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """g, q: pooled Kneser-Ney probability of the last byte of every 4-gram, from continuation counts."""
    level = counts.select("g")
    levels = []
    for n in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.col("g").bitwiseAND((1 << 8 * n) - 1).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        levels.append(level)
        level = level.select("g")
    q = None
    for n, level in zip(range(1, ORDER), reversed(levels), strict=True):
        context = F.shiftright("g", 8)
        totals = level.groupBy(context.alias("x")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = level.withColumn("x", context).join(totals, "x")
        if q is None:
            below = F.lit(1 / 256)
        else:
            rows = rows.withColumn("y", F.col("g").bitwiseAND((1 << 8 * (n - 1)) - 1)).join(q.select(F.col("g").alias("y"), F.col("q").alias("below")), "y")
            below = F.col("below")
        q = rows.select("g", ((F.col("c") - discount + discount * F.col("kinds") * below) / F.col("total")).alias("q"))
    return q


class Table:
    """Ratios of keys that have room in arrays of fixed size, and which other keys there may be."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray):
        self.levels, self.rest = levels, rest

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys' ratios (not a number where there is none here) and whether the rest may have them."""
        out = np.full(len(keys), np.nan)
        left = np.arange(len(keys))
        for level, (own, ratio) in enumerate(self.levels):
            at = _slot(keys[left], len(own).bit_length() - 1, level)
            same = own[at] == keys[left]
            out[left[same]] = ratio[at[same]]
            left = left[~same]
        maybe = np.zeros(len(keys), bool)
        maybe[left] = has_bits(self.rest, _slot(keys[left], 64, len(self.levels)))
        return out, maybe


class Ratios:
    """Log ratios of 5-grams and of contexts' backoff weights: tables for the tasks, frames (g, r) and (x, w) for the rest."""

    def __init__(self, gram: Table, context: Table, grams: DataFrame, contexts: DataFrame):
        self.tables, self.grams, self.contexts = (gram, context), grams, contexts


def sums(tables: tuple[Table, Table], buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Each text's summed ratios and number of 5-grams, and the (5-gram, count) rows that only the whole tables can tell."""
    gram, context = tables
    packed, first = grams(buf, offsets)
    found, opened = gram.find(packed)
    unseen = np.flatnonzero(np.isnan(found) & ~opened)
    found[unseen], more = context.find(packed[unseen] >> 8)
    opened[unseen] = more
    opened &= np.isnan(found)
    found[np.isnan(found)] = 0.0
    row = np.searchsorted(first, np.flatnonzero(opened), side="right") - 1
    late: list[list[tuple[int, int]]] = [[] for _ in range(len(first) - 1)]
    for r in np.unique(row).tolist():
        late[r] = list(zip(*(x.tolist() for x in np.unique(packed[np.flatnonzero(opened)[row == r]], return_counts=True)), strict=True))
    return np.add.reduceat(found, first[:-1]) if len(first) > 1 else np.zeros(0), np.diff(first), late


def train(labelled: DataFrame, discount: float = DISCOUNT, shared: float = SHARED_WEIGHT) -> Ratios:
    """Ratios of all (text, toxic) rows."""
    counts = stage(count_grams(labelled), "grams")
    context = F.shiftright("g", 8)
    by_context = counts.groupBy(context.alias("x")).agg(
        *[F.sum(c).alias(f"n_{c}") for c in "to"], *[F.count_if(F.col(c) > 0).alias(f"k_{c}") for c in "to"], F.count(F.lit(1)).alias("kinds"))
    total, kinds = F.col("n_t") + F.col("n_o"), F.col("kinds")
    # beside what discounting frees, every context gives a fixed weight to the pooled model
    weight = {c: (discount * F.col(f"k_{c}") + shared) / (F.col(f"n_{c}") + shared) for c in "to"}
    own = {c: F.greatest(F.col(c) - discount, F.lit(0.0)) / (F.col(f"n_{c}") + shared) for c in "to"}
    rows = counts.withColumn("x", context).withColumn("y", F.col("g").bitwiseAND((1 << 8 * (ORDER - 1)) - 1))
    rows = rows.join(by_context, "x").join(shared_backoff(counts, discount).select(F.col("g").alias("y"), "q"), "y")
    pooled = (F.col("t") + F.col("o") - discount + discount * kinds * F.col("q")) / total
    ratio = F.log(own["t"] + weight["t"] * pooled) - F.log(own["o"] + weight["o"] * pooled)
    every = stage(rows.select("g", ratio.alias("r"), (F.col("t") + F.col("o")).alias("n")), "ratios")
    contexts = stage(by_context.select(F.col("x").alias("g"), (F.log(weight["t"]) - F.log(weight["o"])).alias("r"), (F.col("n_t") + F.col("n_o")).alias("n")), "contexts")
    return Ratios(_table(every, GRAM_BITS), _table(contexts, CONTEXT_BITS), every.select("g", "r"), contexts.select(F.col("g").alias("x"), F.col("r").alias("w")))


def _table(rows: DataFrame, bits: tuple[int, ...]) -> Table:
    """(g, r, n) rows as arrays of 2**bits slots; at most one row a slot, and the words of a bit map, reach the driver."""

    def slotted(left: DataFrame, size: int, level: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_slot(b.column("g").to_numpy(), size, level)), *b.columns], names=["s", "g", "r", "n"])

        return left.select("g", "r", "n").mapInArrow(run, "s long, g long, r double, n long")

    levels = []
    for level, size in enumerate(bits):
        placed = slotted(rows, size, level)
        best = stage(placed.groupBy("s").agg(F.max(F.struct("n", "g", "r")).alias("b")).select("s", "b.g", "b.r"), "slots")
        found = best.toArrow()
        own, ratio = np.full(1 << size, -1, np.int64), np.zeros(1 << size, np.float32)
        own[found.column("s").to_numpy()], ratio[found.column("s").to_numpy()] = found.column("g").to_numpy(), found.column("r").to_numpy()
        levels.append((own, ratio))
        rows = stage(rows.join(best.select("g"), "g", "left_anti"), "rest")
    return Table(levels, key_bits(slotted(rows, 64, len(bits)), "s", REST_BITS))


def raw_scores(df: DataFrame, model: Ratios, keep: list[str], text: str = "text", prior: int = LENGTH_PRIOR) -> DataFrame:
    """The ``keep`` columns and ``raw``, the mean difference per byte of every whole text, as if ``prior`` bytes without any stood before it."""
    shared = df.sparkSession.sparkContext.broadcast(model.tables)
    kind = T.ArrayType(T.StructType([T.StructField("g", T.LongType()), T.StructField("n", T.LongType())]))

    def make(part: pa.RecordBatch):
        buf, offsets = utf8(part.column("s0"))
        total, size, late = sums(shared.value, buf, offsets)
        names = [hashlib.blake2b(buf[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest() if x else None for i, x in enumerate(late)]
        return total, size, names, [[{"g": g, "n": n} for g, n in x] if x else None for x in late]

    made = stage(map_rows(df, keep, [text], {"_sum": T.DoubleType(), "_size": T.LongType(), "_name": T.BinaryType(), "_late": kind}, make), "sums")
    # equal texts are looked up once; an n-gram has one row a text at most
    asked = made.where("_name IS NOT NULL").groupBy("_name").agg(F.first("_late").alias("late")).select("_name", F.explode("late").alias("l")).select("_name", "l.g", "l.n")
    told = asked.join(model.grams, "g", "left").withColumn("x", F.shiftright("g", 8)).join(model.contexts, "x", "left")
    more = told.groupBy("_name").agg(F.sum(F.col("n") * F.coalesce("r", "w", F.lit(0.0))).alias("_more"))
    kept = [F.col(f"`{k}`") for k in keep]
    late = made.where("_name IS NOT NULL").join(more, "_name").select(*kept, ((F.col("_sum") + F.col("_more")) / (F.col("_size") + prior)).alias("raw"))
    return made.where("_name IS NULL").select(*kept, (F.col("_sum") / (F.col("_size") + prior)).alias("raw")).union(late)


class Curve:
    """Isotonic share of toxic rows over binned scores, with a slight slope to keep their order."""

    def __init__(self, bins: list[tuple[int, int, int]]):
        toxic = sum(t for _, t, _ in bins)
        rows = sum(t + o for _, t, o in bins)
        self.share = toxic / rows if rows else 0.0
        pools: list[list[float]] = []
        for b, t, o in sorted(bins):
            pools.append([b, t, t + o])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, t2, n2 = pools.pop()
                pools[-1][1] += t2
                pools[-1][2] += n2
        self.from_bin = np.array([p[0] for p in pools])
        self.height = np.array([(p[1] + self.share) / (p[2] + 1) for p in pools])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.from_bin):
            return np.full(len(raw), self.share)
        at = np.searchsorted(self.from_bin, np.clip(raw, -SPAN, SPAN) * (BINS / SPAN), side="right") - 1
        return 0.99 * self.height[np.maximum(at, 0)] + 0.01 / (1 + np.exp(-np.clip(10 * raw, -30, 30)))


def held_out_scores(docs: DataFrame, labels: DataFrame, held_fold: int = 0, curve_fold: int = 4, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels of ``held_fold`` are never read; those of ``curve_fold`` fit the curve only.
    """
    docs, labels = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    fold = fold_of("doc_id", folds)
    known = labels.where((fold != held_fold) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = stage(known.where("doc_id IS NOT NULL"), "known")
    # only labelled texts are shuffled, and by the same plan at any size
    texts = flagged(docs.where((fold != held_fold) & (fold != curve_fold) & (F.length("text") > 0)).select("doc_id", "text"), bit_map(known, "doc_id"), [F.col("doc_id")], "labelled")
    counted = texts.where("labelled").join(known.hint("merge"), "doc_id").select("text", "toxic")
    model = train(counted)
    raw = stage(raw_scores(docs.select("doc_id", "text"), model, ["doc_id"]), "raw")
    tuned = raw.where(fold == curve_fold).join(known, "doc_id")
    place = F.round(F.least(F.greatest(F.col("raw"), F.lit(-SPAN)), F.lit(SPAN)) * (BINS / SPAN)).cast("int")
    bins = tuned.groupBy(place.alias("b")).agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("o")).collect()
    fitted = Curve([(r["b"], r["t"], r["o"]) for r in bins])
    held = F.coalesce(fold == held_fold, F.lit(False))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = fitted(b.column("raw").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return raw.select("doc_id", held.alias("held_out"), "raw").mapInArrow(scored, T.StructType([raw.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
