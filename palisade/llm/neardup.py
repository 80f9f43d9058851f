"""Near-duplicate documents by SetSketch registers.

A document is its set of distinct k-word shingles. Register i of its sketch is the
truncated, exponentially spaced minimum of the elements' i-th exponential hashes, so
sketches merge by maxima and equal registers tell of common elements. Equal sets are
one node from the start. Bands of registers find candidates, the joint likelihood of
the registers' order relations estimates their similarity, and what may reach the
threshold is verified on the full sets.

Buckets are never expanded into pairs. First every set meets one other, the smallest id
in any of its buckets: what is verified is a forest, so n near copies make n links. Then
the members of buckets that still hold several components meet the bucket's smallest id.
Buckets mixed even then are gone through in blocks inside tasks: what registers let be
linked across components makes clusters, and the texts of a cluster meet in blocks, where
the pairs across components are verified and only links leave. Links inside a component
cannot change it, so nothing is lost but what no band finds: with 32 bands of 4, less
than 1e-10 of pairs at a similarity of 0.85, 5e-8 at 0.8. Texts that are alike but not
near enough to be linked (a cluster of m components) cost m * m comparisons of registers,
spread over blocks.

Defined cases: a null or empty text has no shingles and is linked with nothing; fewer
words than k are one shingle, the whole sequence; rows with one doc_id are one node;
a row with a null doc_id is linked with nothing, its component is null and it is kept.
Very long texts are hashed whole, in a run of their own. Other columns, whatever their
names, are not looked at; ``keep_one`` returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_map, flagged, fresh
from .graph import Forest, components, flattened
from .staging import stage
from .textvec import give_back, map_rows, mix, runs, shingles, slices, utf8, words

REGISTERS, BANDS = 128, 32
BASE, SHIFT = 1.01, 400
BLOCK, BLOCK_BYTES = 512, 8 << 20
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, REGISTERS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BAND_MULTIPLIERS = np.random.default_rng(8).integers(1, 2**63, (BANDS, REGISTERS // BANDS), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SetSketch registers of the rows that have elements; ``at`` are the rows' starts."""
    out = np.zeros((len(at), REGISTERS), np.uint16)
    for j in range(REGISTERS):
        least = np.minimum.reduceat(((hashes * _MULTIPLIERS[j]) >> np.uint64(32)).astype(np.uint32), at)
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
        out[:, j] = np.clip(np.floor(SHIFT + 1 - np.log(exponential) / math.log(BASE)), 0, 65535)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union."""
    return np.maximum(a, b)


def likely_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of register rows given the sets' sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = size_a / (size_a + size_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)[None, :] * most[:, None]

    def chance(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12)

    up, down = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    same = np.maximum(1 - up - down, 1e-12)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (REGISTERS - more - less)[:, None] * np.log(same)
    return grid[np.arange(len(grid)), fit.argmax(axis=1)]


def least_estimate(percent: int) -> float:
    """Estimates below this are of pairs below ``percent`` but for one pair in a million."""
    p = percent / 100
    return p - 4.7 * math.sqrt(p * (1 - p) / REGISTERS)


def sketches(df: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, set_key (128 bits that tell sets apart) and sketch of every whole text."""

    def make(part: pa.RecordBatch):
        hashes, _, _, rows = words(*utf8(part.column("s0")))
        found, at = shingles(hashes, rows, k)
        full = np.flatnonzero(np.diff(at))
        sizes = np.zeros(part.num_rows, np.int64)
        keys: list[bytes | None] = [None] * part.num_rows
        sketch: list[bytes | None] = [None] * part.num_rows
        made = registers(found, at[full]) if len(full) else None
        for n, i in enumerate(full.tolist()):
            own = np.unique(found[at[i] : at[i + 1]])
            sizes[i] = len(own)
            keys[i] = np.array([own.sum(dtype=np.uint64), mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()
            sketch[i] = made[n].tobytes()
        return sizes.tolist(), keys, sketch

    return map_rows(df, [key], [text], {"n_shingles": T.LongType(), "set_key": T.BinaryType(), "sketch": T.BinaryType()}, make)


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(sets: DataFrame) -> DataFrame:
    """band, id: the band keys of (id, sketch) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = _registers_of(batch.column("sketch")).reshape(batch.num_rows, BANDS, -1).astype(np.uint64) + np.uint64(1)
            keys = mix((regs * _BAND_MULTIPLIERS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), BANDS))], names=["band", "id"])

    return sets.select("id", "sketch").mapInArrow(run, T.StructType([T.StructField("band", T.LongType()), T.StructField("id", T.LongType())]))


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose estimated similarity may reach ``percent``."""
    least = least_estimate(percent)
    sided = [sets.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                na, nb = part.column("na").to_numpy(), part.column("nb").to_numpy()
                ok = likely_jaccard(_registers_of(part.column("sa")), _registers_of(part.column("sb")), na, nb) >= least
                yield part.select(["a", "b"]).filter(pa.array(ok & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))))

    return pairs.join(sided[0], "a").join(sided[1], "b").mapInArrow(run, "a long, b long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = _common(a, b)
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The (doc_id, text) rows of ``docs`` whose id may be in ``ids``; a few others pass too, but the texts of most need no shuffle."""
    marked = flagged(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), bit_map(ids, "id"), [F.col("doc_id")], "wanted")
    return marked.where("wanted").select("doc_id", "text")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) pairs with 100 * |A & B| >= percent * |A | B|, on full sets.

    The texts that share an ``a`` meet in runs of some hundred, each led by the text of
    ``a``, of which alone the set is held.
    """
    share = F.ceil(F.col("m") / 256)
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    leaders = counts.select("a", F.explode(F.sequence(F.lit(0), (share - 1).cast("int"))).alias("part"), F.col("a").alias("id"), F.lit(0).alias("side"))
    others = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), share).cast("int").alias("part"), F.col("b").alias("id"), F.lit(1).alias("side"))
    wanted = stage(leaders.union(others), "pairs")
    rows = texts_of(wanted, docs).select(F.col("doc_id").alias("id"), "text").join(wanted, "id")
    placed = rows.repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, leading = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, first = words(*utf8(part.column("text")))
                found, at = shingles(hashes, first, k)
                a, p, ids, side = (part.column(c).to_numpy() for c in ("a", "part", "id", "side"))
                out = []
                for i in range(part.num_rows):
                    own = np.unique(found[at[i] : at[i + 1]])
                    if mark != (a[i], p[i]):
                        mark, leading = (a[i], p[i]), []
                    if side[i] == 0:
                        leading.append(own)
                    elif any(_near(lead, own, percent) for lead in leading):
                        out.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(ids[out])], names=["a", "b"])
        give_back()

    return placed.mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, key: str, blocks: Column, extra: list[str]) -> DataFrame:
    """``members`` dealt so that any two rows of a key meet in one (key, i, j) group of two blocks at most, of ``blocks`` in all."""
    own = members.withColumn("blocks", F.ceil(blocks).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "sketch", *extra)
    return met.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _possible(group: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the first block with the later rows, in other components, that their registers and sizes let reach ``percent``."""
    own, ids, comp, n = (group.column(c).to_numpy() for c in ("own", "id", "component", "n"))
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    regs = _registers_of(group.column("sketch"))
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    enough = math.floor(least_estimate(percent) * REGISTERS)
    for x in left.tolist():
        y = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
        if i == j:
            y = y[y > x]
        if len(y):
            y = y[(regs[y] == regs[x]).sum(axis=1) >= enough]
        if len(y):
            yield x, y


def possible_forest(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) edges that connect, in each block, what pairs across components might connect; a forest for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["band", "i", "j"]):
            ids, forest, edges = group.column("id").to_numpy(), Forest(), []
            for x, y in _possible(group, percent):
                edges += [(int(ids[x]), b) for b in ids[y].tolist() if forest.union(int(ids[x]), b)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _blocks(members, "band", F.col("m") / BLOCK, []).mapInArrow(run, "a long, b long").distinct()


def verified_across(members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) components that a link within a cluster ties together, verified on full sets in blocks.

    ``members`` has cluster, id, component, n, sketch, text and the cluster's size, m rows
    and bytes of text. A block skips pairs whose components it has linked already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cluster", "i", "j"]):
            comp, texts = group.column("component").to_numpy(), group.column("text")
            sets: dict[int, np.ndarray] = {}

            def of(row: int, texts=texts, sets=sets) -> np.ndarray:
                if row not in sets:
                    hashes, _, _, first = words(*utf8(texts.slice(row, 1)))
                    sets[row] = np.unique(shingles(hashes, first, k)[0])
                return sets[row]

            forest, links = Forest(), []
            for x, ys in _possible(group, percent):
                for y in ys.tolist():
                    a, b = int(comp[x]), int(comp[y])
                    if forest.root(a) != forest.root(b) and _near(of(x), of(y), percent):
                        forest.union(a, b)
                        links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([e[c] for e in links], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return _blocks(members, "cluster", F.greatest(F.col("m") / (4 * BLOCK), F.col("bytes") / BLOCK_BYTES), ["text"]).mapInArrow(run, "a long, b long").distinct()


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` whose ``component`` is carried on by (id, component) rows of ``labels``."""
    below = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
    return rows.join(below, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root").select(*rows.columns)


def _mixed(named: DataFrame) -> DataFrame:
    """The (band, id, component) rows of the buckets that hold several components, with hub (the bucket's smallest id and its component) and m."""
    hubs = named.groupBy("band").agg(F.min(F.struct("id", "component")).alias("hub"), F.count(F.lit(1)).alias("m"), F.min("component").alias("x"), F.max("component").alias("y"))
    return named.join(hubs.where("x <> y").select("band", "hub", "m"), "band")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = stage(sketches(plain, k), "sketches")
    full = sketched.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    sets = stage(full.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n")), "sets")
    banded = stage(bands(sets), "bands")
    stars = banded.groupBy("band").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "a")
    shared = stage(banded.join(stars, "band"), "shared")

    # one pair a set: with the smallest id that any of its buckets holds. What is confirmed is a forest
    first = stage(shared.where("id <> a").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "first")
    trees = verified(stage(likely(first, sets, percent), "likely"), plain, k, percent)
    labels = stage(flattened(trees.select(F.col("b").alias("id"), F.col("a").alias("up"))).withColumnRenamed("root", "component"), "labels")
    found = [labels]

    # then with the hubs of the buckets that still hold several components; an id with several texts ties their sets together
    named = stage(_relabelled(shared.select("band", "id", F.col("id").alias("component")), labels), "named")
    mixed = stage(_mixed(named), "mixed")
    pairs = mixed.where("component <> hub.component").select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    links = verified(stage(likely(pairs, sets, percent), "likely"), plain, k, percent)
    several = full.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
    owned = stage(full.join(several, "doc_id").select("doc_id", "set_key").join(sets.select("set_key", "id"), "set_key").select("doc_id", "id"), "owned")
    ties = owned.join(owned.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("id <> a").select("a", F.col("id").alias("b"))
    links = stage(links.union(ties), "links")
    ends = _relabelled(_relabelled(links.select("a", F.col("b").alias("component")), labels).select(F.col("component").alias("b"), F.col("a").alias("component")), labels)
    found.append(stage(components(ends.select(F.col("component").alias("a"), "b")), "labels"))

    # what no hub settled: across the components of a bucket in blocks, inside tasks
    rest = stage(_mixed(_relabelled(mixed.select("band", "id", "component"), found[1])).join(sets.select("id", "n", "sketch"), "id"), "mixed")
    edges = stage(possible_forest(rest, percent), "edges")
    if not edges.isEmpty():
        clusters = stage(components(edges).select("id", F.col("component").alias("cluster")), "clusters")
        facts = rest.select("id", "component", "n", "sketch").dropDuplicates(["id"])
        members = stage(clusters.join(facts, "id").join(texts_of(clusters, plain).select(F.col("doc_id").alias("id"), "text"), "id"), "members")
        sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("text")).alias("bytes"))
        found.append(stage(components(verified_across(members.join(sizes, "cluster"), k, percent)), "labels"))

    nodes = sets.select("set_key", F.col("id").alias("component"))
    for step in found:
        nodes = _relabelled(nodes, step)
    none = F.lit(None).cast("long")
    rows = sketched.where("set_key IS NOT NULL").join(nodes.select("set_key", F.col("component").alias("root")), "set_key", "left").select("doc_id", "n_shingles", "root")
    rows = rows.union(sketched.where("set_key IS NULL").select("doc_id", "n_shingles", none))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; of rows with one doc_id, one stays (the one with the lowest hash of its text).

    Rows without a doc_id stay. Only rows that may be dropped are shuffled.
    """
    made = stage(near_duplicates(docs, k, percent), "near")
    per_id = made.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept"))
    suspects = stage(per_id.where("n > 1 OR NOT kept"), "suspects")
    flag, nth = fresh("suspect", docs.columns), fresh("nth", docs.columns)
    marked = flagged(docs, bit_map(suspects, "doc_id"), [F.col("doc_id").cast("long")], flag)
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    dropped = suspects.where("NOT kept").select(F.col("doc_id").alias(flag))
    rows = marked.where(F.col(flag) & F.col("doc_id").isNotNull()).select(*columns)
    once = rows.join(dropped, F.col("doc_id").cast("long") == F.col(flag), "left_anti").withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1)
    return once.select(*columns).union(marked.where(~F.col(flag) | F.col("doc_id").isNull()).select(*columns))
