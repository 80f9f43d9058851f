"""Centroid clustering filtered by ball trees.

Vectors become integers, so that every sum, mean and distance is exact and no result
depends on the order of rows. Each partition's vectors are cut into runs of bounded size,
and each run becomes a tree of balls (radius, count, integer sum) that is written once; a
round reads the trees and sends the sums of each centroid back. From the root on, a ball
drops every centroid whose distance to the ball's centre, less the radius, is beyond the
smallest such distance plus the radius: by the triangle inequality no member is nearer to
it. A ball with one centroid left is assigned whole, by its count and sum; else its
children are looked at, and at leaves the exact integer distances. Bounds are floating
point with a margin far above its error, so that they only ever keep a centroid too many.

Defined cases: null vectors, vectors of another number of components and vectors with a
null or non-finite one are left out; a component x beyond 2^17 in size counts as 2^17
(floor(1024 x) is held within 2^27, since squared distances must fit into 64 bits); sums
of distances beyond 64 bits are held at their largest. Repeated vectors and repeated or
null ids are rows of their own (null ids come last as first centroids; equal ids by their
components); fewer vectors than centroids make fewer centroids; an empty table gives no
rows; only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

RUN, LEAF = 2048, 16
BOUND = 1 << 27
_MARGIN = 1e-9
LONG = (1 << 63) - 1
TREES = "ids array<bigint>, points binary, first binary, last binary, right binary, radius binary, sums binary"


def integers(df: DataFrame, dims: int, id: str, vector: str) -> DataFrame:
    """vec_id and x, an array of ``dims`` integers floor(1024 * component), of the vectors that are whole."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    scaled = F.transform(v, lambda x: F.least(F.greatest(F.floor(x * 1024), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))
    return df.where((F.size(v) == dims) & finite).select(F.col(f"`{id}`").cast("long").alias("vec_id"), scaled.alias("x"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``salt:vec_id``."""
    ranked = vectors.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    rows = ranked.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def tree(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of ``points`` in a tree of balls, and its nodes.

    A node holds the points from ``first`` to ``last`` (exclusive); ``right`` is its second
    child, 0 for leaves, and the first child follows the node itself.
    """
    order = np.arange(len(points))
    first, last, right, radius, sums = [], [], [], [], []
    todo = [(0, len(points), -1)]
    while todo:
        a, z, parent = todo.pop()
        node = len(first)
        if parent >= 0:
            right[parent] = node
        own = points[order[a:z]].astype(np.float64)
        total = points[order[a:z]].sum(axis=0, dtype=np.int64)
        away = np.sqrt(((own - total / (z - a)) ** 2).sum(axis=1))
        first.append(a)
        last.append(z)
        right.append(0)
        radius.append(away.max() * (1 + _MARGIN) + _MARGIN)
        sums.append(total)
        if z - a > LEAF and away.max() > 0:
            far = own[away.argmax()]
            apart = ((own - far) ** 2).sum(axis=1)
            axis = own[apart.argmax()] - far
            middle = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(own @ axis, middle)]
            todo += [(a + middle, z, node), (a, a + middle, -1)]
    return order, {"first": np.array(first, np.int32), "last": np.array(last, np.int32), "right": np.array(right, np.int32), "radius": np.array(radius), "sums": np.array(sums, np.int64)}


def plant(vectors: DataFrame, dims: int) -> DataFrame:
    """A row for each tree over a run of a partition's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
            order, nodes = tree(points)
            row = [ids.take(pa.array(order)).to_pylist(), points[order].tobytes(), *(nodes[c].tobytes() for c in ("first", "last", "right", "radius", "sums"))]
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["ids", "points", "first", "last", "right", "radius", "sums"])

        held: list[tuple[pa.Array, np.ndarray]] = []
        size = 0
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy().reshape(-1, dims)
            at = 0
            while at < len(flat):
                n = min(RUN - size, len(flat) - at)
                held.append((batch.column("vec_id").slice(at, n), flat[at : at + n]))
                size, at = size + n, at + n
                if size == RUN:
                    yield grown(pa.concat_arrays([i for i, _ in held]), np.concatenate([p for _, p in held]))
                    held, size = [], 0
        if held:
            yield grown(pa.concat_arrays([i for i, _ in held]), np.concatenate([p for _, p in held]))

    return vectors.mapInArrow(run, TREES)


def exact(points: np.ndarray, centroids: np.ndarray, open: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the open centroids of each point, by exact squared distance, the smaller number on ties."""
    best, least = np.zeros(len(points), np.int64), np.full(len(points), LONG)
    for c in range(len(centroids)):
        rows = np.flatnonzero(open[:, c])
        diff = points[rows].astype(np.int64) - centroids[c]
        apart = (diff * diff).sum(axis=1)
        nearer = apart < least[rows]
        best[rows[nearer]], least[rows[nearer]] = c, apart[nearer]
    return best, least


def filtered(row: dict, centroids: np.ndarray, dims: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """A tree against the centroids, a level at a time: ("balls", nodes, centroid of each) and ("points", places, centroid of each)."""
    first, last, right = (np.frombuffer(row[c], np.int32) for c in ("first", "last", "right"))
    radius, sums = np.frombuffer(row["radius"]), np.frombuffer(row["sums"], np.int64).reshape(-1, dims)
    points, floats = np.frombuffer(row["points"], np.int32).reshape(-1, dims), centroids.astype(np.float64)
    nodes, open = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(nodes):
        centre = sums[nodes] / (last[nodes] - first[nodes])[:, None]
        apart = np.stack([np.sqrt(((centre - c) ** 2).sum(axis=1)) for c in floats], axis=1)
        reach = np.where(open, apart, np.inf).min(axis=1) + 2 * radius[nodes]
        open = open & (apart <= (reach * (1 + _MARGIN) + _MARGIN)[:, None])
        whole = open.sum(axis=1) == 1
        if whole.any():
            yield "balls", nodes[whole], open[whole].argmax(axis=1)
        leaf = ~whole & (right[nodes] == 0)
        if leaf.any():
            a, n = first[nodes[leaf]], (last - first)[nodes[leaf]]
            places = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield "points", places, exact(points[places], centroids, np.repeat(open[leaf], n, axis=0))[0]
        deeper = ~whole & ~leaf
        nodes, open = np.concatenate([nodes[deeper] + 1, right[nodes[deeper]].astype(np.int64)]), np.concatenate([open[deeper]] * 2)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() if c != "ids" else batch.column(c)[i].values for c in batch.schema.names}


def moved(trees: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after a round: exact floors of the means of their vectors; those without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for row in _rows(batches):
            first, last, sums = np.frombuffer(row["first"], np.int32), np.frombuffer(row["last"], np.int32), np.frombuffer(row["sums"], np.int64).reshape(-1, dims)
            points = np.frombuffer(row["points"], np.int32).reshape(-1, dims)
            for kind, found, to in filtered(row, centroids, dims):
                np.add.at(total, to, sums[found] if kind == "balls" else points[found])
                count += np.bincount(to, (last - first)[found] if kind == "balls" else None, len(centroids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centroids)), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["c", "n", "s"])

    columns = [c for c in trees.columns if c not in ("ids", "right", "radius")]
    parts = trees.select(*columns, "right", "radius").mapInArrow(run, "c int, n bigint, s array<bigint>").where("n > 0")
    each = parts.select("c", "n", F.posexplode("s").alias("i", "x"))
    out = centroids.copy()
    for r in each.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(19,0)")).alias("x")).collect():  # a row a centroid's component
        out[r["c"], r["i"]] = int(r["x"]) // r["n"]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            points, first, last = np.frombuffer(row["points"], np.int32).reshape(-1, dims), np.frombuffer(row["first"], np.int32), np.frombuffer(row["last"], np.int32)
            cluster = np.zeros(len(points), np.int64)
            for kind, found, to in filtered(row, centroids, dims):
                if kind == "points":
                    cluster[found] = to
                else:
                    for node, c in zip(found, to, strict=True):
                        cluster[first[node] : last[node]] = c
            diff = points - centroids[cluster]
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(cluster.astype(np.int32)), pa.array((diff * diff).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def fit(trees: DataFrame, centroids: np.ndarray, rounds: int, dims: int) -> np.ndarray:
    """The centroids after ``rounds`` rounds, or as soon as none moves."""
    for _ in range(rounds):
        new = moved(trees, centroids, dims)
        if (new == centroids).all():
            break
        centroids = new
    return centroids


def clusters(df: DataFrame, dims: int = 64, k: int = 8, rounds: int = 10, salt: str = "3", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector."""
    vectors = integers(df, dims, id, vector)
    centroids = first_centroids(vectors, k, salt)
    if not len(centroids):
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    trees = stage(plant(vectors, dims), "trees")
    centroids = fit(trees, centroids, rounds, dims)
    rows = stage(assigned(trees, centroids, dims), "assigned")
    per = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}  # a row a centroid
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of(values: list[Column]) -> Column:
        return F.get(F.array(*values), F.col("cluster"))

    return rows.select("vec_id", "cluster", "distance", of([F.lit(min(per.get(c, 0), LONG)).cast("long") for c in range(len(centroids))]).alias("cluster_inertia"),
                       F.lit(min(sum(per.values()), LONG)).cast("long").alias("inertia"), of([F.lit(x) for x in named]).alias("centroid_sha256"))
