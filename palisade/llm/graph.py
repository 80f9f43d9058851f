"""Connected components of links between integer ids, by hooking and contraction.

Links are first thinned inside tasks to spanning forests. Then each round every node hooks
onto its smallest neighbour, if that is smaller; the trees that arise are flattened, links
are carried over to the roots and those inside a tree go. So links only ever get fewer,
and a node that has hooked is settled and never read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage

CHUNK = 1 << 18


class Forest:
    """Union-find over the ids of one bounded set of links; the smaller root stays."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def thinned(links: DataFrame) -> DataFrame:
    """(a, b) links, a < b, that connect what the (a, b) rows of ``links`` connect: stars of each ``CHUNK`` links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, read = Forest(), 0

        def stars() -> pa.RecordBatch:
            nodes = [x for x in forest.up if forest.root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array([forest.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.union(x, y)
            read += batch.num_rows
            if read >= CHUNK:
                yield stars()
                forest, read = Forest(), 0
        yield stars()

    return links.mapInArrow(run, "a long, b long").distinct()


def flattened(forest: DataFrame) -> DataFrame:
    """(id, root) of every (id, up) row of a forest, by pointer jumping; only who is not yet right below a root jumps."""
    done: list[DataFrame] = []
    left = stage(forest.select("id", F.col("up").alias("root")), "forest")
    while True:
        every = reduce(DataFrame.union, done, left)
        deep = stage(left.join(every.select(F.col("id").alias("root"), F.col("root").alias("next")), "root").select("id", F.col("next").alias("root")), "deep")
        if deep.isEmpty():
            return every
        done.append(stage(left.join(deep.select("id"), "id", "left_anti"), "settled"))
        left = deep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) of every id in ``links`` that is not alone.

    Rows with a null end link nothing; empty links give an empty frame; self links are
    allowed and lead to nothing.
    """
    plain = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = stage(thinned(plain), "links")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        # a < b in every link, so each b hooks onto something smaller and no cycle arises
        trees = stage(flattened(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up"))), "trees")
        hooks.append(trees)
        root = F.coalesce("root", "a")
        low = edges.join(trees.withColumnRenamed("id", "a"), "a", "left").select(root.alias("a"), "b")
        both = low.join(trees.withColumnRenamed("id", "b"), "b").select("a", F.col("root").alias("b")).where("a <> b")
        edges = stage(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not hooks:
        return links.sparkSession.createDataFrame([], "id long, component long")
    below = hooks[0] if len(hooks) == 1 else stage(flattened(reduce(DataFrame.union, hooks).withColumnRenamed("root", "up")), "trees")
    roots = below.select(F.col("root").alias("id")).distinct()
    return below.union(roots.select("id", F.col("id").alias("root"))).select("id", F.col("root").alias("component"))
