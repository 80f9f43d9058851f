"""Clustering with ball trees against plain rounds over all vectors and the SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import balltree
from palisade.llm.queries import ORACLE_SQL

SCHEMA = "vec_id long, embedding array<double>"


def want(rows, dims, k, rounds):
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(x * 1024))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in named[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, own in groups.items():
            centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    per = [sum(d for _, d, n in out if n == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, min(per[n], (1 << 63) - 1), min(sum(per), (1 << 63) - 1), sha[n]) for i, d, n in out), key=str)


def got(df, **more):
    return sorted(map(tuple, balltree.clusters(df, **more).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_equals_plain_rounds(spark):
    rng = random.Random(5)
    tight = [[rng.gauss(c, 0.02) for _ in range(3)] for c in (-40, -3, 0, 7, 90) for _ in range(120)]
    loose = [[rng.uniform(-1, 1) for _ in range(3)] for _ in range(200)]
    same = [[0.25, -0.5, 0.125]] * 150
    rows = list(enumerate([*tight, *loose, *same]))
    rng.shuffle(rows)
    rows += [(None, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, -3.0]), (7, [0.1, 0.1, 0.1]), (7, [0.1, 0.1, 0.1]), (2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [1.0, None, 2.0]), (2004, [1.0, math.nan, 2.0]), (2005, [math.inf, 0.0, 0.0]), (2006, [0.0] * 4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("x", F.lit("clash")).withColumn("cluster", F.lit(1)).withColumn("ids", F.lit(None).cast("int"))
    assert got(df, dims=3, k=6, rounds=4) == want(rows, 3, 6, 4)
    far = [*rows, (3000, [1e30, -1e30, 1e300]), (3001, [-2e5, 0.0, 1.0])]
    assert got(spark.createDataFrame(far, SCHEMA), dims=3, k=6, rounds=3) == want(far, 3, 6, 3)


def test_few_and_none(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [-1.0, 2.0])]
    assert got(spark.createDataFrame(rows, SCHEMA), dims=2) == want(rows, 2, 8, 10)
    assert got(spark.createDataFrame([], SCHEMA)) == [] and got(spark.createDataFrame([(1, [1.0])], SCHEMA)) == []
    assert balltree.clusters(spark.createDataFrame([], SCHEMA)).dtypes == balltree.clusters(spark.createDataFrame(rows, SCHEMA), dims=2).dtypes


def test_floats_equal_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(64)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op11_centroid_clustering"]).fetchall(), key=str) == got(df)


@pytest.mark.parametrize("spread", [0.0, 1.0, 500.0])
def test_balls_lose_no_nearest_centroid(spread):
    rng = np.random.default_rng(int(spread))
    middle = rng.integers(-2000, 2000, (12, 5))
    points = (middle[rng.integers(0, 12, 3000)] + rng.normal(0, spread, (3000, 5))).astype(np.int32)
    order, nodes = balltree.tree(points)
    assert sorted(order) == list(range(3000)) and (nodes["sums"][0] == points.sum(axis=0)).all()
    row = {"points": points[order].tobytes(), **{k: v.tobytes() for k, v in nodes.items()}}
    centroids = np.concatenate([middle[:6], middle[:2] + 1, middle[:2]]).astype(np.int64)
    found, whole = np.full(3000, -1), 0
    for kind, which, to in balltree.filtered(row, centroids, 5):
        for n, c in zip(which, to, strict=True):
            a, z = (n, n + 1) if kind == "points" else (nodes["first"][n], nodes["last"][n])
            assert (found[a:z] == -1).all()
            found[a:z] = c
            whole += (z - a) * (kind == "balls")
    apart = ((points[order].astype(np.int64)[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (found == apart.argmin(axis=1)).all() and whole > (1000 if spread < 100 else 0)
