"""What Python holds of a batch of bodies does not grow with the batch."""

import pyarrow as pa

from palisade import queries
from palisade.sources.bodies import PART_BYTES, PART_ROWS, parts


def test_parts_are_small_and_whole():
    small = pa.record_batch({"i": pa.array(range(10_000)), "b": pa.array([b"x"] * 10_000)})
    large = pa.record_batch({"i": pa.array(range(10)), "b": pa.array([b"x" * PART_BYTES] * 10)})
    none = small.slice(0, 0)
    made = list(parts(iter([small, none, large])))
    assert [i for b in made for i in b.column(0).to_pylist()] == [*range(10_000), *range(10)]
    assert max(b.num_rows for b in made) <= PART_ROWS
    assert [b.num_rows for b in made[-10:]] == [1] * 10


def test_parts_of_uneven_batches_are_small():
    sizes = [10] * 5_000 + [PART_BYTES // 4] * 40 + [10] * 5_000
    uneven = pa.record_batch({"i": pa.array(range(len(sizes))), "b": pa.array([b"x" * n for n in sizes]), "edits": pa.array([[{"replacement": "y"}]] * len(sizes))})
    made = list(parts(iter([uneven])))
    assert [i for b in made for i in b.column(0).to_pylist()] == [*range(len(sizes))]
    assert [len(x) for b in made for x in b.column(1).to_pylist()] == sizes
    assert max(b.nbytes for b in made) <= PART_BYTES


def test_roundtrip_has_one_worker_a_task(spark, monkeypatch):
    plans, stage = [], queries.stage

    def seen(df, name):
        plans.append(df)
        return stage(df, name)

    monkeypatch.setattr(queries, "stage", seen)
    plans.append(queries.json_roundtrip(spark, "/root/testdata/sf0.001"))
    passes = [df._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") for df in plans]
    # walking, the vault, rewriting, restoring
    assert passes == [1, 0, 1, 1]
