"""Intermediate tables in the folder that every executor shares.

A staged table is ordinary Parquet below ``spark.checkpoint.dir``, so losing an
executor never loses it and nothing upstream runs twice. Staged tables stay until that
folder is cleared, by whoever set it and after the results are written, as results are
read from them; only a folder made here, on a local master, goes with the process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset a fresh local folder on a local master, and an error on a cluster."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = context._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="palisade-shared-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        path = f"file://{made}"
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used before."""
    return f"{shared_dir(spark)}/palisade-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
