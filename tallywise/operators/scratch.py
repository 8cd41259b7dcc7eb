"""Durable places for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine, and only if all tasks run on it: on any other master this raises,
    because executors would write to their own disks and a later read would find nothing.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.getConf().get("spark.master") or ""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master!r})")
    if not getattr(spark, "_tallywise_scratch", None):
        spark._tallywise_scratch = tempfile.mkdtemp(prefix="tallywise-")
    return spark._tallywise_scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the scratch root, known to ``release``."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if not hasattr(spark, "_tallywise_paths"):
        spark._tallywise_paths = []
    spark._tallywise_paths.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete every path this session got from ``scratch_path``; returns how many were there.

    Tables read from those paths can't be used afterwards, so the caller decides when results are safe.
    """
    jvm, gone = spark._jvm, 0
    paths = getattr(spark, "_tallywise_paths", [])
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def durable(df: DataFrame, name: str = "table", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut and a lost executor costs no recomputation.

    Used where two jobs must see the same physical rows, or where a costly result feeds several outputs. The number of
    rows read back must be the number written, else this raises.
    """
    spark = df.sparkSession
    path, seen = scratch_path(spark, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*partition_by).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    written, found = seen.get["n"], back.count()
    if written != found:
        raise RuntimeError(f"{written} rows were written to {path}, but {found} can be read")
    return back
