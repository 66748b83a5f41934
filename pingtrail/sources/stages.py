"""Parquet stages (hand-over between pipeline steps) and partitioned exports."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"
_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """The session with another value of a setting, for what runs here."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def save_stage(df: DataFrame, path: str, partition_by: Sequence[str] | str | None = None) -> str:
    """Write ``df`` as parquet (overwrite), optionally one folder per key value.

    NULL keys land in ``__HIVE_DEFAULT_PARTITION__``; read back with the schema
    so that key columns keep their type."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def load_stage(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a stage written by :func:`save_stage`; pass ``schema`` for partitioned
    stages so partition columns are not re-inferred (a numeric-looking tag id
    would come back as an integer).  Its folders are listed by as many tasks as a
    shuffle has: Spark's default is a task per folder."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    with setting(spark, _LISTERS, spark.conf.get("spark.sql.shuffle.partitions")):
        return r.parquet(path)


def write_partitioned(df: DataFrame, path: str, key: str) -> str:
    """One output folder per value of ``key`` (the per-species / per-tag export).

    Rows are rebalanced by the key first: adaptive execution splits a key larger than
    its advisory partition size over several tasks, so a hot key is not one task's
    work.  It would also put all keys of few bytes together in one task, but a folder
    costs the same however little it holds: so partitions are not coalesced, and the
    folders are dealt over all shuffle partitions."""
    with setting(df.sparkSession, _COALESCE, "false"):
        df.hint("rebalance", key).write.mode("overwrite").partitionBy(key).parquet(path)
    return path
