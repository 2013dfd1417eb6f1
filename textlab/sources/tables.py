"""Parquet table reader that guarantees scan parallelism.

A table stored as one large row group is one scan task, and every per-row step
after it (regex tokenising, hashing) would run in that one task.  When a scan
yields fewer partitions than the cluster's default parallelism it is spread
round-robin (deterministic: Spark sorts before a round-robin repartition, so a
retried task sees the same rows); an input already split into many files or row
groups, as at cluster scale, is left untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    try:
        want = min_partitions or spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # no RDD API (e.g. a Spark Connect session): read as is
        return df
    return df.repartition(want) if have < want else df
