"""Ordered ranks and prefix sums without a single-task global window.

A ``Window.orderBy`` with no ``partitionBy`` runs in one task.  These helpers
cut the order into ranges of about equal size (range partitioning), take the
prefix over the small table of ranges, and finish with windows partitioned by
range, so the work stays spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import materialize

#: Ranges that an ordering is cut into, at least; the cuts follow the data.
MIN_RANGES = 64


def range_bucketed(df: DataFrame, order: list[Column], out: str = "_b") -> DataFrame:
    """``df`` range-partitioned by ``order`` with the range's number, ascending in ``order``.

    Cut points are sampled from the data, so ranges are about equal whatever the
    values' scale.  The result is written once: the numbers stay the same for
    every later read and after a lost executor.  NaN sorts after all numbers,
    null first.
    """
    n = max(MIN_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()), "ranges")


def ordered_positions(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """``df`` with its 0-based position in ``order``: counts per range, their prefix, and a window per range."""
    d = range_bucketed(df, order)
    first = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return d.join(F.broadcast(starts), "_b").withColumn(out, (F.col("_start") + inside).cast("bigint")).select(*df.columns, out)


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values of ``value`` with ``cnt`` and ``before`` (# rows with a smaller value)
    and ``avg_rank`` (1-based average rank for ties, as in Spearman's rho).  Null is left
    out; NaN is one value, larger than all numbers."""
    vc = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("cnt"))
    vc = range_bucketed(vc, [F.col(value)])
    bt = vc.groupBy("_b").agg(F.sum("cnt").alias("_bcnt"))
    bt = bt.withColumn(
        "_bbefore",
        F.coalesce(F.sum("_bcnt").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_bcnt")
    within = F.coalesce(
        F.sum("cnt").over(Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    out = vc.join(F.broadcast(bt), "_b").withColumn("before", (F.col("_bbefore") + within).cast("bigint"))
    return out.select(value, "cnt", "before",
                      (F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)).alias("avg_rank"))


def grouped_prefix(df: DataFrame, group: list[str], order: list[str], bucket: Column, value: Column,
                   how: str = "max", inclusive: bool = False, out: str = "prefix") -> DataFrame:
    """For each row, aggregate ``value`` over earlier rows of its group (``how`` in sum/max/min).

    ``bucket`` must be monotone in ``order`` within a group (e.g. the hour of a
    timestamp).  Work per task is one (group, bucket), not one whole group.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    d = df.withColumn("_pb", bucket).withColumn("_pv", value)
    bt = d.groupBy(*group, "_pb").agg(agg("_pv").alias("_bv"))
    w_b = Window.partitionBy(*group).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("_bprev", agg("_bv").over(w_b)).drop("_bv")
    hi = 0 if inclusive else -1
    w_r = Window.partitionBy(*group, "_pb").orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    d = d.join(bt, [*group, "_pb"]).withColumn("_rprev", agg("_pv").over(w_r))
    if how == "sum":
        comb = F.coalesce(F.col("_bprev"), F.lit(0)) + F.coalesce(F.col("_rprev"), F.lit(0))
    else:
        pick = F.greatest if how == "max" else F.least
        comb = pick(F.col("_bprev"), F.col("_rprev"))  # greatest/least skip nulls
    return d.withColumn(out, comb).drop("_pb", "_pv", "_bprev", "_rprev")
