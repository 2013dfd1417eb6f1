"""Running totals within hot groups: a bucketed prefix, so no task sorts a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: int) -> int:
    """About the square root of the rows, as a power of two: buckets and rows per bucket grow alike."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows)) / 2))


def running_total(df: DataFrame, group: list[str], key: Column, amount: Column, rows: int, out: str) -> DataFrame:
    """``df`` with ``out`` = the sum of ``amount`` over the rows of its group that come before it.

    ``key`` is a 64-bit hash that orders the rows; its high bits name the bucket.  Bucket totals are pre-aggregated,
    their prefix is a window over about sqrt(rows) buckets, and the rows of one bucket are ordered in one task.
    Rows with equal keys are ordered by the remaining columns, so equal rows may swap without changing the result."""
    n = buckets_for(rows)
    shift = 64 - (n.bit_length() - 1)
    bucket = F.lit(0).cast("long") if n == 1 else F.shiftrightunsigned(key, shift)
    keyed = df.withColumn("__key", key).withColumn("__bucket", bucket).withColumn("__amount", amount.cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group] + [F.col("__bucket") == F.col("__b")]
    totals = keyed.groupBy(*group, "__bucket").agg(F.sum("__amount").alias("__sum"))
    w = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"__g_{c}") for c in group], F.col("__bucket").alias("__b"),
                           F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__start"))
    order = ["__key", *[c for c in df.columns if c not in group]]
    inner = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("__local", F.coalesce(F.sum("__amount").over(inner), F.lit(0)))
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return (local.join(starts, cond, "left")
            .select(*df.columns, (F.col("__start") + F.col("__local")).alias(out)))
