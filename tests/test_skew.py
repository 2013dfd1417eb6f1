"""Operators stay exact when one key holds a third of all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlab.operators import labels as lb
from textlab.operators import split as sp
from textlab.operators.freq import word_freq
from textlab.operators.ranks import value_ranks


def _skewed(spark, n=30000):
    # key 0 holds a third of the rows, the rest spread over 1000 keys
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000 + 1).alias("k"),
        (F.col("id") * 7919 % 1009).alias("v"))


def test_latest_per_key_hot_key(spark):
    df = _skewed(spark)
    got = lb.latest_per_key(df, "k", "v", "id")
    w = Window.partitionBy("k").orderBy(F.desc("v"), "id")
    ref = df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    assert got.select("id", "k", "v").exceptAll(ref.select("id", "k", "v")).count() == 0


def test_take_quota_hot_group(spark):
    df = _skewed(spark)
    quota = df.groupBy("k").agg((F.count("*") / 2).cast("bigint").alias("quota"))
    got = sp.take_quota(df, ["k"], "id", quota, seed=11)
    w = Window.partitionBy("k").orderBy(sp.hash_key("id", 11), "id")
    ref = df.withColumn("rn", F.row_number().over(w) - 1).join(quota, "k").select("id", "k", "v", (F.col("rn") < F.col("quota")).alias("in_quota"))
    assert got.select("id", "k", "v", "in_quota").exceptAll(ref).count() == 0


def test_value_ranks_hot_value(spark):
    df = _skewed(spark).select(F.when(F.col("k") == 0, 5).otherwise(F.col("v")).alias("x"))
    got = {r["x"]: r["avg_rank"] for r in value_ranks(df, "x").collect()}
    xs = sorted(r["x"] for r in df.collect())
    first = {}
    for i, x in enumerate(xs, 1):
        first.setdefault(x, [i, i])[1] = i
    assert all(abs(got[x] - (a + b) / 2) < 1e-9 for x, (a, b) in first.items())


def test_word_freq_hot_word(spark):
    rows = [("the " * 50 + f"w{i}",) for i in range(300)]
    df = spark.createDataFrame(rows, "text string")
    f = {r["word"]: r["frequency"] for r in word_freq(df, remove_stop_words=False, pattern=r"[\p{L}\p{N}]+").collect()}
    assert f["the"] == 15000 and f["w7"] == 1
