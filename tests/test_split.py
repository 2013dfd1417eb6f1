"""Splits: exact sizes, disjoint, complete, seed-deterministic, partition-independent."""

import pytest
from pyspark.sql import functions as F

from textlab.operators import split as sp


@pytest.fixture
def classes(spark):
    rows = []
    i = 0
    for label, size in ((0, 299), (1, 49), (2, 42), (3, 9)):
        for _ in range(size):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "id long, label int")


def sizes(df):
    out = {}
    for r in df.groupBy("label", "split").count().collect():
        out.setdefault(r["label"], {})[r["split"]] = r["count"]
    return {k: (v.get("train", 0), v.get("valid", 0), v.get("test", 0)) for k, v in out.items()}


def test_kshot_golden_branches(classes):
    s = sp.split_kshot(classes, "label", "id", 100)
    assert sizes(s) == {0: (100, 99, 100), 1: (39, 5, 5), 2: (33, 4, 5), 3: (7, 1, 1)}


def test_split_complete_disjoint_and_partition_independent(classes):
    a = sp.split_kshot(classes, "label", "id", 20)
    b = sp.split_kshot(classes.repartition(7), "label", "id", 20)
    assert a.count() == classes.count() == a.select("id").distinct().count()
    assert a.exceptAll(b).count() == 0


def test_bucket_cut_equals_full_ordering(classes):
    quota = classes.groupBy("label").agg((F.count("*") / 3).cast("bigint").alias("quota"))
    got = sp.take_quota(classes, ["label"], "id", quota, seed=7)
    from pyspark.sql import Window
    w = Window.partitionBy("label").orderBy(sp.hash_key("id", 7), "id")
    ref = (classes.withColumn("rn", F.row_number().over(w) - 1).join(quota, "label")
           .select("id", "label", (F.col("rn") < F.col("quota")).alias("in_quota")))
    assert got.select("id", "label", "in_quota").exceptAll(ref).count() == 0


def test_full_shot_sizes(spark):
    rows = [(i, i % 7 if i < 95 else 100 + i) for i in range(100)]  # five singletons
    df = spark.createDataFrame(rows, "id long, label int")
    s = sp.split_full(df, "label", "id")
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 76 + 5, "test": 10, "valid": 9}  # rest = ceil(0.2 * 95) = 19, test = ceil(19 / 2)
    assert s.count() == 100


def test_tiny_classes_kept_in_train_and_flagged(spark, classes):
    tiny = spark.createDataFrame([(10_000, 9), (10_001, 9), (10_002, 8)], "id long, label int")
    s = sp.split_kshot(classes.unionByName(tiny), "label", "id", 5)
    rep = {r["split"]: r for r in sp.split_report(s).collect()}
    assert rep["train"]["tiny_classes"] == 2 and rep["valid"]["tiny_classes"] == 0
    assert sizes(s)[9] == (2, 0, 0) and sizes(s)[8] == (1, 0, 0)


def test_ratios_checked(classes):
    with pytest.raises(ValueError):
        sp.split_kshot(classes, "label", "id", 5, ratios=(0.8, 0.2, 0.1))


def test_positions_are_a_permutation(classes):
    p = sp.positions(classes, "id", 3)
    assert sorted(r["pos"] for r in p.collect()) == list(range(classes.count()))


def test_sample_fraction_deterministic(classes):
    a = sp.sample_fraction(classes, "id", 0.5)
    assert a.exceptAll(sp.sample_fraction(classes.repartition(3), "id", 0.5)).count() == 0
    assert 0.35 * 399 < a.count() < 0.65 * 399


def test_few_classes_do_not_deal_rows_out_by_class(spark):
    """Where Spark cannot tell that the class table is small, a frequent class's rows would all meet in one task."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        df = spark.range(100_000).withColumn("label", (F.col("id") % 10 == 0).cast("int")).withColumn("text", F.lit("x" * 20))
        for out in (sp.split_full(df, "label", "id"), sp.split_kshot(df, "label", "id", 100)):
            plan = out._jdf.queryExecution().sparkPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
