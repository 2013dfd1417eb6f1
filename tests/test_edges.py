"""Inputs the tables do not hold: null labels, NaN, narrow ranges, large degrees of freedom, other id types, nested folders."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from textlab.functions.scalar import parse_bool
from textlab.functions.special import chi2_sf, gamma_q, t_sf
from textlab.operators import knn
from textlab.operators import labels as lb
from textlab.operators import models as mo
from textlab.operators import split as sp
from textlab.operators.metrics import classification_report
from textlab.operators.ranks import ordered_positions, range_bucketed, value_ranks
from textlab.plans.evaluate_knn import evaluate_knn
from textlab.session import ensure_checkpoint_dir, scratch_path
from textlab.sources import delimited as io
from textlab.sources.catalog import read_corpus


@pytest.mark.parametrize("dof", [1e5, 1e6, 1e9, 1e11])
@pytest.mark.parametrize("z", [-3.0, -1.0, 0.0, 0.5, 2.0, 5.0])
def test_tails_reach_the_normal_limit(dof, z):
    normal = 0.5 * math.erfc(z / math.sqrt(2))
    h = 2 / (9 * dof)  # the cube root of chi-square / dof is nearly normal, to O(1 / dof)
    assert chi2_sf(dof * (1 - h + z * math.sqrt(h)) ** 3, dof) == pytest.approx(normal, abs=2e-6)
    assert t_sf(z, dof) == pytest.approx(normal, abs=1e-4 if dof < 1e6 else 1e-6)


def test_tails_agree_across_the_change_of_method():
    for a in (9e4, 1.2e5):
        for k in (-2, 0, 1):
            x = a + k * math.sqrt(a)
            assert gamma_q(a, x) == pytest.approx(gamma_q(a * (1 + 1e-9), x * (1 + 1e-9)), abs=1e-7)
    assert gamma_q(99_999.0, 99_999.0) == pytest.approx(gamma_q(100_001.0, 100_001.0), abs=1e-8)
    assert gamma_q(5e9, 5e9) == pytest.approx(0.5 - 1 / (3 * math.sqrt(2 * math.pi * 5e9)), abs=1e-12)
    assert t_sf(1.5, 99_999) == pytest.approx(t_sf(1.5, 100_001), abs=1e-8)


def test_ranges_spread_narrow_values(spark):
    for df in (spark.range(1_000_000_000, 1_001_000_000).toDF("v"), spark.range(200_000).select((F.rand(3)).alias("v"))):
        sizes = [r["count"] for r in range_bucketed(df, [F.col("v")]).groupBy("_b").count().collect()]
        assert len(sizes) >= 60 and max(sizes) < 5 * sum(sizes) / len(sizes)


def test_ranks_with_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (None,), (1.0,), (float("-inf"),)], "v double")
    got = {str(r["v"]): (r["cnt"], r["before"], r["avg_rank"]) for r in value_ranks(df, "v").collect()}
    assert got == {"-inf": (1, 0, 1.0), "1.0": (2, 1, 2.5), "2.0": (1, 3, 4.0), "nan": (1, 4, 5.0)}
    pos = ordered_positions(df.where("v = v and v is not null"), [F.desc("v")]).collect()
    assert sorted(r["pos"] for r in pos) == list(range(len(pos)))


def test_label_rank_breaks_ties_by_label(spark):
    df = spark.createDataFrame([(x,) for x in "bbaaccd"], "label string")
    assert {r["label"]: r["rank"] for r in lb.label_rank(df).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_pareto_front_with_nan(spark):
    rows = [(1, 0.5, 0.9), (2, float("nan"), 0.95), (3, 0.4, 0.8), (4, 0.6, float("nan")), (5, 0.7, 0.7)]
    df = spark.createDataFrame(rows, "id int, loss double, f1 double")
    two = {r["id"] for r in mo.pareto_front(df, {"loss": "min", "f1": "max"}).collect()}
    three = {r["id"] for r in mo.pareto_front(df.withColumn("c", F.lit(1.0)), {"loss": "min", "f1": "max", "c": "min"}).collect()}
    assert two == three == {1, 2, 3}


def test_null_label_is_a_class_of_its_own(spark):
    df = spark.range(200).select(F.col("id"), F.when(F.col("id") >= 50, F.lit("x")).alias("label"))
    got = {(r["label"], r["split"]): r["count"] for r in sp.split_kshot(df, "label", "id", 5).groupBy("label", "split").count().collect()}
    assert got[(None, "train")] == 5 and got[("x", "train")] == 5 and sum(got.values()) == 200
    full = {(r["label"], r["split"]): r["count"] for r in sp.split_full(df, "label", "id").groupBy("label", "split").count().collect()}
    assert full[(None, "train")] == 40 and full[("x", "train")] == 120 and sum(v for (_, s), v in full.items() if s == "valid") == 20
    quota = spark.createDataFrame([(None, 10), ("x", 3)], "label string, quota int")
    taken = {r["label"]: r["n"] for r in sp.take_quota(df, ["label"], "id", quota).where("in_quota").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert taken == {None: 10, "x": 3}
    assert sorted(r["pos"] for r in sp.positions(df, "id", group=["label"]).where("label is null").collect()) == list(range(50))
    one = df.where("id >= 49")  # a single row without a label stays in train
    assert sp.split_two(one, "label", "id").where("label is null").first()["split"] == "train"


def test_latest_row_by_date_and_time(spark):
    t = datetime.datetime
    df = spark.createDataFrame([(1, t(2020, 1, 1), 2), (1, t(2021, 1, 1), 9), (1, t(2021, 1, 1), 3), (2, t(2019, 1, 1), 1), (None, t(2019, 1, 1), 1), (3, None, 1)],
                               "k int, at timestamp, tie int")
    for order in ("at", "d", "s"):
        x = df.withColumn("d", F.to_date("at")).withColumn("s", F.col("at").cast("string"))
        assert sorted((r["k"], r["tie"]) for r in lb.latest_per_key(x, "k", order, "tie").collect()) == [(1, 3), (2, 1)]
    assert {r["k"] for r in lb.latest_per_key(df, "k", "at").collect()} == {1, 2}


def test_one_as_text_is_not_true(spark):
    df = spark.createDataFrame([("1",), ("True",), ("Y",), ("0",)], "x string")
    assert [r[0] for r in df.select(parse_bool("x")).collect()] == [False, True, True, False]
    assert df.select(parse_bool("x", extra_true=("1",))).first()[0]


@pytest.mark.parametrize("complexity", ["gzip", "shingle"])
def test_knn_null_texts_and_text_ids(spark, complexity):
    train = spark.createDataFrame([("a", "red red red red", 1), ("b", None, 0), ("c", "blue blue blue", 2)], "id string, text string, label int")
    test = spark.createDataFrame([("x", "red red red", 1), ("y", None, 0)], "id string, text string, label int")
    got = {r["test_id"]: r["train_id"] for r in knn.neighbours(train, test, 1, complexity).collect()}
    assert got["x"] == "a" and set(got) == {"x", "y"}


def test_gzip_knn_report_against_plain_python(spark):
    import zlib
    words = ["sun moon star", "cat dog cow", "sun star star", "dog dog cat", "moon moon sun", "cow cat dog"]
    rows = [(i, f"{words[i % 6]} {words[(i * 5) % 6]}", i % 2) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    train, valid, test = df.where("id < 12"), df.where("id between 12 and 17"), df.where("id > 17")
    tuning, pred, report = evaluate_knn(train, valid, test, ks=[1, 3])
    size = lambda s: len(zlib.compress(s.encode(), 9, 31))

    def predict(text, k):
        d = sorted(((size(text + " " + t) - min(size(text), size(t))) / max(size(text), size(t)), i, y) for i, t, y in rows if i < 12)[:k]
        votes = {}
        for dist, _, y in d:
            n, s = votes.get(y, (0, 0.0))
            votes[y] = (n + 1, s + dist)
        return min(votes, key=lambda y: (-votes[y][0], votes[y][1], y))

    best = [r["k"] for r in tuning.collect() if r["best"]][0]
    assert {r["id"]: r["y_pred"] for r in pred.collect()} == {i: predict(t, best) for i, t, _ in rows if i > 17}
    assert report.count() > 0


def test_text_classifier_fits_and_beats_the_majority(spark):
    rows = [(i, ("good fine nice " if i % 3 else "bad poor sad ") * 3 + f"w{i % 7}", int(bool(i % 3))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = mo.train_text_classifier(df.where("doc_id < 60"), max_iter=20)
    got = mo.score(model, df.where("doc_id >= 60"), id_col="doc_id").collect()
    assert all(r["y_true"] == r["y_pred"] and 0.5 < r["confidence"] <= 1 for r in got) and len(got) == 30
    assert classification_report(mo.score(model, df, id_col="doc_id")).count() > 0


def test_sources_defaults(spark):
    base = scratch_path(spark, "nested")
    df = spark.createDataFrame([(1, "one"), (2, "two")], "id int, text string")
    io.write_delimited(df, f"{base}/train")
    io.write_delimited(df.where("id = 1"), f"{base}/test")
    assert io.read_dir(spark, f"{base}/train").count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_dir(spark, base)
    assert io.read_dir(spark, base, recursive=True).count() == 3
    assert sorted(r["text"] for r in read_corpus(spark, "unknown", f"{base}/train").collect()) == ["one", "two"]
    assert io.read_delimited(spark, f"{base}/train", multiline=False).count() == 2


def test_no_local_scratch_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
