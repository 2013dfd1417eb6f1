"""Training by epochs: early stop, best epoch, resumption, several labels, cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import training as tr
from textlab.operators.metrics import multilabel_report, subset_accuracy
from textlab.operators.models import baseline

WORDS = {"a": ["ash", "oak", "elm"], "b": ["cod", "eel", "ray"], "c": ["tin", "zinc", "iron"]}
SMALL = dict(num_features=1 << 10, learning_rate=0.3)


def texts(seed, n, classes="abc", noise=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.choice(classes)
        rows.append((i, " ".join([rng.choice(WORDS[c]) for _ in range(4)] + [f"w{rng.randrange(40)}" for _ in range(noise)]), c))
    return rows


@pytest.fixture(scope="module")
def sides(spark):
    return [spark.createDataFrame(texts(s, n), "id long, text string, label string") for s, n in ((1, 240), (2, 90), (3, 120))]


def accuracy(df):
    return df.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0]


def test_learns_stops_and_beats_the_baseline(spark, sides):
    train, valid, test = sides
    model = tr.train_classifier(train, valid, epochs=30, patience=3, **SMALL)
    log = [r for r in model.log.orderBy("epoch").collect()]
    assert model.classes == ["a", "b", "c"] and [r.epoch for r in log] == list(range(len(log))) and len(log) < 30
    assert model.stopped_at == log[-1].epoch and log[model.best_epoch].metric == max(r.metric for r in log)
    assert log[-1].loss < log[0].loss
    got = accuracy(tr.predict(model, test))
    base = accuracy(baseline(train, test, "most_frequent"))
    assert got > 0.95 > base + 0.3


def test_gradient_against_differences(spark, sides):
    """The summed gradient is the derivative of the loss, for both kinds of output."""
    train = sides[0].limit(30)
    features = tr.learn_features(train, "text", 64)
    rng = np.random.default_rng(1)
    w = rng.normal(size=(65, 3)) * 0.3
    place = F.array_position(F.array(*[F.lit(c) for c in "abc"]), F.col("label"))
    truth = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (i == place).cast("int"))
    rows = train.select(features.words("text").alias("words"), truth.alias("truth"), F.lit(True).alias("train")).cache()
    for multilabel in (False, True):
        def loss(w):
            return tr._pass(rows, features, w, slice(0, 3), multilabel)[1][0].sum()
        grad = tr._pass(rows, features, w, slice(0, 3), multilabel)[0]
        for i, c in ((64, 0), (int(np.abs(grad[:64, 1]).argmax()), 1)):
            d = np.zeros_like(w)
            d[i, c] = 1e-5
            assert grad[i, c] == pytest.approx((loss(w + d) - loss(w - d)) / 2e-5, rel=1e-4, abs=1e-6)


def test_a_killed_run_goes_on(spark, sides, tmp_path, monkeypatch):
    train, valid, _ = sides
    whole = tr.train_classifier(train, valid, epochs=5, patience=99, **SMALL)
    add = tr._Run.add

    def dies(self, epoch, *rest):
        if epoch == 3:
            raise KeyboardInterrupt  # after its state, before its log
        add(self, epoch, *rest)

    monkeypatch.setattr(tr._Run, "add", dies)
    with pytest.raises(KeyboardInterrupt):
        tr.train_classifier(train, valid, epochs=5, patience=99, run_dir=f"{tmp_path}/run", **SMALL)
    passes = []
    monkeypatch.setattr(tr._Run, "add", lambda self, epoch, *rest: passes.append(epoch) or add(self, epoch, *rest))
    again = tr.train_classifier(train, valid, epochs=5, patience=99, run_dir=f"{tmp_path}/run", **SMALL)
    assert passes == [3, 4]
    assert np.allclose([tuple(r) for r in again.log.orderBy("epoch").collect()], [tuple(r) for r in whole.log.orderBy("epoch").collect()])
    assert np.allclose(again.weights, whole.weights)
    with pytest.raises(ValueError, match="other settings"):
        tr.train_classifier(train, valid, run_dir=f"{tmp_path}/run", **SMALL | {"learning_rate": 0.1})


def multi(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = [int(rng.random() < 0.4) for _ in "abc"]
        words = [w for c, h in zip("abc", hot) if h for w in rng.choices(WORDS[c], k=4)] + [f"w{rng.randrange(40)}" for _ in range(5)]
        rows.append((i, " ".join(words), hot))
    return spark.createDataFrame(rows, "id long, text string, label array<int>")


def test_several_labels_in_blocks(spark, monkeypatch):
    train, valid, test = (multi(spark, s, n) for s, n in ((5, 300), (6, 80), (7, 120)))
    one = tr.train_classifier(train, valid, multilabel=True, epochs=3, patience=99, metric="micro_f1", **SMALL)
    with monkeypatch.context() as m:
        m.setattr(tr, "BLOCK", 2 * 1025)  # two classes at a time
        two = tr.train_classifier(train, valid, multilabel=True, epochs=3, patience=99, metric="micro_f1", **SMALL)
    assert np.allclose(one.weights, two.weights) and one.weights.shape == (1025, 3)
    two = tr.train_classifier(train, valid, multilabel=True, epochs=30, patience=99, metric="micro_f1", **SMALL | {"learning_rate": 0.6})
    pred = tr.predict(two, test)
    assert pred.schema["y_pred"].dataType.simpleString() == "array<int>"
    assert subset_accuracy(pred).first()[0] > 0.85
    report = {r.label: r for r in multilabel_report(pred).collect()}
    assert report["micro avg"].f1 > 0.95 and {"0", "1", "2", "samples avg"} <= report.keys()


def test_cases(spark):
    schema = "id long, text string, label int, words string, truth string, y_pred string"
    rows = [(1, None, 0), (2, "", 1), (3, "x " * 50_000, 0), (None, "ash oak", 1), (5, "ash", None), (5, "cod", 0), (5, "cod", 0)]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], schema)
    model = tr.train_classifier(df, df.where("false"), epochs=3, **SMALL)
    assert model.best_epoch == 0 and model.classes == [0, 1]
    got = tr.predict(model, df)
    assert got.count() == len(rows) and {r.y_pred for r in got.collect()} <= {0, 1} and got.where("confidence between 0 and 1").count() == len(rows)
    assert tr.predict(model, df.where("false")).collect() == []
    assert tr.predict(model, df, label=None).columns == ["id", "y_pred", "confidence"]
    with pytest.raises(ValueError, match="no classes"):
        tr.train_classifier(df.where("false"), df, **SMALL)
    with pytest.raises(ValueError, match="softmax"):
        tr.train_classifier(df, df, classes=list(range(40)), num_features=1 << 18)
