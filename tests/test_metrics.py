"""Prediction metrics against hand-computed goldens."""

import pytest

from textlab.operators import metrics as me


@pytest.fixture
def preds(spark):
    return spark.createDataFrame(list(zip(range(5), [0, 0, 1, 1, 2], [0, 1, 1, 1, 3])), "id int, y_true int, y_pred int")


def test_classification_report_golden(preds):
    rep = {r["label"]: r for r in me.classification_report(preds).collect()}
    assert [round(rep[str(c)]["f1"], 6) for c in range(4)] == [0.666667, 0.8, 0.0, 0.0]
    assert [rep[str(c)]["support"] for c in range(4)] == [2, 2, 1, 0]
    m, w = rep["macro avg"], rep["weighted avg"]
    assert (round(m["precision"], 6), round(m["recall"], 6), round(m["f1"], 6)) == (0.416667, 0.375, 0.366667)
    assert (round(w["precision"], 6), round(w["recall"], 6), round(w["f1"], 6)) == (0.666667, 0.6, 0.586667)
    assert rep["accuracy"]["f1"] == pytest.approx(0.6)


def test_micro_f1_equals_accuracy(preds):
    assert me.f1(preds, "micro").first()["f1"] == pytest.approx(me.accuracy(preds).first()["accuracy"])


def test_confusion_with_labels_drops_outside_pairs(preds):
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in me.confusion(preds, labels=[0, 1]).collect()}
    assert cm == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    full = me.confusion(preds).collect()
    assert len(full) == 16 and sum(r["n"] for r in full) == 5


def test_multilabel(spark):
    df = spark.createDataFrame([(0, [1, 0, 1], [1, 1, 0]), (1, [0, 1, 0], [0, 1, 0])], "id int, y_true array<int>, y_pred array<int>")
    mc = {r["label"]: (r["tn"], r["fp"], r["fn"], r["tp"]) for r in me.multilabel_confusion(df).collect()}
    assert mc == {0: (1, 0, 0, 1), 1: (0, 1, 0, 1), 2: (1, 0, 1, 0)}
    assert me.multilabel_micro_f1(df).first()["f1"] == pytest.approx(2 * 2 / (2 * 2 + 1 + 1))  # TP 2, FP 1, FN 1
    assert me.subset_accuracy(df).first()["subset_accuracy"] == pytest.approx(0.5)
    assert me.micro_auc(df).first()["roc_auc"] == pytest.approx((2 / 3 + 2 / 3) / 2)  # TPR 2/3, TNR 2/3
    rep = {r["label"]: r for r in me.multilabel_report(df).collect()}
    assert rep["samples avg"]["f1"] == pytest.approx((0.5 + 1.0) / 2)


def test_losses(spark):
    import math
    df = spark.createDataFrame([([0.0, 0.0], 1), ([math.log(3.0), 0.0], 0)], "logits array<double>, label int")
    expected = (math.log(2) + (math.log(4) - math.log(3))) / 2
    assert me.eval_loss(df).first()["loss"] == pytest.approx(expected)
    kl = spark.createDataFrame([([0.0], [1.0])], "mu array<double>, std array<double>")
    assert me.gaussian_kl(kl).first()["kl"] == pytest.approx(0.0, abs=1e-12)
