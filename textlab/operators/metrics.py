"""Prediction metrics.

Everything derives from one aggregated table: cell counts ``(y_true, y_pred, n)``
for single-label data, per-label ``(tp, fp, fn, tn)`` for multi-label data.
Those have one row per class (pair), so the row-level work is one partial
aggregate; classification reports never bring rows to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.arrays import log_sum_exp


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def cells(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Cell counts ``(y_true, y_pred, n)`` -- the only row-level aggregate."""
    return df.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, labels: Iterable | None = None, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Long, zero-filled confusion matrix ``(y_true, y_pred, n)``.

    ``labels`` fixes the axes; pairs outside them are not counted.  Without
    it the axes are the labels seen in truth or prediction.  The label x label
    grid comes from exploding the class array twice (C^2 rows, C = classes).
    """
    c = cells(df, y_true, y_pred)
    if labels is not None:
        labels = list(labels)
        c = c.where(F.col("y_true").isin(labels) & F.col("y_pred").isin(labels))
        axis = F.array(*[F.lit(x) for x in labels])
        grid_src = df.sparkSession.range(1).select(axis.alias("_l"))
    else:
        seen = c.select(F.explode(F.array("y_true", "y_pred")).alias("l")).distinct()
        grid_src = seen.agg(F.array_sort(F.collect_list("l")).alias("_l"))
    grid = grid_src.select(F.explode("_l").alias("y_true"), "_l").select("y_true", F.explode("_l").alias("y_pred"))
    return grid.join(c, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Share of rows with ``y_true == y_pred`` (E2) -> one row ``accuracy``."""
    return df.agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"))


def per_class(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per-class ``(label, tp, predicted, support, precision, recall, f1)`` over the
    labels of truth or prediction; 0/0 -> 0 (E3)."""
    c = cells(df, y_true, y_pred)
    roles = c.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("pred"), F.col("n").alias("sup")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("pred"),
                 F.lit(0).cast("bigint").alias("sup")))).alias("r")).select("r.*")
    pc = roles.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("pred").alias("predicted"), F.sum("sup").alias("support"))
    pc = pc.withColumn("precision", _safe_div(F.col("tp"), F.col("predicted"))) \
           .withColumn("recall", _safe_div(F.col("tp"), F.col("support")))
    return pc.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _row(name: str, p: str, r: str, f: str) -> Column:
    return F.struct(F.lit(name).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                    F.col(f).alias("f1"), F.col("n").cast("bigint").alias("support"))


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Flat report, one row per class plus ``accuracy``, ``macro avg`` and
    ``weighted avg`` (E3, E4, E6) -> ``(label STRING, precision, recall, f1, support)``.
    The accuracy row repeats the accuracy in the three score columns."""
    pc = per_class(df, y_true, y_pred)
    classes = pc.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1",
                        F.col("support").cast("bigint").alias("support"))
    tot = pc.agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = F.col("tp").cast("double") / F.col("n")
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), F.col("n").cast("bigint").alias("support")),
        _row("macro avg", "mp", "mr", "mf"), _row("weighted avg", "wp", "wr", "wf"))).alias("s")).select("s.*")
    return classes.unionByName(summary)


def metric_set(labels: Iterable | None = None):
    """A metric function bound to a label list (Z5): ``metrics(df)`` -> macro F1, accuracy, the
    confusion matrix over ``labels`` and the report over all labels seen."""
    bound = None if labels is None else list(labels)

    def metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> dict[str, DataFrame]:
        return {"f1": f1(df, "macro", y_true, y_pred), "accuracy": accuracy(df, y_true, y_pred),
                "confusion": confusion(df, bound, y_true, y_pred), "report": classification_report(df, y_true, y_pred)}

    return metrics


def f1(df: DataFrame, average: str = "macro", y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """F1 with ``macro``, ``weighted`` or ``micro`` averaging (E5) -> one row ``f1``."""
    pc = per_class(df, y_true, y_pred)
    if average == "macro":
        return pc.agg(F.avg("f1").alias("f1"))
    if average == "weighted":
        return pc.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))
    if average == "micro":  # single label: every error is one FP and one FN
        t = pc.agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("p"), F.sum("support").alias("s"))
        return t.select((F.lit(2.0) * F.col("tp") / (F.col("p") + F.col("s"))).alias("f1"))
    raise ValueError(average)


# ---------------------------------------------------------------- multi-label

def _cells_long(df: DataFrame, y_true: str, y_pred: str, row_id: str | None) -> DataFrame:
    keep = [row_id] if row_id else []
    z = df.select(*keep, F.posexplode(F.arrays_zip(F.col(y_true).alias("t"), F.col(y_pred).alias("p"))).alias("label", "z"))
    return z.select(*keep, "label", F.col("z.t").alias("t"), F.col("z.p").alias("p"))


def multilabel_confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Per label ``(label, tn, fp, fn, tp)`` (E7); label = 0-based position."""
    z = _cells_long(df, y_true, y_pred, None)
    return z.groupBy("label").agg(
        F.count_if((F.col("t") == 0) & (F.col("p") == 0)).alias("tn"),
        F.count_if((F.col("t") == 0) & (F.col("p") == 1)).alias("fp"),
        F.count_if((F.col("t") == 1) & (F.col("p") == 0)).alias("fn"),
        F.count_if((F.col("t") == 1) & (F.col("p") == 1)).alias("tp"))


def _scores(tp: Column, fp: Column, fn: Column):
    p = _safe_div(tp, tp + fp)
    r = _safe_div(tp, tp + fn)
    return p, r, _f1(p, r)


def multilabel_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", row_id: str = "id",
                      axis: str = "label") -> DataFrame:
    """Multi-label report (E8): per label plus ``micro avg``, ``macro avg``,
    ``weighted avg`` and ``samples avg``.  ``axis='row'`` scores each row (E9).
    -> ``(label STRING, precision, recall, f1, support)``."""
    if axis == "row":
        z = _cells_long(df, y_true, y_pred, row_id)
        g = z.groupBy(row_id).agg(F.count_if((F.col("t") == 1) & (F.col("p") == 1)).alias("tp"),
                                  F.count_if((F.col("t") == 0) & (F.col("p") == 1)).alias("fp"),
                                  F.count_if((F.col("t") == 1) & (F.col("p") == 0)).alias("fn"))
        p, r, f = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
        return g.select(F.col(row_id).cast("string").alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        (F.col("tp") + F.col("fn")).cast("bigint").alias("support"))
    mc = multilabel_confusion(df, y_true, y_pred)
    p, r, f = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    per = mc.select(F.col("label").cast("string").alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                    (F.col("tp") + F.col("fn")).cast("bigint").alias("support"))
    t = mc.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    mp, mr, mf = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    micro = t.select(F.lit("micro avg").alias("label"), mp.alias("precision"), mr.alias("recall"), mf.alias("f1"),
                     (F.col("tp") + F.col("fn")).cast("bigint").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                    F.avg("f1").alias("f1"), F.sum("support").cast("bigint").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"),
                       *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
                       F.sum("support").cast("bigint").alias("support"))
    rows = multilabel_report(df, y_true, y_pred, row_id, axis="row")
    samples = rows.agg(F.lit("samples avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                       F.avg("f1").alias("f1"), F.sum("support").cast("bigint").alias("support"))
    return per.unionByName(micro).unionByName(macro).unionByName(weighted).unionByName(samples)


def multilabel_micro_f1(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """``2TP / (2TP + FP + FN)`` over all cells."""
    t = multilabel_confusion(df, y_true, y_pred).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return t.select(_safe_div(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def micro_auc(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Micro ROC-AUC of thresholded 0/1 predictions = (TPR + TNR) / 2."""
    t = multilabel_confusion(df, y_true, y_pred).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    tpr = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    tnr = _safe_div(F.col("tn"), F.col("tn") + F.col("fp"))
    return t.select(((tpr + tnr) / 2).alias("roc_auc"))


def subset_accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Share of rows whose whole label vector is right."""
    return df.agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("subset_accuracy"))


# ---------------------------------------------------------------- losses

def eval_loss(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Mean cross-entropy over rows; squared error when there is one output."""
    lg = F.col(logits)
    ce = log_sum_exp(lg) - F.element_at(lg, F.col(label).cast("int") + 1).cast("double")
    se = F.pow(F.element_at(lg, 1).cast("double") - F.col(label).cast("double"), 2)
    return df.agg(F.avg(F.when(F.size(lg) == 1, se).otherwise(ce)).alias("loss"))


def gaussian_kl(df: DataFrame, mu: str = "mu", std: str = "std", mu_p: str | None = None, std_p: str | None = None,
                eps: float = 1e-8) -> DataFrame:
    """Mean KL(q || p) of per-row diagonal Gaussians; std clamped at ``eps`` inside
    the logs; prior defaults to N(0, 1) (E14)."""
    k = F.size(mu)
    mp = F.col(mu_p) if mu_p else F.transform(F.col(mu), lambda x: F.lit(0.0))
    sp = F.col(std_p) if std_p else F.transform(F.col(mu), lambda x: F.lit(1.0))
    z = F.arrays_zip(F.col(mu).alias("m"), F.col(std).alias("s"), mp.alias("mp"), sp.alias("sp"))
    term = F.aggregate(z, F.lit(0.0), lambda acc, e: acc
                       + F.pow(e["s"].cast("double"), 2) / F.pow(e["sp"].cast("double"), 2)
                       + F.pow((e["mp"] - e["m"]).cast("double"), 2) / F.pow(e["sp"].cast("double"), 2)
                       + F.lit(2.0) * F.log(F.greatest(e["sp"].cast("double"), F.lit(eps)))
                       - F.lit(2.0) * F.log(F.greatest(e["s"].cast("double"), F.lit(eps))))
    return df.agg(F.avg((term - k) * F.lit(0.5)).alias("kl"))


def sampled_logits(df_long: DataFrame, row_id: str = "id", sample: str = "sample", logits: str = "logits",
                   label: str = "label") -> DataFrame:
    """Ensemble of sampled logits (E15) -> ``(row_id, label, mean_logits, loss)``:
    element-wise mean over samples, and the loss averaged over samples: squared
    error when there is one output, else cross-entropy."""
    per = df_long.select(row_id, F.posexplode(logits).alias("_pos", "_v"))
    mean_v = per.groupBy(row_id, "_pos").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    mean_arr = mean_v.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda s: s["_m"]).alias("mean_logits"))
    ce = log_sum_exp(logits) - F.element_at(F.col(logits), F.col(label).cast("int") + 1).cast("double")
    se = F.pow(F.element_at(F.col(logits), 1).cast("double") - F.col(label).cast("double"), 2)
    one = F.when(F.size(logits) == 1, se).otherwise(ce)
    loss = df_long.select(row_id, label, one.alias("_loss")).groupBy(row_id, label).agg(F.avg("_loss").alias("loss"))
    return loss.join(mean_arr, row_id)


def sampled_loss(df_long: DataFrame, row_id: str = "id", sample: str = "sample", logits: str = "logits", label: str = "label") -> DataFrame:
    """Loss of sampled logits averaged over samples, then over rows (E15) -> one row ``loss``."""
    return sampled_logits(df_long, row_id, sample, logits, label).agg(F.avg("loss").alias("loss"))


def annealed_loss(parts: DataFrame, step: str = "step", ce: str = "ce", kl: str = "kl", beta: float = 1.0, warmup: int = 0) -> DataFrame:
    """``ce + beta(step) * kl`` with beta rising linearly to ``beta`` over ``warmup`` steps
    (E14 with E15) -> input plus ``beta`` and ``loss``."""
    b = F.lit(float(beta)) if warmup <= 0 else F.least(F.lit(1.0), F.col(step) / F.lit(float(warmup))) * F.lit(float(beta))
    return parts.withColumn("beta", b).withColumn("loss", F.col(ce) + F.col("beta") * F.col(kl))
