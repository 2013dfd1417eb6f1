"""Text classifiers trained epoch by epoch: validation, early stop, resumption, one label or several.

Texts become weighted hashed words once, as a written table.  An epoch is one pass over it for every block of classes: tasks
turn training rows into a gradient, cut into slices of features, and validation rows into counts per class; slices are
summed by a shuffle, each in its own group, and the driver takes one block's sum (``BLOCK`` numbers at most) for an AdamW step.  One
label per row takes a softmax over all classes, several labels a sigmoid for each.

Every epoch is written to the run's folder: the state it leads to, then its row of the log, which makes it count.  A killed run
goes on after the last epoch of its log.  Training ends by patience on the validation metric; the log is what ``early_stop`` (M11)
and ``best_checkpoint`` (M12) read, and the best epoch's weights are the model, not the last ones.

Cases: a null text has no words (its score is the bias alone).  Rows with a null label, or a label not given or seen in training, are
left out of training and validation; scoring keeps them.  Without validation rows the metric is 0 and the first epoch is the best.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.text import WORD_PATTERN, tokens
from textlab.operators.models import best_checkpoint, early_stop
from textlab.session import materialize, scratch_path

#: Numbers of one block of weights (features times classes), and features in a slice of it.
BLOCK = 1 << 23
SLICE = 1 << 12
#: Products of weights and features that a task holds at once.
CELLS = 1 << 22
BETAS, EPS = (0.9, 0.999), 1e-8


# ---------------------------------------------------------------- sums of slices

def _sum_slices(df: DataFrame, task, width: int) -> np.ndarray:
    """``task(batches)`` gives an array of ``width`` columns from the rows of a partition; their sum over all partitions."""
    def run(it: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        out, part = task(it), TaskContext.get().partitionId()
        rows = [(i // SLICE, part, out[i:i + SLICE].tobytes()) for i in range(0, len(out), SLICE) if out[i:i + SLICE].any()]
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], ["slice", "part", "data"])

    def add(slices: pd.DataFrame) -> pd.DataFrame:
        ordered = slices.sort_values("part")["data"]  # always added in the same order
        total = np.frombuffer(ordered.iloc[0], float).copy()
        for data in ordered.iloc[1:]:
            total += np.frombuffer(data, float)
        return pd.DataFrame({"slice": slices["slice"].iloc[:1], "data": [total.tobytes()]})

    parts = df.mapInArrow(run, "slice int, part int, data binary").groupBy("slice").applyInPandas(add, "slice int, data binary")
    found = {r["slice"]: np.frombuffer(r["data"], float).reshape(-1, width) for r in parts.collect()}
    empty = np.zeros((0, width))
    last = max(found, default=-1)
    return np.concatenate([found.get(i, np.zeros((SLICE, width))) for i in range(last + 1)]) if found else empty


def _rows_to(total: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([total[:n], np.zeros((n - min(n, len(total)), total.shape[1]))])


# ---------------------------------------------------------------- features

@dataclass
class Features:
    """Hashed words weighted by (1 + ln tf) * ln((n + 1) / (df + 1)), rows scaled to length 1."""

    size: int
    pattern: str
    idf: np.ndarray

    def words(self, text: str) -> Column:
        return F.transform(F.coalesce(tokens(F.col(text).cast("string"), self.pattern, lower=True), F.array().cast("array<string>")),
                           lambda w: F.pmod(F.xxhash64(w), F.lit(self.size)).cast("int"))

    def weighted(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and weights of all rows after one another, and the row of each."""
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        key, tf = np.unique(row * self.size + flat, return_counts=True)
        row, at = key // self.size, key % self.size
        value = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(np.bincount(row, value * value, minlength=len(lists)))
        return at, value / np.where(norm[row] > 0, norm[row], 1), row


def learn_features(train: DataFrame, text: str, size: int = 1 << 18, pattern: str = WORD_PATTERN) -> Features:
    """Document frequencies of the hashed words: tasks count, slices are summed."""
    raw = Features(size, pattern, np.ones(size))

    def task(it):
        seen = np.zeros((size + 1, 1))
        for batch in it:
            at, _, _ = raw.weighted(batch.column(0))
            seen[:size, 0] += np.bincount(at, minlength=size)
            seen[size] += batch.num_rows
        return seen

    counts = _rows_to(_sum_slices(train.select(raw.words(text)), task, 1), size + 1)[:, 0]
    return Features(size, pattern, np.log((counts[size] + 1) / (counts[:size] + 1)))


# ---------------------------------------------------------------- the model

@dataclass
class TextClassifier:
    """Weights (features and a bias, times classes) of the best epoch of a run, and the run's log (``epoch, loss, metric``)."""

    features: Features
    classes: list
    multilabel: bool
    weights: np.ndarray
    log: DataFrame
    best_epoch: int
    stopped_at: int | None


def _scores(features: Features, weights: np.ndarray, lists: pa.Array):
    """Scores of a batch's rows, and its features, values and rows."""
    at, value, row = features.weighted(lists)
    out = np.tile(weights[-1], (len(lists), 1))
    step = max(1, CELLS // weights.shape[1])
    for i in range(0, len(at), step):
        part = value[i:i + step, None] * weights[at[i:i + step]]
        for c in range(weights.shape[1]):
            out[:, c] += np.bincount(row[i:i + step], part[:, c], minlength=len(lists))
    return out, at, value, row


def _probabilities(scores: np.ndarray, multilabel: bool) -> np.ndarray:
    if multilabel:
        return 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pass(rows: DataFrame, features: Features, weights: np.ndarray, block: slice, multilabel: bool) -> tuple[np.ndarray, np.ndarray]:
    """One pass for a block of classes: the sum of the training rows' gradients, and per class the loss, training rows, and
    validation counts of true and false positives and false negatives."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    n, width = len(weights), weights.shape[1]

    def task(it):
        out, w = np.zeros((n + 5, width)), held.value
        for batch in it:
            scores, at, value, row = _scores(features, w, batch.column(0))
            p = _probabilities(scores, multilabel)
            truth = np.array(batch.column(1).to_pylist(), float).reshape(len(p), -1)[:, block]
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            error = (p - truth) * train[:, None]
            for c in range(width):
                out[:n - 1, c] += np.bincount(at, value * error[row, c], minlength=n - 1)
            out[n - 1] += error.sum(axis=0)
            right = np.where(truth > 0, p, 1 - p if multilabel else 1.0)
            out[n] -= (np.log(np.maximum(right, 1e-300)) * train[:, None]).sum(axis=0)
            out[n + 1] += train.sum()
            guess = p >= 0.5 if multilabel else np.arange(width) == p.argmax(axis=1)[:, None]
            for k, hit in enumerate((guess & (truth > 0), guess & (truth == 0), ~guess & (truth > 0))):
                out[n + 2 + k] += (hit & ~train[:, None]).sum(axis=0)
        return out

    total = _rows_to(_sum_slices(rows, task, width), n + 5)
    held.destroy()
    return total[:n], total[n:]


def _metric(counts: np.ndarray, metric: str) -> float:
    """``f1`` (macro over classes that occur), ``micro_f1`` or ``accuracy`` (of single labels) from counts per class."""
    tp, fp, fn = counts
    if metric == "accuracy":
        return float(tp.sum() / max(1.0, (tp + fn).sum()))
    if metric == "micro_f1":
        return float(2 * tp.sum() / max(1.0, (2 * tp + fp + fn).sum()))
    if metric != "f1":
        raise ValueError(metric)
    present = 2 * tp + fp + fn > 0
    return float(np.mean(2 * tp[present] / (2 * tp + fp + fn)[present])) if present.any() else 0.0


class _Run:
    """The folder of a run: states by epoch and class block, and the log."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        where = f"{self.path}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        if not hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(where)

    def log(self) -> DataFrame:
        return self._read("log", "epoch int, loss double, metric double, setting string")

    def add(self, epoch: int, loss: float, metric: float, setting: str) -> None:
        row = self.spark.createDataFrame([(epoch, loss, metric, setting)], "epoch int, loss double, metric double, setting string")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def save(self, epoch: int, block: int, state: np.ndarray) -> None:
        """``state`` is (3, features, classes): weights and the two moments."""
        rows = [(k, i // SLICE, state[k, i:i + SLICE].tobytes()) for k in range(3) for i in range(0, state.shape[1], SLICE)]
        df = self.spark.createDataFrame(rows, "kind int, slice int, data binary")
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/{epoch}-{block}")

    def load(self, epoch: int, block: int, width: int, kinds: int = 3) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/state/{epoch}-{block}").where(F.col("kind") < kinds).collect()
        by = {(r["kind"], r["slice"]): np.frombuffer(r["data"], float).reshape(-1, width) for r in rows}
        return np.stack([np.concatenate([by[key] for key in sorted(by) if key[0] == k]) for k in range(kinds)])


def _stopped(values: list[float], patience: int, threshold: float) -> bool:
    best, streak = -math.inf, 0
    for v in values:
        streak = 0 if v - best > threshold else streak + 1
        best = max(best, v)
    return streak >= patience


def train_classifier(train: DataFrame, valid: DataFrame, text: str = "text", label: str = "label", classes: list | None = None,
                     multilabel: bool = False, epochs: int = 50, learning_rate: float = 0.1, weight_decay: float = 0.01, patience: int = 3,
                     threshold: float = 0.01, metric: str = "f1", num_features: int = 1 << 18, pattern: str = WORD_PATTERN,
                     run_dir: str | None = None) -> TextClassifier:
    """Train on ``train``, judge every epoch on ``valid`` and return the best epoch's model (M7).

    ``label`` holds one value of ``classes`` (by default those seen in ``train``), or with ``multilabel`` a 0/1 array with a place for
    each of ``classes``.  Give the same ``run_dir``, data and settings to go on with a run that was killed."""
    spark = train.sparkSession
    run = _Run(spark, run_dir or scratch_path(spark, "training"))
    if classes is None:
        if multilabel:
            classes = list(range(int(train.agg(F.max(F.size(label))).first()[0] or 0)))
        else:
            classes = sorted(r[0] for r in train.where(F.col(label).isNotNull()).select(label).distinct().collect())
    n_classes, per = len(classes), max(1, BLOCK // (num_features + 1))
    if not n_classes:
        raise ValueError("no classes to learn")
    if not multilabel and n_classes > per:
        raise ValueError(f"a softmax over {n_classes} classes needs at most {BLOCK // n_classes - 1} features")
    features = learn_features(train, text, num_features, pattern)
    if multilabel:
        truth = F.when(F.size(label) == n_classes, F.col(label).cast("array<int>"))
    else:
        place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
        truth = F.when(place > 0, F.transform(F.sequence(F.lit(1), F.lit(n_classes)), lambda i: (i == place).cast("int")))
    both = train.select(features.words(text).alias("words"), truth.alias("truth"), F.lit(True).alias("train")).unionByName(
        valid.select(features.words(text).alias("words"), truth.alias("truth"), F.lit(False).alias("train")))
    rows = materialize(both.where("truth is not null"), "training-rows")

    blocks = [slice(i, min(n_classes, i + per)) for i in range(0, n_classes, per)]
    setting = json.dumps([str(classes[:100]), n_classes, multilabel, learning_rate, weight_decay, metric, num_features, pattern])
    done = sorted(run.log().collect(), key=lambda r: r["epoch"])
    if any(r["setting"] != setting for r in done):
        raise ValueError(f"{run.path} holds a run with other settings")
    values = [r["metric"] for r in done]
    if not done:
        for b, block in enumerate(blocks):
            run.save(0, b, np.zeros((3, num_features + 1, block.stop - block.start)))
    while len(values) < epochs and not _stopped(values, patience, threshold):
        epoch, loss, n, counts = len(values), 0.0, 0.0, []
        for b, block in enumerate(blocks):  # a block at a time: its weights, gradient and moments are all the driver holds
            w, m, v = run.load(epoch, b, block.stop - block.start)
            grad, seen = _pass(rows, features, w, block, multilabel)
            n = float(seen[1].max())
            grad, loss = grad / max(1.0, n), loss + float(seen[0].sum()) / max(1.0, n)
            counts.append(seen[2:])
            m, v = BETAS[0] * m + (1 - BETAS[0]) * grad, BETAS[1] * v + (1 - BETAS[1]) * grad * grad
            step = (m / (1 - BETAS[0] ** (epoch + 1))) / (np.sqrt(v / (1 - BETAS[1] ** (epoch + 1))) + EPS)
            decay = np.full((num_features + 1, 1), learning_rate * weight_decay)
            decay[-1] = 0  # not on the bias
            run.save(epoch + 1, b, np.stack([w - decay * w - learning_rate * step, m, v]))
        values.append(_metric(np.concatenate(counts, axis=1), metric))
        run.add(epoch, loss, values[-1], setting)
    log = run.log().withColumn("run", F.lit(0))
    best = int(best_checkpoint(log, "run", "epoch", "metric").first()["best_step"])
    stop = early_stop(log, "run", ["epoch"], "metric", patience=patience, threshold=threshold).first()["stop_at"]
    weights = np.concatenate([run.load(best, b, x.stop - x.start, 1)[0] for b, x in enumerate(blocks)], axis=1)
    return TextClassifier(features, classes, multilabel, weights, log.select("epoch", "loss", "metric"), best, stop["epoch"] if stop else None)


def predict(model: TextClassifier, df: DataFrame, text: str = "text", id_col: str = "id", label: str | None = "label", threshold: float = 0.5) -> DataFrame:
    """Batch scoring (M8): ``id``, ``y_true`` where there is a label, ``y_pred`` and the probability behind it.

    One label: ``y_pred`` is the likeliest class, ``confidence`` its probability.  Several: ``y_pred`` is a 0/1 array in the order of
    the classes, as the multi-label reports (E7-E12) read it, ``confidence`` the array of probabilities."""
    held = df.sparkSession.sparkContext.broadcast((model.features, model.weights))
    multilabel, classes = model.multilabel, model.classes
    fields = [T.StructField("id", df.schema[id_col].dataType)] + ([T.StructField("y_true", df.schema[label].dataType)] if label else [])
    src = df.select(F.col(id_col).alias("id"), *([F.col(label).alias("y_true")] if label else []), model.features.words(text).alias("__words"))

    def run(it: Iterable[pa.RecordBatch]):
        features, weights = held.value
        for batch in it:
            p = _probabilities(_scores(features, weights, batch.column(batch.num_columns - 1))[0], multilabel)
            if multilabel:
                out = [pa.array(list((p >= threshold).astype(np.int32)), pa.list_(pa.int32())), pa.array(list(p), pa.list_(pa.float64()))]
            else:
                best = p.argmax(axis=1)
                out = [pa.array(best.astype(np.int32)), pa.array(p.max(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], [f.name for f in fields] + ["y_pred", "confidence"])

    kinds = ("array<int>", "array<double>") if multilabel else ("int", "double")
    schema = T.StructType([*fields, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(("y_pred", "confidence"), kinds)]])
    out = src.mapInArrow(run, schema)
    if multilabel:
        return out
    named = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("y_pred") + 1)
    return out.withColumn("y_pred", named)
