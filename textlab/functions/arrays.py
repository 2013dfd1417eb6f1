"""Array column functions over logits, label vectors and id sequences
(SURVEY F12-F18, Z6).  All are higher-order SQL functions: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(arr) -> Column:
    """0-based position of the first maximum."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double")))


def sigmoid_threshold(arr, threshold: float = 0.5) -> Column:
    """Element-wise ``(sigmoid(x) >= threshold)::int``."""
    return F.transform(_col(arr), lambda x: (sigmoid(x) >= F.lit(threshold)).cast("int"))


def log_sum_exp(arr) -> Column:
    """Max-shifted log-sum-exp of a numeric array."""
    a = F.transform(_col(arr), lambda x: x.cast("double"))
    m = F.array_max(a)
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return m + F.log(s)


def softmax(arr) -> Column:
    """Softmax of a numeric array."""
    a = F.transform(_col(arr), lambda x: x.cast("double"))
    lse = log_sum_exp(a)
    return F.transform(a, lambda x: F.exp(x - lse))


# Activations by name.
ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "tanh": lambda x: F.tanh(x),
    "sigmoid": sigmoid,
    "softplus": lambda x: F.when(x > 20, x).otherwise(F.log1p(F.exp(x))),
    "identity": lambda x: x,
}


def activate(arr, name: str) -> Column:
    fn = ACTIVATIONS[name]
    return F.transform(_col(arr), lambda x: fn(x.cast("double")))


def clamp(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return x


def decode_active(hot, names) -> Column:
    """Label names at the positions where a 0/1 vector is 1 (F16)."""
    names = names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names])
    pairs = F.arrays_zip(_col(hot).alias("h"), names.alias("n"))
    return F.transform(F.filter(pairs, lambda p: p["h"] == 1), lambda p: p["n"])


def sort_by_rank(labels, rank_map: Column) -> Column:
    """Sort a label array by an external rank ``MAP<label, rank>`` (F17); unknown labels last."""
    keyed = F.transform(_col(labels), lambda l: F.struct(F.coalesce(F.element_at(rank_map, l), F.lit(1 << 30)).alias("r"), l.alias("l")))
    return F.transform(F.array_sort(keyed), lambda s: s["l"])


def truncate_pad(arr, length, pad_value=0) -> Column:
    """Cut to ``length`` and right-pad with ``pad_value``."""
    a = F.slice(_col(arr), 1, length) if isinstance(length, int) else F.slice(_col(arr), F.lit(1), length)
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(a, F.array_repeat(F.lit(pad_value), F.greatest(n - F.size(a), F.lit(0))))


def attention_mask(arr, length) -> Column:
    """1 for real positions, 0 for padding, of width ``length``."""
    a = _col(arr)
    n = F.lit(length) if isinstance(length, int) else length
    real = F.least(F.size(a), n)
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.greatest(n - real, F.lit(0))))
