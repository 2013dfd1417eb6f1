"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is described by shares of byte kinds, word shapes,
repetition and hashed words, and encoded by a tanh layer.  Gated attention (a tanh gate times a sigmoid gate) weighs
the passages, and a logistic unit scores the weighted sum.  Only document labels are used; the attention weights are
learned with the rest by Adam on the log loss.

The network (a few thousand weights) is fitted on a bounded sample of labelled documents: at most ``SAMPLE`` of them,
chosen by a hash of the id.  Scoring is one pass over the documents without a shuffle.

Cases: a null or empty text, or one without words, is a bag of one empty passage and gets a score like any other.  Labels
that are null are left out; an id labelled several times takes its smallest label.  Without any label, or with one class
only, the score is the share of that class (0.5 without labels).  Very long texts are read whole.  Extra columns are passed
through; a column named ``score`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import WordHash, byte_rows, chunk_docs

PASSAGE = 64
#: Bound of the sample of labelled documents the network is fitted on.
SAMPLE = 8192
#: A training bag's passages are averaged with their neighbours down to this many; scoring never does that.
BAG = 256
HASHED = 32
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b";:'\"()-", b"!?", b"|", b"#*$%&<>", b"@/\\_=+[]{}~^`"]
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _chars in enumerate(_KINDS):
    _KIND[list(_chars)] = _i
GROUPS = len(_KINDS) + 1
FEATURES = GROUPS + 6 + HASHED


def passages(text: bytes | None, words: WordHash) -> np.ndarray:
    """(passages, FEATURES) of a whole text."""
    toks = (text or b"").split()
    if not toks:
        return np.zeros((1, FEATURES), np.float32)
    n = len(toks)
    count = -(-n // PASSAGE)
    of_word = np.arange(n) // PASSAGE
    lens = np.fromiter(map(len, toks), np.int64, n)
    size = np.bincount(of_word, minlength=count).astype(np.float32)
    byte = np.frombuffer(b"".join(toks), np.uint8)
    chars = np.bincount(of_word, weights=lens, minlength=count)
    kinds = np.bincount(np.repeat(of_word * GROUPS, lens) + _KIND[byte], minlength=count * GROUPS).reshape(count, GROUPS)
    ends = np.cumsum(lens)
    first, last = _KIND[byte[ends - lens]], _KIND[byte[ends - 1]]
    h = words.of(toks)
    same = np.zeros(n, bool)
    same[1:] = h[1:] == h[:-1]
    order = np.lexsort((h, of_word))
    new = np.ones(n, bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    share = lambda flag: np.bincount(of_word, weights=flag, minlength=count) / size
    hashed = np.bincount(of_word * HASHED + (h >> np.uint64(59)).astype(np.int64), minlength=count * HASHED).reshape(count, HASHED)
    out = np.empty((count, FEATURES), np.float32)
    out[:, :GROUPS] = kinds / chars[:, None]
    out[:, GROUPS] = chars / size / 10
    out[:, GROUPS + 1] = share(first == 1)
    out[:, GROUPS + 2] = share((last >= 5) & (last < GROUPS - 1))
    out[:, GROUPS + 3] = share(same)
    out[:, GROUPS + 4] = np.bincount(of_word[order], weights=new, minlength=count) / size
    out[:, GROUPS + 5] = share(lens <= 3)
    out[:, GROUPS + 6:] = hashed / size[:, None]
    return out


def _averaged(bag: np.ndarray, most: int = BAG) -> np.ndarray:
    if len(bag) <= most:
        return bag
    cuts = np.linspace(0, len(bag), most + 1).astype(int)[:-1]
    return np.add.reduceat(bag, cuts, axis=0) / np.diff([*cuts, len(bag)])[:, None]


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    constant: float = 0.5

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of the bags whose passages begin at ``starts``."""
        if self.weights is None:
            return np.full(len(starts), self.constant)
        return _forward(self.weights, (x - self.mean) / self.scale, starts)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
    e = np.tanh(x @ w["enc"] + w["enc_b"])
    t, g = np.tanh(e @ w["gate_t"]), 1 / (1 + np.exp(-(e @ w["gate_s"])))
    logit = (t * g) @ w["att"]
    a = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
    a = a / np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(e * a[:, None], starts, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))
    return {"bag": bag, "e": e, "t": t, "g": g, "a": a, "z": z, "p": p}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, starts)
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * w["out"]
    back = dz[f["bag"]]
    da = (back * f["e"]).sum(axis=1)
    dl = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
    gate = f["t"] * f["g"]
    dt, ds = dl[:, None] * w["att"] * f["g"] * (1 - f["t"] ** 2), dl[:, None] * w["att"] * gate * (1 - f["g"])
    de = (back * f["a"][:, None] + dt @ w["gate_t"].T + ds @ w["gate_s"].T) * (1 - f["e"] ** 2)
    return {"enc": x.T @ de, "enc_b": de.sum(axis=0), "gate_t": f["e"].T @ dt, "gate_s": f["e"].T @ ds, "att": gate.T @ dl,
            "out": f["z"].T @ d, "out_b": d.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 30, batch: int = 256,
          rate: float = 0.01, decay: float = 1e-3, seed: int = 11) -> AttentionModel:
    """Fit the network on bags and their 0/1 labels."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return AttentionModel(np.zeros(FEATURES), np.ones(FEATURES), None, float(labels[0]) if len(labels) else 0.5)
    bags = [_averaged(b) for b in bags]
    flat = np.concatenate(bags).astype(float)
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"enc": init(FEATURES, hidden), "enc_b": np.zeros(hidden), "gate_t": init(hidden, gates), "gate_s": init(hidden, gates),
         "att": init(gates), "out": init(hidden), "out_b": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            x = (np.concatenate([bags[j] for j in some]) - mean) / scale
            starts = np.cumsum([0, *[len(bags[j]) for j in some]])[:-1]
            step += 1
            for k, g in _gradient(w, x, starts, labels[some]).items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return AttentionModel(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id",
        sample: int = SAMPLE, **options) -> AttentionModel:
    """Fit on at most ``sample`` labelled documents, those with the smallest hash of the id."""
    key = F.xxhash64(F.lit("mil"), F.col(id_col).cast("string"))
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(id_col).agg(F.min(label_col).cast("double").alias("__y")).orderBy(key, id_col).limit(sample))
    src = (docs.select(id_col, F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), id_col)
           .select(F.col(id_col).cast("string").alias("id"), "text", F.col("__y").alias("y")))

    def run(it):
        words = WordHash()
        for batch in chunk_docs(it, 256):
            bags = [_averaged(passages(t, words)).astype("<f4").tobytes() for t in byte_rows(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], ["id", "y", "bag"])

    got = src.mapInArrow(run, "id string, y double, bag binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["bag"]))  # the fit doesn't depend on the order of tasks
    return train([np.frombuffer(r["bag"], "<f4").reshape(-1, FEATURES) for r in got], np.array([r["y"] for r in got]), **options)


def score(docs: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability of label 1."""
    own = [c for c in docs.columns if c != "score"]
    src = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").cast("string").alias("score"))
    schema = T.StructType([*[src.schema[i] for i in range(len(own))], T.StructField("score", T.DoubleType())])

    def run(it):
        words = WordHash()
        for batch in chunk_docs(it, 512):
            bags = [passages(t, words) for t in batch.column(len(own)).cast(pa.binary()).to_pylist()]
            starts = np.cumsum([0, *map(len, bags)])[:-1]
            p = model.score(np.concatenate(bags), starts) if bags else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(own)], pa.array(p, pa.float64())], [*own, "score"])

    return src.mapInArrow(run, schema)
