"""Language identification by multilingual mixture inference.

A language is a smoothed distribution over hashed letter trigrams, counted over every learning document.  A document is a
mixture: expectation-maximisation estimates the language proportions that explain its trigrams, and languages join the
document's set, in the order of their proportions, as long as the likelihood gained exceeds a penalty per language.

Cases: a null text or one without a letter is ``und`` with score 0.  Rows without a language teach nothing.  Ties between
languages go to the smaller name.  Without a single learning row every document is ``und``.  Very long texts are read
whole, in runs of bounded size.  Extra columns are passed through by ``identify``; its own two columns win over
columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import chunk_docs

#: Hash buckets of trigrams: with the number of languages this bounds the model (8 bytes per bucket and language).
BUCKETS = 1 << 15
#: Likelihood a further language must add, in units of log(trigrams).
PENALTY = 6.0
ROUNDS = 8
RUN = 1 << 16

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """code point -> is a letter (built once per worker)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def trigrams(text: str | None) -> np.ndarray:
    """Hashed trigrams centred on a letter; whatever is not a letter counts as one separator sign."""
    if not text:
        return np.empty(0, np.uint32)
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[c]
    c = np.where(is_letter, c, np.uint32(32))
    mid = np.flatnonzero(is_letter)
    if not len(mid):
        return np.empty(0, np.uint32)
    h = c[mid - 1] * np.uint32(0x9E3779B1) ^ c[mid] * np.uint32(0x85EBCA77) ^ c[mid + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(7)) & np.uint32(BUCKETS - 1)


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.2) -> LanguageModel:
    """Trigram counts per language over all of ``docs``.  A task sends one row per bucket and language it has seen."""

    def run(it):
        have: dict[str, np.ndarray] = {}
        for batch in chunk_docs(it, 512):
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(trigrams(text))
            for lang, ids in by_lang.items():
                have[lang] = have.get(lang, 0) + np.bincount(np.concatenate(ids), minlength=BUCKETS)
        for lang, n in have.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                                             ["lang", "bucket", "n"])

    rows = (docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
            .mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    got = rows.toArrow()
    names = got.column("lang").to_pandas()
    langs = sorted(set(names))
    counts = np.zeros((BUCKETS, max(1, len(langs))))
    if langs:
        counts[got.column("bucket").to_numpy(), names.map({x: i for i, x in enumerate(langs)}).to_numpy()] = got.column("n").to_numpy()
    p = (counts + alpha) / (counts.sum(axis=0) + alpha * BUCKETS)
    return LanguageModel(langs, np.log(p).astype(np.float32))


def _mixture(p: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of rows ``p`` (likelihoods, scaled) seen ``weight`` times."""
    pi = np.full(p.shape[1], 1 / p.shape[1], p.dtype)
    total = weight.sum()
    for _ in range(rounds):
        mix = p @ pi
        pi = pi * ((weight / mix) @ p) / total
    return pi, float(weight @ np.log(p @ pi))


def proportions(ids: np.ndarray, log_p: np.ndarray, penalty: float = PENALTY) -> np.ndarray | None:
    """Language proportions of a document's trigrams, zero outside the chosen set; None without trigrams."""
    if not len(ids):
        return None
    n = len(ids)
    if n > 2048:  # counts instead of places, so the work no longer grows with the text
        count = np.zeros(BUCKETS, np.int64)
        for i in range(0, n, RUN):
            count += np.bincount(ids[i:i + RUN], minlength=BUCKETS)
        ids = np.flatnonzero(count)
        weight = count[ids].astype(np.float64)
    else:
        weight = np.ones(n)
    lp = log_p[ids].astype(np.float64)
    single = weight @ lp
    langs = log_p.shape[1]
    out = np.zeros(langs)
    if langs == 1:
        out[0] = 1
        return out
    top = lp.max(axis=1)
    p = np.exp(lp - top[:, None])
    base = float(weight @ top)
    pi, _ = _mixture(p, weight, ROUNDS)
    order = np.argsort(-pi, kind="stable")
    chosen, best = [int(np.argmax(single))], float(single.max()) - base
    share = np.ones(1)
    for lang in order:
        if int(lang) in chosen:
            continue
        trial = chosen + [int(lang)]
        got, ll = _mixture(p[:, trial], weight, ROUNDS)
        if ll - best <= penalty * np.log(n + 1):
            break
        chosen, best, share = trial, ll, got
    out[chosen] = share
    return out


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the predicted language's proportion)."""
    langs, log_p = model.languages, model.log_p
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    src = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").cast("string").alias("lang_pred"))
    schema = T.StructType([*[src.schema[i] for i in range(len(own))], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(it):
        for batch in chunk_docs(it):
            pred, score = [], []
            for text in batch.column(len(own)).to_pylist():
                pi = proportions(trigrams(text), log_p) if langs else None
                best = int(np.argmax(pi)) if pi is not None else 0
                pred.append(langs[best] if pi is not None else "und")
                score.append(min(1.0, float(pi[best])) if pi is not None else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(own)], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [*own, "lang_pred", "score"])

    return src.mapInArrow(run, schema)
