"""Dictionary word segmentation for unspaced scripts.

Contract (the reference calls an external segmenter): greedy longest match left to right against a caller's word table; a
character that starts no dictionary word becomes a one-character token.  Counting the tokens stays in Spark (``word_freq`` with
``tokenizer=``).

A dictionary of up to ``PATTERN_CHARS`` characters becomes a regular expression, the trie of its words, which Spark runs; one of up to
``HELD_CHARS`` is held by the tasks (``Words``).  Texts become tokens where they are read; nothing is shuffled or written.

In the plan for a larger dictionary only matches travel:

1. The dictionary's prefixes are hashed character by character into two bit tables of a fixed size, one of all prefixes and one
   of whole words.  Tasks build their part, slices are joined by a shuffle; tasks over texts get the tables (``BITS`` / 4 bytes).
2. Tasks walk all positions of their texts at once, a character a step, as long as the prefix is in the table: a hashed trie.
   Where the whole-word table says so, the span is a candidate and becomes a row.
3. Candidates are semi-joined to the dictionary, so a false hit of the tables costs a row and never a token, and the greedy walk
   runs over each text's longest spans.  Spans are keyed by the text's digest, so repeated texts are segmented once.

Cases: a null text gives null tokens, an empty text no tokens, an empty or null dictionary one-character tokens.  Repeated rows
each get their tokens.  Words longer than a text, and texts of any length, are fine.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.session import materialize

#: Characters of a dictionary, and of a word, that become a regular expression, of about four times that size.
PATTERN_CHARS, PATTERN_DEPTH = 1 << 18, 64
#: Characters of a dictionary that tasks hold; about 100 MB of Python objects.
HELD_CHARS = 1 << 22
#: First letters by which held words are found, lengths that are tried one by one, and heads whose lengths are kept.
HEAD = 4
TRIED = 8
KEPT_HEADS = 1 << 20
#: Bits of each table: 4 MB.  A million words set 3% of the bits of whole words.
BITS = 1 << 25
#: Bytes of a slice of the tables, and characters whose positions are walked together.
SLICE = 1 << 16
STEP = 1 << 20
#: Texts whose spans and tokens a task holds as Python objects.
WALKED = 32
_MIX = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _steps(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts after one another, the characters left from each position, and the texts' starts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    return code, np.repeat(ends, size) - np.arange(len(code)), ends - size


def _grow(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ (code + np.uint64(1))) * np.uint64(_MIX[0])
    return h ^ (h >> np.uint64(29))


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * np.uint64(_MIX[1])) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _tables(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of all prefixes and of whole words."""
    bits = BITS

    def run(it: Iterable[pa.RecordBatch]):
        table = np.zeros((2, bits), bool)
        for batch in it:
            code, left, starts = _steps(batch.column(0).to_pylist())
            at, h = starts, np.full(len(starts), _MIX[1], np.uint64)
            while len(at):
                h = _grow(h, code[at])
                bit = _bit(h, bits)
                table[0, bit] = True
                table[1, bit[left[at] == 1]] = True
                more = left[at] > 1
                at, h = at[more] + 1, h[more]
        for k in range(2):
            packed = np.packbits(table[k])
            parts = [i for i in range(0, len(packed), SLICE) if packed[i:i + SLICE].any()]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts), pa.int32()), pa.array([i // SLICE for i in parts], pa.int32()),
                                              pa.array([packed[i:i + SLICE].tobytes() for i in parts], pa.binary())], ["k", "slice", "bits"])

    def either(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(parts["bits"].iloc[0]), np.uint8)
        for b in parts["bits"]:
            total |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"k": parts["k"].iloc[:1], "slice": parts["slice"].iloc[:1], "bits": [total.tobytes()]})

    out = np.zeros((2, bits // 8), np.uint8)
    slices = words.mapInArrow(run, "k int, slice int, bits binary").groupBy("k", "slice").applyInPandas(either, "k int, slice int, bits binary")
    for r in slices.collect():  # at most the two tables, whatever the dictionary
        out[r["k"], r["slice"] * SLICE:r["slice"] * SLICE + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out[0], out[1]


def _has(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def _candidates(texts: list[str], prefixes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that may be words: number of the text, position, length."""
    code, left, starts = _steps(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(code))))
    found = []
    for lo in range(0, len(code), STEP):
        first = np.arange(lo, min(len(code), lo + STEP))
        h, n = np.full(len(first), _MIX[1], np.uint64), 0
        while len(first):
            n += 1
            h = _grow(h, code[first + n - 1])
            bit = _bit(h, 8 * len(prefixes))
            alive = _has(prefixes, bit)
            first, h, bit = first[alive], h[alive], bit[alive]
            hit = first[_has(whole, bit)]
            found.append((hit, np.full(len(hit), n)))
            more = left[first] > n
            first, h = first[more], h[more]
    at = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    size = np.concatenate([f[1] for f in found]) if found else at
    return owner[at], at - starts[owner[at]], size


def _walk(text: str, ends: dict[int, int]) -> list[str]:
    out, i = [], 0
    while i < len(text):
        step = ends.get(i, 1)
        out.append(text[i:i + step])
        i += step
    return out


def _walked(texts: pa.Array, at: pa.Array, size: pa.Array) -> Iterator[pa.Array]:
    """Tokens of the texts of an Arrow batch, which has thousands, a few texts at a time."""
    for j in range(0, len(texts), WALKED):
        few = zip(*(c.slice(j, WALKED).to_pylist() for c in (texts, at, size)))
        yield pa.array([None if t is None else _walk(t, dict(zip(a or (), n or ()))) for t, a, n in few], pa.list_(pa.string()))


def spans(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``_k, i, n, w`` of the spans of ``texts(_k, _t)`` that the bit tables take for words of ``words(w)``."""
    held = texts.sparkSession.sparkContext.broadcast(_tables(words))

    def run(it: Iterable[pa.RecordBatch]):
        prefixes, whole = held.value
        for batch in it:
            for i in range(0, batch.num_rows, 256):
                key, text = batch.column(0).slice(i, 256), batch.column(1).slice(i, 256).to_pylist()
                owner, at, size = _candidates(text, prefixes, whole)
                for j in range(0, len(at), STEP):
                    o, a, n = owner[j:j + STEP], at[j:j + STEP], size[j:j + STEP]
                    word = [text[x][y:y + z] for x, y, z in zip(o.tolist(), a.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([key.take(pa.array(o)), pa.array(a, pa.int32()), pa.array(n, pa.int32()), pa.array(word, pa.string())],
                                                     ["_k", "i", "n", "w"])

    return texts.mapInArrow(run, "_k string, i int, n int, w string")


def _pattern(words: Iterable[str]) -> str:
    """A regular expression whose matches are the tokens: the longest word, or any character."""
    root: dict = {}
    for w in sorted(words):
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def sub(node: dict) -> str:
        leaves = "".join(f"\\x{{{ord(c):x}}}" for c, n in node.items() if n.keys() == {""})
        ways = [f"\\x{{{ord(c):x}}}{sub(n)}" for c, n in node.items() if c and n.keys() != {""}] + ([f"[{leaves}]"] if leaves else [])
        return f"(?:{'|'.join(ways)}){'?' if '' in node else ''}"

    return f"(?s)(?:{sub(root)}|.)" if root else "(?s)."


class Words:
    """A dictionary in memory, found by the first letters at a position and the few lengths of words that begin so.

    Words of a head with many lengths are sorted: the last one not above the text, or a word that begins it, is the longest match;
    ``shorter`` is the longest other word of the head that begins a word."""

    def __init__(self, words: Iterable[str]):
        self.words = set(words)
        self.heads: dict[str, list[str]] = {}
        for w in sorted(w for w in self.words if len(w) >= HEAD):
            self.heads.setdefault(w[:HEAD], []).append(w)
        self.tried: dict[str, tuple[int, ...]] = {}  # lengths to try at a head, the longest first; none: search the sorted words
        self.shorter: dict[str, str] = {}
        self.longest: dict[str, int] = {}

    def _lengths(self, head: str) -> tuple[int, ...]:
        same = self.heads.get(head, [])
        sizes = sorted(set(map(len, same)), reverse=True)
        if len(sizes) > TRIED and head not in self.longest:
            self.longest[head], begun = sizes[0], []
            for w in same:
                while begun and not w.startswith(begun[-1]):
                    begun.pop()
                if begun:
                    self.shorter[w] = begun[-1]
                begun.append(w)
        sizes += [n for n in range(min(HEAD, len(head) + 1) - 1, 0, -1) if n == 1 or head[:n] in self.words]
        if len(self.tried) >= KEPT_HEADS:
            self.tried.clear()
        self.tried[head] = () if head in self.longest else tuple(sizes)
        return self.tried[head]

    def _search(self, text: str, i: int, head: str) -> str:
        same = self.heads[head]
        at = bisect_right(same, text[i:i + self.longest[head]])
        word = same[at - 1] if at else None
        while word is not None and not text.startswith(word, i):
            word = self.shorter.get(word)
        return word or next((head[:n] for n in range(HEAD - 1, 1, -1) if head[:n] in self.words), head[0])

    def tokens(self, text: str) -> list[str]:
        words, tried, end = self.words, self.tried, len(text)
        out, i = [], 0
        while i < end:
            head = text[i:i + HEAD]
            lengths = tried.get(head)
            if lengths is None:
                lengths = self._lengths(head)
            if lengths:
                for n in lengths:
                    word = text[i:i + n]
                    if word in words:
                        break
            else:
                word = self._search(text, i, head)
            out.append(word)
            i += len(word)
        return out


def _held(words: DataFrame):
    """Tokens by a dictionary that every task holds."""
    kept = words.sparkSession.sparkContext.broadcast([r["w"] for r in words.collect()])  # at most HELD_CHARS characters

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def tokens(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = Words(kept.value)
        for texts in it:
            for j in range(0, len(texts), WALKED):
                yield pa.array([None if t is None else held.tokens(t) for t in texts.slice(j, WALKED).to_pylist()], pa.list_(pa.string()))
            if not len(texts):
                yield pa.array([], pa.list_(pa.string()))

    return tokens


def segment(df: DataFrame, text: str, dictionary: DataFrame, out: str = "tokens") -> DataFrame:
    """Add ``out`` ARRAY<STRING>: the greedy longest-match segmentation of ``text``."""
    words = dictionary.select(F.col(dictionary.columns[0]).cast("string").alias("w")).where(F.length("w") > 0).distinct()
    words = materialize(words, "words")
    chars, longest = words.agg(F.coalesce(F.sum(F.length("w")), F.lit(0)), F.coalesce(F.max(F.length("w")), F.lit(0))).first()
    if chars <= PATTERN_CHARS and longest <= PATTERN_DEPTH:
        return df.withColumn(out, F.regexp_extract_all(F.col(text), F.lit(_pattern(r["w"] for r in words.collect())), F.lit(0)))
    if chars <= HELD_CHARS:
        return df.withColumn(out, _held(words)(F.col(text)))
    key = F.sha2(F.col(text), 256)
    texts = df.select(key.alias("_k"), F.col(text).alias("_t")).where(F.length("_t") > 0).dropDuplicates(["_k"])
    longest = spans(texts, words).join(words, "w", "left_semi").groupBy("_k", "i").agg(F.max("n").alias("n"))
    hits = longest.groupBy("_k").agg(F.collect_list(F.struct("i", "n")).alias("_spans"))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def walk_spans(it: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in it:
            yield from _walked(*batch)

    return (df.withColumn("_k", key).join(hits, "_k", "left").withColumn(out, walk_spans(F.col(text), F.col("_spans.i"), F.col("_spans.n")))
            .drop("_spans", "_k"))
