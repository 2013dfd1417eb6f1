"""Maximal periodic runs of words by descending-LCP Kruskal.

A run is a maximal stretch of consecutive words with smallest period q, at least twice q and at least ``min_length`` long.
If it starts at s, the suffixes at s and s + q share exactly ``length - q`` words, no suffix between them shares as much
with either, and ``length - q >= max(q, min_length / 2)``.  So, document by document:

1. Words become numbers.  Positions whose word sequence of the floor length ``ceil(min_length / 2)`` is unique in its document
   can neither start a run nor lie one period after its start; a document without any other position has no run.
2. The suffixes of the other documents are sorted by prefix doubling; the ranks of every doubling give the common prefix
   (LCP) of neighbours in that order.
3. Kruskal over these neighbours by decreasing LCP, down to the floor: union-find joins the classes of suffixes that share that
   many words.  Each class keeps its positions in order.  The smaller class is inserted into the larger; two positions of
   different classes that become adjacent share exactly this LCP, and where their distance does not exceed it they seed the run
   of that period from the first of them.  A seed that could be extended to the left is part of the run seeded further left.

A task works on batches of at most ``BLOCK`` words, or one longer document; a document of n words costs O(n log^2 n).
Nothing is shuffled.

Cases: null and empty texts have no words and no runs.  Repeated rows and ids are treated row by row.  An empty table gives an
empty result.  Other columns are passed through; columns named like a result column are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import byte_rows, chunk_docs

MIN_LENGTH = 12
#: Words of the documents that are sorted together.
BLOCK = 200_000

Run = tuple[int, int, int]  # start, length, period


class Ordered:
    """Positions in order, in blocks, so that an insertion moves a bounded number of them."""

    __slots__ = ("blocks", "lows")
    WIDTH = 1024

    def __init__(self, position: int):
        self.blocks, self.lows = [[position]], [position]

    def __len__(self) -> int:
        return sum(map(len, self.blocks))

    def __iter__(self) -> Iterator[int]:
        for b in self.blocks:
            yield from b

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Insert ``x``, which must be new; the positions before and after it."""
        k = max(0, bisect_left(self.lows, x) - 1) if len(self.lows) > 1 else 0
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else (self.blocks[k - 1][-1] if k else None)
        after = block[i] if i < len(block) else (self.lows[k + 1] if k + 1 < len(self.lows) else None)
        block.insert(i, x)
        self.lows[k] = block[0]
        if len(block) > 2 * self.WIDTH:
            self.blocks[k:k + 1] = [block[:self.WIDTH], block[self.WIDTH:]]
            insort(self.lows, block[self.WIDTH])
        return before, after


def _repeating(words: np.ndarray, doc: np.ndarray, left: np.ndarray, floor: int) -> np.ndarray:
    """Documents in which some sequence of ``floor`` words occurs twice; ``left`` counts the words from here to the document's
    end.  Sequences grow from those that occur twice, so few positions take part after the first step."""
    high = int(words.max(initial=0)) + 1
    size = min(2, floor)
    at = np.flatnonzero(left >= size)
    key = doc[at] * high + words[at]
    if size == 2:
        key = key * high + words[at + 1]
    while True:
        _, which, n = np.unique(key, return_inverse=True, return_counts=True)
        again = n[which] > 1
        at, which = at[again], which[again]
        if size == floor or not len(at):
            return np.unique(doc[at])
        rank = np.full(len(words), -1)
        rank[at] = which
        step = min(size, floor - size)
        size += step
        at = at[left[at] >= size]
        at = at[rank[at + step] >= 0]
        key = rank[at] * len(words) + rank[at + step]


def neighbours(seq: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that are neighbours in order and share ``floor`` or more symbols: ``(one, other, how many)`` by decreasing
    number.  ``seq`` ends with a symbol that occurs once, and such symbols separate its documents."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    new = np.r_[True, seq[order][1:] != seq[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # first place of the group
    h, levels = 1, []
    while True:
        sizes = np.bincount(rank, minlength=n)
        at = np.flatnonzero(sizes[rank] > 1)
        if not len(at):
            break
        levels.append((h, rank))
        key = rank[at] * n + rank[at + h]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        group = rank[at]
        i = np.arange(len(at))
        first = np.r_[True, group[1:] != group[:-1]]
        part = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[at] = group + i[part][np.cumsum(part) - 1] - i[first][np.cumsum(first) - 1]
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    for h, r in levels:
        if h <= floor < 2 * h:
            near = r[a] == r[b]
            a, b = a[near], b[near]
            break
    else:
        a = b = order[:0]
    x, y = a.copy(), b.copy()
    for h, r in reversed(levels):
        same = np.where(r[x] == r[y], h, 0)
        x += same
        y += same
    lcp = x - a
    by = np.argsort(-lcp, kind="stable")
    by = by[lcp[by] >= floor]
    return a[by], b[by], lcp[by]


def runs_of(seq: np.ndarray, min_length: int = MIN_LENGTH) -> list[Run]:
    """All runs of a sequence whose documents end with symbols that occur once, ``(start, length, period)`` in order."""
    floor = -(-min_length // 2)
    one, other, shared = (x.tolist() for x in neighbours(seq, floor))
    symbol = seq.tolist()
    parent: dict[int, int] = {}
    members: dict[int, Ordered] = {}
    size: dict[int, int] = {}
    out: list[Run] = []

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b, lcp in zip(one, other, shared):
        a, b = find(a), find(b)
        if size.get(a, 1) < size.get(b, 1):
            a, b = b, a
        into = members.get(a) or members.setdefault(a, Ordered(a))
        coming = list(members.pop(b, (b,)))
        pairs, last = [], None
        for x, following in zip(coming, [*coming[1:], None]):
            before, after = into.insert(x)
            if before is not None and before != last:
                pairs.append((before, x))
            if after is not None and (following is None or after < following):
                pairs.append((x, after))
            last = x
        parent[b] = a
        size[a] = size.get(a, 1) + len(coming)
        for i, j in pairs:
            period = j - i
            if period <= lcp and period + lcp >= min_length and (i == 0 or symbol[i - 1] != symbol[j - 1]):
                out.append((i, period + lcp, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def find_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[Run]]:
    """The runs of every document, given as its words."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    words = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    chosen = _repeating(words, doc, ends[doc] - np.arange(len(words)), -(-min_length // 2))
    out: list[list[Run]] = [[] for _ in texts]
    if not len(chosen):
        return out
    # words of the chosen documents, told apart by document, each document followed by a symbol of its own
    high = len(number)
    parts = [np.r_[k * high + words[ends[d] - sizes[d]:ends[d]], len(chosen) * high + k] for k, d in enumerate(chosen)]
    starts = np.cumsum([0, *map(len, parts)])
    for start, length, period in runs_of(np.concatenate(parts), min_length):
        k = int(np.searchsorted(starts, start, side="right")) - 1
        out[chosen[k]].append((start - int(starts[k]), length, period))
    return out


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words outside repetitions: of every run only the first period is kept, unless another run drops it."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns named in ``keep``, by default all) with ``n_words``, ``runs`` (by start, then period) and
    ``collapsed``, the words without repetitions joined by one blank."""
    results = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    made = {f.name for f in results}
    fields = [f for f in docs.schema.fields if f.name not in made and (keep is None or f.name in keep)]
    schema = T.StructType([*fields, *results])
    src = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(it: Iterable[pa.RecordBatch]):
        for batch in chunk_docs(it):
            texts = [(t or b"").split() for t in byte_rows(batch, "__text")]
            runs: list[list[Run]] = []
            at, words = 0, 0
            for i, t in enumerate(texts):
                if words and words + len(t) > BLOCK:
                    runs += find_runs(texts[at:i], min_length)
                    at, words = i, 0
                words += len(t)
            runs += find_runs(texts[at:], min_length)
            cols = [pa.array(list(map(len, texts)), pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], _ARROW),
                    pa.array([b" ".join(collapse(t, r)) for t, r in zip(texts, runs)], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], schema.names)

    return src.mapInArrow(run, schema)
