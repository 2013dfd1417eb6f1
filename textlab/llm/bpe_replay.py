"""Byte-level BPE by replaying the merges over a corpus of words, and decoding.

1. A text is cut into pieces by the pattern; pieces never merge with each other, so a text is the sequence of its pieces.
2. Tasks read their documents in batches of ``CORPUS`` bytes.  The distinct pieces of a batch that are not yet known, and that are not tokens as
   they stand (those keep their own rank, as in the ``tiktoken`` library), are one corpus: a flat array of byte tokens with a
   boundary after each piece.
3. An inverted index holds, for every token that some adjacent pair makes, the positions of such pairs.  Merges are applied
   over the whole corpus in rank order, each at its positions from left to right.  A merge touches only its two neighbours:
   their new pairs enter the index, the old ones are recognised as gone when their turn comes.  If a merge makes a pair of a
   lower rank (possible in vocabularies that were not trained by pairs), the rest of that piece waits until that pair is done.
4. Known pieces are remembered per worker up to ``REMEMBERED`` of them, then anew: a cache of results, no limit on the work.

A corpus of n bytes costs O(n log n), also when one piece is megabytes long.  Nothing is shuffled, and the table of ranks is
read from its file by every worker, so nothing grows with the documents.

Cases: a null or empty text has no ids and decodes to no bytes.  Repeated rows and ids are encoded row by row.  An empty table
gives an empty result.  Very long texts are encoded whole.  Other columns are passed through; a column named like the result
column is replaced.  Ids outside the vocabulary (also null ids) are an error in ``decode``; null id lists decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import chunk_docs

#: Chunks (of each of two generations) and pieces that a worker remembers between batches, and the longest of them in characters.
REMEMBERED = 120_000
LONGEST = 64
#: White space as Unicode has it, and a coarse cut for patterns whose pieces hold white space only as one leading blank or
#: alone: between these chunks such a pattern always cuts too, so each distinct chunk is cut into pieces once.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Bytes of batches whose new pieces are one corpus.
CORPUS = 3 << 20
_NONE, _EDGE, _GONE = 1 << 40, -1, -2
#: Positions of a pair from which its merges are applied together.
MANY = 12


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: a line has a token in base64 and its rank, which is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path} lacks single bytes")
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        #: ``left << 32 | right`` -> rank of the token that the pair makes, over all ways to cut a token in two
        self.pairs = {self.ranks[t[:i]] << 32 | self.ranks[t[i:]]: r for t, r in self.ranks.items()
                      for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(self.keys)
        self.keys, self.made = self.keys[order], np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[order]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs make; ``_NONE`` where there is none or a side is no token."""
        key = left << 32 | right  # negative if a side is
        if not len(self.keys):
            return np.full(len(key), _NONE)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of every word (as 32-bit numbers), merged together in rank order over an inverted index of pairs."""
    if not words:
        return []
    rank_of, ranks_of = vocabulary.pairs.get, vocabulary.ranks_of
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.r_[0, np.cumsum(sizes + 1)]
    flat = vocabulary.of_byte[np.frombuffer(b"\0".join(words) + b"\0", np.uint8)]
    flat[starts[1:] - 1] = _EDGE
    n = len(flat)
    # the same memory for single positions (array) and for many (numpy)
    tok_, nxt_, prv_, made_ = (array("q", bytes(8 * n + 8)) for _ in range(4))
    tok, nxt, prv, made = (np.frombuffer(x, np.int64) for x in (tok_, nxt_, prv_, made_))
    tok[:n], tok[n] = flat, _EDGE
    nxt[:], prv[:] = np.arange(1, n + 2), np.arange(-1, n)  # position -1 is the last one, an edge
    word = np.repeat(np.arange(len(words)), sizes + 1)
    made[:n], made[n] = ranks_of(tok[:-1], tok[1:]), _NONE  # token that the pair at a position makes

    index: dict[int, list[np.ndarray]] = {}
    single: dict[int, list[int]] = {}  # positions that entered one by one
    heap: list[int] = []

    def enter(rank: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts)):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                if r not in single:
                    heapq.heappush(heap, r)

    def enter_one(r: int, p: int) -> None:
        if r in single:
            single[r].append(p)
        else:
            single[r] = [p]
            if r not in index:
                heapq.heappush(heap, r)

    at = np.flatnonzero(made < _NONE)
    if len(at):
        enter(made[at], at)
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r, [])
        if r in single:
            parts.append(np.array(single.pop(r), np.int64))
        at = np.concatenate(parts) if len(parts) > 1 else parts[0]
        at = np.sort(at[made[at] == r])  # the others changed since they entered the index
        if len(at) >= MANY:
            # words with one such pair: their merges do not meet, and go together
            of = word[at]
            alone = np.r_[True, of[1:] != of[:-1]]
            alone[:-1] &= alone[1:]
            p, at = at[alone], at[~alone]
            q = nxt[p]
            after, before = nxt[q], prv[p]
            tok[p], tok[q], made[q], nxt[p], prv[after] = r, _GONE, _NONE, after, p
            made[p] = right = ranks_of(tok[p], tok[after])
            inner = tok[before] >= 0
            before = before[inner]
            made[before] = left = ranks_of(tok[before], tok[p[inner]])
            rank, new = np.r_[right, left], np.r_[p, before]
            made_pairs = rank < _NONE
            if made_pairs.any():
                enter(rank[made_pairs], new[made_pairs])
        wait, high = -1, r << 32
        for p in at.tolist():
            if made_[p] != r:
                continue
            if p < wait:
                enter_one(r, p)
                continue
            q = nxt_[p]
            after, before = nxt_[q], prv_[p]
            tok_[p], tok_[q], made_[q], nxt_[p], prv_[after] = r, _GONE, _NONE, after, p
            t = tok_[after]
            made_[p] = new = rank_of(high | t, _NONE) if t >= 0 else _NONE
            lowest = new
            if new < _NONE:
                enter_one(new, p)
            t = tok_[before]
            if t >= 0:
                made_[before] = new = rank_of(t << 32 | r, _NONE)
                if new < _NONE:
                    enter_one(new, before)
                    lowest = min(lowest, new)
            if lowest < r:
                wait = int(starts[word[p] + 1])
    kept = tok[:n] >= 0
    ends = (np.r_[0, np.cumsum(kept)][starts] * 4).tolist()
    ids = tok[:n][kept].astype(np.int32).tobytes()
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


class Encoder:
    """Ids of texts; chunks and pieces are remembered between batches."""

    def __init__(self, path: str, pattern: str, chunks: str | None):
        self.vocabulary = Vocabulary(path)
        self.pieces = regex.compile(pattern).findall
        self.chunks = re.compile(chunks).findall if chunks else lambda text: [text]
        self.letters = chunks == CHUNKS  # then a chunk of letters after at most one blank is a piece
        self.of_chunk: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[str, bytes] = {}
        self.of_piece: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks; pieces not seen before are one corpus for ``replay``."""
        pieces = self.pieces
        cut = [[c] if c.lstrip(" ").isalpha() and self.letters else pieces(c) for c in chunks]
        known, ranks = self.of_piece, self.vocabulary.ranks
        todo: dict[str, bytes] = {}
        for p in {p for pieces in cut for p in pieces if p not in known}:
            raw = p.encode()
            if raw in ranks:
                known[p] = ranks[raw].to_bytes(4, sys.byteorder)
            else:
                todo[p] = raw
        known.update(zip(todo, replay(list(todo.values()), self.vocabulary)))
        out = {c: b"".join([known[p] for p in pieces]) for c, pieces in zip(chunks, cut)}
        for p in todo:
            if len(p) > LONGEST:
                del known[p]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts after one another, and the offsets of each text's."""
        cut = [self.chunks(t) if t else [] for t in texts]
        words = set(chain.from_iterable(cut))
        if len(self.of_chunk) > REMEMBERED:
            self.of_chunk, self.older = {}, self.of_chunk  # what is still in use moves on
        known, older = self.of_chunk, self.older
        new = words.difference(known)
        again = new.intersection(older)
        known.update((c, older[c]) for c in again)
        new = list(new - again)
        known.update(self._learn(new))
        of = known.__getitem__
        ids = [b"".join(map(of, chunks)) for chunks in cut]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        for c in new:
            if len(c) > LONGEST:
                del known[c]
        return np.frombuffer(b"".join(ids), np.int32), ends.astype(np.int32)


class Tokens:
    """The bytes of ids."""

    def __init__(self, path: str, vocabulary: Vocabulary | None = None):
        ranks = (vocabulary or Vocabulary(path)).ranks
        self.decimal = list(map(str, range(max(ranks.values()) + 1)))
        self.row = np.full(max(ranks.values()) + 1, -1)
        self.row[list(ranks.values())] = np.arange(len(ranks))
        self.bytes = pa.array(list(ranks), pa.large_binary())

    def join(self, lists: pa.ListArray) -> pa.Array:
        """The joined bytes of every list of ids."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.dtype.kind != "i" or ids.min() < 0 or ids.max() >= len(self.row) or (self.row[ids] < 0).any()):
            raise ValueError("ids outside the vocabulary")
        taken = self.bytes.take(pa.array(self.row[ids]))
        cuts = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(taken) + 1] if len(ids) else np.zeros(1, np.int64)
        ends = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(cuts[ends].astype(np.int64)), taken.buffers()[2] or pa.py_buffer(b"")])
        return joined.cast(pa.binary())


_ENCODERS: dict[tuple, Encoder] = {}
_TOKENS: dict[str, Tokens] = {}


def encoder(path: str, pattern: str, chunks: str | None = None) -> Encoder:
    """One encoder per worker, so that chunks and pieces stay remembered between tasks."""
    key = (path, pattern, chunks)
    return _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(*key))


def corpora(it: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Batches joined until they hold ``CORPUS`` bytes: the larger a corpus, the more positions each merge has."""
    have: list[pa.RecordBatch] = []
    for batch in it:
        have.append(batch)
        if sum(b.nbytes for b in have) >= CORPUS:
            yield pa.concat_batches(have)
            have = []
    if have:
        yield pa.concat_batches(have)


def _beside(frame: DataFrame, source: Column, out: str, kind: T.DataType, keep: list[str] | None) -> tuple[DataFrame, T.StructType]:
    """The kept columns with ``source`` after them, and the schema in which the result takes its place."""
    fields = [f for f in frame.schema.fields if f.name != out and (keep is None or f.name in keep)]
    return frame.select(*[F.col(f"`{f.name}`") for f in fields], source.alias("__source")), T.StructType([*fields, T.StructField(out, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None,
           chunks: str | None = None) -> DataFrame:
    """``docs`` (its columns named in ``keep``, by default all) with the ids of every text as ``out`` (array of int)."""
    src, schema = _beside(docs, F.col(f"`{text_col}`").cast("string"), out, T.ArrayType(T.IntegerType()), keep)

    def run(it: Iterable[pa.RecordBatch]):
        enc = encoder(path, pattern, chunks)
        for batch in corpora(it):
            ids, ends = enc.batch(batch.column(batch.num_columns - 1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield from chunk_docs([pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], schema.names)])

    return src.mapInArrow(run, schema)


def decode(frame: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``frame`` with the bytes of every id list as ``out`` (binary)."""
    src, schema = _beside(frame, F.col(f"`{ids_col}`").cast("array<int>"), out, T.BinaryType(), keep)

    def run(it: Iterable[pa.RecordBatch]):
        tokens = _TOKENS.get(path) or _TOKENS.setdefault(path, Tokens(path))
        for batch in chunk_docs(it):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], tokens.join(batch.column(batch.num_columns - 1))], schema.names)

    return src.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, chunks: str | None = None) -> DataFrame:
    """``docs`` (its columns named in ``keep``, by default all) with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas)
    and ``decoded_sha256`` (of the bytes that the ids decode to): what ``encode`` and ``decode`` give, without leaving the task."""
    made = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields = [f for f in docs.schema.fields if f.name not in dict(made) and (keep is None or f.name in keep)]
    schema = T.StructType([*fields, *[T.StructField(*m) for m in made]])
    src = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text_col}`").cast("string").alias("__source"))

    def run(it: Iterable[pa.RecordBatch]):
        enc = encoder(path, pattern, chunks)
        tokens = _TOKENS.get(path) or _TOKENS.setdefault(path, Tokens(path, enc.vocabulary))
        for batch in corpora(it):
            ids, ends = enc.batch(batch.column(batch.num_columns - 1).to_pylist())
            decoded = tokens.join(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
            name = tokens.decimal.__getitem__
            digests = [hashlib.sha256(",".join(map(name, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            cols = [pa.array(np.diff(ends), pa.int64()), pa.array(digests), pa.array([hashlib.sha256(d.as_buffer()).hexdigest() for d in decoded])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], schema.names)

    return src.mapInArrow(run, schema)
