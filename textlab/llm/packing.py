"""Best-fit packing planned on the length histogram.

1. Every document becomes token ids, then the end id; only documents longer than a sequence are cut, into full pieces
   and a rest.  A piece is one small row: its place, length and the CRC of its ids.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver.  Best-fit decreasing runs over counts:
   equal lengths are placed together into runs of sequences with equal free space, tightest space first, which is what
   placing them one by one would do.  The plan has a few rows per length, however many documents there are.
3. Pieces are ranked within their length by a bucketed prefix (a length holding a third of all pieces is spread over
   many tasks) and take the slot that the plan has for (length, rank).

Cases: a null or empty text is the end id alone.  Repeated rows are packed row by row.  An empty table packs into nothing.
Very long texts are encoded whole.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import byte_rows, chunk_docs
from textlab.llm.ranking import running_total
from textlab.session import materialize

CAPACITY = 4096
END_ID = 1
#: Pre-token pattern of a tokenizer that drops white space and encodes each white-space run's words on their own.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts in which every step of such a tokenizer is known: Latin-1 letters, digits, and ASCII signs without apostrophes.
_PLAIN = regex.compile(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
_PART = regex.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _byte_signs() -> dict[int, str]:
    """Byte -> sign of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on."""
    out, other = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + other)
            other += 1
    return out


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    A tokenizer that drops white space and never looks beyond it is run once per distinct word and remembered;
    any other tokenizer encodes the whole text."""

    def __init__(self, path: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = self._drops_space(spec)
        self.signs = str.maketrans(_byte_signs())
        self.parts: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.limit = limit

    @staticmethod
    def _drops_space(spec: dict) -> bool:
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"]
                and pre[0]["pattern"].get("Regex") == _WORD_PATTERN and pre[0]["invert"] and pre[0]["behavior"] == "Removed"
                and not pre[1]["add_prefix_space"])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, s: str) -> bytes:
        ids = self.parts.get(s)
        if ids is None:
            signs = s if s.isascii() else s.encode().decode("latin-1").translate(self.signs)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(signs)], "<u4").tobytes()
            if len(self.parts) >= self.limit:
                self.parts.clear()
            self.parts[s] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        s = word.decode().lower()
        plain = len(word) <= 64 and "<|" not in s and _PLAIN.fullmatch(s)
        ids = b"".join(map(self._part, _PART.findall(s))) if plain else self._whole(word.decode())
        if len(word) <= 64:
            if len(self.words) >= self.limit:
                self.words.clear()
            self.words[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if not self.by_word:
            return self._whole(text.decode())
        known, word = self.words.get, self._word
        if b"<|" in text:  # special tokens are matched before letters become small: such words stay as they are
            words = [w if b"<|" in w else w.lower() for w in text.split()]
        else:
            words = text.lower().split()
        return b"".join([known(w) or word(w) for w in words])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file, so that words stay remembered between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian 32-bit) of every document."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(it):
        enc = encoder(path)
        for batch in chunk_docs(it, 512):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_rows(batch, "text")):
                ids = enc.ids(text or b"") + end
                for i, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), *[part] * keep_ids))
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return src.mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, sequence_from, per, used).

    Ranks ``rank_from .. rank_to - 1`` of a length go, ``per`` to a sequence, to the sequences from ``sequence_from`` on,
    each of which has ``used`` tokens before them."""
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    out, opened = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[i]
            else:
                space, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            per = space // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, rank + full * per, first, per, capacity - space))
                put(space - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:
                out.append((length, rank, rank + left, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(space, first + full, n - full)
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: its columns, ``sequence_id`` and ``offset``."""
    cut = materialize(pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = sorted(plan(histogram, capacity))
    slots = np.array(rows or [(0, 0, 0, 0, 1, 0)], np.int64)
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = running_total(cut, ["length"], key, F.lit(1), sum(histogram.values()), "rank")
    own = cut.columns
    names = [*own, "sequence_id", "offset"]

    def run(it: Iterable[pa.RecordBatch]):
        at_most = int(slots[:, 2].max()) + 1
        starts = slots[:, 0] * at_most + slots[:, 1]
        for batch in it:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            s = slots[np.searchsorted(starts, length * at_most + rank, side="right") - 1] if len(rank) else slots[:0]
            j = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in own],
                 pa.array(s[:, 3] + j // s[:, 4], pa.int64()), pa.array(s[:, 5] + (j % s[:, 4]) * length, pa.int64())], names)

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
