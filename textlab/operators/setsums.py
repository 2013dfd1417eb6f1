"""Sums over all pairs of a test and a train set, gram by gram and without the pairs.

The distance of two sets is ``1 - |x and y| / max(|x|, |y|)``.  Its sum over all train sets y is their number less a sum over the grams g of
x: for the n train sets that hold g and are no larger than x, ``n / |x|``, and for the larger ones the sum of ``1 / |y|``.  Both follow from the
sizes of the sets that hold g, sorted.  Grams are dealt into buckets by their value: every block of texts sends one compressed row to a
bucket, in which a gram is once, and a bucket gives one sum per test set.  The work grows with the grams, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.blocks import packed, parts, unpacked
from textlab.operators.setsearch import sets_of

#: Characters of train texts, and so grams at most, of a bucket: 12 bytes each, several times while they are sorted.
BUCKET_CHARS = 4_000_000


def _sizes(train: DataFrame) -> tuple[int, int]:
    """Rows and characters of blocks of texts."""
    def run(it: Iterable[pa.RecordBatch]):
        for batch in it:
            for data in batch.column("data"):
                table = unpacked(data.as_py())
                yield pa.RecordBatch.from_pylist([{"n": table.num_rows, "chars": pc.sum(pc.utf8_length(table.column("text"))).as_py() or 0}])

    got = train.select("data").mapInArrow(run, "n long, chars long").agg(F.sum("n"), F.sum("chars")).first()
    return got[0] or 0, got[1] or 0


def _dealt(side: DataFrame, buckets: int, test: bool) -> DataFrame:
    """``bucket, block, data, sizes``: the grams of a block that are in a bucket, each with the sizes (``test``: the numbers) of its sets, and
    of a test block the sizes of all sets."""
    def run(it: Iterable[pa.RecordBatch]):
        for batch in it:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                sets = sets_of(unpacked(data.as_py()))
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                grams = np.concatenate(sets)
                order = np.argsort(grams)
                grams, owner = grams[order], np.repeat(np.arange(len(sets)), size)[order]
                value = (owner if test else size[owner]).astype(np.int32)
                starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
                distinct, ends = grams[starts], np.append(starts, len(grams))
                bucket = (((distinct >> 40) + (1 << 23)) * buckets) >> 24  # hashes are spread evenly; in their order
                cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
                out: dict[str, list] = {"bucket": [], "block": [], "data": [], "sizes": []}
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    of = pa.ListArray.from_arrays(pa.array(ends[a:b + 1] - ends[a], pa.int32()), pa.array(value[ends[a]:ends[b]]))
                    out["bucket"].append(int(bucket[a]))
                    out["block"].append(block if test else None)
                    out["data"].append(packed(pa.table({"g": distinct[a:b], "of": of})))
                    out["sizes"].append(size.astype(np.int32).tobytes() if test else None)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("sizes", pa.binary())]))

    return side.select("block", "data").mapInArrow(run, "bucket long, block long, data binary, sizes binary")


def _bucket(table: pa.Table) -> pa.Table:
    """``block, sums``: what the grams of a bucket add for every set of a test block."""
    def read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = unpacked(data)
        of = t.column("of").combine_chunks()
        return t.column("g").to_numpy(), of.value_lengths().to_numpy(), of.flatten().to_numpy().astype(np.int64)

    rows = list(zip(*(table.column(c).to_pylist() for c in ("block", "data", "sizes"))))
    train = [read(data) for block, data, _ in rows if block is None]
    grams = np.sort(np.concatenate([g for g, _, _ in train] + [np.zeros(0, np.int64)]))
    grams = grams[np.append(True, grams[1:] != grams[:-1])] if len(grams) else grams
    keys = np.sort(np.concatenate([(np.repeat(np.searchsorted(grams, g), n) << 32) | c for g, n, c in train] + [np.zeros(0, np.int64)]))
    starts = np.searchsorted(keys, np.arange(len(grams) + 1) << 32)
    inverse = np.append(0.0, np.cumsum(1.0 / (keys & 0xFFFFFFFF)))
    out: dict[str, list] = {"block": [], "sums": []}
    for block, data, sizes in rows:
        if block is None:
            continue
        g, n, owner = read(data)
        size = np.frombuffer(sizes, np.int32).astype(np.int64)
        at = np.searchsorted(grams, g)
        held = at < len(grams)
        held[held] = grams[at[held]] == g[held]
        at, owner = np.repeat(at[held], n[held]), owner[np.repeat(held, n)]
        up_to = np.searchsorted(keys, (at << 32) | size[owner], side="right")
        add = (up_to - starts[at]) / size[owner] + (inverse[starts[at + 1]] - inverse[up_to])
        out["block"].append(block)
        out["sums"].append(np.bincount(owner, add, len(size)).astype(np.float64).tobytes())
    return pa.table(out, pa.schema([("block", pa.int64()), ("sums", pa.binary())]))


def summed(train: DataFrame, test: DataFrame, it: str) -> DataFrame:
    """Blocks of texts of both sides -> ``(test_id, n, dsum)``: for every test row the number of train rows and its distances to them, added up."""
    total, chars = _sizes(train)
    buckets = max(1, -(-chars // BUCKET_CHARS))
    dealt = _dealt(train, buckets, False).unionByName(_dealt(test, buckets, True))
    sums = dealt.repartition(min(buckets, parts(train)), "bucket").groupBy("bucket").applyInArrow(_bucket, "block long, sums binary")

    def add(table: pa.Table) -> pa.Table:
        every = [np.frombuffer(s, np.float64) for s in table.column("sums").to_pylist()]
        return pa.table({"block": table.column("block")[:1], "sums": pa.array([np.sum(every, axis=0).tobytes()], pa.binary())})

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for data, s in zip(batch.column("data"), batch.column("sums")):
                ids, less = unpacked(data.as_py()).column("id").combine_chunks(), np.frombuffer(s.as_py(), np.float64)
                yield pa.RecordBatch.from_arrays([ids, pa.array([total] * len(less), pa.int64()), pa.array(total - less)], ["test_id", "n", "dsum"])

    per_block = sums.groupBy("block").applyInArrow(add, "block long, sums binary")
    out = test.join(per_block, "block").select("data", "sums").mapInArrow(run, f"test_id {it}, n long, dsum double")
    return out if total else out.where("false")
