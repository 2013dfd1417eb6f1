r"""Exact repeat removal by distributed bucket-pointer refinement of suffixes.

Every byte covered by a string of ``LENGTH`` = 100 bytes that also starts earlier (smaller doc_id, or earlier in the same
document) is removed.  Matches never cross documents; strings are judged on the input.

Suffixes are put into buckets by their first q = 32 bytes and buckets are refined to depth 100 by the bucket identifiers of
later offsets.  Identifiers are names derived from content, id(p, 2k) = mix(id(p, k), id(p + k, k)), so an identifier made at
one depth is reused at the next without renumbering: 1, 2, 4, ... 32, 64 and then 100 = 64 at p and at p + 36.

Not every suffix enters a bucket.  Of the q-grams inside a 100-byte string the one with the smallest name (the first of
equals) is its anchor, so equal strings have equal anchors at equal places, and only anchors, about one position in
thirty, are dealt to buckets; an anchor stands for the run of strings that it is the anchor of.

1. Buckets of anchors by q-gram.  Inside a bucket, anchors are refined by the identifier of their whole run: all but the first
   of a class are repeats, run and all.  A bucket of a single class is settled.  A task refines its own anchors first, so a
   passage that a third of all documents share sends one row per task to its bucket.
2. The first of each class in a bucket of several classes stays open, as its run may be repeated in part.  Its bytes go to
   the bucket, and its strings are refined by their identifiers at depth 100, in sub-buckets of at most ``SUB`` runs.  What is
   first in a full sub-bucket meets the other sub-buckets' firsts in a grouped minimum.
3. Per document the removed runs are merged and the rest is hashed.

Cases: a null text is empty; texts under 100 bytes lose nothing.  Null ids come first.  Rows repeating an id are ordered by a
hash of their text; rows repeating id and text count as one document, and each gets its result.  Very long texts are
handled in runs of ``RUN`` positions.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import byte_rows, chunk_docs, whole_groups
from textlab.session import materialize

LENGTH, Q = 100, 32
SPAN = LENGTH - Q + 1  # q-grams in a string
RUN = 1 << 20
#: Runs of a bucket that are refined together, and anchors a task refines at once before dealing them.
SUB, BATCH = 4096, 1_000_000

_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
_BYTE = np.random.default_rng(65537).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x += b
    x ^= x >> _S
    x *= _B
    return x


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers at depth ``Q`` and at depth ``LENGTH`` of every position that has so many bytes."""
    h = _BYTE[data]
    for k in (1, 2, 4, 8, 16):
        h = _mix(h[:-k], h[k:])
    double = _mix(h[:-Q], h[Q:])
    rest = LENGTH - 2 * Q
    return h, _mix(double[:-rest], double[rest:])


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a text: per anchor its bucket, its run's class, the run's first start and its length."""
    out = []
    for at in range(0, len(data) - LENGTH + 1, RUN):
        h, whole = names(data[at:at + RUN + LENGTH - 1])
        v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        low, width = v, 1
        while width < SPAN:
            step = min(width, SPAN - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        own = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        last = np.concatenate([first[1:], [len(own)]]) - 1
        a = own[first]
        shape = ((a - first) << 8 | (last - first)).astype(np.uint64)
        out.append((h[a], _mix(_mix(whole[first], whole[last]), shape), first + at, last - first + 1))
    if not out:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _joined(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one document that follow each other, as one."""
    if not len(doc):
        return doc, tie, start, n
    order = np.lexsort((start, tie, doc))
    doc, tie, start, n = doc[order], tie[order], start[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + n[:-1])
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(start + n, at)
    return doc[at], tie[at], start[at], end - start[at]


_DEALT = "deal long, bucket long, class long, doc long, tie int, start long, n int"


def _deal(docs: DataFrame) -> DataFrame:
    """Anchors to their buckets; what a task itself finds repeated has no bucket and is dealt anywhere."""

    def flush(have):
        b, c, s, n, d, t = (np.concatenate(x) for x in zip(*have))
        order = np.lexsort((s, t, d, c))
        b, c, s, n, d, t = (x[order] for x in (b, c, s, n, d, t))
        again = np.zeros(len(c), bool)
        # the same place twice is a repeated row, not a repeat
        again[1:] = (c[1:] == c[:-1]) & ~((d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (s[1:] == s[:-1]))
        same = np.zeros(len(c), bool)
        same[1:] = (c[1:] == c[:-1]) & ~again[1:]
        rd, rt, rs, rn = _joined(d[again], t[again], s[again], n[again])
        keep = ~again & ~same
        free = pa.nulls(len(rd), pa.int64())
        spread = (rs.astype(np.uint64) * _A ^ rd.astype(np.uint64) * _B).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(spread), free, free, pa.array(rd), pa.array(rt, pa.int32()), pa.array(rs), pa.array(rn, pa.int32())],
            ["deal", "bucket", "class", "doc", "tie", "start", "n"])
        bucket = pa.array(b[keep].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [bucket, bucket, pa.array(c[keep].view(np.int64)), pa.array(d[keep]), pa.array(t[keep], pa.int32()), pa.array(s[keep]), pa.array(n[keep], pa.int32())],
            ["deal", "bucket", "class", "doc", "tie", "start", "n"])

    def run(it):
        have, size = [], 0
        for batch in chunk_docs(it, 256):
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text in enumerate(byte_rows(batch, "text")):
                if len(text or b"") >= LENGTH:
                    b, c, s, n = anchors(np.frombuffer(text, np.uint8))
                    have.append((b, c, s, n, np.full(len(b), ids[i]), np.full(len(b), ties[i], np.int64)))
                    size += len(b)
                if size >= BATCH:
                    yield from flush(have)
                    have, size = [], 0
        if have:
            yield from flush(have)

    return docs.select("doc", "tie", "text").mapInArrow(run, _DEALT)


def _refine(dealt: DataFrame) -> DataFrame:
    """``doc, tie, start, n, bucket, sub``: repeated runs (bucket null) and open ones."""
    buckets = dealt.repartition("deal").drop("deal").sortWithinPartitions("bucket", "class", "doc", "tie", "start")

    def run(it):
        last_b = last_c = None
        seen, waiting = 0, None  # classes of the bucket so far; its first row while it is the only class
        for batch in it:
            cols = [batch.column(i) for i in range(6)]
            free = cols[0].is_null().to_numpy(zero_copy_only=False)
            b, c = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in cols[:2])
            doc, tie, start, n = (x.to_numpy(zero_copy_only=False) for x in cols[2:])
            first = np.flatnonzero(~free)
            out = [(doc[free], tie[free], start[free], n[free], None, None)]
            if len(first):
                b, c, doc, tie, start, n = (x[first] for x in (b, c, doc, tie, start, n))
                new_b, new_c = np.ones(len(b), bool), np.ones(len(b), bool)
                new_b[1:] = b[1:] != b[:-1]
                new_b[0] = last_b is None or b[0] != last_b
                new_c[1:] = c[1:] != c[:-1]
                new_c[0] = new_b[0] or c[0] != last_c
                new_c |= new_b
                out.append((doc[~new_c], tie[~new_c], start[~new_c], n[~new_c], None, None))
                f = np.flatnonzero(new_c)
                if len(f):
                    fb, head = b[f], new_b[f]
                    at = np.maximum.accumulate(np.where(head, np.arange(len(f)), -1))
                    place = np.where(at >= 0, np.arange(len(f)) - at, np.arange(len(f)) + seen)
                    if waiting is not None and not head[0]:
                        out.append(waiting)
                    waiting = None
                    follows = np.append(fb[1:] == fb[:-1], False)
                    is_open = (place > 0) | follows
                    o = f[is_open]
                    out.append((doc[o], tie[o], start[o], n[o], b[o], place[is_open] // SUB))
                    seen = int(place[-1]) + 1
                    if not is_open[-1]:
                        z = f[-1:]
                        waiting = (doc[z], tie[z], start[z], n[z], b[z], np.zeros(1, np.int64))
                last_b, last_c = b[-1], c[-1]
            for doc_, tie_, start_, n_, b_, s_ in out:
                if len(doc_):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_), pa.array(tie_, pa.int32()), pa.array(start_), pa.array(n_, pa.int32()),
                         pa.nulls(len(doc_), pa.int64()) if b_ is None else pa.array(b_), pa.nulls(len(doc_), pa.int32()) if s_ is None else pa.array(s_, pa.int32())],
                        ["doc", "tie", "start", "n", "bucket", "sub"])

    return buckets.mapInArrow(run, "doc long, tie int, start long, n int, bucket long, sub int")


def _open_runs(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The bytes of the open runs: ``bucket, sub, doc, tie, start, data``."""
    lists = (marks.where("bucket is not null").groupBy("doc", "tie")
             .agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"), F.collect_list("bucket").alias("buckets"), F.collect_list("sub").alias("subs")))
    both = docs.select("doc", "tie", "text").join(lists.hint("merge"), ["doc", "tie"]).select("doc", "tie", "text", "starts", "ns", "buckets", "subs")

    def run(it):
        for batch in chunk_docs(it, 256):
            rows = []
            cols = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
            for text, doc, tie, starts, ns, buckets, subs in zip(byte_rows(batch, "text"), *cols):
                rows += [(b, u, doc, tie, s, text[s:s + n + LENGTH - 1]) for s, n, b, u in zip(starts, ns, buckets, subs)]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 6, types)],
                                             ["bucket", "sub", "doc", "tie", "start", "data"])

    return both.mapInArrow(run, "bucket long, sub int, doc long, tie int, start long, data binary")


def _strings(runs: DataFrame) -> DataFrame:
    """Open runs refined string by string: ``doc, tie, start, n, name``, the name being null where the repeat is settled.

    Sub-buckets are cut out of a sorted stream, so a task holds a few thousand runs at a time."""
    dealt = runs.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub")

    def settle(t: pa.Table):
        data = [np.frombuffer(x, np.uint8) for x in t.column("data").to_pylist()]
        size = np.array([len(x) for x in data])
        at = np.concatenate([[0], np.cumsum(size)])
        _, whole = names(np.concatenate(data))
        count = size - LENGTH + 1
        row = np.repeat(np.arange(len(data)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        name = whole[at[row] + within]
        bucket, sub, doc, tie, start = (t.column(c).to_numpy() for c in ("bucket", "sub", "doc", "tie", "start"))
        place = start[row] + within
        order = np.lexsort((place, tie[row], doc[row], name, sub[row], bucket[row]))
        b, u, d, k, p, w = bucket[row][order], sub[row][order], doc[row][order], tie[row][order], place[order], name[order]
        again = np.zeros(len(w), bool)
        again[1:] = (w[1:] == w[:-1]) & (b[1:] == b[:-1]) & (u[1:] == u[:-1])
        twice = np.zeros(len(w), bool)
        twice[1:] = again[1:] & (d[1:] == d[:-1]) & (k[1:] == k[:-1]) & (p[1:] == p[:-1])
        # a repeated row's copy of the first place is not a repeat
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(w))))
        again &= ~((d == d[lead]) & (k == k[lead]) & (p == p[lead]))
        rd, rk, rp, rn = _joined(d[again], k[again], p[again], np.ones(int(again.sum()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(rd), pa.array(rk, pa.int32()), pa.array(rp), pa.array(rn, pa.int32()), pa.nulls(len(rd), pa.int64())],
                                         ["doc", "tie", "start", "n", "name"])
        head = np.concatenate([[True], (b[1:] != b[:-1]) | (u[1:] != u[:-1])])
        group = np.cumsum(head) - 1
        key = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (sub[1:] != sub[:-1])]) if len(bucket) else np.empty(0, bool)
        runs_in = np.bincount(np.cumsum(key) - 1)
        wait = ~again & ~twice & ((u > 0) | (runs_in[group] >= SUB))
        if wait.any():
            yield pa.RecordBatch.from_arrays([pa.array(d[wait]), pa.array(k[wait], pa.int32()), pa.array(p[wait]),
                                              pa.array(np.ones(int(wait.sum()), np.int64), pa.int32()), pa.array(w[wait].view(np.int64))],
                                             ["doc", "tie", "start", "n", "name"])

    def run(it):
        for t in whole_groups(it, ["bucket", "sub"]):
            yield from settle(t)

    return dealt.mapInArrow(run, "doc long, tie int, start long, n int, name long")


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per input row; with ``keep_text`` also ``kept``
    (the remaining bytes) and ``spans`` (start, length of the removed runs)."""
    least = -(1 << 63)
    src = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(least)).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    repeated = src.groupBy("doc").count().where("count > 1").take(1)
    tie = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") if repeated else F.lit(0)
    src = src.withColumn("tie", tie)
    marks = materialize(_refine(_deal(src)), "marks")
    strings = materialize(_strings(_open_runs(src, marks)), "strings")
    waiting = strings.where("name is not null").select("name", F.struct("doc", "tie", "start").alias("at"))
    first = waiting.groupBy("name").agg(F.min("at").alias("first"))
    late = waiting.join(first, "name").where("at != first").select("at.doc", "at.tie", "at.start", F.lit(1).alias("n"))
    found = (marks.where("bucket is null").select("doc", "tie", "start", "n")
             .unionByName(strings.where("name is null").select("doc", "tie", "start", "n")).unionByName(late))
    spans = found.groupBy("doc", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))
    both = src.join(spans.hint("merge"), ["doc", "tie"], "left").select("doc", "text", "starts", "ns")
    extra = ", kept binary, spans array<struct<start:long,length:long>>" if keep_text else ""

    def run(it):
        for batch in chunk_docs(it, 256):
            rows = []
            for text, starts, ns in zip(byte_rows(batch, "text"), batch.column(2), batch.column(3)):
                text = text or b""
                cut, kept = [], text
                if starts.is_valid and len(starts):
                    s, n = starts.values.to_numpy(), ns.values.to_numpy()
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate((s + n + LENGTH - 1)[order])
                    new = np.concatenate([[True], s[1:] > e[:-1]])
                    begin, end = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                    cut = list(zip(begin.tolist(), end.tolist()))
                    parts, at = [], 0
                    for x, y in cut:
                        parts.append(text[at:x])
                        at = y
                    kept = b"".join([*parts, text[at:]])
                row = (len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())
                rows.append(row + ((kept, [{"start": x, "length": y - x} for x, y in cut]) if keep_text else ()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
            cols = list(zip(*rows)) if rows else [()] * (6 if keep_text else 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: 1 + len(cols)])

    out = both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
