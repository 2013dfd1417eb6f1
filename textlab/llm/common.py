"""Small helpers the operators of this subpackage share: held-out folds, words as
bytes, 64-bit word hashes, and connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.session import discard, materialize, ship_package

#: ``[^\x20\x09-\x0D]+`` as a Java regex; ``bytes.split()`` cuts at the same six characters.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Rows of an Arrow batch where rows carry whole texts; the default of 10,000 fills memory outside the heap.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, and keep Arrow batches small unless the session says otherwise."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id hashes as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % k


def byte_rows(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def chunk_docs(it: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterable[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that what is built from a batch stays small."""
    for batch in it:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class WordHash(dict):
    """word bytes -> 64-bit hash; the cache starts anew when it has grown to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def group_bounds(t: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal keys."""
    if not len(t):
        return []
    new = np.zeros(len(t), bool)
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = [0, *np.flatnonzero(new).tolist(), len(t)]
    return list(zip(at[:-1], at[1:]))


def whole_groups(it: Iterable[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterable[pa.Table]:
    """A partition sorted by ``keys`` as tables of about ``rows`` rows that never cut a group; a larger group comes alone
    or with few others, so groups have to be of bounded size."""
    have: list[pa.RecordBatch] = []
    size = 0
    for batch in chunk_docs(it, rows):
        have.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        t = pa.Table.from_batches(have)
        last = group_bounds(t, keys)[-1][0]
        if last:
            yield t.slice(0, last).combine_chunks()
        have = t.slice(last).to_batches()
        size = len(t) - last
    if size:
        yield pa.Table.from_batches(have).combine_chunks()


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(src long, dst long)``: ``(node, component)``, the component being its smallest node.

    Alternating large-star and small-star steps.  A step is an aggregate (a minimum per node, combined before the
    shuffle) and an equi-join, so a hub of any degree is never gathered in one task.  Every round is written to the
    shared checkpoint folder, so a lost executor repeats one round.  Self loops and repeated edges are fine; an empty
    table gives an empty result.
    """
    a, b = F.col("src"), F.col("dst")
    cur = (edges.where(a.isNotNull() & b.isNotNull() & (a != b))
           .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    cur = materialize(cur, name)
    before = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = materialize(large, name)
        last = cur
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        cur = materialize(small, name)
        discard(last, large)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (cur.groupBy("u").agg(F.min("v").alias("v"))
            .select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
