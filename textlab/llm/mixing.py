r"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes: words ``[^\x20\x09-\x0D]+`` per document and per source.  Sources in code point order, null last, weigh
   5, 2, 1, repeating.  Targets share the total by weight; a target above ``MAX_EPOCHS`` times its source's size stops
   there and the excess is shared again by weight among the others, until none is above.
2. Each source's documents are put in a seeded order.  A source's stream repeats them until the target is reached; the
   copy of a document that crosses the target is cut there, so the words taken are the target to within one word.
3. The stream is cut into blocks of about ``block_words`` words; a copy belongs to the block in which it starts.
4. Splitting tree over the output shards: the root holds the exact block quota of every source, a node deals its blocks
   to its halves by a multivariate hypergeometric draw in proportion to their shards, and a leaf is one shard.  A node's
   draw is seeded by its place in the tree, so any task recomputes it and nothing is sent around.
5. A shard takes its quota from a seeded permutation of the source's blocks, so shards are disjoint and together take
   every block once.  Copies are shuffled inside their shard by a hash.

Cases: null and empty texts have size 0 and are taken 0 words, in one copy less than none.  Repeated rows are mixed row
by row.  A null source is a source of its own, the last.  An empty table gives an empty result.  Reruns agree.  Extra
columns are passed through; the operator's own columns win over columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import WORD_RE, chunk_docs
from textlab.llm.ranking import running_total
from textlab.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK_WORDS = 1024
#: Words of an output shard; the number of shards follows the mixture's size.
SHARD_WORDS = 1 << 21
#: The generator draws from fewer than 1e9 blocks at once; block size grows beyond that.
MAX_BLOCKS = 1 << 29
OWN = ["size", "source_size", "target", "copies"]


def targets(sizes: list[int], weights: Iterable[float] = WEIGHTS, cap: float = MAX_EPOCHS) -> list[float]:
    """Target words per source, in source order; water-filling below ``cap`` times the size."""
    cycle = list(weights)
    w = np.array([cycle[i % len(cycle)] for i in range(len(sizes))], float)
    top = cap * np.array(sizes, float)
    out, open_ = np.zeros(len(sizes)), np.array(sizes) > 0
    left = float(sum(sizes))
    while open_.any():
        share = np.where(open_, w, 0) * left / w[open_].sum()
        full = open_ & (share >= top)
        if not full.any():
            return [float(x) for x in np.where(open_, share, out)]
        out[full] = top[full]
        left -= top[full].sum()
        open_ &= ~full
    return [float(x) for x in out]


@dataclass
class Plan:
    """Per source (by its rank): stream length in words and blocks; shards, seed."""

    words: np.ndarray
    blocks: np.ndarray
    block_words: int
    shards: int
    seed: int

    def bounds(self) -> np.ndarray:
        """(shards + 1, sources): the permuted block numbers each shard takes are ``bounds[s] .. bounds[s + 1]``."""
        out = np.zeros((self.shards + 1, len(self.blocks)), np.int64)
        stack = [(0, self.shards, self.blocks.astype(np.int64), np.zeros(len(self.blocks), np.int64), 1)]
        while stack:
            lo, hi, quota, start, node = stack.pop()
            out[lo], out[hi] = start, start + quota
            if hi - lo < 2:
                continue
            mid = (lo + hi) // 2
            total = int(quota.sum())
            left = np.random.default_rng([self.seed, node]).multivariate_hypergeometric(
                quota, round(total * (mid - lo) / (hi - lo)), method="marginals") if total else quota
            stack.append((lo, mid, left, start, 2 * node))
            stack.append((mid, hi, quota - left, start + left, 2 * node + 1))
        return out


def permuted(block: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """A seeded bijection of ``0 .. n - 1`` (per row its own n): a four-round Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = block.astype(np.uint64), np.ones(len(block), bool)
    size = n.astype(np.uint64)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            h = (right + np.uint64((seed * 4 + r + 1) & 0xFFFF)) * np.uint64(0x9E3779B97F4A7C15) ^ size[todo] * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
            left, right = right, left ^ ((h * np.uint64(0x165667B19E3779F9)) >> np.uint64(33)) & mask[todo]
        x[todo] = (left << half[todo]) | right
        todo[todo] = x[todo] >= size[todo]
    return x.astype(np.int64)


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: Iterable[float] = WEIGHTS,
        max_epochs: float = MAX_EPOCHS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = 7, carry: Iterable[str] = ()) -> DataFrame:
    """One row per document: id, source, ``carry`` and ``size, source_size, target, copies``.

    ``copies`` is an array of (epoch, words, shard, place): each copy the mixture takes, the words of it that are taken
    (all but for the copy at the target), its shard and its seeded place inside the shard."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long")
    keep = [c for c in dict.fromkeys([id_col, source_col, *carry]) if c not in OWN]
    sized = materialize(docs.select(*[F.col(f"`{c}`") for c in keep], size.alias("size")), "sizes")
    # one row per source reaches the driver; code point order is the order of the UTF-8 bytes
    per = sized.groupBy(source_col).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    per.sort(key=lambda r: (r[0] is None, str(r[0]).encode() if r[0] is not None else b""))
    sizes = [int(r["s"]) for r in per]
    goal = targets(sizes, weights, max_epochs)
    words = np.array([int(round(x)) for x in goal], np.int64)
    total = int(words.sum()) if len(words) else 0
    step = max(block_words, -(-total // MAX_BLOCKS))
    plan = Plan(words, -(-words // step), step, max(1, -(-total // shard_words)), seed)

    kind = sized.schema[source_col].dataType
    table = docs.sparkSession.createDataFrame(
        [(r[0], i, s, g) for i, (r, s, g) in enumerate(zip(per, sizes, goal))],
        T.StructType([T.StructField("__s", kind), T.StructField("__rank", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"))
    placed = running_total(sized, [source_col], key, F.col("size"), sum(int(r["n"]) for r in per), "__start")
    placed = placed.join(F.broadcast(table), F.col(f"`{source_col}`").eqNullSafe(F.col("__s")), "left")
    cols = [*keep, "size", "source_size", "target"]
    src = placed.select(*[F.col(f"`{c}`") for c in cols], key.alias("__key"), "__rank", "__start")
    copy = T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("words", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("place", T.LongType())])
    schema = T.StructType([*src.select(*[F.col(f"`{c}`") for c in cols]).schema, T.StructField("copies", T.ArrayType(copy))])
    sizes_, epochs = np.array(sizes or [0], np.int64), int(np.ceil(max_epochs)) + 1

    def run(it):
        bounds = plan.bounds()
        for batch in chunk_docs(it, 8192):
            take = {n: batch.column(batch.schema.get_field_index(n)) for n in ("size", "__key", "__rank", "__start")}
            n, hashed, rank, start = (take[x].to_numpy(zero_copy_only=False) for x in ("size", "__key", "__rank", "__start"))
            row = np.repeat(np.arange(len(n)), epochs)
            epoch = np.tile(np.arange(epochs), len(n))
            begin = start[row] + epoch * sizes_[rank[row]]
            used = np.minimum(n[row], np.maximum(0, plan.words[rank[row]] - begin))
            on = used > 0
            row, epoch, begin, used = row[on], epoch[on], begin[on], used[on]
            source = rank[row]
            at = permuted(begin // plan.block_words, plan.blocks[source], plan.seed)
            shard = np.empty(len(row), np.int64)
            for s in np.unique(source):
                mine = source == s
                shard[mine] = np.searchsorted(bounds[1:, s], at[mine], side="right")
            place = (hashed[row].astype(np.uint64) + epoch.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            place = (place ^ (place >> np.uint64(32))).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])
            copies = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(epoch, pa.int32()), pa.array(used, pa.int64()), pa.array(shard, pa.int32()), pa.array(place, pa.int64())],
                ["epoch", "words", "shard", "place"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(cols)], copies], [*cols, "copies"])

    return src.mapInArrow(run, schema)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: one row per copy, by shard and shuffled inside it.

    The copy cut at its source's target keeps its first words, joined by spaces; a column ``n_chars`` follows the text.
    Documents taken 0 words are left out.  Rows meet their copies by a hash of all columns, so each row takes its own, also where
    ids repeat or are null; rows equal in all columns are interchangeable."""
    names = docs.columns
    docs = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in names if "map<" not in docs.schema[c].dataType.simpleString()]))
    options["carry"] = [*options.get("carry", ()), "__row"]
    copies = (mix(docs, text_col=text_col, id_col=id_col, **options)
              .select(F.col(f"`{id_col}`").alias("__id"), F.col("__row").alias("__own"), F.explode("copies").alias("__c"))
              .select("__id", "__own", F.struct("__c.words", "__c.shard", "__c.place", "__c.epoch").alias("__c")))
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long")
    docs = docs.dropDuplicates(["__row", id_col])
    joined = docs.withColumn("__n", size).join(copies, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__own")))
    cut = F.col("__c.words") < F.col("__n")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD_RE})"), F.lit(1)), F.lit(1), F.col("__c.words").cast("int")), " ")
    joined = joined.withColumn("__text", F.when(cut, first).otherwise(text))
    cols = []
    for c in names:
        if c == text_col:
            cols.append(F.col("__text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(cut, F.length("__text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    # ranges of (shard, place): each written part holds whole stretches of shards, in their shuffled order
    order = [F.col("__c.shard"), F.col("__c.place"), F.col("__c.epoch")]
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select(*cols)
