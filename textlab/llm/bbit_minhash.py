r"""MinHash near-duplicate groups with b-bit signatures.

A document is the set of its distinct k-word shingles (words ``[^\x20\x09-\x0D]+``, A-Z lower-cased; fewer than k words:
the whole sequence).  Two documents are linked when ``100 * |A & B| >= threshold * |A | B|``; groups are the connected
components of the links.

1. Per document: the minima of ``HASHES`` hash functions.  ``BANDS`` keys of four full minima each go to candidate
   generation; of every minimum the low 4 bits are kept and packed, 16 to a long.
2. Documents with equal sets become one class (an aggregate), so thousands of copies cost one row.
3. In every band bucket each class is paired with the bucket's smallest class (minimum and equi-join; nothing is gathered).
   The bit counts of XORed signatures estimate the similarity, corrected for chance collisions; pairs estimated far
   below the threshold go, the others are confirmed on the full sets.
4. Components.  Buckets that still hold several components are compared between components, in blocks of bounded size:
   the packed signatures name the candidates, nearest first, the full sets confirm them in the same task, and only links
   that join components leave it.

A pair at similarity 0.8 misses all 28 bands of four rows with probability (1 - 0.8^4)^28, about 4e-7; the estimate's
margin of 0.26 is over six standard deviations at 0.8.

Cases: null and empty texts and texts without words have an empty set, are linked with nothing and form their own group.
Rows repeating a doc_id give one row each and share the group.  A null doc_id gets a null component, is kept, and links
nothing.  An empty table gives an empty result.  Extra columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import WordHash, byte_rows, chunk_docs, components, discard, group_bounds, whole_groups
from textlab.session import materialize

BANDS, ROWS = 28, 4
HASHES = BANDS * ROWS
#: Kept bits of a minimum, and the packed longs of a signature.
BITS = 4
LONGS = HASHES * BITS // 64
#: Allowed shortfall of an estimate before a candidate goes unconfirmed.
MARGIN = 0.26
#: Classes of a bucket that one task compares with as many others.
BLOCK = 2048
#: The same bound in shingles, for buckets of long texts.
BLOCK_SHINGLES = 2_000_000

_MULT = np.random.default_rng(20240531).integers(1 << 32, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a sequence of word hashes."""
    k = min(k, len(words))
    if not k:
        return np.empty(0, np.uint64)
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ words[i:i + n]) * _MIX[0]
        h ^= h >> np.uint64(29)
    h *= _MIX[1]
    return np.unique(h ^ (h >> np.uint64(32)))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash function; long sets in runs, so memory is bounded."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        h = shingles[None, i:i + 4096] * _MULT[:, None]
        h ^= h >> np.uint64(31)
        np.minimum(low, h.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[1]
    for j in range(ROWS):
        h = (h ^ rows[:, j]) * _MIX[0]
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def pack(low: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of each minimum, packed into longs."""
    bits = (low & np.uint64((1 << BITS) - 1)).reshape(LONGS, 64 // BITS)
    return (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal slots by bit counts, less what collides by chance."""
    ones = sum(1 << i for i in range(0, 64, BITS))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        y = x
        for s in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(y.bitwiseAND(F.lit(ones)))
    chance = 2.0 ** -BITS
    return ((HASHES - differ) / F.lit(float(HASHES)) - chance) / (1 - chance)


def signatures(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_key`` (128-bit hash of the set, null if empty), ``bands``, ``sig``."""
    schema = f"{id_col} long, n_shingles long, set_key binary, bands array<long>, sig array<long>"

    def run(it):
        words = WordHash()
        for batch in chunk_docs(it):
            out = []
            for text in byte_rows(batch, text_col):
                s = shingle_set(words.of((text or b"").lower().split()), k)
                if len(s):
                    low = minima(s)
                    out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(low), pack(low)))
                else:
                    out.append((0, None, None, None))
            n, key, bands, sig = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))],
                [id_col, "n_shingles", "set_key", "bands", "sig"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs ``(src, dst)`` whose full sets pass.  ``texts(id, text)`` has every id of the pairs once.

    The whole text travels, not its set (which is larger); one task keeps one text's set between rows."""
    both = (pairs.join(texts.select(F.col("id").alias("src"), F.col("text").alias("a")).hint("merge"), "src")
            .join(texts.select(F.col("id").alias("dst"), F.col("text").alias("b")).hint("merge"), "dst")
            .select("src", "dst", "a", "b"))

    def run(it):
        words, last, have = WordHash(), None, None
        for batch in chunk_docs(it, 256):
            src, dst = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for s, a, b in zip(src, byte_rows(batch, "a"), byte_rows(batch, "b")):
                if (s, a) != last:
                    last, have = (s, a), shingle_set(words.of(a.lower().split()), k)
                other = shingle_set(words.of(b.lower().split()), k)
                common = len(np.intersect1d(have, other, assume_unique=True))
                ok.append(100 * common >= threshold * (len(have) + len(other) - common))
            keep = [i for i, x in enumerate(ok) if x]
            yield pa.RecordBatch.from_arrays([pa.array([src[i] for i in keep], pa.int64()), pa.array([dst[i] for i in keep], pa.int64())],
                                             ["src", "dst"])

    return both.mapInArrow(run, "src long, dst long")


def _candidate_pairs(left: dict, right: dict, band: int, floor: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of left, row of right, differing slots), nearest first: pairs of different components whose estimate reaches
    ``floor`` and whose first common band is this one, so that a pair is looked at in one bucket only."""
    ones = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    most = HASHES - (floor * (1 - 2.0 ** -BITS) + 2.0 ** -BITS) * HASHES
    out = []
    for i in range(len(left["comp"])):
        near = right["comp"] != left["comp"][i]
        if same:
            near[:i + 1] = False
        j = np.flatnonzero(near)
        if not len(j):
            continue
        x = right["sig"][j] ^ left["sig"][i]
        y = x.copy()
        for s in range(1, BITS):
            y |= x >> np.uint64(s)
        d = np.bitwise_count(y & ones).sum(axis=1, dtype=np.int64)
        ok = d <= most
        j, d = j[ok], d[ok]
        if len(j):
            ok = (right["bands"][j] == left["bands"][i]).argmax(axis=1) == band
            out.append((np.full(int(ok.sum()), i), j[ok], d[ok]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none
    i, j, d = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(d, kind="stable")
    return i[order], j[order], d[order]


def _sides(t: pa.Table, start: int, end: int, cols: dict) -> tuple[dict, dict, bool]:
    """The two blocks of a group; a block paired with itself is both."""
    lo, hi = cols["lo"][start], cols["hi"][start]
    rows = np.arange(start, end)
    pick = lambda r: {"row": r, **{c: cols[c][r] for c in ("id", "comp", "sig", "bands")}}
    if lo == hi:
        one = pick(rows)
        return one, one, True
    mine = cols["mine"][rows]
    return pick(rows[mine == lo]), pick(rows[mine == hi]), False


def _columns(t: pa.Table) -> dict:
    flat = lambda c, n: t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, n)
    return {"sig": flat("sig", LONGS).view(np.uint64), "bands": flat("bands", BANDS),
            **{c: t.column(c).to_numpy() for c in ("key", "band", "lo", "hi", "mine", "id", "comp")}}


_MEMBER = "key long, band int, lo int, hi int, mine int, id long, comp long, sig array<long>, bands array<long>"
_GROUP = ["key", "band", "lo", "hi"]


def _dealt(members: DataFrame) -> DataFrame:
    """Bucket members with ``blocks`` per bucket, dealt to pairs of blocks: a group holds at most about two blocks."""
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return dealt.select("key", "band", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "comp", "sig", "bands")


def _needed(members: DataFrame, floor: float) -> DataFrame:
    """The members that have a candidate in their group."""

    def run(it):
        for t in whole_groups(it, _GROUP):
            cols, keep = _columns(t), []
            for start, end in group_bounds(t, _GROUP):
                if (cols["comp"][start:end] == cols["comp"][start]).all():
                    continue
                left, right, same = _sides(t, start, end, cols)
                i, j, _ = _candidate_pairs(left, right, int(cols["band"][start]), floor, same)
                keep += [left["row"][i], right["row"][j]]
            if keep:
                yield from t.take(pa.array(np.unique(np.concatenate(keep)))).combine_chunks().to_batches()

    return members.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, _MEMBER)


def _between(needed: DataFrame, texts: DataFrame, k: int, threshold: int, floor: float) -> DataFrame:
    """Links between components inside a group, confirmed on the full sets, nearest candidates first; components that a
    link has joined need no further one, so a group returns a forest and never its pairs."""
    both = needed.join(texts.hint("merge"), "id").select(*[f.split()[0] for f in _MEMBER.split(", ")], "text")

    def run(it):
        words = WordHash()
        for t in whole_groups(it, _GROUP, rows=2048):
            cols, src, dst = _columns(t), [], []
            texts_ = t.column("text").cast(pa.binary())
            for start, end in group_bounds(t, _GROUP):
                left, right, same = _sides(t, start, end, cols)
                root: dict[int, int] = {}
                sets: dict[int, np.ndarray] = {}

                def find(x):
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                def shingles(row):
                    if row not in sets:
                        sets[row] = shingle_set(words.of(texts_[row].as_py().lower().split()), k)
                    return sets[row]

                for i, j, _ in zip(*_candidate_pairs(left, right, int(cols["band"][start]), floor, same)):
                    x, y = find(int(left["comp"][i])), find(int(right["comp"][j]))
                    if x == y:
                        continue
                    a, b = shingles(int(left["row"][i])), shingles(int(right["row"][j]))
                    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
                        continue
                    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                    if 100 * common >= threshold * (len(a) + len(b) - common):
                        root[max(x, y)] = min(x, y)
                        src.append(int(left["id"][i]))
                        dst.append(int(right["id"][j]))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return both.repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, "src long, dst long")


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, text`` of the documents that occur in ``pairs``, written once for the two joins."""
    ids = pairs.select(F.col("src").alias("doc_id")).unionByName(pairs.select(F.col("dst").alias("doc_id"))).distinct()
    return materialize(docs.join(ids.hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = materialize(signatures(docs, k), "signatures")
    floor = threshold / 100 - MARGIN
    usable = signed.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    # one class per distinct set, named by its smallest id; an id carrying several texts is one node with several sets
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
                                            F.first("n_shingles").alias("n_shingles"))
    classes = materialize(classes, "classes")

    buckets = classes.select("id", F.posexplode("bands").alias("band", "key"))
    first = buckets.groupBy("key", "band").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub != top").select("key", "band", "hub")
    first = materialize(first, "buckets")
    star = materialize(buckets.join(first, ["key", "band"]).where("id != hub").select(F.col("hub").alias("src"), F.col("id").alias("dst")).distinct(), "star")
    texts = _texts_of(docs, star)
    near = (star.join(classes.select(F.col("id").alias("src"), F.col("sig").alias("sa")), "src")
            .join(classes.select(F.col("id").alias("dst"), F.col("sig").alias("sb")), "dst")
            .where(estimate(F.col("sa"), F.col("sb")) >= floor).select("src", "dst"))
    links = materialize(_confirm(near, texts, k, threshold), "links")
    groups = materialize(components(links), "groups")

    # buckets that still hold several components
    placed = (buckets.join(first.select("key", "band"), ["key", "band"]).join(groups, F.col("id") == F.col("node"), "left")
              .select("key", "band", "id", F.coalesce("component", "id").alias("comp")))
    sized = placed.join(classes.select("id", "n_shingles"), "id")
    mixed = (sized.groupBy("key", "band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
             .where("c1 != c2").select("key", "band", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("blocks")))
    members = placed.join(mixed, ["key", "band"]).join(classes.select("id", "sig", "bands"), "id")
    needed = materialize(_needed(_dealt(members), floor), "needed")
    if needed.take(1):
        more = materialize(_between(needed, texts, k, threshold, floor), "links")
        groups = materialize(components(links.unionByName(more)), "groups")
    discard(texts, star, first, needed)

    out = (signed.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "id"), "set_key", "left")
           .join(groups, F.col("id") == F.col("node"), "left"))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
