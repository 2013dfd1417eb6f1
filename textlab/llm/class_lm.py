r"""Language-model scoring with Brown class-based bigrams.

Tokens are words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, then one end token per text.  The model is

    P(w | previous) = P(class(w) | class(previous)) * P(w | class(w))

* Classes: the cube root of the vocabulary, ``CLASSES`` at least.
* Exchange clustering: in each round a unit moves to the class under which its neighbours and itself are likeliest.  What stands
  before and after every unit is counted once; each round reads that table, in which a unit's row is complete, with the classes
  of the others, and shuffles nothing.  Units move against the same class counts, a half of them per round.  Units of these rounds are
  the ``WORDS`` most frequent words, the end token, and the others' ``ENDINGS`` hashed endings.
* Then every other word moves by itself, by the classes before and after all its occurrences: a table keyed by word, against
  the broadcast class-by-class table.  Only words never seen in learning keep the class of their ending.
* Class transitions are smoothed towards the class frequencies.  Emissions use absolute discounting with D = n1 / (n1 +
  2 n2) from the corpus' once- and twice-seen words; the mass a class saves is its probability of a new word.

Word counts cover the whole corpus.  The ``WORDS`` most frequent words are looked up in every task (a bounded table); all others
meet their count and class in an equi-join on the word's hash, pre-aggregated per document, so no vocabulary of unbounded
size is sent to the tasks or the driver.  The model shows the classes of the ``HEAD`` most frequent words.

Cases: a null or empty text is the end token alone.  Repeated rows are counted and scored row by row.  Without learning
rows every token is unknown, the base is log10(1 / 1) = 0 a token and the model's classes are uniform.  Very long texts are
read whole.  A null id belongs to the fold of the empty text.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import chunk_docs, discard
from textlab.session import materialize

#: Classes at least.
CLASSES = 48
#: Words clustered first, hashed endings for all others meanwhile, and words whose classes the model shows.
WORDS, ENDINGS, HEAD = 8192, 1024, 1 << 16
ROUNDS = 8
#: Weight, in observations, of the class frequencies in a transition.
SMOOTH = 20.0
UNITS = 1 + ENDINGS + WORDS


def word_keys(words: pa.Array) -> np.ndarray:
    """64-bit keys of words without white space; the low bits are the word's ending, so the key alone gives the unit of a rare word."""
    words = words.cast(pa.binary())
    each = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b" ")[0].as_py().split(b" ") if len(words) else []
    ends = pc.binary_slice(words, -3).dictionary_encode()
    crc = np.fromiter(map(zlib.crc32, ends.dictionary.to_pylist()), np.uint64, len(ends.dictionary))
    key = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(words))
    return (key & ~np.uint64(ENDINGS - 1)) | (crc % np.uint64(ENDINGS))[ends.indices.to_numpy()]


class Words(dict):
    """Keys of single words, given as bytes."""

    def __missing__(self, word: bytes) -> int:
        self[word] = key = int(word_keys(pa.array([word], pa.binary()))[0])
        return key


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of the words of these texts, sorted, the key's place there of each word in the order of the texts, and the texts'
    numbers of words.  Arrow cuts and numbers the words, so Python sees each word of a batch once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    size = lists.value_lengths().fill_null(0).to_numpy()
    words = lists.flatten()
    full = pc.not_equal(words, "")  # empty ones stand before and after white space at the ends of a text
    if not pc.all(full).as_py():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[full.to_numpy(zero_copy_only=False)], minlength=len(size))
        words = words.filter(full)
    coded = words.dictionary_encode()
    kinds, place = np.unique(word_keys(coded.dictionary), return_inverse=True)
    return kinds, place[coded.indices.to_numpy()], size.astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key, n`` of every word of ``docs``, counted in the tasks first."""

    def run(it):
        have: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            k, n = _sums(have)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in chunk_docs(it, 512):
            kinds, which, _ = batch_words(batch.column(0))
            have.append((kinds, np.bincount(which, minlength=len(kinds))))
            size += len(kinds)
            if size > 2_000_000:
                yield flush()
                have, size = [], 0
        if have:
            yield flush()

    return (docs.select(F.col(f"`{text_col}`").cast("string").alias(text_col)).mapInArrow(run, "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    tokens: int  # N, with the end tokens
    types: int  # V, with the end token
    texts: int
    discount: float
    head_keys: np.ndarray  # sorted, unsigned
    head_counts: np.ndarray
    head_units: np.ndarray
    k: int = CLASSES  # number of classes
    classes: np.ndarray | None = None  # per unit
    log_transition: np.ndarray | None = None  # (previous, next), log10
    log_size: np.ndarray | None = None  # log10 of a class's tokens
    log_new: np.ndarray | None = None  # log10 of the mass saved for new words, times the class's tokens


def _vocabulary(counts: DataFrame, texts: int) -> Model:
    s = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("n1"),
                   F.sum((F.col("n") == 2).cast("long")).alias("n2")).first()
    n, v, n1, n2 = (int(x or 0) for x in s)
    head = counts.orderBy(F.desc("n"), "key").limit(HEAD).toArrow()
    keys, num = head.column("key").to_numpy().view(np.uint64), head.column("n").to_numpy()
    rank = np.lexsort((keys.view(np.int64), -num))
    unit = np.empty(len(keys), np.int64)
    unit[rank] = np.where(np.arange(len(keys)) < WORDS, 1 + ENDINGS + np.arange(len(keys)), 1 + (keys[rank] & np.uint64(ENDINGS - 1)).astype(np.int64))
    order = np.argsort(keys)
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
    return Model(n + texts, v + (texts > 0), texts, d, keys[order], num[order], unit[order], max(CLASSES, math.ceil(v ** (1 / 3))))


def unit_texts(docs: DataFrame, model: Model, held_out: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its sequence of units, with -1 - i for its i-th other word, the sums over its shown words, and its
    other words with their counts, the ``n_shown`` shown ones first."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                      held_out.alias("held_out"), F.monotonically_increasing_id().alias("row"))
    keys, num, unit = model.head_keys, model.head_counts, model.head_units
    log_known, log_base = np.log10(np.maximum(num - model.discount, 1e-9)), np.log10(num + 1.0)

    def run(it):
        for batch in chunk_docs(it, 512):
            kinds, which, size = batch_words(batch.column(1))  # each word of the batch is looked up once
            doc = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(keys, kinds), max(0, len(keys) - 1))
            shown = keys[at] == kinds if len(keys) else np.zeros(len(kinds), bool)
            own = shown.copy()
            own[shown] = unit[at[shown]] > ENDINGS

            def per_doc(values):
                at_kind = np.zeros(len(kinds))
                at_kind[shown] = values[at[shown]]
                return np.bincount(doc, at_kind[which], len(size)).astype(float)  # without a word, bincount gives whole numbers

            # other words of a text: shown ones first, each once with its count
            rest = np.flatnonzero(~own[which])
            entry, place, times = np.unique((doc[rest] * 2 + ~shown[which[rest]]) * len(kinds) + which[rest], return_inverse=True, return_counts=True)
            entry_doc, entry_kind = entry // (2 * len(kinds) or 1), entry % (len(kinds) or 1)
            ends = np.searchsorted(entry_doc, np.arange(len(size) + 1))
            n_shown = np.bincount(entry_doc, shown[entry_kind], len(size)).astype(np.int32)
            u = np.zeros(len(which), np.int64)
            u[own[which]] = unit[at[which[own[which]]]]
            u[rest] = -1 - (place - ends[doc[rest]])
            starts = np.cumsum(size) - size
            cells = []
            for i, (a, n) in enumerate(zip(starts.tolist(), size.tolist())):
                kind = "<i2" if ends[i + 1] - ends[i] <= 1 << 15 else "<i4"
                cells.append(u[a:a + n].astype(kind).tobytes() + np.zeros(1, kind).tobytes())
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (kinds[entry_kind].view(np.int64), times)]
            cols = [pa.array(cells, pa.binary()), pa.array(size), pa.array(np.bincount(doc, shown[which], len(size)).astype(np.int64)),
                    pa.array(per_doc(log_known)), pa.array(per_doc(log_base)), *lists, pa.array(n_shown)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *cols],
                                             ["doc_id", "held_out", "row", "units", "n_words", "n_head", "known", "base", "rare", "times", "n_shown"])

    return src.mapInArrow(run, "doc_id long, held_out boolean, row long, units binary, n_words long, n_head long, known double, base double, "
                               "rare array<long>, times array<long>, n_shown int")


def _tokens(batch: pa.RecordBatch, values: str = "rare") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The unit sequences of a batch one after another, the places of words without a unit, these words' entries in
    ``values``, and the lengths."""
    n = batch.column("n_words").to_numpy() + 1
    u = [np.frombuffer(b, "<i2" if len(b) == 2 * m else "<i4") for b, m in zip(batch.column("units").to_pylist(), n)]
    u = np.concatenate([np.zeros(0, np.int64), *u]).astype(np.int64)
    lists = batch.column(values)
    size = lists.value_lengths().fill_null(0).to_numpy()
    at = np.flatnonzero(u < 0)
    return u, at, lists.flatten().to_numpy()[np.repeat(np.cumsum(size) - size, n)[at] - u[at] - 1], n


def _sums(have: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their counts, added up."""
    cell, which = np.unique(np.concatenate([c for c, _ in have]), return_inverse=True)
    return cell, np.bincount(which, np.concatenate([n for _, n in have]), len(cell)).astype(np.int64)


def unit_bigrams(units: DataFrame) -> DataFrame:
    """``side, unit, other array<int>, n array<long>``: what stands after (side 1) and before (side 0) every unit in all learning
    texts, counted once.  Tasks add up their own pairs; a unit's row has at most ``UNITS`` neighbours."""

    def run(it):
        have, size = [], 0

        def flush():
            cell, n = _sums(have)
            for i in range(0, len(cell), 1 << 16):
                c = cell[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((c // UNITS).astype(np.int32)), pa.array((c % UNITS).astype(np.int32)),
                                                  pa.array(n[i:i + (1 << 16)])], ["a", "b", "n"])

        for batch in chunk_docs(it, 1024):
            if not batch.num_rows:
                continue
            u, at, keys, _ = _tokens(batch)
            u[at] = 1 + (keys & (ENDINGS - 1))
            cell = np.concatenate([np.zeros(1, np.int64), u[:-1]]) * UNITS + u  # each text follows an end token
            cell, n = np.unique(cell, return_counts=True)
            have.append((cell, n))
            size += len(cell)
            if size > 4_000_000:
                have = [_sums(have)]
                size = len(have[0][0])
                if size > 3_000_000:
                    yield from flush()
                    have, size = [], 0
        if have:
            yield from flush()

    pairs = units.select("units", "rare", "n_words").mapInArrow(run, "a int, b int, n long").repartition("a")
    pairs = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "unit-pairs")

    def side(k: int, unit: str, other: str) -> DataFrame:
        rows = pairs.select(F.col(unit).alias("unit"), F.struct(F.col(other).alias("o"), "n").alias("x")).groupBy("unit").agg(F.collect_list("x").alias("x"))
        return rows.select(F.lit(k).alias("side"), "unit", F.col("x.o").alias("other"), F.col("x.n").alias("n"))

    out = materialize(side(1, "a", "b").unionByName(side(0, "b", "a")), "unit-bigrams")
    discard(pairs)
    return out


def _by_class(bigrams: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """(2, UNITS, k) counts of classes before and after each unit: every unit is complete in its row, so nothing is shuffled."""

    def run(it):
        for batch in chunk_docs(it, 64):
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), size)
            n = np.bincount(row * k + classes[lists.flatten().to_numpy()], batch.column(3).flatten().to_numpy(), batch.num_rows * k).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in n], pa.binary())], ["side", "unit", "counts"])

    out = np.zeros((2, UNITS, k))
    got = bigrams.mapInArrow(run, "side int, unit int, counts binary").toArrow()
    for side, unit, counts in zip(*(c.to_pylist() for c in got.columns)):
        out[side, unit] = np.frombuffer(counts, float)
    return out


def _class_pairs(texts: DataFrame, k: int) -> np.ndarray:
    """(k, k) transitions of texts as classes."""

    def run(it):
        total = np.zeros(k * k, np.int64)
        for batch in chunk_docs(it, 1024):
            c = np.concatenate([np.zeros(1, "<i2"), *[np.frombuffer(b, "<i2") for b in batch.column(0).to_pylist()]]).astype(np.int64)
            total += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    got = texts.select("classes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(k, k)


def _transitions(n: np.ndarray) -> np.ndarray:
    freq = (n.sum(axis=0) + 1e-3) / (n.sum() + 1e-3 * len(n))
    return (n + SMOOTH * freq) / (n.sum(axis=1, keepdims=True) + SMOOTH)


def cluster(bigrams: DataFrame, k: int = CLASSES, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Class of every unit by exchange over ``unit_bigrams``; the end token keeps class 0 to itself."""
    rng = np.random.default_rng(seed)
    classes = 1 + np.arange(UNITS) % (k - 1)
    classes[0] = 0
    for r in range(rounds):
        n = _by_class(bigrams, classes, k)
        member = np.zeros((UNITS, k))
        member[np.arange(UNITS), classes] = 1
        p = np.log(_transitions(member.T @ n[1]))
        seen = n[0].sum(axis=1)
        size = np.log(np.maximum(1.0, member.T @ seen))
        gain = n[0] @ p + n[1] @ p.T - seen[:, None] * size
        gain[:, 0] = -np.inf
        move = (seen > 0) & (rng.random(UNITS) < (0.5 if r else 1.0))
        move[0] = False
        best = gain.argmax(axis=1)
        better = gain[np.arange(UNITS), best] > gain[np.arange(UNITS), np.where(classes == 0, 1, classes)] + 1e-9
        change = move & better
        if r and not change.any():
            break
        classes = np.where(change, best, classes)
    return classes


def word_classes(units: DataFrame, bigrams: DataFrame, classes: np.ndarray, k: int) -> DataFrame:
    """``key, class, n`` of every learnt word without a unit: the class under which all its neighbours and itself are likeliest.

    Tasks count a word's pairs of classes around it before they send them; what arrives is sorted and added up in pieces, so a
    frequent word is never held whole."""
    n = _by_class(bigrams, classes, k)
    member = np.zeros((UNITS, k))
    member[np.arange(UNITS), classes] = 1
    p = np.log(_transitions(member.T @ n[1]))
    size = np.log(np.maximum(1.0, member.T @ n[0].sum(axis=1)))
    size[0] = np.inf  # the end token keeps its class to itself
    after, ending = np.ascontiguousarray(p.T), classes[1:1 + ENDINGS]

    def neighbours(it):
        have, size = [], 0

        def counted():
            key, pair = (np.concatenate(x) for x in zip(*have))
            order = np.lexsort((pair, key))
            key, pair = key[order], pair[order]
            at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            n = np.diff(np.append(at, len(key))).astype(np.int32)
            for i in range(0, len(at), 1 << 16):
                j = at[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(key[j], pa.int64()), pa.array(pair[j], pa.int32()), pa.array(n[i:i + (1 << 16)])], ["key", "pair", "n"])

        for batch in chunk_docs(it, 1024):
            u, at, keys, _ = _tokens(batch)
            if not len(at):
                continue
            u[at] = 1 + (keys & (ENDINGS - 1))
            c = np.concatenate([np.zeros(1, np.int64), classes[u]])
            have.append((keys, (c[at] * k + c[at + 2]).astype(np.int32)))
            size += len(keys)
            if size > 2_000_000:
                yield from counted()
                have, size = [], 0
        if have:
            yield from counted()

    def choose(it):
        have = None

        def moved(keys, gain, count):
            gain[np.arange(len(keys)), ending[keys & (ENDINGS - 1)]] += 1e-9  # at a tie a word stays
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gain.argmax(axis=1), pa.int32()), pa.array(count, pa.int64())], ["key", "class", "n"])

        for batch in chunk_docs(it, 8192):
            if not batch.num_rows:
                continue
            key, pair, times = (c.to_numpy() for c in batch.columns)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            gain = np.add.reduceat((p[pair // k] + after[pair % k] - size) * times[:, None], at, axis=0)
            keys, count = key[at], np.add.reduceat(times.astype(np.int64), at)
            if have and have[0][0] == keys[0]:
                gain[0] += have[1][0]
                count[0] += have[2][0]
            elif have:
                yield moved(*have)
            if len(keys) > 1:
                yield moved(keys[:-1], gain[:-1], count[:-1])
            have = keys[-1:], gain[-1:].copy(), count[-1:]
        if have:
            yield moved(*have)

    seen = units.select("units", "rare", "n_words").mapInArrow(neighbours, "key long, pair int, n int")
    return seen.repartition("key").sortWithinPartitions("key", "pair").mapInArrow(choose, "key long, class int, n long")


def class_texts(units: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """``units`` with the sequences as classes, and the sums over words without a unit.

    The classes of other words are written before they join the texts, so the shuffle of words is gone when texts are shuffled."""
    classes, own = model.classes, [(e, int(model.classes[1 + e]), float(model.log_new[model.classes[1 + e]])) for e in range(ENDINGS)]
    endings = units.sparkSession.createDataFrame(own, "ending int, ending_class int, log_new double")
    beyond = [F.slice(c, F.col("n_shown") + 1, F.size(c)) for c in ("rare", "times")]  # shown words need no join
    rare = units.select("row", F.posexplode(F.arrays_zip(beyond[0].alias("rare"), beyond[1].alias("times"))).alias("i", "x")).select("row", "i", F.col("x.rare").alias("key"), F.col("x.times").cast("int").alias("times"))
    rare = (rare.join(words, "key", "left")
            .join(F.broadcast(endings), F.col("key").bitwiseAND(F.lit(ENDINGS - 1)) == F.col("ending"))
            .groupBy("row").agg(
                F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("r_known"),
                F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("r_base"),
                F.sum(F.col("times") * F.when(F.col("n").isNotNull(), F.log10(F.col("n") - F.lit(model.discount))).otherwise(F.col("log_new"))).alias("r_score"),
                F.array_sort(F.collect_list(F.struct("i", F.coalesce("class", "ending_class").alias("class")))).alias("own")))
    rare = materialize(rare.withColumn("own", F.col("own.class")), "rare-classes", "zstd")

    keys, unit = model.head_keys, model.head_units

    def run(it):
        for batch in chunk_docs(it, 1024):
            # the classes of a text's other words: of the shown ones from the model, of the rest from the join
            rare, joined, shown = (batch.column(batch.schema.get_field_index(c)) for c in ("rare", "own", "n_shown"))
            size = rare.value_lengths().to_numpy()
            ends = np.r_[0, np.cumsum(size)]
            first = np.arange(ends[-1]) - np.repeat(ends[:-1], size) < np.repeat(shown.to_numpy(), size)
            found = np.empty(ends[-1], np.int64)
            found[first] = classes[unit[np.searchsorted(keys, rare.flatten().to_numpy()[first].view(np.uint64))]]
            found[~first] = joined.flatten().to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
            batch = batch.drop_columns(["rare", "own", "n_shown"]).append_column("own", lists)
            u, at, own, n = _tokens(batch, "own")
            batch = batch.drop_columns(["own"])
            c = classes[np.maximum(u, 0)]
            c[at] = own
            c = c.astype("<i2")
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array([c[e - m:e].tobytes() for e, m in zip(ends, n)], pa.binary()), *batch.columns[1:]], ["classes", *batch.schema.names[1:]])

    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c)
    texts = (units.join(rare, "row", "left")
            .select("units", "rare", "own", "n_shown", "n_words", "doc_id", "held_out", "n_head", "known", "base", *[zero(c) for c in ("r_known", "r_base", "r_score")])
            .mapInArrow(run, "classes binary, n_words long, doc_id long, held_out boolean, n_head long, known double, base double, r_known double, "
                             "r_base double, r_score double"))
    texts = materialize(texts, "class-texts", "zstd")
    discard(rare)
    return texts


def learn(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS,
          keep_counts: bool = True) -> tuple[Model, DataFrame, DataFrame | None]:
    """The model of the rows that are not held out, all rows as class sequences, and the word counts if they are to be kept."""
    known = docs.where(~held_out)
    counts = materialize(word_counts(known, text_col), "words")
    model = _vocabulary(counts, known.count())
    if not keep_counts:
        discard(counts)
        counts = None
    units = materialize(unit_texts(docs, model, held_out, text_col, id_col), "units", "zstd")
    train = units.where(~F.col("held_out"))
    bigrams = unit_bigrams(train)
    model.classes = cluster(bigrams, model.k, rounds)
    words = materialize(word_classes(train, bigrams, model.classes, model.k), "word-classes")
    discard(bigrams)
    # tokens and types of every class
    own = model.head_units > ENDINGS
    at = model.classes[model.head_units[own]]
    size, kinds = np.bincount(at, weights=model.head_counts[own], minlength=model.k), np.bincount(at, minlength=model.k).astype(float)
    per = words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    size[per.column("class").to_numpy()] += per.column("n").to_numpy()
    kinds[per.column("class").to_numpy()] += per.column("v").to_numpy()
    size[0], kinds[0] = max(1, model.texts), 0  # the end token is always the end token
    size[1:][kinds[1:] == 0] = 1
    model.log_size = np.log10(size)
    model.log_new = np.log10(np.where(kinds > 0, model.discount * kinds, 1.0))
    # the other shown words get units of their own
    more = words.orderBy(F.desc("n"), "key").limit(HEAD - WORDS).toArrow()
    place = np.searchsorted(model.head_keys, more.column("key").to_numpy().view(np.uint64))
    model.head_units[place] = UNITS + np.arange(len(place))
    model.classes = np.concatenate([model.classes, more.column("class").to_numpy()])
    texts = class_texts(units, words, model)
    discard(units, words)
    model.log_transition = np.log10(_transitions(_class_pairs(texts.where(~F.col("held_out")), model.k)))
    return model, texts, counts


def score(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    model, texts, _ = learn(docs, held_out, text_col, id_col, rounds, keep_counts=False)
    trans, size = model.log_transition, model.log_size
    end_score = float(np.log10(model.texts)) if model.texts else 0.0

    def run(it):
        for batch in chunk_docs(it, 2048):
            got = []
            for b in batch.column(0).to_pylist():
                c = np.frombuffer(b, "<i2")
                before = np.concatenate([np.zeros(1, "<i2"), c[:-1]])
                got.append(float(trans[before, c].sum() - size[c].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got, pa.float64())], [*batch.schema.names[1:], "path"])

    whole = texts.mapInArrow(run, "n_words long, doc_id long, held_out boolean, n_head long, known double, base double, r_known double, r_base double, "
                                  "r_score double, path double")
    tokens = F.col("n_words") + 1
    norm = float(np.log10(model.tokens + model.types + 1.0))
    return whole.select(
        "doc_id", "held_out", tokens.cast("long").alias("n_tokens"),
        (F.col("n_head") + F.col("r_known") + int(model.texts > 0)).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("r_base") + F.lit(float(np.log10(model.texts + 1.0))) - tokens * norm).alias("base_score"),
        (F.col("path") + F.col("known") + F.col("r_score") + F.lit(end_score)).alias("score"))
