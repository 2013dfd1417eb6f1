"""Per-document operators (rules, language, quality, LM) against plain Python and on odd input."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import class_lm, language_mix, quality_mil, quality_rules
from textlab.llm.common import fold

from .llm_helpers import prose

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# quality rules ------------------------------------------------------------------------------------------------------

def rule_counts(text):
    text = text or ""
    ws = words(text)
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] >= 2 for k in range(3)}
    lines = [s for s in text.split("\n") if s.strip(SPACE)]
    return (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_rules_counts_match_python(spark, documents, odd_docs, no_docs):
    extra = spark.createDataFrame([(100, "a b c a b c a b", "en", "s", 1), (101, "x x x x x", "en", "s", 1), (102, "p q r s p q r", None, None, None),
                                   (103, "l1\nl1\n\n \nl1\nl2", "en", "s", 2), (104, "a\x85b c d é|*#", "en", "s", 3)], documents.schema)
    for docs in (documents, odd_docs.select(documents.columns), extra, no_docs):
        got = quality_rules.apply_rules(docs).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rule_counts(r.text)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_rules_plan_is_one_projection(documents):
    plan = quality_rules.apply_rules(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_pass_other_columns_and_replace_clashing(odd_docs):
    got = quality_rules.apply_rules(odd_docs)
    assert {"size", "score", "lang"} <= set(got.columns) and len(got.columns) == len(set(got.columns))
    assert dict(got.dtypes)["n_words"] == "bigint"


def test_rules_keep_clean_reject_junk(spark):
    clean = " ".join(["the man of the house and his dog went to town on a day"[i % 7:] for i in range(30)])
    clean = prose(5, 200) + " the of and to in is was for that on with by"
    rows = [(1, clean), (2, " ".join(f"{w}***" for w in clean.split())), (3, " | ".join(clean.split())),
            (4, clean.upper().replace(" ", "!! ")), (5, " ".join(w for w in clean.split()[:20] for _ in range(9)))]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


# language ID --------------------------------------------------------------------------------------------------------

def test_language_held_out_accuracy(documents):
    model = language_mix.learn(documents.where(fold("doc_id", 3) != 1))
    got = language_mix.identify(documents, model).where(fold("doc_id", 3) == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_mixture_recovers_proportions(documents):
    model = language_mix.learn(documents)
    by = {x: [r.text for r in documents.where(F.col("lang") == x).limit(20).collect()] for x in ("en", "de")}
    text = " ".join(by["en"])[:6000] + " " + " ".join(by["de"])[:2000]
    pi = dict(zip(model.languages, language_mix.proportions(language_mix.trigrams(text), model.log_p)))
    assert 0.6 < pi["en"] < 0.9 and 0.1 < pi["de"] < 0.4 and pi["en"] + pi["de"] > 0.95
    alone = dict(zip(model.languages, language_mix.proportions(language_mix.trigrams(by["de"][0]), model.log_p)))
    assert alone["de"] == 1


def test_language_long_text_counts_equal_places(documents):
    """Counting trigrams in runs gives the proportions of the direct computation."""
    model = language_mix.learn(documents)
    ids = language_mix.trigrams(documents.first().text)
    once = language_mix.proportions(ids[:2000], model.log_p)
    many = language_mix.proportions(np.tile(ids[:2000], 40), model.log_p)
    assert np.argmax(once) == np.argmax(many)


def test_language_odd_rows(odd_docs, no_docs):
    model = language_mix.learn(odd_docs)
    got = language_mix.identify(odd_docs, model)
    assert got.columns.count("score") == 1 and got.columns.count("lang_pred") == 1
    rows = got.collect()
    assert len(rows) == 12
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages
    empty = language_mix.learn(no_docs)
    assert empty.languages == [] and language_mix.identify(odd_docs, empty).where("lang_pred != 'und'").count() == 0
    assert language_mix.identify(no_docs, model).count() == 0


# quality classifier -------------------------------------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    from .conftest import SF001
    sf = SF001.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_mil.fit(docs, labels.where(fold("doc_id", 5) != 0))
    got = quality_mil.score(docs, model).join(labels, "doc_id").where(fold("doc_id", 5) == 0).collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in got]) > 0.9
    again = quality_mil.fit(docs, labels.where(fold("doc_id", 5) != 0))
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)


def test_quality_gradient_matches_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality_mil.FEATURES)) for k in (1, 3, 5)]
    y = np.array([0.0, 1, 1])
    m = quality_mil.train(bags, y, hidden=4, gates=3, epochs=1)
    x, starts = np.concatenate(bags), np.array([0, 1, 4])

    def loss():
        p = quality_mil._forward(m.weights, x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = quality_mil._gradient(m.weights, x, starts, y)
    for k, w in m.weights.items():
        at = tuple(0 for _ in w.shape)
        keep = w[at]
        w[at] = keep + 1e-6
        up = loss()
        w[at] = keep - 1e-6
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-5


def test_quality_attention_sums_to_one():
    bags = [np.random.default_rng(i).normal(size=(k, quality_mil.FEATURES)) for i, k in enumerate((2, 7))]
    m = quality_mil.train(bags, np.array([0, 1]), epochs=2)
    f = quality_mil._forward(m.weights, np.concatenate(bags), np.array([0, 2]))
    assert np.allclose(np.add.reduceat(f["a"], [0, 2]), 1)


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 1), (7, 0), (7, 1), (8, None), (None, 1)], "doc_id long, quality int")
    got = quality_mil.score(odd_docs, quality_mil.fit(odd_docs, labels))
    assert got.count() == 12 and got.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in got.collect())
    none = quality_mil.fit(odd_docs, labels.where("false"))
    assert {r.score for r in quality_mil.score(odd_docs, none).collect()} == {0.5}
    one = quality_mil.fit(odd_docs, labels.where("quality = 1 and doc_id = 1"))
    assert {r.score for r in quality_mil.score(odd_docs, one).collect()} == {1.0}
    assert quality_mil.score(no_docs, none).count() == 0


# language model -----------------------------------------------------------------------------------------------------

def unigram_base(rows):
    count, tokens = collections.Counter(), []
    for r in rows:
        toks = (r.text or "").encode().lower().split() + [None]
        tokens.append(toks)
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            count.update(toks)
    n, v = sum(count.values()), len(count)
    return [(r.doc_id, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)) for r, t in zip(rows, tokens)]


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_lm_base_is_exact_and_model_is_better(request, which):
    docs = request.getfixturevalue(which)
    got = class_lm.score(docs, fold("doc_id", 7) == 2, rounds=3).collect()
    want = unigram_base(docs.collect())
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * max(1, abs(b[4]))
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    if which == "documents":
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_is_a_distribution(documents):
    """Over all known words, new words of every class and the end, the probabilities after any word sum to 1."""
    model, _, counts = class_lm.learn(documents, fold("doc_id", 7) == 2, rounds=2)
    table = counts.toPandas()
    keys = table["key"].to_numpy().view(np.uint64)
    unit = 1 + (keys & np.uint64(class_lm.ENDINGS - 1)).astype(int)
    at = np.searchsorted(model.head_keys, keys)
    hit = model.head_keys[np.minimum(at, len(model.head_keys) - 1)] == keys
    unit[hit] = model.head_units[at[hit]]
    c = model.classes[unit]
    emit = (table["n"].to_numpy() - model.discount) / 10 ** model.log_size[c]
    per = np.bincount(c, weights=emit, minlength=class_lm.CLASSES)
    used = np.unique(c)
    new = 10 ** (model.log_new - model.log_size)
    assert np.allclose(per[used] + new[used], 1)
    assert np.allclose((10 ** model.log_transition).sum(axis=1), 1)


def test_lm_without_learning_rows(no_docs, odd_docs):
    assert class_lm.score(no_docs, F.lit(False)).count() == 0
    got = class_lm.score(odd_docs, F.lit(True)).collect()
    assert len(got) == 12 and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)


def test_lm_every_word_has_its_own_class(spark, monkeypatch):
    """Rare words of one ending, half of them always between nouns and half between verbs, fall into two classes."""
    monkeypatch.setattr(class_lm, "WORDS", 40)
    monkeypatch.setattr(class_lm, "UNITS", 1 + class_lm.ENDINGS + 40)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        side = "ab"[i % 2]
        pick = [f"{side}{x}" for x in rng.integers(0, 20, 40)]
        pick[5::8] = [f"{side}q{x}xyz" for x in rng.integers(0, 60, 5)]
        rows.append((i, " ".join(pick)))
    model, _, counts = class_lm.learn(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), rounds=4)
    words = class_lm.Words()
    unit = dict(zip(model.head_keys.tolist(), model.head_units.tolist()))
    of = lambda side: {int(model.classes[unit[words[f"{side}q{x}xyz".encode()]]]) for x in range(60)}
    assert len({words[f"{s}q{x}xyz".encode()] & (class_lm.ENDINGS - 1) for s in "ab" for x in range(60)}) == 1
    assert not of("a") & of("b")


def test_lm_classes_follow_the_vocabulary(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 400), i -> concat('w', id * 400 + i)), ' ')").alias("text"))
    assert class_lm.learn(docs, F.lit(False), rounds=1)[0].k == 55  # 160,000 words


def test_lm_hashes_each_word_of_a_batch_once(monkeypatch):
    """Words are cut and numbered by Arrow; a word is hashed once however often the texts hold it, and keys, places and sizes are
    those of plain Python."""
    import pyarrow as pa
    import xxhash

    hashed, digest = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: hashed.append(w) or digest(w))
    texts = [None, "", " ", "The cat the CAT\x0bthe\x0c cat", "\t a  b\n", "É é\x85q\x1cz", "x" * 300 + "\r a", "the\u2003cat", None, "b " * 500]
    for part in (pa.array(texts), pa.array(texts).slice(3, 4), pa.array(texts).slice(0, 3), pa.array([], pa.string())):
        hashed.clear()
        kinds, which, size = class_lm.batch_words(part)
        plain = [(t or "").encode().lower().split() for t in part.to_pylist()]
        every = [w for ws in plain for w in ws]
        assert sorted(hashed) == sorted(set(every))
        keys = [(digest(w) & ~(class_lm.ENDINGS - 1)) | (zlib.crc32(w[-3:]) % class_lm.ENDINGS) for w in every]
        assert kinds[which].tolist() == keys and kinds.tolist() == sorted(set(keys)) and size.tolist() == [len(ws) for ws in plain]


def test_lm_counts_words_over_batches(spark):
    """Counts of a task's batches are added up: more rows than a batch has, and words that occur in many of them."""
    docs = spark.range(0, 3000, 1, 2).select(F.concat(F.lit("All one "), (F.col("id") % 7).cast("string"), F.lit(" all w"), F.col("id").cast("string")).alias("text"))
    words = class_lm.Words()
    want = collections.Counter(words[w] for r in docs.collect() for w in r.text.lower().encode().split())
    got = class_lm.word_counts(docs).collect()
    assert len(got) == len(want) and {r.key % 2 ** 64: r.n for r in got} == want
