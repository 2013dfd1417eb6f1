"""The registered queries over whole tables: SQL where there is some, brute force elsewhere."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from textlab.llm import language_mix, mixing
from textlab.session import materialize

from .conftest import SF001
from .test_corpus_operators import check_packed, near_brute, repeats_brute, word_file
from .test_text_operators import unigram_base

SF01 = "/root/testdata/sf0.01"
SECRET = re.compile(r'AKIA[0-9A-Z]{16}|(?<=password=)\w+|(?<=token = ")\w+', re.I)


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r for r in documents.collect()}


def rows_of(spark, name, sf=SF001):
    return entry.queries()[name](spark, sf).collect()


@pytest.mark.parametrize("name", ["op3_embedding_range", "op8_bbit_minhash", "op9_quality_rules"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(tuple(r[c] for c in cols) for r in rows_of(spark, name)) == sorted(cur.fetchall())


def test_op1_held_out(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    got = rows_of(spark, "op1_quality_mil", SF01)
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_op2_finds_the_planted(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = rows_of(spark, "op2_secret_forest", SF01)
    for r in got:
        value = docs[r.doc_id][r.start:r.start + r.length]
        assert hashlib.sha256(value.encode()).hexdigest() == r.value_sha256
    want = {(i, m.start()) for i, t in docs.items() for m in SECRET.finditer(t)}
    assert {(r.doc_id, r.start) for r in got if r.is_secret} == want and want


def test_op4_takes_the_targets(spark, texts):
    got = rows_of(spark, "op4_source_mix")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id].text)) and r.taken <= 3 * r.size
        by[r.source].append(r)
    names = sorted(by, key=lambda s: s.encode())
    want = mixing.targets([sum(r.size for r in by[s]) for s in names])
    for s, t in zip(names, want):
        assert {r.target for r in by[s]} == {t} and abs(sum(r.taken for r in by[s]) - t) <= 1
    assert sum(want) == pytest.approx(sum(r.size for r in got))


def expected_pieces(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_file())
    out = []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(ids), 4096):
            part = ids[i:i + 4096]
            out.append((doc_id, i // 4096, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def test_op5_round_trip(spark, texts):
    got = rows_of(spark, "op5_best_fit_packing")
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces((i, r.text) for i, r in texts.items())
    assert check_packed(got, 4096) <= 1.05 * sum(r.length for r in got) / 4096 + 1


def test_op6_equals_brute_force(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, "op6_repeat_removal")}
    assert got == repeats_brute([(i, r.text) for i, r in texts.items()])


def test_op7_base_and_gain(spark, texts):
    got = {r.doc_id: r for r in rows_of(spark, "op7_class_lm")}
    for i, n, known, total, base in unigram_base(list(texts.values())):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op10_held_out(spark, texts):
    got = rows_of(spark, "op10_language_mix")
    assert len(got) == len(texts)
    assert np.mean([r.lang_pred == texts[r.doc_id].lang for r in got if r.held_out]) > 0.97


def test_pipeline_against_brute_force(spark, documents, texts):
    """Each stage on what its predecessor kept; the whole run is the last stage's result."""
    out, docs = {}, documents
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF001), f"test-{name}")
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == documents.columns
    assert sorted(r.doc_id for r in out["language_id"]) == sorted(texts)  # every document has letters and a leading language
    group, _ = near_brute([(r.doc_id, r.text) for r in out["language_id"]], 5)
    assert sorted(r.doc_id for r in out["near_dedup"]) == sorted(set(group.values()))
    clean = {r.doc_id: r.text for r in out["near_dedup"]}
    assert {r.doc_id: r.text for r in out["secrets"]} == {i: SECRET.sub("[secret]", t) for i, t in clean.items()}
    size = {r.doc_id: len(r.text.split()) for r in out["secrets"]}
    copies = collections.Counter(r.doc_id for r in out["mixing"])
    assert max(copies.values()) <= 4 and sum(len(r.text.split()) for r in out["mixing"]) == pytest.approx(sum(size.values()), abs=25)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out["packing"]) == expected_pieces((r.doc_id, r.text) for r in out["mixing"])
    check_packed(out["packing"], 4096)
    whole = entry.queries()["pipeline"](spark, SF001).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out["packing"])


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = materialize(stage(spark, docs, SF001), f"odd-{name}")
            if name != "packing":
                assert docs.columns == names
            if name in ("language_id", "near_dedup"):
                assert docs.count() <= before
            if name == "secrets":
                assert docs.count() == before


def test_tables_of_nulls(spark):
    """Nulls in every column of every row."""
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF001).count() in (0, 3)


def test_pipeline_keeps_unrelated_rows_of_one_id(spark):
    """Rows that share an id, or have none, are rows of their own in near_dedup and mixing."""
    from .llm_helpers import prose
    copy = prose(1, 80)
    texts = [(7, prose(i, 50 + i), "a") for i in range(6)] + [(7, copy, "a"), (3, copy, "b"), (7, copy, "a"), (9, prose(50, 60), "b")]
    texts += [(None, prose(100 + i, 40), "ab"[i % 2]) for i in range(20)] + [(None, prose(300, 40), "b")] * 2
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = materialize(corpus_pipeline.near_dedup(spark, docs, SF001), "test-rows")
    want = [x for x in texts if not (x[0] == 7 and x[1] == copy)]
    assert sorted((r.text, r.source) for r in kept.collect()) == sorted(x[1:] for x in want)
    got = mixing.mixed_documents(kept).collect()
    goal = mixing.targets([sum(len(t.split()) for _, t, s in want if s == x) for x in "ab"])
    for x, words in zip("ab", goal):
        assert abs(sum(len(r.text.split()) for r in got if r.source == x) - words) <= 1
    assert max(collections.Counter(r.text for r in got if len(r.text.split()) == 40).values()) <= 8


def test_pipeline_learns_languages_of_every_fold(spark, documents, monkeypatch):
    """A language whose documents all fall into fold 1 of three is learned."""
    ids = [i for i in range(10**6, 10**6 + 60) if zlib.crc32(str(i).encode()) % 3 == 1][:9]
    rare = spark.createDataFrame([(i, "привет мир это русский текст " * 30, "ru", "a", 870) for i in ids], documents.schema)
    seen = []
    monkeypatch.setattr(corpus_pipeline, "learn", lambda docs: seen.append(language_mix.learn(docs)) or seen[0])
    kept = corpus_pipeline.language_id(spark, documents.unionByName(rare), SF001)
    assert kept.where("lang = 'ru'").count() == len(ids)
    assert "ru" in seen[0].languages
