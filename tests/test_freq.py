"""Tokenising and word counting."""

from pyspark.sql import functions as F

from textlab.functions.text import PUNCT, TOKEN_PATTERN, tokens
from textlab.operators import freq as fq

from conftest import SF001


def test_punct_fixed_value():
    assert len(PUNCT) == 33 and " " in PUNCT


def test_punctuation_is_substring_test(spark):
    df = spark.createDataFrame([(t,) for t in ["()", "-./", "...", "</", "word"]], "word string")
    kept = sorted(r["word"] for r in fq.drop_stopwords(df, None).collect())
    assert kept == ["...", "</", "word"]


def test_tokens_are_lossless(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    bad = docs.where(F.array_join(tokens("text", TOKEN_PATTERN), "") != F.col("text")).count()
    assert bad == 0


def test_word_freq_merge_equals_whole(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    whole = fq.word_freq(docs, remove_stop_words=False, lower=True)
    parts = [fq.word_freq(docs.where(F.col("lang") == l), remove_stop_words=False, lower=True) for l in ("en", "fr", "de", "es")]
    rest = fq.word_freq(docs.where(~F.col("lang").isin("en", "fr", "de", "es")), remove_stop_words=False, lower=True)
    merged = fq.merge_freq(*parts, rest)
    assert whole.exceptAll(merged).count() == 0 and merged.exceptAll(whole).count() == 0


def test_stopwords_as_dataframe_or_list_agree(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    sw = ["the", "and", "of"]
    a = fq.word_freq(docs, stopwords=sw)
    b = fq.word_freq(docs, stopwords=spark.createDataFrame([(w,) for w in sw], "w string"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_histogram_covers_all_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "frequency double")
    h = fq.histogram(df, "frequency", 10).collect()
    assert len(h) == 10 and sum(r["n"] for r in h) == 100
    assert max(h, key=lambda r: r["bin"])["n"] == 10  # last bin closed on the right
