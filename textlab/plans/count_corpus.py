"""Corpus to frequency file in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.functions.text import TOKEN_PATTERN
from textlab.operators.freq import word_freq
from textlab.sources.catalog import corpus_entry, read_corpus
from textlab.sources.delimited import read_freq, write_freq


def count_corpus(spark: SparkSession, name: str, path: str, out_dir: str, remove_stop_words: bool = False, stopwords=None,
                 pattern: str = TOKEN_PATTERN, lower: bool = False, tokenizer=None, **override) -> DataFrame:
    """Find the corpus ``name`` in the catalogue, read its texts under ``path``, count its words and write them to
    ``<out_dir>/word-freq-<name>``, most frequent first, with the corpus' own delimiter; the written table is returned.

    ``override`` is what the caller knows better than the catalogue, or an unknown corpus: ``is_csv``, ``text_column_id``,
    ``delimiter``, ``header``.  Texts are counted where they are read, so a word leaves a task once."""
    entry = corpus_entry(name, **override)
    freq = word_freq(read_corpus(spark, name, path, **override), "text", remove_stop_words, stopwords, pattern, lower, tokenizer)
    out = f"{out_dir.rstrip('/')}/word-freq-{name}"
    write_freq(freq, out, sep=entry.delimiter)
    return read_freq(spark, out, sep=entry.delimiter)
