"""Corpus catalogue: name -> format, delimiter, header and text column."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.sources.delimited import read_delimited, read_lines


@dataclass(frozen=True)
class CorpusEntry:
    name: str
    is_csv: bool
    text_column_id: int
    delimiter: str
    header: bool = True


# Fixed values that must equal the reference's for right results (one headerless
# corpus gets header=False: the reference skipped its first data row instead).
CATALOG = {
    "tscc": CorpusEntry("tscc", True, 6, ","),
    "wongnai": CorpusEntry("wongnai", True, 0, ";", header=False),
    "prachathai": CorpusEntry("prachathai", True, 3, ","),
    "thaipbs": CorpusEntry("thaipbs", True, 1, ","),
    "wisesight_sentiment": CorpusEntry("wisesight_sentiment", True, 0, ","),
    "wangchanberta": CorpusEntry("wangchanberta", False, -1, ","),
}


def corpus_entry(name: str, **override) -> CorpusEntry:
    """The catalogue's entry, or that of an unknown corpus (a CSV file with its text in the last column); what the caller
    names wins."""
    return replace(CATALOG.get(name, CorpusEntry(name, True, -1, ",")), **override)


def read_corpus(spark: SparkSession, name: str, path: str, **override) -> DataFrame:
    """Texts of a corpus as ``(text)``: the catalogue entry for ``name`` (or the
    caller's ``is_csv``, ``text_column_id``, ``delimiter``, ``header``), position
    -1 = last column, the default of an unknown corpus (S5, P2).  What the caller
    names wins over the catalogue."""
    e = corpus_entry(name, **override)
    if not e.is_csv:
        return read_lines(spark, path).select(F.col("value").alias("text"))
    df = read_delimited(spark, path, sep=e.delimiter, header=e.header)
    return df.select(F.col(df.columns[e.text_column_id]).alias("text"))
