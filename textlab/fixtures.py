"""Inputs derived from the driver's tables (FIXTURES.md section 2).

Every fixture is a lazy DataFrame over the parquet tables, so each registered
query's work grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A short stop-word list for the P7 checks (caller data in the library).
STOPWORDS_10 = ["the", "and", "of", "to", "a", "in", "is", "le", "la", "de"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from textlab.sources.tables import read_table
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """``corpus_a`` (source number < 10) or ``corpus_b`` (>= 10)."""
    docs = table(spark, sf_dir, "documents")
    num = F.substring("source", 4, 1 << 20).try_cast("int")
    return docs.where(num < 10) if side == "a" else docs.where(num >= 10)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal-case-shaped table from lineitem: one case per order.

    ``lawids`` = sorted distinct codes 'LI-<100 + partkey % 30>-0<linenumber % 2>'
    comma-joined; ``fact`` carries one ``<discr>`` span; ``isguilty`` = lines % 2.
    """
    li = table(spark, sf_dir, "lineitem")
    code = F.concat(F.lit("LI-"), (F.lit(100) + F.col("l_partkey") % 30).cast("string"),
                    F.lit("-0"), (F.col("l_linenumber") % 2).cast("string"))
    g = li.groupBy(F.col("l_orderkey").alias("dekaid")).agg(
        F.array_join(F.array_sort(F.collect_set(code)), ",").alias("lawids"),
        F.count(F.lit(1)).alias("_n"))
    from textlab.session import materialize
    return materialize(g.select(
        "dekaid", "lawids",
        F.concat(F.lit("order "), F.col("dekaid").cast("string"), F.lit(" <discr>lines "),
                 F.col("_n").cast("string"), F.lit("</discr> end")).alias("fact"),
        (F.col("_n") % 2).cast("int").alias("isguilty")), "cases")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` joined to ``labels``; label = quality * 2 + toxic."""
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id").select("doc_id", "text", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"))


def rare(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """``documents`` with label = n_chars div ``width`` (many classes, singletons)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", (F.col("n_chars") / width).cast("bigint").alias("label"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-label predictions: y_pred = first argmax of embedding[1..10], 0-based."""
    from textlab.functions.arrays import argmax
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y_true"),
                      argmax(F.slice("embedding", 1, 10)).alias("y_pred"))


def mlpreds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-label predictions: truth = embedding[9..16] > 0, predicted = sigmoid(embedding[1..8]) >= 0.5."""
    from textlab.functions.arrays import sigmoid_threshold
    emb = table(spark, sf_dir, "embeddings")
    truth = F.transform(F.slice("embedding", 9, 8), lambda x: (x.cast("double") > 0).cast("int"))
    return emb.select(F.col("vec_id").alias("id"), truth.alias("y_true"),
                      sigmoid_threshold(F.slice("embedding", 1, 8)).alias("y_pred"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log from ``events``: run = user_id, ordered by (ts, event_id), metric = value."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("trial_id"), F.col("user_id").alias("run"), "ts", F.col("value").alias("metric"))
