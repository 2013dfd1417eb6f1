"""Corpus pipeline over ``documents``: language ID, near-duplicate removal, secret redaction, source mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm.bbit_minhash import near_duplicates
from textlab.llm.common import prepare
from textlab.llm.language_mix import identify, learn
from textlab.llm.mixing import mixed_documents
from textlab.llm.packing import pack
from textlab.llm.secret_forest import redact, scan
from textlab.session import materialize

#: A document stays when one language makes up at least this share of it.
LANGUAGE_SHARE = 0.5
#: No SQL expresses the learned stages; tests hold them against plain Python.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a leading language go; all rows that name a language teach it."""
    prepare(spark)
    names = docs.columns
    model = learn(docs)
    kept = identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE))
    return kept.select(*[F.col(f"`{c}`") for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8) stays, the one with the smallest id.

    Where ids repeat, rows are told apart by id, text and source, so unrelated texts of one id stay; rows without an id stay."""
    prepare(spark)
    named = docs.where(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().where("count > 1").take(1):
        named = materialize(named.withColumn("__row", F.xxhash64("doc_id", "text", "source")).dropDuplicates(["__row"]), "named")
        groups = near_duplicates(named, k=5, threshold=80, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
        kept = named.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row"))["__row"].alias("__row"))
        out = named.join(kept.hint("merge"), "__row", "left_semi").select(*docs.columns)
    else:
        groups = near_duplicates(docs, k=5, threshold=80).where(F.col("doc_id").isNotNull())
        kept = groups.where("kept").select("doc_id").distinct()
        out = docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    return out.unionByName(docs.where(F.col("doc_id").isNull()))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    prepare(spark)
    return redact(docs, scan(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each copy of a document that it takes."""
    prepare(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's token pieces and their places in sequences of 4096."""
    import public_tokenizers

    prepare(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's result is returned unwritten."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
