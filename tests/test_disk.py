"""What a step leaves on disk: its tables as long as something reads them, its shuffles not at all."""

import os
import random
import time

from pyspark.sql import functions as F

from textlab.llm import class_lm
from textlab.operators import knn
from textlab.operators import models as mo
from textlab.session import ensure_checkpoint_dir, materialize

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _tables(spark) -> set[str]:
    return set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))


def _rows(spark, ids):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    return spark.createDataFrame([(i, " ".join(rng.choices(words, k=12)), i % 3) for i in ids], "id long, text string, label int")


def test_materialize_leaves_no_shuffle_and_no_setting(spark):
    was, old = spark.conf.get(CLEAN_UP, None), _shuffles(spark)
    got = materialize(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"), "few")
    end = time.time() + 20
    while _shuffles(spark) - old and time.time() < end:  # Spark deletes them in the background
        time.sleep(0.2)
    assert not _shuffles(spark) - old
    assert got.agg(F.sum("count")).first()[0] == 5000 and spark.conf.get(CLEAN_UP, None) == was


def test_rows_of_both_sides_go_once_they_are_packed(spark):
    train, test = _rows(spark, range(30)), _rows(spark, range(30, 40))
    old = _tables(spark)
    for complexity in ("shingle", len):
        assert knn.neighbours(train, test, 2, complexity).count() == 20
    left = {t.rsplit("-", 1)[0] for t in _tables(spark) - old}
    assert {"set-chunks", "set-blocks", "knn-train", "knn-test"} <= left
    assert not left & {"set-train", "set-test", "knn-train-rows", "knn-test-rows"}


def test_encode_does_not_deal_tokens_out(spark):
    docs = _rows(spark, range(20))
    plan = mo.encode(docs, mo.build_vocab(docs, size=10))._jdf.queryExecution().toString()
    assert "hashpartitioning(token" not in plan and "BroadcastHashJoin [token" in plan


def test_class_lm_writes_the_classes_of_words_before_texts_are_shuffled(spark, monkeypatch):
    docs = _rows(spark, range(60)).withColumnRenamed("id", "doc_id")
    old, written = _tables(spark), []
    monkeypatch.setattr(class_lm, "materialize", lambda df, name, codec=None: written.append(name) or materialize(df, name, codec))
    assert class_lm.score(docs, F.col("doc_id") % 5 == 0, rounds=1).count() == 60
    assert written[-2:] == ["rare-classes", "class-texts"]
    assert {t.rsplit("-", 1)[0] for t in _tables(spark) - old} == {"class-texts"}
