"""Dataset card: #train, #valid, #test, #classes of train, average
tokens and characters over all splits -- one aggregate, one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import WORD_PATTERN, tokens


def dataset_stats(df: DataFrame, text: str = "text", label: str = "label", split: str = "split",
                  pattern: str = WORD_PATTERN) -> DataFrame:
    return df.agg(
        F.count_if(F.col(split) == "train").alias("n_train"),
        F.count_if(F.col(split) == "valid").alias("n_valid"),
        F.count_if(F.col(split) == "test").alias("n_test"),
        F.count_distinct(F.when(F.col(split) == "train", F.col(label))).alias("n_classes"),
        F.avg(F.size(tokens(text, pattern, lower=True))).alias("avg_tokens"),
        F.avg(F.length(text)).alias("avg_chars"))
