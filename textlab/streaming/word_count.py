"""Incremental corpus word count.

The reference counts one file per worker and merges the per-file counters.  Here each micro-batch of new text files is
counted by itself and its counts are one folder of a log; the corpus' table is the sum of the log (A3).  No state grows with
the vocabulary, a batch writes its own words only, and a reader sees whole batches.  With ``trigger(availableNow=True)`` the
job is a restartable batch: the checkpoint records which files were counted, and a batch that is run again after a crash
replaces its own folder, so no file is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.text import WORD_PATTERN, tokens
from textlab.operators.freq import merge_freq

FREQ = "word string, frequency bigint"


def stream_words(spark: SparkSession, src: str, glob: str = "*.txt", pattern: str = WORD_PATTERN, lower: bool = True,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(word)`` of the text files arriving under ``src``."""
    r = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(src).select(F.explode(tokens("value", pattern, lower=lower)).alias("word"))


def run_to_log(words: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run until the source is drained; the counts of batch n are written to ``<out_path>/batch=<n>``."""
    def write(batch: DataFrame, epoch: int) -> None:
        counts = batch.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
        counts.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={epoch}")

    words.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def read_log(spark: SparkSession, out_path: str) -> DataFrame:
    """The corpus' ``(word, frequency)``: the log's counts added up; empty before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], FREQ)
    return merge_freq(spark.read.schema(f"{FREQ}, batch bigint").parquet(out_path))
