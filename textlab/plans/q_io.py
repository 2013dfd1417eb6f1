"""Registered source / sink queries.

Each writes data Spark derives from the driver's tables to a fresh folder under
the session's shared checkpoint folder, and reads it back through the reader
under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab import fixtures as fx
from textlab.operators import split as sp
from textlab.operators.freq import word_freq
from textlab.functions.text import WORD_PATTERN
from textlab.plans.compare_corpora import compare_corpora
from textlab.plans.count_corpus import count_corpus
from textlab.plans.q_corpus import SQL_SIZES
from textlab.plans.q_labels import SQL_CASES, SQL_LABELLED
from textlab.plans.q_split import sql_kshot
from textlab.plans.registry import SQL_FREQ, SQL_LL, r6, register
from textlab.session import scratch_path
from textlab.sources import delimited as io
from textlab.sources.catalog import read_corpus
from textlab.streaming.word_count import read_log, run_to_log, stream_words

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@register("S1", "select * from documents")
def q_s1(spark, d):
    path = scratch_path(spark, "s1")
    io.write_delimited(fx.table(spark, d, "documents"), path)
    return io.read_delimited(spark, path, schema=DOC_SCHEMA)


@register("S2", "select * from documents")
def q_s2(spark, d):
    path = scratch_path(spark, "s2")
    io.write_delimited(fx.table(spark, d, "documents"), path, sep="|", header=False)
    return io.read_delimited(spark, path, sep="|", header=False, schema=DOC_SCHEMA)


@register("S3", "select doc_id, text, lang from documents")
def q_s3(spark, d):
    base = scratch_path(spark, "s3")
    io.write_delimited(fx.corpus(spark, d, "a").select("doc_id", "text", "lang"), f"{base}/a")
    io.write_delimited(fx.corpus(spark, d, "b").select("lang", "doc_id", "text"), f"{base}/b")  # other column order
    return io.read_dir(spark, base, ".csv", schema="doc_id bigint, text string, lang string", recursive=True)


@register("S4", SQL_FREQ)
def q_s4(spark, d):
    path = scratch_path(spark, "s4")
    io.write_lines(fx.table(spark, d, "documents").select("text", "lang"), path, "text", partition_by=["lang"])
    lines = io.read_lines(spark, path, "*.txt")
    return word_freq(lines, "value", remove_stop_words=False, pattern=WORD_PATTERN, lower=True)


@register("S5", "select text from documents")
def q_s5(spark, d):
    path = scratch_path(spark, "s5")
    io.write_delimited(fx.table(spark, d, "documents").select("text", "doc_id"), path, sep=";", header=False)
    return read_corpus(spark, "wongnai", path)


@register("S6", """select doc_id, case when try_cast(substr(source, 4) as integer) < 10 then 'a' else 'b' end as split
  from documents where try_cast(substr(source, 4) as integer) is not null""")
def q_s6(spark, d):
    return io.union_splits({"a": fx.corpus(spark, d, "a").select("doc_id"), "b": fx.corpus(spark, d, "b").select("doc_id")})


@register("S7", f"select * from {SQL_CASES}")
def q_s7(spark, d):
    path = scratch_path(spark, "s7")
    io.write_delimited(fx.cases(spark, d), path)
    return io.read_delimited(spark, path, schema="dekaid bigint, lawids string, fact string, isguilty int")


@register("S8", f"select split, count(*)::BIGINT as rows, count(distinct label)::BIGINT as classes from {sql_kshot(SQL_LABELLED, 100)} group by split")
def q_s8(spark, d):
    path = scratch_path(spark, "s8")
    s = sp.split_kshot(fx.labelled(spark, d), "label", "doc_id", 100)
    io.write_splits(s, path)
    back = io.read_splits(spark, path, schema="doc_id bigint, text string, label int, split string")
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("label").alias("classes"))


@register("S9", SQL_FREQ)
def q_s9(spark, d):
    path = scratch_path(spark, "s9")
    f = word_freq(fx.table(spark, d, "documents"), remove_stop_words=False, pattern=WORD_PATTERN, lower=True)
    io.write_freq(f, path)
    return io.read_freq(spark, path)


SQL_PD = f"""(select sum((o1 - e1) * (o1 - e1) / e1 + (o2 - e2) * (o2 - e2) / e2) as chi2,
  2.0 * sum(o1 * ln(o1 / e1) + o2 * ln(o2 / e2)) as g, count(*) - 1 as dof from {SQL_LL})"""


@register("S10", f"""select metric, round(value, 6) as value from ({SQL_SIZES}
  union all select 'chi2', chi2 from {SQL_PD} union all select 'g', g from {SQL_PD} union all select 'dof', dof::DOUBLE from {SQL_PD})""")
def q_s10(spark, d):
    path = scratch_path(spark, "s10")
    fa = word_freq(fx.corpus(spark, d, "a"), remove_stop_words=False, pattern=WORD_PATTERN, lower=True)
    fb = word_freq(fx.corpus(spark, d, "b"), remove_stop_words=False, pattern=WORD_PATTERN, lower=True)
    rep = compare_corpora(fa, fb, pvalues=False).where(
        F.col("metric").isin("raw_words_1", "raw_words_2", "filtered_words_1", "filtered_words_2", "common_words",
                             "exclusive_words_1", "exclusive_words_2", "chi2", "g", "dof"))
    io.write_report(rep, path, text_path=path + "-text")
    return spark.read.parquet(path).select("metric", r6("value").alias("value"))


@register("A2_stream", SQL_FREQ)
def q_a2_stream(spark, d):
    src = scratch_path(spark, "stream-src")
    io.write_lines(fx.table(spark, d, "documents").select("text", "source"), src, "text", partition_by=["source"])
    out = scratch_path(spark, "stream-out")
    run_to_log(stream_words(spark, src, max_files_per_trigger=64), out, scratch_path(spark, "stream-ckpt"))
    return read_log(spark, out)


@register("A2_corpus", SQL_FREQ)  # corpus to frequency file in one call: catalogue, count, sink
def q_a2_corpus(spark, d):
    src = scratch_path(spark, "corpus")
    io.write_delimited(fx.table(spark, d, "documents").select("text", "doc_id"), src, sep=";", header=False)
    return count_corpus(spark, "wongnai", src, scratch_path(spark, "corpus-freq"), pattern=WORD_PATTERN, lower=True)
