"""Delimited and plain-text sources and sinks.

Text fields hold quotes, separators and newlines, so reader and writer share
one option set: RFC-4180 quoting (quote and escape ``"``), ``multiLine`` on read,
no whitespace trimming on write.  Without it a round trip silently changes rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Null is written as \N (not as an empty field) so that an empty string and a
# null both survive a round trip.
NULL_MARK = "\\N"
READ_OPTS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST", "nullValue": NULL_MARK}
WRITE_OPTS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
              "quoteAll": "false", "emptyValue": '""', "nullValue": NULL_MARK}


def read_delimited(spark: SparkSession, path, sep: str = ",", header: bool = True, schema: T.StructType | str | None = None,
                   names: list[str] | None = None, infer: bool = False, multiline: bool = True) -> DataFrame:
    """Read a delimited file or directory (S1); ``header=False`` with ``names`` or
    ``schema`` reads a headerless file (S2).  Without a schema all columns are
    strings unless ``infer``.  ``multiline=False`` lets Spark split large files whose
    fields hold no line breaks."""
    r = spark.read.options(**READ_OPTS).option("multiLine", str(multiline).lower()).option("sep", sep).option("header", str(header).lower())
    if schema is not None and header:
        # a header names the columns: map them to the schema by name, not by position
        st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        raw = r.csv(path)
        return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in st.fields])
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", "true")
    df = r.csv(path)
    if names is not None and schema is None:
        df = df.toDF(*names)
    return df


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "overwrite",
                    partition_by: list[str] | None = None) -> None:
    """Write a delimited file set, UTF-8, no index."""
    w = df.write.mode(mode).options(**WRITE_OPTS).option("sep", sep).option("header", str(header).lower())
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def _fs_list(spark: SparkSession, path: str, ext: str, recursive: bool) -> list[str]:
    """List data files of ``path`` with the Hadoop FileSystem API (metadata only)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    it = fs.listFiles(p, recursive)
    out = []
    while it.hasNext():
        s = it.next().getPath().toString()
        name = s.rsplit("/", 1)[-1]
        if name.endswith(ext) and not name.startswith((".", "_")):
            out.append(s)
    return sorted(out)


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()


def read_dir(spark: SparkSession, path: str, ext: str = ".csv", sep: str = ",", schema=None, recursive: bool = False) -> DataFrame:
    """Read every ``*ext`` file of a directory and concatenate by column name (S3);
    sub-folders (e.g. the splits of S8) only with ``recursive``.

    Files are grouped by their header line (one line read per file); each group
    is one ``read.csv`` over its files, and the groups are unioned by name, so a
    file with the same columns in another order is not mis-assigned.
    """
    from concurrent.futures import ThreadPoolExecutor
    files = _fs_list(spark, path, ext, recursive)
    with ThreadPoolExecutor(max_workers=32) as pool:  # one short read per file, I/O bound
        heads = list(pool.map(lambda f: _first_line(spark, f), files))
    groups: dict[str, list[str]] = {}
    for f, h in zip(files, heads):
        groups.setdefault(h, []).append(f)
    out = None
    for _, files in sorted(groups.items()):
        d = read_delimited(spark, files, sep=sep, header=True, schema=None)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no {ext} files under {path}")
    if schema is not None:
        st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        out = out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in st.fields])
    return out


def read_lines(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = True) -> DataFrame:
    """One row per line of every matching file under ``path`` (S4) -> ``(value)``.

    Lines lose their ``\\n`` (the reference's line iteration keeps it); no newline token.
    """
    return (spark.read.option("recursiveFileLookup", str(recursive).lower())
            .option("pathGlobFilter", glob).text(path))


def write_lines(df: DataFrame, path: str, col: str = "text", partition_by: list[str] | None = None) -> None:
    w = df.select(col, *(partition_by or [])).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def union_splits(splits: dict[str, DataFrame], col: str = "split") -> DataFrame:
    """Several named splits as one table with a split column."""
    out = None
    for name, d in splits.items():
        d = d.withColumn(col, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def write_splits(df: DataFrame, path: str, sep: str = ",", col: str = "split") -> None:
    """train / valid / test under one directory each, ``<path>/split=<name>/``."""
    write_delimited(df, path, sep=sep, partition_by=[col])


def read_splits(spark: SparkSession, path: str, sep: str = ",", schema=None, which: list[str] | None = None) -> DataFrame:
    """Read split directories back; a filter on ``split`` prunes directories."""
    df = read_delimited(spark, path, sep=sep, schema=schema)
    return df.where(F.col("split").isin(which)) if which else df


def write_freq(freq: DataFrame, path: str, sep: str = ",") -> None:
    """Frequency sink: header ``Word,Frequency``, most frequent first."""
    out = freq.orderBy(F.desc("frequency"), F.asc("word")).select(F.col("word").alias("Word"), F.col("frequency").alias("Frequency"))
    write_delimited(out, path, sep=sep)


def read_freq(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Read a frequency file; words are read as text ('NA', 'null' stay words)."""
    return read_delimited(spark, path, sep=sep, schema="Word string, Frequency bigint").select(
        F.col("Word").alias("word"), F.col("Frequency").alias("frequency"))


def write_report(metrics: DataFrame, path: str, run: str | None = None, text_path: str | None = None) -> None:
    """Append a long ``(metric, value)`` report as parquet (S10); optional
    text form ``metric: value`` with six decimals and no digit grouping."""
    m = metrics.withColumn("run", F.lit(run)) if run is not None else metrics
    m.write.mode("append").parquet(path)
    if text_path is not None:
        m.select(F.concat_ws(": ", F.col("metric"), F.format_string("%.6f", F.col("value").cast("double"))).alias("line")) \
         .coalesce(1).write.mode("overwrite").text(text_path)
