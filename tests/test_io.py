"""Sources and sinks: round trips with awkward text, header grouping, catalogue."""

import os

from textlab.session import scratch_path
from textlab.sources import delimited as io
from textlab.sources.catalog import read_corpus


def test_csv_round_trip_keeps_text(spark):
    rows = [(1, 'a "quoted", text\nwith newline'), (2, "  padded  "), (3, ""), (4, "semi;colon")]
    df = spark.createDataFrame(rows, "id long, text string")
    p = scratch_path(spark, "t-csv")
    io.write_delimited(df, p)
    back = io.read_delimited(spark, p, schema="id long, text string")
    assert sorted(back.collect()) == sorted(df.collect())


def test_read_dir_groups_by_header(spark):
    a = spark.createDataFrame([(1, "x")], "id long, text string")
    b = spark.createDataFrame([("y", 2)], "text string, id long")
    p = scratch_path(spark, "t-dir")
    io.write_delimited(a, os.path.join(p, "a"))
    io.write_delimited(b, os.path.join(p, "b"))
    back = io.read_dir(spark, p, schema="id long, text string", recursive=True)  # the groups lie in sub-folders
    assert sorted((r["id"], r["text"]) for r in back.collect()) == [(1, "x"), (2, "y")]


def test_catalogue_headerless_keeps_first_row(spark):
    df = spark.createDataFrame([("first review", 5), ("second", 4)], "review string, star int")
    p = scratch_path(spark, "t-cat")
    io.write_delimited(df, p, sep=";", header=False)
    assert sorted(r["text"] for r in read_corpus(spark, "wongnai", p).collect()) == ["first review", "second"]


def test_freq_sink_reads_na_as_word(spark):
    f = spark.createDataFrame([("NA", 3), ("null", 2)], "word string, frequency bigint")
    p = scratch_path(spark, "t-freq")
    io.write_freq(f, p)
    assert sorted(io.read_freq(spark, p).collect()) == sorted(f.collect())
