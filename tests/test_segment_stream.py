"""Dictionary segmentation and the streaming word count."""


import pyarrow as pa
from pyspark.sql import functions as F

from textlab.operators.freq import merge_freq, word_freq
from textlab.operators.segment import WALKED, _walked, segment
from textlab.session import scratch_path
from textlab.sources.delimited import write_lines
from textlab.streaming.word_count import read_log, run_to_log, stream_words

from conftest import SF001


def test_greedy_longest_match_any_dictionary(spark):
    df = spark.createDataFrame([(1, "thecatsat"), (2, "xcat"), (1, "w1x"), (1, "xw1"), (3, None), (4, ""), (2, "xcat")], "id int, text string")
    d = spark.createDataFrame([(w,) for w in ["the", "cat", "ca", "sat", "t", "w1", None, ""]], "w string")
    got = sorted(((r["id"], r["text"], r["tokens"]) for r in segment(df, "text", d).collect()), key=str)
    assert got == sorted([(1, "thecatsat", ["the", "cat", "sat"]), (2, "xcat", ["x", "cat"]), (2, "xcat", ["x", "cat"]), (1, "w1x", ["w1", "x"]),
                          (1, "xw1", ["x", "w1"]), (3, None, None), (4, "", [])], key=str)
    none = segment(df, "text", d.where("false")).where("id = 2").first()
    assert none["tokens"] == ["x", "c", "a", "t"]
    many = d.unionByName(spark.range(3000).selectExpr("concat('zz', id) as w"))  # more words, same tokens
    assert sorted(((r["id"], r["text"], r["tokens"]) for r in segment(df, "text", many).collect()), key=str) == got


def test_stream_count_equals_batch(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    src = scratch_path(spark, "t-stream")
    write_lines(docs.select("text", "lang"), src, "text", partition_by=["lang"])
    out = scratch_path(spark, "t-stream-out")
    assert read_log(spark, out).count() == 0
    checkpoint = scratch_path(spark, "t-stream-ck")
    run_to_log(stream_words(spark, src, max_files_per_trigger=1), out, checkpoint)
    got = read_log(spark, out)
    want = word_freq(docs, remove_stop_words=False, pattern=r"[\p{L}\p{M}\p{N}]+", lower=True)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # files that arrive later are counted by a second run, alone; nothing twice
    write_lines(docs.limit(3).select("text", F.lit("more").alias("lang")), src + "/late", "text", partition_by=["lang"])
    run_to_log(stream_words(spark, src), out, checkpoint)
    run_to_log(stream_words(spark, src), out, checkpoint)
    late = word_freq(docs.limit(3), remove_stop_words=False, pattern=r"[\p{L}\p{M}\p{N}]+", lower=True)
    want = merge_freq(want, late)
    got = read_log(spark, out)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_only_matches_travel(spark, monkeypatch):
    """Many word lengths, characters of all planes, shared prefixes: rows are the matches, also with tables so small that most
    hits are false."""
    import random

    from pyspark.sql import functions as F

    from textlab.operators import segment as sg
    rng = random.Random(7)
    letters = "abกข漢😀"
    words = {"".join(rng.choices(letters, k=rng.randint(1, 60 if i % 9 == 0 else 6))) for i in range(400)} | {"a" * n for n in (2, 3, 50)}
    texts = ["".join(rng.choice([rng.choice(sorted(words)), rng.choice(letters), "z"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["a" * 3000, "z" * 500]

    def plain(t):
        got, i = [], 0
        while i < len(t):
            n = max((n for n in range(1, 61) if t[i:i + n] in words and len(t[i:i + n]) == n), default=1)
            got.append(t[i:i + n])
            i += n
        return got

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    dictionary = spark.createDataFrame([(w,) for w in sorted(words)], "w string")
    matches = sum(t[i:i + n] in words for t in set(texts) for i in range(len(t)) for n in range(1, min(60, len(t) - i) + 1))
    keyed = df.dropDuplicates(["text"]).where("text != ''").select(F.col("id").cast("string").alias("_k"), F.col("text").alias("_t"))
    assert matches <= sg.spans(keyed, dictionary).count() <= 1.02 * matches
    for bits in (sg.BITS, 1 << 19):
        monkeypatch.setattr(sg, "BITS", bits)
        assert {r["id"]: r["tokens"] for r in segment(df, "text", dictionary).collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_only_a_large_dictionary_shuffles_texts_and_all_give_the_same_tokens(spark, monkeypatch):
    import random

    from textlab.operators import segment as sg
    rng = random.Random(11)
    letters = "abกข漢😀"
    words = {"".join(rng.choices(letters, k=rng.randint(1, 40 if i % 9 == 0 else 5))) for i in range(300)} | {"a" * n for n in (2, 3, 50, 60)} | {"[^a]", "\\x{61}"}
    texts = ["".join(rng.choice([rng.choice(sorted(words)), rng.choice(letters), "z\\n"]) for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", "a" * 300, "a" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    dictionary = spark.createDataFrame([(w,) for w in sorted(words)] + [(None,), ("",), ("ab",), ("ab",)], "w string")
    words.add("ab")

    def plain(t):
        got, i = [], 0
        while i < len(t):
            n = max((n for n in range(1, 91) if t[i:i + n] in words and len(t[i:i + n]) == n), default=1)
            got.append(t[i:i + n])
            i += n
        return got

    want = {i: None if t is None else plain(t) for i, t in enumerate(texts)}
    for name, value in ((None, 0), ("PATTERN_DEPTH", 59), ("TRIED", 0), ("KEPT_HEADS", 2), ("HELD_CHARS", 0)):
        if name is not None:
            monkeypatch.setattr(sg, name, value)
        got = segment(df, "text", dictionary)
        plan = got._jdf.queryExecution().toString()
        assert ("Exchange" in plan or "Join" in plan) == (name == "HELD_CHARS") and ("UDF" in plan or "tokens(" in plan) == (name is not None)
        assert {r["id"]: r["tokens"] for r in got.collect()} == want


def test_counting_tokens_cuts_each_text_once(spark):
    df = spark.createDataFrame([("ab" * 5,), (None,), ("",)], "text string")
    for dictionary in (["ab"], ["x" * 100, "ab"]):  # a regular expression, held words
        got = word_freq(segment(df, "text", spark.createDataFrame([(w,) for w in dictionary], "w string")), "tokens", remove_stop_words=False, tokenizer=lambda c: c)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") + plan.count("tokens(") == 1
        assert [tuple(r) for r in got.collect()] == [("ab", 5)]


def test_tokens_of_a_batch_come_a_few_texts_at_a_time():
    texts = pa.array(["abcx", None, ""] * 1000)
    at, size = pa.array([[0], None, None] * 1000, pa.list_(pa.int32())), pa.array([[3], None, None] * 1000, pa.list_(pa.int32()))
    parts = list(_walked(texts, at, size))
    assert max(map(len, parts)) <= WALKED
    assert pa.concat_arrays(parts).to_pylist() == [["abc", "x"], None, []] * 1000
