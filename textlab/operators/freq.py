"""Word counting over corpora.

Plan shape of ``word_freq``: scan -> Generate(explode) -> HashAggregate(partial)
-> Exchange(word) -> HashAggregate(final).  The partial aggregate is the
per-file ``Counter`` of the reference done per task, so a hot word ships one row
per map task, never one row per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import COMPARE_EXCLUDE, PUNCT, TOKEN_PATTERN, tokens


def tokenize(df: DataFrame, text: str = "text", pattern: str = TOKEN_PATTERN, lower: bool = False,
             out: str = "tokens", trim: bool = False) -> DataFrame:
    """Add an ARRAY<STRING> token column; concatenated tokens give the text back."""
    src = F.trim(F.col(text)) if trim else F.col(text)
    return df.withColumn(out, tokens(src, pattern, lower=lower))


def explode_tokens(df: DataFrame, text: str = "text", pattern: str = TOKEN_PATTERN, lower: bool = False,
                   tokenizer=None, out: str = "word") -> DataFrame:
    """One row per token (``tokenizer`` is a ``Column -> ARRAY<STRING>`` override)."""
    # of a plain column Spark would infer the filter that it has tokens, and cut every text again to test it
    arr = F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>")) if tokenizer is not None else tokens(text, pattern, lower=lower)
    return df.select(F.explode(arr).alias(out))


def is_punct(word: Column, punct: str = PUNCT) -> Column:
    """The reference's test: the token is a *substring* of the punctuation string."""
    return F.instr(F.lit(punct), word) > 0


def drop_stopwords(words_df: DataFrame, stopwords: DataFrame | Iterable[str] | None, word: str = "word",
                   punct: str = PUNCT) -> DataFrame:
    """Drop stop-words and punctuation tokens.

    ``stopwords`` is a one-column DataFrame (any size: left-anti join, broadcast
    when the planner sees it is small) or a short literal list.
    """
    out = words_df.where(~is_punct(F.col(word), punct))
    if stopwords is None:
        return out
    if isinstance(stopwords, DataFrame):
        sw = stopwords.select(F.col(stopwords.columns[0]).alias(word)).distinct()
        return out.join(sw, on=word, how="left_anti")
    return out.where(~F.col(word).isin(list(stopwords)))


def word_freq(df: DataFrame, text: str = "text", remove_stop_words: bool = True,
              stopwords: DataFrame | Iterable[str] | None = None, pattern: str = TOKEN_PATTERN,
              lower: bool = False, tokenizer=None) -> DataFrame:
    """Word counts of a corpus -> ``(word STRING, frequency BIGINT)``."""
    w = explode_tokens(df, text, pattern=pattern, lower=lower, tokenizer=tokenizer)
    if remove_stop_words:
        w = drop_stopwords(w, stopwords)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))


def word_freq_by(df: DataFrame, part: str, text: str = "text", pattern: str = TOKEN_PATTERN, lower: bool = False) -> DataFrame:
    """Word counts of every part (file, source) of a corpus in one scan -> ``(part, word, frequency)``; their sum by word,
    ``merge_freq``, is the corpus' table (SURVEY A2)."""
    w = df.select(F.col(part).alias("part"), F.explode(tokens(text, pattern, lower=lower)).alias("word"))
    return w.groupBy("part", "word").agg(F.count(F.lit(1)).alias("frequency"))


def merge_freq(*freqs: DataFrame) -> DataFrame:
    """Add already-computed frequency tables."""
    u = freqs[0].select("word", "frequency")
    for f in freqs[1:]:
        u = u.unionByName(f.select("word", "frequency"))
    return u.groupBy("word").agg(F.sum("frequency").cast("bigint").alias("frequency"))


def filter_vocab(freq: DataFrame, min_excl: int = 5, exclude: Iterable[str] = COMPARE_EXCLUDE) -> DataFrame:
    """Keep words with frequency > ``min_excl`` and not excluded."""
    return freq.where((F.col("frequency") > min_excl) & ~F.col("word").isin(list(exclude)))


def most_common(freq: DataFrame, n: int | None = None) -> DataFrame:
    """Words by frequency descending, ties by word.

    With ``n`` the plan is ``TakeOrderedAndProject`` (per-task top-n, merged).
    """
    out = freq.orderBy(F.desc("frequency"), F.asc("word"))
    return out.limit(n) if n is not None else out


def histogram(df: DataFrame, col: str = "frequency", bins: int = 300) -> DataFrame:
    """Equal-width histogram from min to max, last bin closed.

    -> ``(bin INT, lo DOUBLE, hi DOUBLE, n BIGINT)`` with empty bins present.
    min and max come from one scalar subquery each; no driver round trip.
    """
    stats = df.agg(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx"))
    mn = stats.select("mn").scalar()
    mx = stats.select("mx").scalar()
    width = (mx - mn) / F.lit(float(bins))
    v = F.col(col).cast("double")
    idx = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((v - mn) / width), F.lit(bins - 1))).cast("int")
    counts = df.where(F.col(col).isNotNull()).select(idx.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    (mn + F.col("bin") * width).alias("lo"),
                    (mn + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))
