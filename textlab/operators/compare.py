"""Compare two word-frequency tables.

Inputs are ``(word, frequency)`` tables.  Corpus totals are scalar subqueries
(``DataFrame.scalar()``): Catalyst runs them once and inlines the value, so no
cross join and no driver round trip is needed to put a total next to each word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.special import chi2_ln_pvalue, chi2_pvalue, t_ln_pvalue_greater, t_pvalue_greater
from textlab.operators.ranks import value_ranks


def align_vocab(f1: DataFrame, f2: DataFrame) -> DataFrame:
    """Inner equi-join on word -> ``(word, o1, o2)``."""
    a = f1.select("word", F.col("frequency").cast("bigint").alias("o1"))
    b = f2.select("word", F.col("frequency").cast("bigint").alias("o2"))
    return a.join(b, "word", "inner")


def common_words(f1: DataFrame, f2: DataFrame) -> DataFrame:
    """Words in both tables."""
    return f1.select("word").join(f2.select("word"), "word", "left_semi")


def only_in(f1: DataFrame, f2: DataFrame) -> DataFrame:
    """Words of ``f1`` missing from ``f2``."""
    return f1.select("word").join(f2.select("word"), "word", "left_anti")


def exclusive_vocab(f1: DataFrame, f2: DataFrame) -> DataFrame:
    """Words exclusive to one side -> ``(side, word, frequency)``, side 1 or 2."""
    a = f1.join(f2.select("word"), "word", "left_anti").select(F.lit(1).alias("side"), "word", "frequency")
    b = f2.join(f1.select("word"), "word", "left_anti").select(F.lit(2).alias("side"), "word", "frequency")
    return a.unionByName(b)


def vocab_report(raw1: DataFrame, raw2: DataFrame, flt1: DataFrame, flt2: DataFrame) -> DataFrame:
    """Vocabulary sizes as ``(metric, value)`` rows."""
    both = flt1.select("word", F.lit(1).alias("s1")).join(flt2.select("word", F.lit(1).alias("s2")), "word", "full_outer")
    sizes = both.agg(
        F.count_if(F.col("s1").isNotNull() & F.col("s2").isNotNull()).alias("common_words"),
        F.count_if(F.col("s2").isNull()).alias("exclusive_words_1"),
        F.count_if(F.col("s1").isNull()).alias("exclusive_words_2"),
        F.count_if(F.col("s1").isNotNull()).alias("filtered_words_1"),
        F.count_if(F.col("s2").isNotNull()).alias("filtered_words_2"),
    )
    r1 = raw1.agg(F.count(F.lit(1)).alias("raw_words_1"))
    r2 = raw2.agg(F.count(F.lit(1)).alias("raw_words_2"))
    cols = ["raw_words_1", "raw_words_2", "filtered_words_1", "filtered_words_2",
            "common_words", "exclusive_words_1", "exclusive_words_2"]
    one = sizes.select(*[F.col(c) for c in cols[2:]],
                       r1.select("raw_words_1").scalar().alias("raw_words_1"),
                       r2.select("raw_words_2").scalar().alias("raw_words_2"))
    return _unpivot(one, cols)


def _unpivot(one_row: DataFrame, cols: list[str]) -> DataFrame:
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("m")).select("m.metric", "m.value")


def _totals(aligned: DataFrame):
    t = aligned.agg(F.sum("o1").cast("double").alias("n1"), F.sum("o2").cast("double").alias("n2"))
    return t.select("n1").scalar(), t.select("n2").scalar()


def log_likelihood(aligned: DataFrame) -> DataFrame:
    """Per-word log-likelihood with expected counts from the aligned totals.

    ``E_i = N_i (O1 + O2) / (N1 + N2)``; ``LL = 2 (O1 ln(O1/E1) + O2 ln(O2/E2))``.
    """
    n1, n2 = _totals(aligned)
    o1, o2 = F.col("o1").cast("double"), F.col("o2").cast("double")
    e1 = n1 * (o1 + o2) / (n1 + n2)
    e2 = n2 * (o1 + o2) / (n1 + n2)
    return aligned.select("word", "o1", "o2", e1.alias("e1"), e2.alias("e2")).withColumn(
        "ll", F.lit(2.0) * (F.col("o1") * F.log(F.col("o1") / F.col("e1")) + F.col("o2") * F.log(F.col("o2") / F.col("e2"))))


def _pd_term(o, e, lam: float):
    if lam == 0:
        return o * F.log(o / e)
    if lam == -1:
        return e * F.log(e / o)
    return o * (F.pow(o / e, F.lit(lam)) - F.lit(1.0))


def power_divergence(aligned: DataFrame, lambdas: dict[str, float] | None = None) -> DataFrame:
    """Power-divergence statistics of the V x 2 table, no continuity correction.

    Returns one row: a column per statistic (default ``chi2`` lambda=1, ``g``
    lambda=0, ``cressie_read`` lambda=2/3), plus ``dof = V - 1`` (SURVEY A15-A18).
    """
    lambdas = lambdas or {"chi2": 1.0, "g": 0.0, "cressie_read": 2.0 / 3.0}
    n1, n2 = _totals(aligned)
    o1, o2 = F.col("o1").cast("double"), F.col("o2").cast("double")
    e1 = n1 * (o1 + o2) / (n1 + n2)
    e2 = n2 * (o1 + o2) / (n1 + n2)
    aggs = []
    for name, lam in lambdas.items():
        term = _pd_term(o1, e1, lam) + _pd_term(o2, e2, lam)
        if lam == 0 or lam == -1:
            factor = 2.0
        else:
            factor = 2.0 / (lam * (lam + 1.0))
        aggs.append((F.lit(factor) * F.sum(term)).alias(name))
    aggs.append((F.count(F.lit(1)) - 1).alias("dof"))
    return aligned.agg(*aggs)


def with_pvalues(stats: DataFrame, names=("chi2", "g", "cressie_read")) -> DataFrame:
    """Add ``<name>_p`` upper-tail chi-square p-values to the one-row statistics, and their logarithms
    ``<name>_ln_p``, which still say how small a value is that is printed as 0."""
    for n in names:
        dof = F.col("dof").cast("double")
        stats = stats.withColumn(f"{n}_p", chi2_pvalue(F.col(n), dof)).withColumn(f"{n}_ln_p", chi2_ln_pvalue(F.col(n), dof))
    return stats


def spearman(aligned: DataFrame, x: str = "o1", y: str = "o2", pvalue: bool = True) -> DataFrame:
    """Spearman's rho with average ranks for ties; one-sided 'greater' p.

    Ranks come from the distinct-value tables (``value_ranks``): no global sort of
    the rows.  -> one row ``(n, rho, t, p, ln_p)``.
    """
    r1 = value_ranks(aligned, x).select(F.col(x), F.col("avg_rank").alias("_r1"))
    r2 = value_ranks(aligned, y).select(F.col(y), F.col("avg_rank").alias("_r2"))
    ranked = aligned.select(x, y).join(r1, x).join(r2, y)
    out = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_r1", "_r2").alias("rho"))
    n = F.col("n").cast("double")
    out = out.withColumn("t", F.col("rho") * F.sqrt((n - 2) / (F.lit(1.0) - F.col("rho") * F.col("rho"))))
    if pvalue:
        out = out.withColumn("p", t_pvalue_greater(F.col("t"), n - 2)).withColumn("ln_p", t_ln_pvalue_greater(F.col("t"), n - 2))
    return out


def ll_extremes(ll: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` highest and ``n`` lowest log-likelihood words with both counts.

    Two ``TakeOrderedAndProject`` plans (per-task top-n, merged); ``rank`` is 1-based.
    """
    key = F.round("ll", 9)
    hi = ll.orderBy(key.desc(), F.asc("word")).limit(n)
    lo = ll.orderBy(key.asc(), F.asc("word")).limit(n)
    from pyspark.sql import Window
    w_hi = Window.orderBy(F.round("ll", 9).desc(), F.asc("word"))
    w_lo = Window.orderBy(F.round("ll", 9).asc(), F.asc("word"))
    # the windows run over at most n rows each (after the limit)
    hi = hi.select(F.lit("highest").alias("direction"), F.row_number().over(w_hi).alias("rank"), "word", "o1", "o2", "ll")
    lo = lo.select(F.lit("lowest").alias("direction"), F.row_number().over(w_lo).alias("rank"), "word", "o1", "o2", "ll")
    return hi.unionByName(lo)
