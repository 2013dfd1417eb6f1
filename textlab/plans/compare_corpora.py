"""Full comparison report of two corpora."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import COMPARE_EXCLUDE
from textlab.operators.compare import (align_vocab, log_likelihood, power_divergence, spearman,
                                       vocab_report, with_pvalues, _unpivot)
from textlab.operators.freq import filter_vocab
from textlab.session import materialize


def compare_corpora(freq1: DataFrame, freq2: DataFrame, min_excl: int = 5,
                    exclude: Iterable[str] = COMPARE_EXCLUDE, pvalues: bool = True) -> DataFrame:
    """``(metric STRING, value DOUBLE)`` rows: vocabulary sizes, chi2 / G / Cressie-Read
    with dof, the per-word LL sum (must equal G), Spearman rho and t, and p-values."""
    # the frequency tables are vocabulary-sized: written once, every statistic
    # below reads them instead of re-tokenising the corpora per subquery
    freq1 = materialize(freq1.select("word", "frequency"), "freq1")
    freq2 = materialize(freq2.select("word", "frequency"), "freq2")
    f1 = filter_vocab(freq1, min_excl, exclude)
    f2 = filter_vocab(freq2, min_excl, exclude)
    aligned = materialize(align_vocab(f1, f2), "aligned")
    sizes = vocab_report(freq1, freq2, f1, f2)
    stats = power_divergence(aligned)
    if pvalues:
        stats = with_pvalues(stats)
    ll_sum = log_likelihood(aligned).agg(F.sum("ll").alias("ll_sum"))
    sp = spearman(aligned, pvalue=pvalues)
    one = stats.select("*", ll_sum.select("ll_sum").scalar().alias("ll_sum"),
                       sp.select("rho").scalar().alias("spearman_rho"),
                       sp.select("t").scalar().alias("spearman_t"),
                       *([sp.select("p").scalar().alias("spearman_p")] if pvalues else []))
    cols = ["chi2", "g", "cressie_read", "dof", "ll_sum", "spearman_rho", "spearman_t"]
    if pvalues:
        cols += ["chi2_p", "g_p", "cressie_read_p", "spearman_p"]
    return sizes.unionByName(_unpivot(one, cols))
