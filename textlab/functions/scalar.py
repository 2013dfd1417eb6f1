"""Small scalar column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results:
# corpus name (lower case) -> report title; anything else is '<Unknown>'.
CORPUS_TITLES = {
    "tscc": "TSCC",
    "wangchan": "Corpora Used by WangChanBERTa",
    "wangchanberta": "Corpora Used by WangChanBERTa",
    "wongnai": "Wongnai",
}
TRUE_WORDS = ("true", "t", "yes", "y")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def corpus_title(name) -> Column:
    """Lower-case a corpus name and map it to a title (F8)."""
    low = F.lower(_col(name))
    out = F.lit("<Unknown>")
    for k, v in reversed(list(CORPUS_TITLES.items())):
        out = F.when(low == k, F.lit(v)).otherwise(out)
    return out


def fixed6(x) -> Column:
    """Fixed 6-decimal text without digit grouping."""
    return F.format_string("%.6f", _col(x).cast("double"))


def parse_bool(x, extra_true=()) -> Column:
    """``lower(x) in ('true', 't', 'yes', 'y')`` (F10).  The text ``'1'`` is false, as in the
    reference, which lists the number 1 and so never matches a text; pass it in
    ``extra_true`` to accept it."""
    return F.lower(_col(x).cast("string")).isin(*TRUE_WORDS, *extra_true)
