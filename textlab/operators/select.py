"""Projections, filters and set operations on rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import strip_spans_col


def as_labelled(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Keep only the text and label columns, renamed ``text`` / ``label``."""
    return df.select(F.col(text).alias("text"), F.col(label).alias("label"))


def column_at(df: DataFrame, position: int, alias: str | None = None) -> DataFrame:
    """Select one column by position; -1 is the last column."""
    name = df.columns[position]
    return df.select(F.col(name).alias(alias or name))


def shift_label(df: DataFrame, col: str = "label", by: int = -1) -> DataFrame:
    """Shift a rating so classes start at 0."""
    return df.withColumn(col, F.col(col) + F.lit(by))


def strip_spans(df: DataFrame, col: str = "fact", tag: str = "discr", out: str = "filtered_fact") -> DataFrame:
    """Remove ``<tag>...</tag>`` spans, shortest match, not across newlines."""
    return df.withColumn(out, strip_spans_col(col, tag))


def exclude_values(df: DataFrame, col: str, values: DataFrame | Iterable) -> DataFrame:
    """Drop rows whose ``col`` is in an exclusion list (P6): a literal list, or any-size DataFrame (anti join)."""
    if isinstance(values, DataFrame):
        v = values.select(F.col(values.columns[0]).alias(col)).distinct()
        return df.join(v, col, "left_anti")
    return df.where(~F.col(col).isin(list(values)))


def preview(df: DataFrame, n: int = 5, order: Iterable[str] | None = None) -> DataFrame:
    """First ``n`` rows by an explicit order (P12); Spark has no row order of its own."""
    order = list(order) if order else [df.columns[0]]
    return df.orderBy(*order).limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def minus_rows(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Remove the rows whose id is in ``ids`` (U4)."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(ids.select(*keys).distinct(), keys, "left_anti")
