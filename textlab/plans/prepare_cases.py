"""Raw case table -> cleaned ``(label, filtered_fact)``.

Latest issue per case (W1) -> strip ``<discr>`` spans (P4) -> relevant codes
(L1) -> drop rows without one (L3/P9) -> primary label by global frequency
(W2/W3) -> drop labels seen fewer than ``k`` times (P10) -> project (P1) ->
dense ids (W4).  One lazy plan: explode + two small aggregates joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators import labels as lb
from textlab.operators.select import strip_spans


def prepare_cases(df: DataFrame, label: str = "lawids", key: str = "dekaid", order: str | None = "issueno",
                  text: str = "fact", tag: str = "discr", min_excl: int = 106, k: int = 5,
                  with_stages: bool = False):
    """Clean a case table.  ``label`` is ``'lawids'`` (multi-label codes) or a plain column.

    ``order=None`` skips the latest-issue step (a table with one row per case).
    With ``with_stages`` also returns the row counts per step (A6).
    """
    stages = {"raw": df}
    if order is not None:
        df = lb.latest_per_key(df, key, order)
        stages["latest_per_key"] = df
    df = strip_spans(df, text, tag, "filtered_fact")
    if label == "lawids":
        relevant = lb.relevant_labels(df, "lawids", min_excl)
        long = lb.explode_codes(df, key, "lawids", out="label").join(relevant, "label", "left_semi")
        rank = lb.label_rank(long)
        prim = lb.primary_label(long, key, rank)          # rows without a relevant code vanish here
        ids = lb.label_map(relevant)
        prim = prim.join(ids, "label").select(key, F.col("id").alias("label"))
        df = df.join(prim, key)
        stages["labelled"] = df
        df = lb.drop_rare_labels(df, "label", k)
        stages["frequent_labels"] = df
    else:
        df = lb.simple_label(df, label, "label")
    df = df.select("label", "filtered_fact")
    out = lb.dense_labels(df, "label").select(F.col("label").cast("int").alias("label"), "filtered_fact")
    stages["cleaned"] = out
    if with_stages:
        return out, lb.stage_counts(stages)
    return out
