"""Labels: counting, ranking, cleaning, multi-hot.

Label tables (one row per class) are the only things ranked with a global
window; they are aggregates whose size is the number of classes.  Row-level
work is always an aggregate with map-side combine or a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.operators.ranks import ordered_positions


# ---------------------------------------------------------------- counting (A4-A10)

def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Value counts with the label as a string (A4) -> ``(label STRING, n BIGINT)``."""
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def classes(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels (A5, T4 with ``orderBy``)."""
    return df.select(F.col(label).alias("label")).distinct()


def n_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """Number of distinct labels, one row (A5)."""
    return df.agg(F.count_distinct(label).alias("n_classes"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several stages -> ``(stage, rows)``."""
    out = None
    for i, (name, d) in enumerate(stages.items()):
        one = d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def label_presence(long_labels: DataFrame, rows: DataFrame, row_id: str, label: str = "label") -> DataFrame:
    """Count of 1 and of 0 per label of a multi-label table in long form.

    ``long_labels`` holds ``(row_id, label)`` pairs; ``rows`` is the row table
    (its count gives the zeros).  -> ``(label, ones, zeros)``.
    """
    total = rows.select(row_id).distinct().agg(F.count(F.lit(1)).alias("t")).select("t").scalar()
    ones = long_labels.select(row_id, label).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("ones"))
    return ones.select(label, "ones", (total - F.col("ones")).alias("zeros"))


def label_cardinality(df: DataFrame, labels: str = "labels", by: str | None = None) -> DataFrame:
    """Labels-per-row histogram (A8); per ``by`` group (e.g. split) with the mean.

    -> ``([by,] n_labels, rows, mean_labels)`` where ``mean_labels`` is the group mean.
    """
    keys = [by] if by else []
    sized = df.select(*keys, F.size(labels).alias("n_labels"))
    hist = sized.groupBy(*keys, "n_labels").agg(F.count(F.lit(1)).alias("rows"))
    means = sized.groupBy(*keys).agg(F.avg("n_labels").alias("mean_labels"))
    if keys:
        return hist.join(means, keys)
    return hist.select("*", means.select("mean_labels").scalar().alias("mean_labels"))


def labelset_counts(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Frequency of whole label sets, key = sorted labels comma-joined (A10)."""
    key = F.array_join(F.array_sort(F.col(labels)), ",")
    return df.groupBy(key.alias("labelset")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- filters

def code_number(code) -> Column:
    """First three characters of the second '-' part as INT; null if not a number (F2)."""
    c = F.col(code) if isinstance(code, str) else code
    return F.substring(F.get(F.split(c, "-"), 1), 1, 3).try_cast("int")


def filter_codes(df: DataFrame, code: str = "code", min_excl: int = 106, max_incl: int | None = None) -> DataFrame:
    """Keep codes whose numeric part is ``> min_excl`` (and ``<= max_incl``) (P5)."""
    n = code_number(code)
    cond = n > min_excl
    if max_incl is not None:
        cond = cond & (n <= max_incl)
    return df.where(cond)


def rare_labels(df: DataFrame, label: str = "label", k: int = 5) -> DataFrame:
    """Labels with frequency below ``k`` -> ``(label, n)``."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def drop_rare_labels(df: DataFrame, label: str = "label", k: int = 5) -> DataFrame:
    """Drop rows whose label occurs fewer than ``k`` times (P10, J4 anti join)."""
    return df.join(rare_labels(df, label, k).select(label), label, "left_anti")


def singletons(df: DataFrame, label: str = "label", keep: bool = True) -> DataFrame:
    """Rows whose label occurs exactly once (``keep``) or all other rows."""
    once = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select(label)
    return df.join(once, label, "left_semi" if keep else "left_anti")


# ---------------------------------------------------------------- windows

def latest_per_key(df: DataFrame, key: str, order: str, tie: str | None = None) -> DataFrame:
    """The row with the largest ``order`` (a number, date, timestamp or text) per
    ``key``; ties -> smallest ``tie`` (W1).

    A ``max_by`` aggregate instead of a window: partial aggregation keeps one
    candidate per key per task, so a key holding a third of the rows is not
    sorted in one task.  Null keys and null orders are skipped.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    kept = df.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    if tie is None:
        return kept.groupBy(key).agg(F.max_by(row, F.col(order)).alias("_r")).select("_r.*")
    # any orderable type: first the largest order per key, then the smallest tie among its rows
    top = kept.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_top"))
    last = kept.join(top, (F.col(key) == F.col("_key")) & (F.col(order) == F.col("_top")))
    return last.groupBy("_key").agg(F.min_by(row, F.col(tie)).alias("_r")).select("_r.*")


def label_rank(long_labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels ranked by frequency, 0 = most frequent, ties by label (W2) -> ``(label, n, rank)``.

    Ranges of (count, label) are ranked apart, so many labels of one count are
    spread over tasks too.
    """
    cnt = long_labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return ordered_positions(cnt, [F.desc("n"), F.asc(label)], "rank").withColumn("rank", F.col("rank").cast("int"))


def primary_label(long_labels: DataFrame, row_id: str, rank: DataFrame, label: str = "label") -> DataFrame:
    """Primary label of each row = its globally most frequent label (W3) -> ``(row_id, label)``."""
    j = long_labels.join(rank.select(label, "rank"), label)
    return j.groupBy(row_id).agg(F.min_by(F.col(label), F.col("rank")).alias(label))


def label_map(labels: DataFrame, label: str = "label") -> DataFrame:
    """Deterministic label <-> id map, ids 0..C-1 in label order (L4, W4) -> ``(label, id)``.

    Ranges of labels are numbered apart, whatever the labels' type and number.
    """
    d = labels.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    return ordered_positions(d, [F.asc("label")], "id").withColumn("id", F.col("id").cast("int"))


def encode_label(df: DataFrame, mapping: DataFrame, col: str = "label", out: str = "label_id") -> DataFrame:
    """Label -> id through a map table."""
    m = mapping.select(F.col("label").alias(col), F.col("id").alias(out))
    return df.join(m, col, "left")


def decode_label(df: DataFrame, mapping: DataFrame, col: str = "label_id", out: str = "label") -> DataFrame:
    """Id -> label through a map table."""
    m = mapping.select(F.col("id").alias(col), F.col("label").alias(out))
    return df.join(m, col, "left")


def dense_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Re-index surviving labels to 0..C-1 in label order."""
    m = label_map(df.select(label), label)
    return df.join(m.select(F.col("label").alias(label), F.col("id").alias("_id")), label).drop(label).withColumnRenamed("_id", label)


def simple_label(df: DataFrame, col: str, out: str = "label") -> DataFrame:
    """Use a plain column as the label and encode any values to 0..C-1."""
    m = label_map(df.select(F.col(col).alias("label")))
    return df.join(m.select(F.col("label").alias(col), F.col("id").alias(out)), col)


# ---------------------------------------------------------------- multi-label (L1-L3)

def explode_codes(df: DataFrame, row_id: str, col: str = "lawids", sep: str = ",", out: str = "code") -> DataFrame:
    """Long form ``(row_id, pos, code)`` of a delimited list column (F1)."""
    return df.select(row_id, F.posexplode(F.split(F.col(col), sep)).alias("pos", out))


def relevant_labels(df: DataFrame, col: str = "lawids", min_excl: int = 106, max_incl: int | None = None,
                    sep: str = ",") -> DataFrame:
    """Distinct codes of the corpus whose numeric part passes ``filter_codes`` (L1) -> ``(label)``."""
    codes = df.select(F.explode(F.split(F.col(col), sep)).alias("label")).distinct()
    return filter_codes(codes, "label", min_excl, max_incl)


def restrict_labels(df: DataFrame, row_id: str, labels: DataFrame, col: str = "lawids", sep: str = ",",
                    out: str = "labels") -> DataFrame:
    """Each row's codes restricted to the relevant set, in their original order (L2).

    Rows left with no code are dropped (P9).  -> ``(row_id, labels ARRAY<STRING>)``.
    """
    long = explode_codes(df, row_id, col, sep, "label").join(labels.select("label"), "label", "left_semi")
    return long.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))),
                                                lambda s: s["label"]).alias(out))


def multi_hot(df: DataFrame, labels: DataFrame, col: str = "lawids", match: str = "exact", sep: str = ",",
              drop_unlabelled: bool = True, out: str = "multi_hot") -> DataFrame:
    """Multi-hot ARRAY<INT> in label-id order.

    The label list is a scalar subquery (one array, one value per class).
    ``match='exact'`` tests list membership; ``'substring'`` reproduces the
    reference's ``label in raw_string`` test.
    """
    all_labels = labels.agg(F.array_sort(F.collect_list("label")).alias("l")).select("l").scalar()
    # a subquery may not sit inside a lambda: bind it to a column first
    df = df.withColumn("_all_labels", all_labels)
    if match == "exact":
        codes = F.split(F.col(col), sep)
        vec = F.transform("_all_labels", lambda l: F.array_contains(codes, l).cast("int"))
    elif match == "substring":
        vec = F.transform("_all_labels", lambda l: (F.instr(F.col(col), l) > 0).cast("int"))
    else:
        raise ValueError(match)
    out_df = df.withColumn(out, vec).drop("_all_labels")
    if drop_unlabelled:
        out_df = out_df.where(F.exists(F.col(out), lambda x: x == 1))
    return out_df
