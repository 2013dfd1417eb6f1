"""Exact-size, seeded, partition-independent splits.

Row order inside a group is ``(md5(id ':' seed), id)``.  A split never sorts a
whole group: rows are counted per (group, md5-prefix bucket) -- 16^5 buckets,
a table whose size is fixed by construction -- the prefix sum over that table
locates the bucket holding each cut, and only rows of those few buckets are
ranked by a window partitioned by (group, bucket).  The result equals a full
``row_number`` ordering, which is what the DuckDB oracle computes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.operators.ranks import ordered_positions
from textlab.session import materialize

HEX_DIGITS = 5
_NO_BUCKET = (1 << 62)
SPLITS = ("train", "valid", "test")


def _same(left: DataFrame, right: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Equi-join in which a null key equals a null key (a missing label is a class of its own)."""
    r = right.select(*[F.col(c).alias(f"__{c}") if c in cols else F.col(c) for c in right.columns])
    cond = None
    for c in cols:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        cond = one if cond is None else cond & one
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{c}" for c in cols])


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def _keyed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return (df.withColumn("_h", hash_key(id_col, seed))
              .withColumn("_bk", F.conv(F.substring("_h", 1, HEX_DIGITS), 16, 10).cast("bigint")))


def _r9(x: Column) -> Column:
    return F.round(x, 9)


def _bucket_counts(k: DataFrame, group: list[str]) -> DataFrame:
    bc = k.groupBy(*group, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    return bc.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def segment_by_cuts(df: DataFrame, group: list[str], id_col: str, seed: int, cuts: DataFrame,
                    out: str = "segment") -> DataFrame:
    """Label each row with the number of cut positions at or before its position.

    ``cuts`` has the ``group`` columns and ``cuts ARRAY<BIGINT>`` (0-based
    positions within the group, ascending).  Position = rank by (md5 key, id).
    """
    k = _keyed(df, id_col, seed)
    bc = _bucket_counts(k, group)
    if group:
        bcc = _same(bc, cuts.select(*group, "cuts"), group, "inner")
    else:  # one group: the cut positions are a handful of numbers
        bcc = bc.withColumn("cuts", _lit_longs(cuts))
    # the bucket holding each cut, and the cut's offset inside it
    hits = (bcc.select(*group, "_bk", "_before", "_n", F.posexplode("cuts").alias("_j", "_c"))
               .withColumn("_c", F.greatest(F.col("_c"), F.lit(0)))
               .where((F.col("_before") <= F.col("_c")) & (F.col("_c") < F.col("_before") + F.col("_n"))))
    info = hits.groupBy(*group).agg(F.collect_list(F.struct(F.col("_bk").alias("b"), (F.col("_c") - F.col("_before")).alias("o"))).alias("_ci"))
    if group:  # one row per group, written: Spark knows its size and deals the rows out by group only when there are many groups
        rows = _same(k, materialize(info, "cuts"), group, "left")
    else:  # one (bucket, offset) pair per cut, fetched as a literal
        got = info.collect()
        pairs = [] if not got else sorted((int(x["b"]), int(x["o"])) for x in got[0]["_ci"])
        lit = F.array(*[F.struct(F.lit(b).cast("bigint").alias("b"), F.lit(o).cast("bigint").alias("o")) for b, o in pairs])
        rows = k.withColumn("_ci", lit if pairs else F.lit(None))
    rows = rows.withColumn("_ci", F.coalesce(F.col("_ci"), F.array().cast("array<struct<b:bigint,o:bigint>>")))
    need = F.exists("_ci", lambda x: (x["b"] == F.col("_bk")) & (x["o"] > 0))
    plain = rows.where(~need).withColumn("_r", F.lit(0).cast("bigint"))
    w = Window.partitionBy(*group, "_bk").orderBy("_h", id_col)
    ranked = rows.where(need).withColumn("_r", (F.row_number().over(w) - 1).cast("bigint"))
    both = plain.unionByName(ranked)
    seg = F.aggregate("_ci", F.lit(0), lambda acc, x: acc + F.when(
        (F.col("_bk") > x["b"]) | ((F.col("_bk") == x["b"]) & (F.col("_r") >= x["o"])), 1).otherwise(0))
    return both.select(*df.columns, seg.cast("int").alias(out))


def _lit_longs(cuts) -> "F.Column":
    """Cut positions as a literal array; ``cuts`` is a list or a one-row DataFrame."""
    if not isinstance(cuts, (list, tuple)):
        cuts = cuts.first()["cuts"]
    return F.array(*[F.lit(int(c)).cast("bigint") for c in cuts])


def _ceil9(x: float) -> int:
    import math
    return int(math.ceil(round(x, 9)))


def _floor9(x: float) -> int:
    import math
    return int(math.floor(round(x, 9)))


def take_quota(df: DataFrame, group: list[str], id_col: str, quota: DataFrame, seed: int = 101,
               out: str = "in_quota") -> DataFrame:
    """Flag the first ``quota`` rows of each group in seeded order.

    ``quota`` has the group columns and an integer ``quota`` column.
    """
    cuts = quota.select(*group, F.array(F.col("quota").cast("bigint")).alias("cuts"))
    return segment_by_cuts(df, group, id_col, seed, cuts, "_seg").withColumn(out, F.col("_seg") == 0).drop("_seg")


def positions(df: DataFrame, id_col: str, seed: int = 101, group: list[str] | None = None, out: str = "pos") -> DataFrame:
    """Seeded shuffle (T5): 0-based position within ``group`` as an output column.

    Bucket offsets come from the bucket-count table; the rank inside a bucket
    is a window partitioned by (group, bucket), so no task holds a whole group.
    """
    group = group or []
    k = _keyed(df, id_col, seed)
    bc = _bucket_counts(k, group).drop("_n")
    w = Window.partitionBy(*group, "_bk").orderBy("_h", id_col)
    return (_same(k, bc, [*group, "_bk"], "inner").withColumn(out, (F.col("_before") + F.row_number().over(w) - 1).cast("bigint"))
             .drop("_h", "_bk", "_before"))


def _counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("f"))


def _assign(seg_df: DataFrame, names=SPLITS, col: str = "segment") -> DataFrame:
    e = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        e = F.when(F.col(col) == i, F.lit(names[i])).otherwise(e)
    return seg_df.withColumn("split", e).drop(col)


def _check_ratios(ratios):
    a, b, c = ratios
    if abs((b + c) - (1 - a)) >= 1e-6:
        raise ValueError(f"ratios must sum to 1: {ratios}")
    return a, b, c


def kshot_quotas(counts: DataFrame, k: int, ratios=(0.8, 0.1, 0.1), on_tiny: str = "train") -> DataFrame:
    """Per-class train / valid / test sizes for K-shot (X2, SURVEY 2.14 branches)."""
    a, b, c = _check_ratios(ratios)
    r = b + c
    f = F.col("f")
    ct = c / r
    enough = _r9(f * a) >= k
    tiny = _r9(f * r) < 2
    m = F.ceil(_r9(f * r))
    train = F.when(enough, F.lit(k)).when(tiny, f - 2).otherwise(f - m)
    test_enough = F.ceil(_r9((f - k) * ct))
    valid = (F.when(enough, f - k - test_enough).when(tiny, F.floor(_r9(F.lit(1 - ct) * 2)))
              .otherwise(F.floor(_r9(F.lit(1 - ct) * m))))
    out = counts.select("*", train.cast("bigint").alias("n_train"), valid.cast("bigint").alias("n_valid"))
    out = out.withColumn("n_test", f - F.col("n_train") - F.col("n_valid"))
    if on_tiny == "train":  # f <= 2 leaves no train row in the reference (it fails)
        out = (out.withColumn("tiny", f <= 2)
                  .withColumn("n_train", F.when(f <= 2, f).otherwise(F.col("n_train")))
                  .withColumn("n_valid", F.when(f <= 2, 0).otherwise(F.col("n_valid")))
                  .withColumn("n_test", F.when(f <= 2, 0).otherwise(F.col("n_test"))))
    return out


def split_kshot(df: DataFrame, label: str, id_col: str, k: int, ratios=(0.8, 0.1, 0.1), seed: int = 101,
                on_tiny: str = "train") -> DataFrame:
    """K-shot split per class (X2) -> input rows plus ``split``."""
    q = kshot_quotas(_counts(df, label), k, ratios, on_tiny)
    cuts = q.select(label, F.array(F.col("n_train"), F.col("n_train") + F.col("n_valid")).alias("cuts"))
    return _assign(segment_by_cuts(df, [label], id_col, seed, cuts))


def stratified_train_quota(counts: DataFrame, label: str, n_train: int, total: int) -> DataFrame:
    """Largest-remainder allocation of ``n_train`` rows over classes; ties by label.

    ``total`` is the row count of ``counts``' classes.  Classes are ranked by ranges
    of their remainder, not in one task.
    """
    cont = _r9(F.col("f").cast("double") * F.lit(int(n_train)) / F.lit(int(total)))
    c = counts.withColumn("_cont", cont).withColumn("_fl", F.floor("_cont"))
    floors = c.agg(F.sum("_fl").alias("s")).first()["s"] or 0
    need = int(n_train) - int(floors)
    c = ordered_positions(c, [F.desc(F.col("_cont") - F.col("_fl")), F.asc(label)], "_rk")
    return c.select(label, "f", (F.col("_fl") + F.when(F.col("_rk") < need, 1).otherwise(0)).cast("bigint").alias("n_train"))


def split_full(df: DataFrame, label: str, id_col: str, ratios=(0.8, 0.1, 0.1), seed: int = 101) -> DataFrame:
    """Full-shot split (X1): singletons to train; stratified train vs rest; rest
    cut into valid / test unstratified."""
    a, b, c = _check_ratios(ratios)
    r = b + c
    counts = _counts(df, label)
    single = materialize(counts.where(F.col("f") == 1).select(label), "singles")  # of a known size: rows are not dealt out by label
    multi_counts = counts.where(F.col("f") > 1)
    rest_df = _same(df, single, [label], "left_anti")
    n_prime = int(multi_counts.agg(F.sum("f").alias("n")).first()["n"] or 0)
    n_rest = _ceil9(n_prime * r)
    q = stratified_train_quota(multi_counts, label, n_prime - n_rest, n_prime)
    first = segment_by_cuts(rest_df, [label], id_col, seed,
                            q.select(label, F.array(F.col("n_train")).alias("cuts")), "_s1")
    train = first.where(F.col("_s1") == 0).drop("_s1").withColumn("split", F.lit("train"))
    rest = first.where(F.col("_s1") == 1).drop("_s1")
    second = segment_by_cuts(rest, [], id_col, seed, [_ceil9(n_rest * (c / r))], "_s2")
    second = second.withColumn("split", F.when(F.col("_s2") == 0, "test").otherwise("valid")).drop("_s2")
    singles = _same(df, single, [label], "left_semi").withColumn("split", F.lit("train"))
    return train.unionByName(second).unionByName(singles)


def split_two(df: DataFrame, label: str, id_col: str, test: float = 0.1, seed: int = 101) -> DataFrame:
    """Two-way stratified split with singletons in train (X5) -> ``split`` in train/valid."""
    counts = _counts(df, label)
    single = materialize(counts.where(F.col("f") == 1).select(label), "singles")  # of a known size: rows are not dealt out by label
    multi_counts = counts.where(F.col("f") > 1)
    n_prime = int(multi_counts.agg(F.sum("f").alias("n")).first()["n"] or 0)
    q = stratified_train_quota(multi_counts, label, n_prime - _ceil9(n_prime * test), n_prime)
    rest_df = _same(df, single, [label], "left_anti")
    seg = segment_by_cuts(rest_df, [label], id_col, seed, q.select(label, F.array("n_train").alias("cuts")))
    two = _assign(seg, ("train", "valid"))
    return two.unionByName(_same(df, single, [label], "left_semi").withColumn("split", F.lit("train")))


def split_random(df: DataFrame, id_col: str, test: float | int = 0.1, seed: int = 101) -> DataFrame:
    """Unstratified two-way split of exact size (X4): ``test`` float -> ceil(test * n)."""
    n = df.count()
    n_test = _ceil9(n * float(test)) if isinstance(test, float) else int(test)
    return _assign(segment_by_cuts(df, [], id_col, seed, [n - n_test]), ("train", "test"))


def sample_fraction(df: DataFrame, id_col: str, p: float, seed: int = 101) -> DataFrame:
    """Deterministic subsample (X8): keep rows whose md5 prefix is below ``p * 2^32``."""
    u = F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("bigint")
    return df.where(u < F.lit(int(p * 4294967296)))


def split_report(df: DataFrame, label: str = "label", tiny_max: int = 2) -> DataFrame:
    """Rows and classes per split, plus ``tiny_classes``: classes of at most
    ``tiny_max`` rows in all, which a K-shot split keeps whole in train (X6)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_f"))
    d = _same(df, sizes, [label], "inner")  # one row per class on the right: broadcast by AQE when small
    return d.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(label)).alias("classes"),
        F.count_distinct(F.when(F.col("_f") <= tiny_max, F.struct(label))).alias("tiny_classes"))


def split_label_counts(df: DataFrame, label: str = "label", splits=SPLITS) -> DataFrame:
    """Per-label counts of each split side by side, missing = 0, by train count."""
    p = df.groupBy(label).pivot("split", list(splits)).agg(F.count(F.lit(1)))
    p = p.fillna(0, subset=list(splits))
    return p.select(label, *[F.col(s).cast("bigint").alias(s) for s in splits]).orderBy(F.desc(splits[0]), label)
