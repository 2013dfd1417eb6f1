"""Baselines, model selection over run logs, vocabulary / encoding and a trained
text classifier (SURVEY M5-M12, K4-K6, M7, M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.arrays import argmax, attention_mask, truncate_pad
from textlab.functions.text import WORD_PATTERN, tokens
from textlab.operators.ranks import MIN_RANGES, grouped_prefix, ordered_positions, range_bucketed
from textlab.session import materialize


# ---------------------------------------------------------------- baselines (M5, M6)

def _uniform01(id_col: str, seed: int) -> Column:
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def baseline(train: DataFrame, evaluate: DataFrame, strategy: str = "most_frequent", label: str = "label",
             id_col: str = "id", constant=None, seed: int = 101) -> DataFrame:
    """Dummy classifier predictions on ``evaluate`` -> ``(id, y_true, y_pred)`` (M5, M6).

    ``most_frequent`` / ``prior``: the training mode (ties: smallest label; a scalar subquery).  ``constant``: ``constant``.
    ``uniform``: an md5-uniform class, by a join on its place among the labels.  ``stratified``: a deterministic
    md5-uniform draw against the cumulative class prior, by a band join: draws and the shares of classes meet in
    ``DRAWS`` buckets of [0, 1), so neither a frequent class nor the class table is in one task.  Without training rows
    the prediction is null.
    """
    ev = evaluate.select(F.col(id_col).alias("id"), F.col(label).alias("y_true"))
    counts = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if strategy in ("most_frequent", "prior"):
        mode = counts.agg(F.min_by("label", F.struct(F.negative("n"), F.col("label"))).alias("m")).select("m").scalar()
        return ev.withColumn("y_pred", mode)
    if strategy == "constant":
        return ev.withColumn("y_pred", F.lit(constant).cast(dict(train.dtypes)[label]))
    ev = evaluate.select(F.col(id_col).alias("id"), F.col(label).alias("y_true"), _uniform01(id_col, seed).alias("_u"))
    if strategy == "uniform":
        named = ordered_positions(counts.where(F.col("label").isNotNull()).select("label"), [F.col("label")], "_i")
        n = named.agg(F.count("*")).scalar()
        return (ev.withColumn("_i", F.floor(F.col("_u") * n)).join(named, "_i", "left")
                .select("id", "y_true", F.col("label").alias("y_pred")))
    if strategy == "stratified":
        prior = _cumulative(counts)
        low, high = F.floor(F.col("lo") * DRAWS), F.least(F.ceil(F.col("hi") * DRAWS) - 1, F.lit(DRAWS - 1))
        bands = prior.withColumn("_d", F.explode(F.sequence(low, F.greatest(low, high))))
        draw = ev.withColumn("_d", F.floor(F.col("_u") * DRAWS))
        inside = (draw["_d"] == bands["_d"]) & (F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi"))
        return draw.join(bands, inside, "left").select("id", "y_true", F.col("label").alias("y_pred"))
    raise ValueError(strategy)


#: Buckets of [0, 1) in which draws meet the prior.
DRAWS = 1024


def _cumulative(counts: DataFrame) -> DataFrame:
    """``label, lo, hi``: each label's share of [0, 1), in the order of labels; prefixes over ranges and within ranges."""
    d = range_bucketed(counts, [F.col("label")])
    total = d.agg(F.sum("n")).scalar()
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = d.groupBy("_b").agg(F.sum("n").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    upto = F.sum("n").over(Window.partitionBy("_b").orderBy("label").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_upto", upto).join(F.broadcast(starts), "_b").withColumn("_upto", F.col("_start") + F.col("_upto"))
    return d.select("label", ((F.col("_upto") - F.col("n")) / total).alias("lo"), (F.col("_upto") / total).alias("hi"))


# ---------------------------------------------------------------- model selection

def best_trial(trials: DataFrame, metric: str = "metric", mode: str = "max", trial_id: str = "trial_id",
               by: list[str] | None = None) -> DataFrame:
    """The best trial overall or per ``by`` group (M9); ties -> smallest trial id.
    ``max_by`` / ``min_by`` aggregate: one candidate per task before the shuffle."""
    cols = trials.columns
    key = F.struct((F.negative(F.col(metric)) if mode == "max" else F.col(metric)).alias("m"), F.col(trial_id).alias("t"))
    row = F.min_by(F.struct(*[F.col(c) for c in cols]), key).alias("_b")
    src = trials.where(F.col(metric).isNotNull())
    out = src.groupBy(*by).agg(row) if by else src.agg(row)
    return out.select("_b.*")


def _cost(col: str, direction: str) -> Column:
    """The objective as a number to be small; NaN is worse than every number."""
    v = F.col(col).cast("double")
    v = v if direction == "min" else -v
    return F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v)


def pareto_front(df: DataFrame, objectives: dict[str, str]) -> DataFrame:
    """Rows not dominated by any other row (M10), e.g.
    ``{'p_retailprice': 'min', 'p_size': 'max'}``; three or more objectives
    (the reference's loss / f1 / accuracy) use a grid, ``_pareto_front_blocked``.

    Exact and without a self-join: sort key = first objective.  A row is on the
    front iff its second objective beats the best second objective of every
    row strictly better on the first, and is the best among rows equal on the
    first.  The prefix best is a bucketed prefix over the distinct values.
    """
    if len(objectives) != 2:
        return _pareto_front_blocked(df, objectives)
    (a, da), (b, db) = objectives.items()
    ka, kb = _cost(a, da), -_cost(b, db)   # smaller = better, larger = better
    d = df.withColumn("_ka", ka).withColumn("_kb", kb).where(F.col("_ka").isNotNull() & F.col("_kb").isNotNull())
    per = d.groupBy("_ka").agg(F.max("_kb").alias("_best_here"))
    per = grouped_prefix(range_bucketed(per, [F.col("_ka")]), [], ["_ka"], F.col("_b"), F.col("_best_here"), "max", False, "_best_before").drop("_b")
    on = d.join(per, "_ka").where((F.col("_kb") == F.col("_best_here"))
                                  & (F.col("_best_before").isNull() | (F.col("_kb") > F.col("_best_before"))))
    return on.drop("_ka", "_kb", "_best_here", "_best_before")


def _dominated(p: "np.ndarray", q: "np.ndarray") -> "np.ndarray":
    """For each row of ``p``: is some row of ``q`` at least as good everywhere and
    better somewhere?  (smaller = better in every column)"""
    import numpy as np
    out = np.zeros(len(p), dtype=bool)
    for s in range(0, len(p), 512):  # bounded memory: 512 x |q| x k booleans
        a = p[s:s + 512, None, :]
        le = (q[None, :, :] <= a).all(axis=2)
        lt = (q[None, :, :] < a).any(axis=2)
        out[s:s + 512] = (le & lt).any(axis=1)
    return out


#: Cells of the grid over all objectives, at most (the driver holds one row for each).
GRID_CELLS = 1024


def _pareto_front_blocked(df: DataFrame, objectives: dict[str, str], block_rows: int = 4096) -> DataFrame:
    """Pareto front for any number of objectives, exact: a skyline over a grid of quantiles.

    1. Cut points per objective make a grid of at most ``GRID_CELLS`` cells.  A cell that is behind some occupied cell in every
       objective is dominated as a whole and goes.
    2. Rows of the other cells meet in groups of about ``block_rows`` of their own cell, and those dominated there go.
    3. A row that is left can only be dominated from a cell that is nowhere behind its own.  Blocks of its cell meet blocks of
       those cells, and of its own, only; a group emits one flag per row of its first block -- rows, never pairs.

    No task holds more than two blocks, also where every row is on the front (objectives that exclude each other): then the
    grid leaves about as many pairs of cells as share a slab.
    """
    import math

    import numpy as np
    import pandas as pd

    names = list(objectives)
    kcols = [f"_k{i}" for i in range(len(names))]
    keys = [_cost(c, d).alias(k) for k, (c, d) in zip(kcols, objectives.items())]
    # written, which fixes the row ids for every later read
    d = materialize(df.withColumn("_rid", F.monotonically_increasing_id()).select("*", *keys).dropna(subset=kcols), "pareto-input")
    per = max(1, int(min(GRID_CELLS, d.count() / 64) ** (1 / len(names))))  # cells worth a group each
    cuts = d.approxQuantile(kcols, [i / per for i in range(1, per)], 0.002) if per > 1 else [[] for _ in kcols]
    place = [sum((F.when(F.col(k) >= F.lit(c), 1).otherwise(0) for c in sorted(set(cs)) if not math.isinf(c)), F.lit(0)) for k, cs in zip(kcols, cuts)]
    ids = d.select("_rid", *kcols, F.array(*place).alias("_cell"))
    found = [(tuple(r["_cell"]), r["n"]) for r in ids.groupBy("_cell").agg(F.count("*").alias("n")).collect()]
    cells = np.array([c for c, _ in found], np.int64).reshape(len(found), len(names))
    ahead = np.array([(cells < c).all(axis=1).any() for c in cells], bool)
    names_of = {c: i for i, (c, _) in enumerate(found) if not ahead[i]}
    spark = df.sparkSession

    def blocks(sizes: dict[int, int]) -> DataFrame:
        rows = [(list(c), i, max(1, math.ceil(sizes[i] / block_rows))) for c, i in names_of.items() if sizes.get(i)]
        return F.broadcast(spark.createDataFrame(rows, "_cell array<int>, _c int, _n int"))

    def in_blocks(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
        return rows.join(blocks(sizes), "_cell").withColumn("_b", F.pmod(F.xxhash64("_rid"), F.col("_n")).cast("int"))

    def local(part: pd.DataFrame) -> pd.DataFrame:
        m = part[kcols].to_numpy(dtype=np.float64)
        return part[~_dominated(m, m)]

    own = in_blocks(ids, {i: n for i, (_, n) in enumerate(found)}).select("_rid", *kcols, "_cell", "_c", "_b")
    left = materialize(own.groupBy("_c", "_b").applyInPandas(local, own.schema).drop("_c", "_b"), "pareto-survivors")
    sizes = {names_of[tuple(r["_cell"])]: r["n"] for r in left.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    # (cell, cell that may dominate it) with the numbers of blocks: pairs of occupied cells of the grid
    n_of = {i: math.ceil(n / block_rows) for i, n in sizes.items()}
    kept = np.array(sorted(n_of), np.int64)
    may = (cells[kept][None, :, :] <= cells[kept][:, None, :]).all(axis=2) if len(kept) else np.zeros((0, 0), bool)
    pairs = [(int(kept[i]), int(kept[j]), n_of[kept[i]], n_of[kept[j]]) for i, j in np.argwhere(may)]
    pairs = F.broadcast(spark.createDataFrame(pairs, "_p int, _q int, _np int, _nq int"))
    side = in_blocks(left, sizes).select("_rid", *kcols, "_c", "_b")
    first = (side.join(pairs, F.col("_c") == F.col("_p")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
             .select("_p", "_q", "_b", "_o", "_rid", *kcols))
    other = (side.withColumnRenamed("_b", "_o").join(pairs, F.col("_c") == F.col("_q")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_np") - 1)))
             .select("_p", "_q", "_b", "_o", *kcols))
    other = other.toDF(*other.columns)  # columns of its own: both sides come from one table

    def check(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        flag = _dominated(p[kcols].to_numpy(dtype=np.float64), q[kcols].to_numpy(dtype=np.float64)) if len(q) else np.zeros(len(p), bool)
        return pd.DataFrame({"_rid": p["_rid"].to_numpy(dtype=np.int64), "_dom": flag})

    by = ["_p", "_q", "_b", "_o"]
    flags = first.groupBy(*by).cogroup(other.groupBy(*by)).applyInPandas(check, "_rid long, _dom boolean")
    front = flags.groupBy("_rid").agg(F.max(F.col("_dom").cast("int")).alias("_dom")).where(F.col("_dom") == 0)
    return d.join(front, "_rid", "left_semi").drop("_rid", *kcols)


def _staircases(threshold: float):
    """Arrow pass over sorted ranges: every row with its place in the run's part of the range, and whether it improves on the
    rows before it there."""
    import numpy as np
    import pyarrow as pa

    def scan(it):
        run, place, best = object(), 0, -np.inf
        for batch in it:
            runs = batch.column(0).to_pylist()
            value = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            places, firsts = np.empty(len(runs), np.int64), np.zeros(len(runs), bool)
            at = [0, *(i for i in range(1, len(runs)) if runs[i] != runs[i - 1]), len(runs)]
            for a, b in zip(at, at[1:]):
                if a == b:
                    continue
                if runs[a] != run:
                    run, place, best = runs[a], 0, -np.inf
                v = np.where(np.isnan(value[a:b]), -np.inf, value[a:b])
                before = np.maximum.accumulate(np.r_[best, v])
                # as long as nothing has a value, every row is an improvement
                with np.errstate(invalid="ignore"):
                    firsts[a:b] = (before[:-1] == -np.inf) | (v - before[:-1] > threshold)
                places[a:b] = np.arange(place, place + b - a)
                place, best = place + b - a, before[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places), pa.array(firsts)], [*batch.schema.names, "_place", "_step"])

    return scan


def early_stop(log: DataFrame, run: str, order: list[str], metric: str, mode: str = "max", patience: int = 3,
               threshold: float = 0.01) -> DataFrame:
    """Early-stopping point of each run (M11) -> ``(run, n_rows, best, stop_pos, stop_at)``.

    A row improves when no earlier row has a value or it beats the best of all earlier rows by more than ``threshold``; the
    streak counts rows since the last improvement; the run stops at its first row with streak >= patience.  Null and NaN
    metrics are no values.

    One scan: rows are dealt once, by ranges of (run, order), so a run of any length, also within one hour, is spread.  Each
    range keeps the rows that beat all rows before them in it.  What one range says about a run is composed with what came
    before: offsets and best values are prefixes over at most one row per (run, range), and a row improves in the whole
    run if it beats the best before its range too.  Between two improvements the streak is their distance.
    """
    sign = 1.0 if mode == "max" else -1.0
    v = F.col(metric).cast("double") * F.lit(sign)
    v = F.when(~F.isnan(v), v)
    n = max(MIN_RANGES, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = log.select(F.col(run).alias("_run"), v.alias("_v"), F.struct(*order).alias("_at")).repartitionByRange(n, "_run", "_at")
    rows = rows.sortWithinPartitions("_run", "_at").withColumn("_part", F.spark_partition_id())
    scan = _staircases(threshold)
    schema = T.StructType([*rows.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_step", T.BooleanType())])
    rows = materialize(rows.mapInArrow(scan, schema), "stop-scan")

    before = Window.partitionBy("_run").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_run", "_part").agg(F.count("*").alias("n"), F.max("_v").alias("m"))
    parts = parts.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_best", F.max("m").over(before))
    same = F.col("_run").eqNullSafe(F.col("r")) & (F.col("_part") == F.col("p"))
    heads = parts.select(F.col("_run").alias("r"), F.col("_part").alias("p"), "_start", "_best")
    steps = rows.where("_step").join(heads, same).where(F.col("_best").isNull() | (F.col("_v") - F.col("_best") > threshold))
    steps = steps.select("_run", "_part", (F.col("_start") + F.col("_place") + 1).alias("pos"))
    total = parts.groupBy("_run").agg(F.sum("n").alias("n_rows"), (F.max("m") * sign).alias("best"))
    # streaks inside a range, then those that reach from one range's last improvement to the next one's first, or to the end
    steps = steps.withColumn("last", F.lag("pos").over(Window.partitionBy("_run", "_part").orderBy("pos")))
    spans = steps.groupBy("_run", "_part").agg(F.min("pos").alias("first"), F.max("pos").alias("final"),
                                               F.min(F.when(F.col("pos") - 1 - F.col("last") >= patience, F.col("last"))).alias("inside"))
    ends = total.select("_run", F.lit(2**31 - 1).alias("_part"), (F.col("n_rows") + 1).alias("first"), F.lit(None).cast("long").alias("final"),
                        F.lit(None).cast("long").alias("inside"))
    spans = spans.unionByName(ends).withColumn("last", F.lag("final").over(Window.partitionBy("_run").orderBy("_part")))
    across = F.when(F.col("first") - 1 - F.col("last") >= patience, F.col("last"))
    stops = spans.groupBy("_run").agg((F.min(F.least("inside", across)) + patience).alias("stop_pos")).where("stop_pos is not null")
    stops = stops.withColumnRenamed("_run", "s")
    places = heads.join(stops, F.expr("r <=> s")).select(F.col("r"), F.col("p"), (F.col("stop_pos") - 1 - F.col("_start")).alias("q"))
    stop_at = rows.join(places, same & (F.col("_place") == F.col("q"))).select(F.col("_run").alias("t"), F.col("_at").alias("stop_at"))
    return (total.join(stops, F.expr("_run <=> s"), "left").join(stop_at, F.expr("_run <=> t"), "left")
            .select(F.col("_run").alias(run), "n_rows", "best", "stop_pos", "stop_at"))


def best_checkpoint(log: DataFrame, run: str, step: str, metric: str, mode: str = "max") -> DataFrame:
    """Best checkpoint of each run by metric, not by name (M12); ties -> earliest step."""
    key = F.struct((F.negative(F.col(metric)) if mode == "max" else F.col(metric)).alias("m"), F.col(step).alias("s"))
    return log.where(F.col(metric).isNotNull()).groupBy(run).agg(
        F.min_by(F.col(step), key).alias("best_step"), F.min_by(F.col(metric), key).alias("best_metric"))


# ---------------------------------------------------------------- vocabulary and encoding

SPECIALS = ["<pad>", "<unk>", "<s>", "</s>"]


def build_vocab(df: DataFrame, text: str = "text", size: int = 30000, specials=SPECIALS, pattern: str = WORD_PATTERN,
                lower: bool = True) -> DataFrame:
    """Vocabulary of the ``size`` most frequent tokens after the specials (K4)
    -> ``(token, id)``; ties by token.  The window runs over at most ``size`` rows."""
    from textlab.operators.freq import word_freq
    f = word_freq(df, text, remove_stop_words=False, pattern=pattern, lower=lower)
    top = f.orderBy(F.desc("frequency"), F.asc("word")).limit(size)
    top = top.select(F.col("word").alias("token"),
                     (F.row_number().over(Window.orderBy(F.desc("frequency"), F.asc("word"))) - 1 + len(specials)).cast("int").alias("id"))
    sp = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(specials)], "token string, id int")
    return sp.unionByName(top)


def encode(df: DataFrame, vocab: DataFrame, text: str = "text", max_length: int = 416, pattern: str = WORD_PATTERN,
           lower: bool = True, unk: str = "<unk>", pad_id: int = 0) -> DataFrame:
    """Token ids truncated to ``max_length`` and padded to the longest sequence of
    the whole set, with an attention mask (K5, F18).

    Only the first ``max_length`` tokens are looked up, each distinct sequence
    once: an equi-join of its tokens with the vocabulary, regrouped by the
    sequence's digest, so the vocabulary's size does not matter.  The vocabulary is
    written first: it is made once, and Spark knows its size, so below the broadcast
    threshold no token is dealt out by its text, however frequent.
    """
    vocab = materialize(vocab.select("token", "id"), "vocab")
    unk_id = vocab.where(F.col("token") == unk).select("id").scalar()
    d = (df.withColumn("_tok", F.slice(tokens(text, pattern, lower=lower), 1, max_length))
         .withColumn("_key", F.sha2(F.concat_ws("\u0000", "_tok"), 256)).withColumn("_unk", unk_id))
    long = d.select("_key", "_tok").dropDuplicates(["_key"]).select("_key", F.posexplode("_tok").alias("_pos", "token"))
    ids = (long.join(vocab.select("token", "id"), "token", "left").groupBy("_key")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("id", F.lit(-1)).alias("id")))), lambda s: s["id"]).alias("_found")))
    d = d.join(ids, "_key", "left").withColumn("_ids", F.transform(
        F.coalesce("_found", F.array().cast("array<int>")), lambda x: F.when(x == -1, F.col("_unk")).otherwise(x)))
    longest = df.select(F.least(F.size(tokens(text, pattern, lower=lower)), F.lit(max_length)).alias("n")).agg(F.max("n").alias("m")).select("m").scalar()
    d = d.withColumn("_len", longest)
    return (d.withColumn("input_ids", truncate_pad(F.col("_ids"), F.col("_len"), pad_id))
             .withColumn("attention_mask", attention_mask(F.col("_ids"), F.col("_len")))
             .drop("_tok", "_key", "_found", "_unk", "_ids", "_len"))


def token_lengths(df: DataFrame, text: str = "text", pattern: str = WORD_PATTERN, lower: bool = True) -> DataFrame:
    """Tokens per row without truncation (K6) -> input plus ``n_tokens``; the mean is ``avg`` of it."""
    return df.withColumn("n_tokens", F.size(tokens(text, pattern, lower=lower)))


# ---------------------------------------------------------------- trained classifier (M7, M8)

def train_text_classifier(train: DataFrame, text: str = "text", label: str = "label", num_features: int = 1 << 18,
                          reg_param: float = 0.01, max_iter: int = 50, pattern: str = r"[^\p{L}\p{M}\p{N}]+"):
    """Fit tokenise -> HashingTF -> IDF -> multinomial logistic regression (M7).

    Re-aims the reference's fine-tuning: weight decay -> ``reg_param``,
    epochs -> ``max_iter``.  Training is distributed by ``pyspark.ml``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    tok = RegexTokenizer(inputCol=text, outputCol="_words", pattern=pattern, gaps=True, toLowercase=True)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=reg_param, maxIter=max_iter,
                            family="multinomial", predictionCol="_prediction", probabilityCol="_probability",
                            rawPredictionCol="_raw")
    model = Pipeline(stages=[tok, tf, idf, lr]).fit(train.withColumn("_label", F.col(label).cast("double")))
    return model


def score(model, df: DataFrame, id_col: str = "id", label: str | None = "label") -> DataFrame:
    """Batch scoring, prediction = argmax of the class probabilities (M8)."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    probs = vector_to_array("_probability")
    cols = [F.col(id_col).alias("id")]
    if label:
        cols.append(F.col(label).alias("y_true"))
    return out.select(*cols, argmax(probs).alias("y_pred"), F.array_max(probs).alias("confidence"))
