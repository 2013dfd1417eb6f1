r"""Secret scans with a random forest that removes false positives.

Candidates are runs of ``LEAST`` or more characters of ``[A-Za-z0-9+/_-]``, and, of any length and alphabet, values assigned to
an identifier that announces a credential: what stands in quotes, or all up to white space.  Each is described by its length,
its character transitions and kinds, how much of it the corpus' own dictionary covers, path signs around it, and its
neighbouring words; a random forest fitted on labelled findings gives the probability that it is a secret.  Everything is SQL
functions and the JVM's forest; no Python runs on the executors.

* Dictionary: letter runs counted over all documents, those with at least one occurrence in ``RARITY``, so at most
  ``RARITY`` words.  Coverage is the share of a candidate's letter 4-grams that occur in dictionary words.
* Labels are the caller's: a column ``label`` (1 secret, 0 not, null unknown) on candidates.  ``seed_labels`` gives labels by
  known formats where nothing was reviewed.  Copies (same label, value and text before) count once; the forest is fitted on
  at most ``SAMPLE`` of them, half of it for each label, those with the smallest hash.  Both labels weigh the same in the forest.

Cases: null and empty texts have no candidates.  Rows repeating id and text share their findings.  Without labels, or with one
class only, the score is that class' share (0 without labels).  A null id is kept as null.  Very long texts are scanned
whole.  An empty table gives no findings.  ``redact`` passes other columns through.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import materialize

LEAST = 16
RARITY = 50_000
SAMPLE = 20_000
CHARS = "A-Za-z0-9+/_\\-"
#: Characters of the neighbouring text that a candidate keeps on either side, and so many matches that they fill it (with the
#: gap, the shortest takes six characters).
CONTEXT, NEAR = 80, 16
#: Words that announce a harmless identifier; fixed values.
HARMLESS = ["commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "revision", "rev", "blob", "uuid", "guid", "hash", "id"]


def _part(word: str) -> str:
    """``word`` as a part of an identifier: ``key`` in ``api_key``, ``API_KEY`` and ``apiKey``, not in ``monkey`` or ``keyboard``."""
    return f"(?<![A-Za-z]){word}s?(?![a-z])|(?<![A-Za-z]){word.upper()}S?(?![A-Za-z])|{word.capitalize()}s?(?![a-z])"


#: An announcing word in an identifier.  Words that hardly occur inside others announce anywhere in it.
ANNOUNCING = ("(?:(?i:password|passwd|passphrase|passcode|pwd|credential|api_?key)|(?:[Tt]oken|[Ss]ecret)s?(?![a-z])|(?:TOKEN|SECRET)S?(?![A-Z])|"
              + "|".join(_part(w) for w in ("key", "pass", "auth", "authorization", "bearer")) + ")")
#: What stands between the identifier and its value: a closing quote or bracket, a type, the sign, a scheme.
ASSIGN = (r"""[\\"'`\])]{0,3}[ \t]*+(?::[ \t]*\w+[ \t]+=(?!=)|:=|=>|=++|:(?!:))(?:\s*+(?=["'])|[ \t]*+)(?:(?i:bearer|basic)[ \t]+)?""")
VALUE = r"""(?:"(?:[^"\\\n]|\\.)++(?=")|'(?:[^'\\\n]|\\.)++(?=')|(?!(["'])\1(?!\1))(?!["'](?:\s|$))\S+)"""
PATTERN = (f"(?<![{CHARS}])(?=[{CHARS}]++[\\\\\"'`\\])]{{0,3}}[ \\t]*+[=:])(?=[{CHARS}]*?{ANNOUNCING})[{CHARS}]++{ASSIGN}{VALUE}|[{CHARS}]{{{LEAST},}}")
#: The part of such a match before the value.
LEAD = f"^[{CHARS}]+{ASSIGN}(?:[\"'](?=[\\s\\S]))?"
#: Identifiers whose assigned values are credentials whatever their alphabet, in ``before``; values that are code or no value.
STRONG = f"(?i:password|passwd|passphrase|passcode|pwd|secret)[{CHARS}]*[\\\\\"'`\\])]{{0,3}}\\s*:?=+\\s*$"
NO_VALUE = r"""[(\[{<$]|^(?i:none|null|nil|true|false|undefined)\W*$"""
FEATURES = ["length", "digits", "upper", "lower", "signs", "transitions", "distinct", "entropy", "coverage", "slashes", "after_path", "extension",
            "assigned", "quoted", "announced", "harmless", "before_hash", "after_hash", "before_digits"]


def dictionary(docs: DataFrame, text_col: str = "text", rarity: int = RARITY) -> DataFrame:
    """``gram``: letter 4-grams of the corpus' frequent words; at most ``rarity`` words, so the table is bounded."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text_col}`").cast("string")), F.lit("([a-z]{4,})"), F.lit(1))).alias("w"))
    counts = materialize(runs.groupBy("w").agg(F.count("*").alias("n")), "letter-runs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = counts.where((F.col("n") * rarity >= F.lit(total)) & (F.length("w") <= 40))
    return words.select(F.explode(_grams(F.col("w"))).alias("gram")).distinct()


def _grams(letters: Column) -> Column:
    return F.when(F.length(letters) >= 4, F.transform(F.sequence(F.lit(1), F.length(letters) - 3), lambda i: F.substr(letters, i, F.lit(4)))).otherwise(
        F.array().cast("array<string>"))


def _pieces(text: Column) -> Column:
    """The text cut at its candidates: array of ``gap, value, told, before, after``; the last ``value`` is null.  ``gap`` is the
    text since the last candidate, ``told`` says that the value was assigned to an announcing identifier."""
    right = lambda s: F.substr(s, F.greatest(F.lit(1), F.length(s) - (CONTEXT - 1)))
    left = lambda s: F.substr(s, F.lit(1), F.lit(CONTEXT))
    nothing = F.lit(None).cast("string")

    def cut(x: Column, i: Column) -> Column:
        m, lead, pre, post = x["m"], x["lead"], x["pre"], x["post"]
        name = F.regexp_extract(lead, f"^[{CHARS}]+", 0)
        value, mid = F.substr(m, F.length(lead) + 1), F.substr(lead, F.length(name) + 1)
        piece = lambda gap, v, told, before, after: F.struct(gap.alias("gap"), v.alias("value"), F.lit(told).alias("told"),
                                                             right(before).alias("before"), left(after).alias("after"))
        return (F.when(m.isNull(), F.array(piece(x["gap"], nothing, False, pre, F.lit(""))))
                .when(lead == "", F.array(piece(x["gap"], m, False, pre, post)))
                .when(F.length(name) >= LEAST, F.array(piece(x["gap"], name, False, pre, F.concat(mid, value, post)),
                                                       piece(mid, value, True, F.concat(pre, lead), post)))
                .otherwise(F.array(piece(F.concat(x["gap"], lead), value, True, F.concat(pre, lead), post))))

    def around(t: Column) -> Column:
        ends, joined = t["ends"], lambda part, start, n: F.array_join(F.slice(part, start, n), "")
        return F.transform(t["zipped"], lambda x, i: F.struct(
            x["gap"].alias("gap"), x["m"].alias("m"), F.coalesce(F.regexp_extract(x["m"], LEAD, 0), F.lit("")).alias("lead"),
            right(F.concat(F.when(i > 0, joined(ends["tail"], F.greatest(F.lit(1), i + 1 - NEAR), F.least(i, F.lit(NEAR)))).otherwise(F.lit("")), right(x["gap"]))).alias("pre"),
            left(F.concat(left(x["next"]), joined(ends["head"], i + 2, F.lit(NEAR)))).alias("post")))

    matches, rest = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.split(text, PATTERN, -1)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    zipped = let(F.struct(matches.alias("m"), rest.alias("r")), lambda t: F.transform(t["r"], lambda g, i: F.struct(
        g.alias("gap"), F.get(t["m"], i).alias("m"), F.coalesce(F.get(t["r"], i + 1), F.lit("")).alias("next"))))
    m = lambda x: F.coalesce(x["m"], F.lit(""))
    ends = lambda z: F.transform(z, lambda x: F.struct(right(F.concat(x["gap"], m(x))).alias("tail"), left(F.concat(m(x), x["next"])).alias("head")))
    return F.flatten(F.transform(let(let(zipped, lambda z: F.struct(z.alias("zipped"), ends(z).alias("ends"))), around), cut))


def candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text_hash, ordinal, start, value, told, before, after``: one row per candidate, in order of the text."""
    text = F.col(f"`{text_col}`").cast("string")
    found = docs.where(text.rlike(PATTERN)).select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), _pieces(text).alias("pieces"))
    rows = found.select("doc_id", "text_hash", F.posexplode(F.transform("pieces", lambda x: F.struct(
        F.length(x["gap"]).cast("long").alias("gap"), *[x[c].alias(c) for c in ("value", "told", "before", "after")]))).alias("ordinal", "x"))
    rows = rows.select("doc_id", "text_hash", "ordinal", "x.*").dropDuplicates(["doc_id", "text_hash", "ordinal"])
    w = Window.partitionBy("doc_id", "text_hash").orderBy("ordinal")
    start = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("start", F.coalesce(start, F.lit(0)) + F.col("gap")).where("value != ''").select(
        "doc_id", "text_hash", "ordinal", "start", "value", "told", "before", "after")


def features(found: DataFrame, grams: DataFrame) -> DataFrame:
    """``found`` with the columns of ``FEATURES``."""
    v = F.col("value")
    n = F.length(v)
    share = lambda keep: F.length(F.regexp_replace(v, f"[^{keep}]", "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "l"), "[A-Z]+", "U"), "[0-9]+", "9"), "[^lU9]+", ".")
    chars = F.split(v, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    name = F.regexp_extract("before", r"([A-Za-z0-9_]+)[^A-Za-z0-9_]*$", 1)
    after_word = F.lower(F.regexp_extract("after", r"^[^A-Za-z0-9_]*([A-Za-z0-9_]+)", 1))
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(16)).cast("double")
    flag = lambda c: c.cast("double")
    base = found.withColumn("name", name).withColumn("before_word", F.lower("name")).withColumn("after_word", after_word).select(
        "*", n.cast("double").alias("length"), share("0-9").alias("digits"), share("A-Z").alias("upper"), share("a-z").alias("lower"),
        (F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")) / n).alias("signs"), ((F.length(kinds) - 1) / n).alias("transitions"), (F.size(F.array_distinct(chars)) / n).alias("distinct"),
        F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)).alias("entropy"),
        flag(n - F.length(F.translate(v, "/", ""))).alias("slashes"), flag(F.col("before").rlike(r"[/\\.~]$")).alias("after_path"),
        flag(F.col("after").rlike(r"^\.[A-Za-z]{1,5}\b")).alias("extension"), flag(F.col("told") | F.col("before").rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).alias("quoted"),
        flag(F.col("told") | F.col("name").rlike(ANNOUNCING)).alias("announced"), flag(F.col("before_word").isin(HARMLESS)).alias("harmless"),
        bucket(F.col("before_word")).alias("before_hash"), bucket(F.col("after_word")).alias("after_hash"),
        (F.length(F.regexp_replace("before", "[^0-9]", "")) / (F.length("before") + 1)).alias("before_digits"))
    key = ["doc_id", "text_hash", "ordinal"]
    pieces = base.select(*key, F.explode_outer(_grams(F.lower(F.regexp_replace(v, "[^A-Za-z]", "")))).alias("gram"))
    cover = (pieces.join(F.broadcast(grams.withColumn("known", F.lit(1.0))), "gram", "left").groupBy(*key)
             .agg((F.sum(F.coalesce("known", F.lit(0.0))) / F.greatest(F.count("gram"), F.lit(1))).alias("coverage")))
    cover = cover.select(*[F.col(c).alias(f"__{c}") for c in key], "coverage")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    return base.join(cover, same[0] & same[1] & same[2], "left").select(*base.columns, F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def seed_labels(described: DataFrame) -> DataFrame:
    """``label`` by formats alone: 1 for issued key formats and announced, assigned values that are no plain word, short number
    or code; 0 for plain words, plain numbers, paths and announced checksums, none of them announced and assigned; null for the
    rest.  Two slashes make a path unless digits and both cases are mixed, as in base64."""
    v = F.col("value")
    issued = v.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$") | v.rlike(r"^gh[opsu]_[A-Za-z0-9]{36}$") | v.rlike(r"^(sk|rk)_live_[A-Za-z0-9]{16,}$")
    told = (F.col("announced") == 1) & (F.col("assigned") == 1)
    mixed = (F.col("digits") > 0) & ((F.col("digits") < 1) | (F.col("length") >= LEAST))
    sure = (mixed | ((F.col("quoted") == 1) & ~v.rlike(r"\s")) | F.col("before").rlike(STRONG)) & ~v.rlike(NO_VALUE)
    path = (F.col("slashes") > 1) & ~((F.col("digits") > 0) & (F.col("upper") > 0) & (F.col("lower") > 0))
    plain = (F.col("digits") == 0) | (F.col("digits") == 1) | path | (F.col("extension") == 1) | (F.col("harmless") == 1)
    return described.withColumn("label", F.when(issued | (told & sure), 1.0).when(~told & plain, 0.0))


def fit_score(described: DataFrame, labelled: DataFrame, sample: int = SAMPLE, trees: int = 40, depth: int = 8, seed: int = 13) -> DataFrame:
    """``described`` with ``score``, by a forest fitted on ``labelled`` (the same features and ``label``)."""
    known = (labelled.where("label is not null").groupBy("label", "value", "before").agg(F.min(F.struct(*FEATURES)).alias("f"))
             .select("label", F.xxhash64(F.lit(seed), "value", "before").alias("o"), "f.*"))
    known = materialize(known, "labelled")
    rows = [known.where(F.col("label") == c).orderBy("o", *FEATURES).limit(max(1, sample // 2)) for c in (0.0, 1.0)]
    rows = materialize(rows[0].unionByName(rows[1]).coalesce(1), "findings")  # bounded; one partition, so the forest's sampling repeats
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        return described.withColumn("score", F.lit(float(next(iter(classes), 0.0))))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="__x", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="__p",
                                    rawPredictionCol="__raw", predictionCol="__y", weightCol="__weight")
    total = sum(classes.values())
    rows = rows.withColumn("__weight", F.when(F.col("label") == 1, total / (2.0 * classes[1.0])).otherwise(total / (2.0 * classes[0.0])))
    model = forest.fit(assemble.transform(rows.coalesce(1).sortWithinPartitions("o", *FEATURES)))
    scored = model.transform(assemble.transform(described))
    return scored.withColumn("score", vector_to_array("__p")[1]).drop("__x", "__p", "__raw", "__y")


def scan(docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """All findings: ``doc_id, text_hash, ordinal, start, length, value, score, is_secret``.

    ``labelled(doc_id, start, label)`` are reviewed findings; without them ``seed_labels`` stands in."""
    grams = materialize(dictionary(docs, text_col), "grams")
    found = materialize(candidates(docs, text_col, id_col), "candidates")
    described = materialize(features(found, grams), "described")
    if labelled is None:
        taught = seed_labels(described)
    else:
        taught = described.join(labelled.select("doc_id", "start", F.col("label").cast("double").alias("label")), ["doc_id", "start"])
    return fit_score(described, taught).select(
        "doc_id", "text_hash", "ordinal", "start", F.length("value").cast("long").alias("length"), "value", "score",
        (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame, text_col: str = "text", id_col: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; a column ``n_chars`` follows the text."""
    secret = (findings.where("is_secret").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
              .agg(F.collect_set("ordinal").alias("__secret")))
    text = F.col(f"`{text_col}`")
    joined = docs.join(secret, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(text.cast("string")) == F.col("__hash")), "left")
    parts = F.transform(_pieces(text.cast("string")), lambda x, i: F.concat(
        x["gap"], F.when(F.array_contains("__secret", i), F.lit(mark)).otherwise(F.coalesce(x["value"], F.lit("")))))
    joined = joined.withColumn("__text", F.when(F.col("__secret").isNotNull(), F.array_join(parts, "")).otherwise(text))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("__text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("__secret").isNotNull(), F.length("__text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return joined.select(*cols)
