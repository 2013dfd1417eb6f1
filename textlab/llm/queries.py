"""The registered queries ``opN_<name>`` of this subpackage and their DuckDB SQL.

Each query applies one operator with production parameters to its whole table and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import bpe_replay, class_lm, turn_repair
from textlab.llm import common as C
from textlab.llm.bbit_minhash import near_duplicates
from textlab.llm.embedding_range import range_join
from textlab.llm.language_mix import identify, learn
from textlab.llm.mixing import mix
from textlab.llm.packing import pack
from textlab.llm.periodic_runs import periodic_runs
from textlab.llm.quality_mil import fit, score
from textlab.llm.quality_rules import apply_rules
from textlab.llm.repeat_removal import remove_repeats
from textlab.llm.secret_forest import scan
from textlab.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op9_quality_rules", r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] as g
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 2)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c >= 2),
cov as (select doc_id, count(distinct i + d)::BIGINT as n from rep, (values (0), (1), (2)) t(d) group by doc_id),
lines as (select doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]')),
ln as (select doc_id, count(*) as n, count(*) - count(distinct l) as dup from lines group by doc_id),
stop as (select doc_id, count(*) as n from (select doc_id, unnest(ws) as x from w) where lower(x) in ({STOP}) group by doc_id),
m as (select w.doc_id, len(ws)::BIGINT as n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT as n_symbols,
  coalesce(ln.dup, 0)::BIGINT as n_dup_lines, coalesce(cov.n, 0)::BIGINT as n_repeat_words,
  coalesce(ln.n, 0) as n_lines, len(regexp_extract_all(text, '\p{Lu}')) as n_upper, len(regexp_extract_all(text, '!')) as n_exclaims,
  coalesce(stop.n, 0) as n_stop_words
  from w left join ln using (doc_id) left join cov using (doc_id) left join stop using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
  and (n_words = 0 or (word_chars >= 2.0 * n_words and word_chars <= 14.0 * n_words))
  and (n_words = 0 or n_symbols <= 0.25 * n_words) and (word_chars = 0 or n_upper <= 0.4 * word_chars)
  and (n_words = 0 or n_exclaims <= 0.5 * n_words) and (n_words = 0 or n_stop_words >= 0.01 * n_words)
  and (n_lines = 0 or n_dup_lines <= 0.5 * n_lines) and (n_words = 0 or n_repeat_words <= 0.4 * n_words) as kept
from m""".replace("{STOP}", ", ".join(f"'{w}'" for w in __import__("textlab.llm.quality_rules", fromlist=["STOP_WORDS"]).STOP_WORDS)))
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold table over every whole text."""
    return apply_rules(C.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op8_bbit_minhash", r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + least(4, len(ws)) - 1], ' ') as g
  from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, least(len(ws), 1)))) as i from w)),
n as materialized (select doc_id, count(*)::BIGINT as n from s group by doc_id),
l as materialized (select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y using (g) where x.doc_id != y.doc_id group by all) p
  join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * c >= 80 * (na.n + nb.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join l on l.a = r.b),
c as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0)::BIGINT as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join c on c.a = d.doc_id left join n using (doc_id)""")
def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on 4-word shingles at similarity 0.8."""
    return near_duplicates(C.documents(spark, sf_dir), k=4, threshold=80)


@register("op10_language_mix")
def op10_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents outside the held-out fold."""
    docs = C.documents(spark, sf_dir)
    model = learn(docs.where(C.fold("doc_id", 3) != 1))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (C.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@register("op4_source_mix")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights, with the shard and place of every copy that the mix takes."""
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return mix(C.documents(spark, sf_dir)).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies")


@register("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces packed into sequences of 4096."""
    import public_tokenizers

    return pack(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@register("op1_quality_mil")
def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learned from the labels outside the held-out fold."""
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(C.fold("doc_id", 5) != 0)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (C.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op3_embedding_range", """
with recursive v as materialized (select vec_id, embedding::DOUBLE[] as e from embeddings),
n as materialized (select vec_id, e, sqrt(list_dot_product(e, e)) as norm from v
  where e is not null and len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0),
l as materialized (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id != b.vec_id and len(a.e) = len(b.e)
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join l on l.a = r.b),
c as (select a, min(b) as component_id from reach group by a),
k as (select a, count(*)::BIGINT as n_links from l group by a)
select d.vec_id, coalesce(k.n_links, 0)::BIGINT as n_links, c.component_id, d.vec_id = c.component_id as kept
from embeddings d join c on c.a = d.vec_id left join k on k.a = d.vec_id""")
def op3_embedding_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings at cosine 0.95."""
    C.prepare(spark)
    return range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)


@register("op7_class_lm")
def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-bigram scores of all whole texts, learned outside the held-out fold."""
    return class_lm.score(C.documents(spark, sf_dir), C.fold("doc_id", 7) == 2)


@register("op6_repeat_removal")
def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the bytes of 100-byte strings that start earlier."""
    return remove_repeats(C.documents(spark, sf_dir))


@register("op2_secret_forest")
def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all whole texts with the forest's verdict; the value itself is not returned."""
    return scan(C.documents(spark, sf_dir)).select("doc_id", "ordinal", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@register("op11_bpe_replay")
def op11_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as byte-level BPE ids, and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_replay.round_trip(C.documents(spark, sf_dir), path, public_tokenizers.PATTERN, keep=["doc_id"], chunks=bpe_replay.CHUNKS)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """The contract's input of op12: a tenth of the texts, by the hash of the id, repeat a stretch of words to their end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({C.WORD_RE})"), F.lit(1)))
    damaged = (docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
               .withColumn("n", F.size("w")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
               .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")))
    tail = "flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int)))"
    text = F.expr(f"case when n > 0 then array_join(slice(concat(slice(w, 1, a), {tail}), 1, n), ' ') else text end")
    return damaged.select("doc_id", text.alias("text"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every whole text, and the texts without their repetitions."""
    found = periodic_runs(repeated_tails(C.documents(spark, sf_dir)), keep=["doc_id"])
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("best", first)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.col2")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"), F.expr("1000 * best.length div -best.col3").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """The contract's input of op13: rows are dropped, emptied, cut, repeated or given to the user by a hash of their place."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = turns.withColumn("hit", F.crc32(key) % 20).where("hit != 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    rows = hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("copy", F.explode(F.expr("sequence(1, n)"))).drop("n", "copy")


@register("op13_turn_repair")
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations aligned with the grammar of turns: faults, least cost, audit and repaired text of each."""
    C.prepare(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                                                         F.coalesce("text", F.lit(" ")).alias("text"))
    rows = damaged_turns(turns)
    report = materialize(turn_repair.audits(rows), "audits")
    hashes = turn_repair.repaired_hashes(rows, report)
    every = turns.select(F.col("conv_id").alias("id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    both = report.withColumnRenamed("conv_id", "a").join(hashes.withColumnRenamed("conv_id", "b"), F.expr("a <=> b")).withColumn("found", F.lit(True))
    return every.join(both, F.expr("id <=> a and found"), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
