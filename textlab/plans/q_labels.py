"""Registered label and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab import fixtures as fx
from textlab.functions import scalar as sc
from textlab.functions.arrays import decode_active, sort_by_rank
from textlab.functions.text import strip_spans_col
from textlab.operators import labels as lb
from textlab.operators import select as sel
from textlab.plans.prepare_cases import prepare_cases
from textlab.session import scratch_path
from textlab.sources.delimited import read_delimited, write_delimited
from textlab.plans.registry import r6, register

SQL_CASES = """(select l_orderkey as dekaid,
  array_to_string(list_sort(list_distinct(list('LI-' || (100 + l_partkey % 30)::VARCHAR || '-0' || (l_linenumber % 2)::VARCHAR))), ',') as lawids,
  'order ' || l_orderkey::VARCHAR || ' <discr>lines ' || count(*)::VARCHAR || '</discr> end' as fact,
  (count(*) % 2)::INTEGER as isguilty from lineitem group by l_orderkey)"""
SQL_CODES = f"(select dekaid, unnest(string_split(lawids, ',')) as label from {SQL_CASES})"
SQL_CODES_POS = f"(select dekaid, unnest(string_split(lawids, ',')) as label, unnest(range(len(string_split(lawids, ',')))) as pos from {SQL_CASES})"
SQL_NUM = "try_cast(substr(string_split(label, '-')[2], 1, 3) as integer)"
SQL_REL = f"(select distinct label from {SQL_CODES} where {SQL_NUM} > 106)"
SQL_LONG = f"(select * from {SQL_CODES} where label in (select label from {SQL_REL}))"
SQL_RANK = f"(select label, count(*)::BIGINT as n, (row_number() over (order by count(*) desc, label) - 1)::INTEGER as rank from {SQL_LONG} group by label)"
SQL_RESTRICT = f"""(select dekaid, list(label order by pos) as labels from {SQL_CODES_POS}
  where label in (select label from {SQL_REL}) group by dekaid)"""
SQL_LABELLED = "(select d.doc_id, d.text, (l.quality * 2 + l.toxic)::INTEGER as label from documents d join labels l using (doc_id))"


def _cases(spark, d):
    return fx.cases(spark, d)


def _restricted(spark, d):
    c = _cases(spark, d)
    return lb.restrict_labels(c, "dekaid", lb.relevant_labels(c))


@register("P1", f"select text, label from {SQL_LABELLED}")
def q_p1(spark, d):
    return sel.as_labelled(fx.labelled(spark, d), "text", "label")


@register("P2", "select text from documents")
def q_p2(spark, d):
    return sel.column_at(fx.table(spark, d, "documents"), 1)


@register("P3", "select p_partkey, p_size - 1 as p_size from part")
def q_p3(spark, d):
    return sel.shift_label(fx.table(spark, d, "part").select("p_partkey", "p_size"), "p_size", -1)


@register("P4", "select page_id, regexp_replace(html, '<nav>.*?</nav>', '', 'g') as html_stripped from pages")
def q_p4(spark, d):
    return sel.strip_spans(fx.table(spark, d, "pages"), "html", "nav", "html_stripped").select("page_id", "html_stripped")


@register("F3", f"select dekaid, regexp_replace(fact, '<discr>.*?</discr>', '', 'g') as filtered_fact from {SQL_CASES}")
def q_f3(spark, d):
    return _cases(spark, d).select("dekaid", strip_spans_col("fact", "discr").alias("filtered_fact"))


@register("P5", f"select dekaid, label from {SQL_CODES} where {SQL_NUM} > 106")
def q_p5(spark, d):
    return lb.filter_codes(lb.explode_codes(_cases(spark, d), "dekaid", out="label"), "label").select("dekaid", "label")


@register("F2", f"select distinct label, {SQL_NUM} as number from {SQL_CODES}")
def q_f2(spark, d):
    c = lb.explode_codes(_cases(spark, d), "dekaid", out="label")
    return c.select("label", lb.code_number("label").alias("number")).distinct()


@register("P6", f"select dekaid, label from {SQL_CODES} where label not in ('LI-107-00', 'LI-110-01', 'LI-129-00')")
def q_p6(spark, d):
    return sel.exclude_values(lb.explode_codes(_cases(spark, d), "dekaid", out="label"), "label",
                              ["LI-107-00", "LI-110-01", "LI-129-00"]).select("dekaid", "label")


@register("P9", f"select distinct dekaid from {SQL_LONG}")
def q_p9(spark, d):
    c = _cases(spark, d)
    return lb.multi_hot(c, lb.relevant_labels(c)).select("dekaid")


SQL_RARE1000 = "(select doc_id, (n_chars // 1000)::BIGINT as label from documents)"
SQL_RARE100 = "(select doc_id, (n_chars // 100)::BIGINT as label from documents)"


@register("P10", f"""select doc_id, label from {SQL_RARE1000} where label in
  (select label from {SQL_RARE1000} group by label having count(*) >= 5)""")
def q_p10(spark, d):
    return lb.drop_rare_labels(fx.rare(spark, d, 1000).select("doc_id", "label"), "label", 5)


@register("J4", f"""select doc_id, label from {SQL_RARE1000} where label in
  (select label from {SQL_RARE1000} group by label having count(*) < 5)""")
def q_j4(spark, d):
    r = fx.rare(spark, d, 1000).select("doc_id", "label")
    return r.join(lb.rare_labels(r, "label", 5).select("label"), "label", "left_semi").select("doc_id", "label")


@register("P11", f"""select doc_id, label from {SQL_RARE100} where label in
  (select label from {SQL_RARE100} group by label having count(*) = 1)""")
def q_p11(spark, d):
    return lb.singletons(fx.rare(spark, d, 100).select("doc_id", "label"), "label")


@register("P12", "select doc_id, text from documents order by doc_id limit 5")
def q_p12(spark, d):
    return sel.preview(fx.table(spark, d, "documents").select("doc_id", "text"), 5, ["doc_id"])


@register("W1", """select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as rn
  from conversations where conv_id is not null and turn is not null) where rn = 1""")
def q_w1(spark, d):
    return lb.latest_per_key(fx.table(spark, d, "conversations"), "conv_id", "turn")


@register("W2", f"select * from {SQL_RANK}")
def q_w2(spark, d):
    c = _cases(spark, d)
    long = lb.explode_codes(c, "dekaid", out="label").join(lb.relevant_labels(c), "label", "left_semi")
    return lb.label_rank(long)


@register("W3", f"select dekaid, arg_min(label, rank) as label from {SQL_LONG} join {SQL_RANK} using (label) group by dekaid")
def q_w3(spark, d):
    c = _cases(spark, d)
    long = lb.explode_codes(c, "dekaid", out="label").join(lb.relevant_labels(c), "label", "left_semi")
    return lb.primary_label(long, "dekaid", lb.label_rank(long))


@register("W4", f"""select doc_id, (dense_rank() over (order by label) - 1)::INTEGER as label from {SQL_RARE100}""")
def q_w4(spark, d):
    return lb.dense_labels(fx.rare(spark, d, 100).select("doc_id", "label"), "label").select("doc_id", "label")


@register("L1", f"select label from {SQL_REL}")
def q_l1(spark, d):
    return lb.relevant_labels(_cases(spark, d))


@register("L2", f"select dekaid, array_to_string(labels, ',') as labels from {SQL_RESTRICT}")
def q_l2(spark, d):
    return _restricted(spark, d).select("dekaid", F.array_join("labels", ",").alias("labels"))


@register("L3", f"""select dekaid, array_to_string(list_transform(r.l, lambda x: (list_contains(string_split(lawids, ','), x))::INTEGER), ',') as multi_hot
  from {SQL_CASES}, (select list(label order by label) as l from {SQL_REL}) r
  where list_bool_or(list_transform(r.l, lambda x: list_contains(string_split(lawids, ','), x)))""")
def q_l3(spark, d):
    c = _cases(spark, d)
    return lb.multi_hot(c, lb.relevant_labels(c)).select("dekaid", F.array_join("multi_hot", ",").alias("multi_hot"))


@register("L4", f"select label, (row_number() over (order by label) - 1)::INTEGER as id from {SQL_REL}")
def q_l4(spark, d):
    return lb.label_map(lb.relevant_labels(_cases(spark, d)))


@register("L5", "select event_id, (dense_rank() over (order by event_type) - 1)::INTEGER as label from events")
def q_l5(spark, d):
    return lb.simple_label(fx.table(spark, d, "events").select("event_id", "event_type"), "event_type").select("event_id", "label")


@register("J3", f"""select c.dekaid, c.label, m.id as label_id, m.label as decoded from {SQL_LONG} c
  join (select label, (row_number() over (order by label) - 1)::INTEGER as id from {SQL_REL}) m using (label)""")
def q_j3(spark, d):
    c = _cases(spark, d)
    rel = lb.relevant_labels(c)
    m = lb.label_map(rel)
    long = lb.explode_codes(c, "dekaid", out="label").join(rel, "label", "left_semi")
    enc = lb.encode_label(long, m, "label", "label_id")
    return lb.decode_label(enc.select("dekaid", "label", "label_id"), m, "label_id", "decoded").select("dekaid", "label", "label_id", "decoded")


SQL_L6 = f"""with long as {SQL_LONG}, rk as {SQL_RANK},
  prim as (select dekaid, arg_min(label, rank) as code from long join rk using (label) group by dekaid),
  ids as (select label as code, row_number() over (order by label) - 1 as id from {SQL_REL}),
  lab as (select p.dekaid, i.id as label from prim p join ids i using (code)),
  kept as (select * from lab where label in (select label from lab group by label having count(*) >= 5)),
  dn as (select label, row_number() over (order by label) - 1 as nl from (select distinct label from kept))
  select dn.nl::INTEGER as label, regexp_replace(c.fact, '<discr>.*?</discr>', '', 'g') as filtered_fact
  from kept join dn using (label) join {SQL_CASES} c using (dekaid)"""


@register("L6", SQL_L6)
def q_l6(spark, d):
    return prepare_cases(_cases(spark, d), "lawids", order=None)


def _issues(spark, d):
    """Every case in two issues: an old text as issue 1, the case as issue 2."""
    c = _cases(spark, d)
    old = c.withColumn("fact", F.concat(F.lit("superseded "), "fact")).withColumn("issueno", F.lit(1))
    return old.unionByName(c.withColumn("issueno", F.lit(2)))


def _written(spark, cleaned):
    """Through the delimited sink and back, as the preparation ends."""
    path = scratch_path(spark, "l6")
    write_delimited(cleaned, path)
    return read_delimited(spark, path, schema="label int, filtered_fact string")


@register("L6_issues", SQL_L6)
def q_l6_issues(spark, d):
    return _written(spark, prepare_cases(_issues(spark, d), "lawids", order="issueno"))


@register("L6_guilty", f"""select isguilty::INTEGER as label, regexp_replace(fact, '<discr>.*?</discr>', '', 'g') as filtered_fact from {SQL_CASES}""")
def q_l6_guilty(spark, d):
    return _written(spark, prepare_cases(_issues(spark, d), "isguilty", order="issueno"))


@register("A6", f"""with long as {SQL_LONG}, rk as {SQL_RANK},
  prim as (select dekaid, arg_min(label, rank) as code from long join rk using (label) group by dekaid),
  kept as (select * from prim where code in (select code from prim group by code having count(*) >= 5))
  select * from (values (0, 'raw', (select count(*) from {SQL_CASES})::BIGINT),
    (1, 'labelled', (select count(*) from prim)::BIGINT),
    (2, 'frequent_labels', (select count(*) from kept)::BIGINT),
    (3, 'cleaned', (select count(*) from kept)::BIGINT)) t(step, stage, rows)""")
def q_a6(spark, d):
    _, stages = prepare_cases(_cases(spark, d), "lawids", order=None, with_stages=True)
    return stages


@register("A4", f"select label::VARCHAR as label, count(*)::BIGINT as n from {SQL_LABELLED} group by 1")
def q_a4(spark, d):
    return lb.label_counts(fx.labelled(spark, d), "label")


@register("A5", f"select distinct label from {SQL_RARE100}")
def q_a5(spark, d):
    return lb.classes(fx.rare(spark, d, 100), "label")


@register("T4", f"select label, count(*)::BIGINT as n from {SQL_RARE100} group by label order by label")
def q_t4(spark, d):
    return fx.rare(spark, d, 100).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label")


@register("A7", f"""select label, count(distinct dekaid)::BIGINT as ones,
  ((select count(*) from {SQL_CASES}) - count(distinct dekaid))::BIGINT as zeros from {SQL_LONG} group by label""")
def q_a7(spark, d):
    c = _cases(spark, d)
    long = lb.explode_codes(c, "dekaid", out="label").join(lb.relevant_labels(c), "label", "left_semi")
    return lb.label_presence(long, c, "dekaid")


@register("A8", f"""select len(labels)::INTEGER as n_labels, count(*)::BIGINT as rows,
  round((select avg(len(labels)) from {SQL_RESTRICT}), 6) as mean_labels from {SQL_RESTRICT} group by 1""")
def q_a8(spark, d):
    h = lb.label_cardinality(_restricted(spark, d), "labels")
    return h.select("n_labels", "rows", r6("mean_labels").alias("mean_labels"))


@register("A10", f"select array_to_string(list_sort(labels), ',') as labelset, count(*)::BIGINT as n from {SQL_RESTRICT} group by 1")
def q_a10(spark, d):
    return lb.labelset_counts(_restricted(spark, d), "labels")


# ---- scalar functions over the cases / documents / events tables

@register("F1", f"select dekaid, len(string_split(lawids, ','))::INTEGER as n_codes from {SQL_CASES}")
def q_f1(spark, d):
    return _cases(spark, d).select("dekaid", F.size(F.split("lawids", ",")).alias("n_codes"))


@register("F4", f"select dekaid, contains(lawids, 'LI-11') as has_substring, list_contains(string_split(lawids, ','), 'LI-111-01') as has_code from {SQL_CASES}")
def q_f4(spark, d):
    return _cases(spark, d).select("dekaid", F.col("lawids").contains("LI-11").alias("has_substring"),
                                   F.array_contains(F.split("lawids", ","), "LI-111-01").alias("has_code"))


@register("F5", f"select dekaid, list_filter(string_split(lawids, ','), lambda x: x in ('LI-111-01', 'LI-112-00')) = [] as none_kept from {SQL_CASES}")
def q_f5(spark, d):
    keep = F.array(F.lit("LI-111-01"), F.lit("LI-112-00"))
    return _cases(spark, d).select("dekaid", (F.size(F.filter(F.split("lawids", ","), lambda x: F.array_contains(keep, x))) == 0).alias("none_kept"))


@register("F6", "select doc_id, length(text)::INTEGER as n, length(text) = n_chars as same from documents")
def q_f6(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), (F.length("text") == F.col("n_chars")).alias("same"))


@register("F7", "select conv_id, turn, regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') as text from conversations")
def q_f7(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


@register("F8", """select distinct source, case when lower(source) in ('tscc') then 'TSCC'
  when lower(source) in ('wangchan', 'wangchanberta') then 'Corpora Used by WangChanBERTa'
  when lower(source) in ('wongnai') then 'Wongnai' else '<Unknown>' end as title from
  (select source from documents union all select 'TSCC' union all select 'WangChan' union all select 'wongnai')""")
def q_f8(spark, d):
    docs = fx.table(spark, d, "documents").select("source")
    extra = docs.sparkSession.createDataFrame([("TSCC",), ("WangChan",), ("wongnai",)], "source string")
    return docs.unionByName(extra).select("source", sc.corpus_title("source").alias("title")).distinct()


@register("F9", "select event_id, printf('%.6f', value) as value_text from events")
def q_f9(spark, d):
    return fx.table(spark, d, "events").select("event_id", sc.fixed6("value").alias("value_text"))


@register("F10", """select event_id, value::VARCHAR as value_text,
  lower(event_type) in ('true', 't', 'yes', 'y', 'click') as flag from events""")
def q_f10(spark, d):
    ev = fx.table(spark, d, "events")
    return ev.select("event_id", F.col("value").cast("string").alias("value_text"),
                     sc.parse_bool("event_type", extra_true=("click",)).alias("flag"))


@register("F11", "select event_id, round(ln(value + 1), 6) as ln_v, round(pow(value, 2), 6) as sq, round(pow(value, 0.5), 6) as root from events where value >= 0")
def q_f11(spark, d):
    ev = fx.table(spark, d, "events").where(F.col("value") >= 0)
    return ev.select("event_id", r6(F.log(F.col("value") + 1)).alias("ln_v"), r6(F.pow("value", 2)).alias("sq"),
                     r6(F.pow("value", 0.5)).alias("root"))


@register("F16", """select vec_id as id, array_to_string(list_transform(list_filter(list_zip(h, ['l0','l1','l2','l3','l4','l5','l6','l7']), lambda p: p[1] = 1), lambda p: p[2]), ',') as names
  from (select vec_id, list_transform(embedding[1:8], lambda x: (1.0 / (1.0 + exp(-x::DOUBLE)) >= 0.5)::INTEGER) as h from embeddings)""")
def q_f16(spark, d):
    ml = fx.mlpreds(spark, d)
    names = [f"l{i}" for i in range(8)]
    return ml.select("id", F.array_join(decode_active("y_pred", names), ",").alias("names"))


@register("F17", f"""select dekaid, array_to_string(list(label order by rank, label), ',') as by_rank
  from {SQL_LONG} join {SQL_RANK} using (label) group by dekaid""")
def q_f17(spark, d):
    c = _cases(spark, d)
    rel = lb.relevant_labels(c)
    long = lb.explode_codes(c, "dekaid", out="label").join(rel, "label", "left_semi")
    rk = lb.label_rank(long)
    rank_map = rk.agg(F.map_from_entries(F.collect_list(F.struct("label", "rank"))).alias("m")).select("m").scalar()
    rows = lb.restrict_labels(c, "dekaid", rel).withColumn("_rank_map", rank_map)
    return rows.select("dekaid", F.array_join(sort_by_rank("labels", F.col("_rank_map")), ",").alias("by_rank"))
