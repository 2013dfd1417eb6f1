"""Registered split queries.  Oracles rank with a plain
``row_number`` over the md5 order; Spark must reach the same rows without one."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab import fixtures as fx
from textlab.operators import labels as lb
from textlab.operators import select as sel
from textlab.operators import split as sp
from textlab.plans.q_labels import SQL_CASES, SQL_LABELLED, SQL_RESTRICT
from textlab.plans.registry import r6, register

SEED = 101


def _h(id_col: str, seed: int = SEED) -> str:
    return f"md5({id_col}::VARCHAR || ':{seed}')"


def sql_kshot(src: str, k: int, a=0.8, b=0.1, c=0.1) -> str:
    r = b + c
    ct = c / r
    return f"""(with t as (select *, {_h('doc_id')} as h from {src}),
  q0 as (select label, count(*) as f from t group by label),
  q as (select label, f,
    case when f <= 2 then f when round(f * {a}::DOUBLE, 9) >= {k} then {k} when round(f * {r!r}::DOUBLE, 9) < 2 then f - 2
         else f - ceil(round(f * {r!r}::DOUBLE, 9)) end as n_train,
    case when f <= 2 then 0 when round(f * {a}::DOUBLE, 9) >= {k} then f - {k} - ceil(round((f - {k}) * {ct!r}::DOUBLE, 9))
         when round(f * {r!r}::DOUBLE, 9) < 2 then floor(round({1 - ct!r}::DOUBLE * 2, 9))
         else floor(round({1 - ct!r}::DOUBLE * ceil(round(f * {r!r}::DOUBLE, 9)), 9)) end as n_valid from q0),
  p as (select *, row_number() over (partition by label order by h, doc_id) - 1 as pos from t)
  select p.* exclude (h, pos), case when pos < n_train then 'train' when pos < n_train + n_valid then 'valid' else 'test' end as split
  from p join q using (label))"""


def sql_strat_train(src: str, test_frac: float, id_col: str = "doc_id") -> str:
    """Rows of non-singleton classes with their class train quota (largest remainder)."""
    return f"""(with t as (select *, {_h(id_col)} as h from {src}),
  c as (select label, count(*) as f from t group by label),
  m as (select * from c where f > 1),
  tot as (select sum(f) as n, sum(f) - ceil(round(sum(f) * {test_frac!r}::DOUBLE, 9)) as nt from m),
  q1 as (select label, f, round(f::DOUBLE * nt / n, 9) as cont from m, tot),
  q2 as (select *, floor(cont) as fl, row_number() over (order by cont - floor(cont) desc, label) as rk from q1),
  q as (select label, f, fl + case when rk <= (select nt from tot) - (select sum(fl) from q2) then 1 else 0 end as n_train from q2)
  select t.*, q.n_train, row_number() over (partition by t.label order by h, {id_col}) - 1 as pos, (select n - nt from tot) as n_rest
  from t join q using (label))"""


def sql_full(src: str, a=0.8, b=0.1, c=0.1) -> str:
    r = b + c
    return f"""(with s as {sql_strat_train(src, r)},
  rest as (select *, row_number() over (order by h, doc_id) - 1 as pos2 from s where pos >= n_train),
  single as (select * from {src} where label in (select label from {src} group by label having count(*) = 1))
  select s.* exclude (h, n_train, pos, n_rest), 'train' as split from s where pos < n_train
  union all select rest.* exclude (h, n_train, pos, n_rest, pos2),
    case when pos2 < ceil(round(n_rest * {c / r!r}::DOUBLE, 9)) then 'test' else 'valid' end from rest
  union all select single.*, 'train' from single)"""


SQL_RARE100_T = "(select doc_id, (n_chars // 100)::BIGINT as label from documents)"
SQL_EMB = "(select vec_id as doc_id, label from embeddings)"


def _kshot(spark, d):
    return sp.split_kshot(fx.labelled(spark, d).select("doc_id", "label"), "label", "doc_id", 100)


@register("X2", f"select * from {sql_kshot(SQL_LABELLED.replace('d.text, ', ''), 100)}")
def q_x2(spark, d):
    return _kshot(spark, d)


@register("X1", f"select * from {sql_full(SQL_RARE100_T)}")
def q_x1(spark, d):
    return sp.split_full(fx.rare(spark, d, 100).select("doc_id", "label"), "label", "doc_id")


@register("X5", f"""select s.* exclude (h, n_train, pos, n_rest), case when pos < n_train then 'train' else 'valid' end as split
  from {sql_strat_train(SQL_EMB, 0.1)} s""")
def q_x5(spark, d):
    emb = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return sp.split_two(emb, "label", "doc_id", 0.1)


@register("X4", f"""select doc_id, case when row_number() over (order by {_h('doc_id')}, doc_id) - 1
  < count(*) over () - ceil(round(count(*) over () * 0.1::DOUBLE, 9)) then 'train' else 'test' end as split from documents""")
def q_x4(spark, d):
    return sp.split_random(fx.table(spark, d, "documents").select("doc_id"), "doc_id", 0.1)


@register("X3", f"""select doc_id, label, row_number() over (partition by label order by {_h('doc_id')}, doc_id) - 1
  < count(*) over (partition by label) // 3 as in_quota from {SQL_LABELLED}""")
def q_x3(spark, d):
    lab = fx.labelled(spark, d).select("doc_id", "label")
    quota = lab.groupBy("label").agg((F.count(F.lit(1)) / 3).cast("bigint").alias("quota"))
    return sp.take_quota(lab, ["label"], "doc_id", quota)


@register("T5", f"select doc_id, (row_number() over (order by {_h('doc_id')}, doc_id) - 1)::BIGINT as pos from documents")
def q_t5(spark, d):
    return sp.positions(fx.table(spark, d, "documents").select("doc_id"), "doc_id", SEED)


@register("X8", f"select doc_id from documents where ('0x' || substr({_h('doc_id')}, 1, 8))::BIGINT < {int(0.8 * 4294967296)}")
def q_x8(spark, d):
    return sp.sample_fraction(fx.table(spark, d, "documents").select("doc_id"), "doc_id", 0.8)


SQL_X2 = sql_kshot(SQL_LABELLED.replace("d.text, ", ""), 100)


@register("X6", f"""select split, count(*)::BIGINT as rows, count(distinct label)::BIGINT as classes,
  count(distinct case when f <= 2 then label end)::BIGINT as tiny_classes
  from {SQL_X2} join (select label, count(*) as f from {SQL_X2} group by label) using (label) group by split""")
def q_x6(spark, d):
    return sp.split_report(_kshot(spark, d))


@register("X7", f"""select label, count(*) filter (where split = 'train')::BIGINT as train,
  count(*) filter (where split = 'valid')::BIGINT as valid, count(*) filter (where split = 'test')::BIGINT as test
  from {SQL_X2} group by label""")
def q_x7(spark, d):
    return sp.split_label_counts(_kshot(spark, d))


@register("J6", f"""select label, count(*) filter (where split = 'train')::BIGINT as train,
  count(*) filter (where split = 'valid')::BIGINT as valid from (select s.label, case when pos < n_train then 'train' else 'valid' end as split
  from {sql_strat_train(SQL_EMB, 0.1)} s) group by label""")
def q_j6(spark, d):
    emb = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return sp.split_label_counts(sp.split_two(emb, "label", "doc_id", 0.1), splits=("train", "valid"))


SQL_CASE_SPLIT = f"""(select dekaid, case when row_number() over (order by {_h('dekaid')}, dekaid) - 1
  < count(*) over () - ceil(round(count(*) over () * 0.1::DOUBLE, 9)) then 'train' else 'test' end as split from {SQL_CASES})"""


@register("A9", f"""select split, len(labels)::INTEGER as n_labels, count(*)::BIGINT as rows,
  round(avg(count(*) * len(labels)) over (partition by split) * 0 + (sum(count(*) * len(labels)) over (partition by split)) / (sum(count(*)) over (partition by split)), 6) as mean_labels
  from {SQL_RESTRICT} r join {SQL_CASE_SPLIT} s using (dekaid) group by split, len(labels)""")
def q_a9(spark, d):
    c = fx.cases(spark, d)
    rows = lb.restrict_labels(c, "dekaid", lb.relevant_labels(c))
    spl = sp.split_random(c.select("dekaid"), "dekaid", 0.1)
    h = lb.label_cardinality(rows.join(spl, "dekaid"), "labels", by="split")
    return h.select("split", "n_labels", "rows", r6("mean_labels").alias("mean_labels"))


@register("U1", "select doc_id, text, null::VARCHAR as lang from documents union all by name select doc_id, null::VARCHAR as text, lang from documents")
def q_u1(spark, d):
    docs = fx.table(spark, d, "documents")
    return sel.union_all(docs.select("doc_id", "text"), docs.select("doc_id", "lang"))


@register("U4", f"""select doc_id from documents where doc_id not in (select doc_id from (select doc_id, row_number() over (order by {_h('doc_id')}, doc_id) - 1
  >= count(*) over () - ceil(round(count(*) over () * 0.1::DOUBLE, 9)) as is_test from documents) where is_test)""")
def q_u4(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    test = sp.split_random(docs, "doc_id", 0.1).where(F.col("split") == "test")
    return sel.minus_rows(docs, test, "doc_id")
