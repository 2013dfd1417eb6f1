"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab import fixtures as fx
from textlab.functions import arrays as ar
from textlab.operators import metrics as me
from textlab.plans.registry import r6, register

SQL_PREDS = """(select vec_id as id, label::INTEGER as y_true,
  (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INTEGER as y_pred from embeddings)"""
SQL_ML = """(select vec_id as id, list_transform(embedding[9:16], lambda x: (x::DOUBLE > 0)::INTEGER) as y_true,
  list_transform(embedding[1:8], lambda x: (1.0 / (1.0 + exp(-x::DOUBLE)) >= 0.5)::INTEGER) as y_pred from embeddings)"""
def sql_pc(preds: str) -> str:
    """Per-class tp / predicted / support / precision / recall / f1 over a predictions subquery."""
    return f"""(with c as (select y_true, y_pred, count(*) as n from {preds} group by all),
  r as (select y_true as label, case when y_true = y_pred then n else 0 end as tp, 0 as pred, n as sup from c
        union all select y_pred, 0, n, 0 from c),
  pc as (select label, sum(tp) as tp, sum(pred) as predicted, sum(sup) as support from r group by label),
  s as (select *, case when predicted = 0 then 0.0 else tp / predicted end as precision,
               case when support = 0 then 0.0 else tp / support end as recall from pc)
  select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from s)"""


def sql_report(preds: str) -> str:
    pc = sql_pc(preds)
    return f"""select label::VARCHAR as label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
    support::BIGINT as support from {pc}
  union all select 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::BIGINT from {pc}
  union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT from {pc}
  union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT from {pc}"""


SQL_PC = f"""(with c as (select y_true, y_pred, count(*) as n from {SQL_PREDS} group by all),
  r as (select y_true as label, case when y_true = y_pred then n else 0 end as tp, 0 as pred, n as sup from c
        union all select y_pred, 0, n, 0 from c),
  pc as (select label, sum(tp) as tp, sum(pred) as predicted, sum(sup) as support from r group by label),
  s as (select *, case when predicted = 0 then 0.0 else tp / predicted end as precision,
               case when support = 0 then 0.0 else tp / support end as recall from pc)
  select *, case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end as f1 from s)"""
SQL_MLC = f"""(select label, count(*) filter (where t = 0 and p = 0)::BIGINT as tn, count(*) filter (where t = 0 and p = 1)::BIGINT as fp,
  count(*) filter (where t = 1 and p = 0)::BIGINT as fn, count(*) filter (where t = 1 and p = 1)::BIGINT as tp
  from (select unnest(range(8)) as label, unnest(y_true) as t, unnest(y_pred) as p from {SQL_ML}) group by label)"""


def _preds(spark, d):
    return fx.preds(spark, d)


def _ml(spark, d):
    return fx.mlpreds(spark, d)


def _round_report(df):
    return df.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), "support")


@register("F12", f"select id, y_pred from {SQL_PREDS}")
def q_f12(spark, d):
    return _preds(spark, d).select("id", "y_pred")


@register("F13", f"select id, array_to_string(y_pred, ',') as y_pred from {SQL_ML}")
def q_f13(spark, d):
    return _ml(spark, d).select("id", F.array_join("y_pred", ",").alias("y_pred"))


@register("E1", f"""select t.l as y_true, p.l as y_pred, coalesce(c.n, 0)::BIGINT as n from
  (select distinct unnest([y_true, y_pred]) as l from {SQL_PREDS}) t, (select distinct unnest([y_true, y_pred]) as l from {SQL_PREDS}) p
  left join (select y_true, y_pred, count(*) as n from {SQL_PREDS} group by all) c on c.y_true = t.l and c.y_pred = p.l""")
def q_e1(spark, d):
    return me.confusion(_preds(spark, d))


@register("E2", f"select round(avg((y_true = y_pred)::INTEGER::DOUBLE), 6) as accuracy from {SQL_PREDS}")
def q_e2(spark, d):
    return me.accuracy(_preds(spark, d)).select(r6("accuracy").alias("accuracy"))


SQL_REPORT = f"""select label::VARCHAR as label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
    support::BIGINT as support from {SQL_PC}
  union all select 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::BIGINT from {SQL_PC}
  union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT from {SQL_PC}
  union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
    round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT from {SQL_PC}"""


@register("E3", SQL_REPORT)
def q_e3(spark, d):
    return _round_report(me.classification_report(_preds(spark, d)))


@register("E4", f"select * from ({SQL_REPORT}) where label in ('accuracy', 'macro avg', 'weighted avg')")
def q_e4(spark, d):
    return _round_report(me.classification_report(_preds(spark, d)).where(F.col("label").isin("accuracy", "macro avg", "weighted avg")))


@register("E6", f"""select label, metric, value from (select label, 'precision' as metric, precision as value from ({SQL_REPORT})
  union all select label, 'recall', recall from ({SQL_REPORT}) union all select label, 'f1', f1 from ({SQL_REPORT})
  union all select label, 'support', support::DOUBLE from ({SQL_REPORT}))""")
def q_e6(spark, d):
    rep = _round_report(me.classification_report(_preds(spark, d)))
    return rep.select("label", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                    for m in ("precision", "recall", "f1", "support")])).alias("m")).select("label", "m.*")


@register("E5", f"""select round((select avg(f1) from {SQL_PC}), 6) as f1_macro,
  round((select 2.0 * sum(tp) / (sum(predicted) + sum(support)) from {SQL_PC}), 6) as f1_micro,
  round((select sum(f1 * support) / sum(support) from {SQL_PC}), 6) as f1_weighted""")
def q_e5(spark, d):
    p = _preds(spark, d)
    return p.sparkSession.range(1).select(r6(me.f1(p, "macro").select("f1").scalar()).alias("f1_macro"),
                                          r6(me.f1(p, "micro").select("f1").scalar()).alias("f1_micro"),
                                          r6(me.f1(p, "weighted").select("f1").scalar()).alias("f1_weighted"))


@register("E7", f"select label::INTEGER as label, tn, fp, fn, tp from {SQL_MLC}")
def q_e7(spark, d):
    return me.multilabel_confusion(_ml(spark, d)).select(F.col("label").cast("int").alias("label"), "tn", "fp", "fn", "tp")


def _sc(tp, fp, fn):
    p = f"(case when {tp} + {fp} = 0 then 0.0 else {tp} / ({tp} + {fp}) end)"
    r = f"(case when {tp} + {fn} = 0 then 0.0 else {tp} / ({tp} + {fn}) end)"
    f = f"(case when {p} + {r} = 0 then 0.0 else 2 * {p} * {r} / ({p} + {r}) end)"
    return p, r, f


_P, _R, _F = _sc("tp", "fp", "fn")
SQL_ROWS = f"""(select id, count(*) filter (where t = 1 and p = 1) as tp, count(*) filter (where t = 0 and p = 1) as fp,
  count(*) filter (where t = 1 and p = 0) as fn from (select id, unnest(y_true) as t, unnest(y_pred) as p from {SQL_ML}) group by id)"""
SQL_ML_PER = f"(select label::VARCHAR as label, {_P} as precision, {_R} as recall, {_F} as f1, (tp + fn)::BIGINT as support from {SQL_MLC})"
SQL_ML_ROW = f"(select id::VARCHAR as label, {_P} as precision, {_R} as recall, {_F} as f1, (tp + fn)::BIGINT as support from {SQL_ROWS})"


@register("E8", f"""select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from (
  select * from {SQL_ML_PER}
  union all select 'micro avg', {_P}, {_R}, {_F}, (tp + fn)::BIGINT from (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from {SQL_MLC})
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT from {SQL_ML_PER}
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
    sum(support)::BIGINT from {SQL_ML_PER}
  union all select 'samples avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT from {SQL_ML_ROW})""")
def q_e8(spark, d):
    return _round_report(me.multilabel_report(_ml(spark, d)))


@register("E9", f"select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from {SQL_ML_ROW}")
def q_e9(spark, d):
    return _round_report(me.multilabel_report(_ml(spark, d), axis="row"))


@register("E10", f"select round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as f1 from {SQL_MLC}")
def q_e10(spark, d):
    return me.multilabel_micro_f1(_ml(spark, d)).select(r6("f1").alias("f1"))


@register("E11", f"select round((sum(tp) / (sum(tp) + sum(fn)) + sum(tn) / (sum(tn) + sum(fp))) / 2, 6) as roc_auc from {SQL_MLC}")
def q_e11(spark, d):
    return me.micro_auc(_ml(spark, d)).select(r6("roc_auc").alias("roc_auc"))


@register("E12", f"select round(avg((y_true = y_pred)::INTEGER::DOUBLE), 6) as subset_accuracy from {SQL_ML}")
def q_e12(spark, d):
    return me.subset_accuracy(_ml(spark, d)).select(r6("subset_accuracy").alias("subset_accuracy"))


SQL_LSE = "(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))))"


@register("E13", f"""select round(avg({SQL_LSE} - l[label + 1]), 6) as loss
  from (select list_transform(embedding[1:10], lambda x: x::DOUBLE) as l, label from embeddings)""")
def q_e13(spark, d):
    emb = fx.table(spark, d, "embeddings").select(F.slice("embedding", 1, 10).alias("logits"), "label")
    return me.eval_loss(emb).select(r6("loss").alias("loss"))


@register("E14", """select round(avg(0.5 * (list_sum(list_transform(list_zip(m, s), lambda e: e[2] * e[2] + e[1] * e[1] - 2 * ln(greatest(e[2], 1e-8)))) - len(m))), 6) as kl
  from (select list_transform(embedding[1:32], lambda x: x::DOUBLE) as m,
               list_transform(embedding[33:64], lambda x: case when x > 20 then x::DOUBLE else ln(1 + exp(x::DOUBLE)) end) as s from embeddings)""")
def q_e14(spark, d):
    emb = fx.table(spark, d, "embeddings").select(F.slice("embedding", 1, 32).alias("mu"),
                                                  ar.activate(F.slice("embedding", 33, 32), "softplus").alias("std"))
    return me.gaussian_kl(emb).select(r6("kl").alias("kl"))


SQL_SAMPLES = "(select vec_id % 100 as id, vec_id // 100 as sample, (vec_id % 100) % 10 as label, list_transform(embedding[1:10], lambda x: x::DOUBLE) as l from embeddings)"


@register("E15", f"""with s as {SQL_SAMPLES},
  loss as (select id, label, round(avg({SQL_LSE} - l[label + 1]), 6) as loss from s group by id, label),
  mean as (select id, pos::INTEGER as pos, round(avg(v), 6) as mean_logit from
           (select id, unnest(range(len(l))) as pos, unnest(l) as v from s) group by id, pos)
  select id, label, loss, pos, mean_logit from loss join mean using (id)""")
def q_e15(spark, d):
    emb = fx.table(spark, d, "embeddings")
    long = emb.select((F.col("vec_id") % 100).alias("id"), (F.col("vec_id") / 100).cast("bigint").alias("sample"),
                      ((F.col("vec_id") % 100) % 10).alias("label"),
                      F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("logits"))
    out = me.sampled_logits(long)
    return out.select("id", "label", r6("loss").alias("loss"), F.posexplode("mean_logits").alias("pos", "mean_logit")) \
              .select("id", "label", "loss", "pos", r6("mean_logit").alias("mean_logit"))


@register("E15_mean", f"""select round(avg(loss), 6) as loss from
  (select id, avg({SQL_LSE} - l[label + 1]) as loss from {SQL_SAMPLES} group by id)""")
def q_e15_mean(spark, d):
    emb = fx.table(spark, d, "embeddings")
    long = emb.select((F.col("vec_id") % 100).alias("id"), (F.col("vec_id") / 100).cast("bigint").alias("sample"),
                      ((F.col("vec_id") % 100) % 10).alias("label"), F.slice("embedding", 1, 10).alias("logits"))
    return me.sampled_loss(long).select(r6("loss").alias("loss"))


@register("E15_one", """select id, label, round(avg(pow(v - label, 2)), 6) as loss, round(avg(v), 6) as mean_logit from
  (select vec_id % 100 as id, (vec_id % 100) % 10 as label, embedding[1]::DOUBLE as v from embeddings) group by id, label""")
def q_e15_one(spark, d):
    emb = fx.table(spark, d, "embeddings")
    long = emb.select((F.col("vec_id") % 100).alias("id"), (F.col("vec_id") / 100).cast("bigint").alias("sample"),
                      ((F.col("vec_id") % 100) % 10).alias("label"), F.slice("embedding", 1, 1).alias("logits"))
    return me.sampled_logits(long).select("id", "label", r6("loss").alias("loss"), r6(F.get("mean_logits", F.lit(0))).alias("mean_logit"))


@register("Z5", f"""with c as (select y_true, y_pred, count(*) as n from {SQL_PREDS} group by all),
  a as (select unnest([0, 2, 4, 6, 11])::INTEGER as l)
  select t.l as y_true, p.l as y_pred, coalesce(c.n, 0)::BIGINT as n from a t cross join a p left join c on c.y_true = t.l and c.y_pred = p.l""")
def q_z5(spark, d):
    return me.metric_set([0, 2, 4, 6, 11])(_preds(spark, d))["confusion"]


@register("Z6", """select vec_id, round(list_sum(list_transform(l, lambda x: 1.0 / (1.0 + exp(-x)))), 6) as sigmoid_sum,
  round(list_sum(l), 6) as identity_sum from (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as l from embeddings)""")
def q_z6(spark, d):
    emb = fx.table(spark, d, "embeddings")
    total = lambda name: F.aggregate(ar.activate("embedding", name), F.lit(0.0), lambda acc, x: acc + x)
    return emb.select("vec_id", *[r6(total(n)).alias(f"{n}_sum") for n in ("sigmoid", "identity")])


@register("F14", f"""select vec_id, round({SQL_LSE}, 6) as lse, round(list_max(list_transform(l, lambda x: exp(x - {SQL_LSE}))), 6) as max_prob
  from (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as l from embeddings)""")
def q_f14(spark, d):
    emb = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("l"))
    return emb.select("vec_id", r6(ar.log_sum_exp("l")).alias("lse"), r6(F.array_max(ar.softmax("l"))).alias("max_prob"))


@register("F15", """select vec_id, round(list_sum(list_transform(l, lambda x: greatest(x, 0.0))), 6) as relu_sum,
  round(list_sum(list_transform(l, lambda x: tanh(x))), 6) as tanh_sum,
  round(list_sum(list_transform(l, lambda x: case when x > 20 then x else ln(1 + exp(x)) end)), 6) as softplus_sum,
  round(list_sum(list_transform(l, lambda x: least(greatest(x, -0.5), 0.5))), 6) as clamp_sum
  from (select vec_id, list_transform(embedding, lambda x: x::DOUBLE) as l from embeddings)""")
def q_f15(spark, d):
    emb = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("l"))
    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return emb.select("vec_id", r6(total(ar.activate("l", "relu"))).alias("relu_sum"), r6(total(ar.activate("l", "tanh"))).alias("tanh_sum"),
                      r6(total(ar.activate("l", "softplus"))).alias("softplus_sum"),
                      r6(total(F.transform("l", lambda x: ar.clamp(x.cast("double"), -0.5, 0.5)))).alias("clamp_sum"))
