"""Registered baseline, model-selection, encoding and classifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab import fixtures as fx
from textlab.functions.arrays import attention_mask, truncate_pad
from textlab.functions.text import WORD_PATTERN, normalize_col, tokens
from textlab.operators import models as mo
from textlab.operators import split as sp
from textlab.operators import training as tr
from textlab.operators.freq import word_freq
from textlab.operators.metrics import classification_report, multilabel_report
from textlab.operators.segment import segment
from textlab.plans.dataset_stats import dataset_stats
from textlab.plans.q_labels import SQL_LABELLED
from textlab.plans.q_split import sql_full, sql_kshot
from textlab.plans.registry import WORD_RE, r6, register

SQL_X2T = sql_kshot(SQL_LABELLED, 100)  # doc_id, text, label, split


SQL_FULLT = sql_full(SQL_LABELLED)  # the same columns, a training split that grows with the data


def _full(spark, d):
    return sp.split_full(fx.labelled(spark, d), "label", "doc_id")


def _x2(spark, d):
    lab = fx.labelled(spark, d)
    return sp.split_kshot(lab, "label", "doc_id", 100)


def _part(df, name):
    return df.where(F.col("split") == name).drop("split")


SQL_MODE = f"(select label from {SQL_FULLT} where split = 'train' group by label order by count(*) desc, label limit 1)"


@register("M5", f"""select 'most_frequent' as strategy, count(*)::BIGINT as n,
  round(avg((label = {SQL_MODE})::INTEGER::DOUBLE), 6) as accuracy from {SQL_FULLT} where split = 'valid'""")
def q_m5(spark, d):
    s = _full(spark, d)
    p = mo.baseline(_part(s, "train"), _part(s, "valid"), "most_frequent", id_col="doc_id")
    return p.agg(F.lit("most_frequent").alias("strategy"), F.count(F.lit(1)).alias("n"),
                 r6(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).alias("accuracy"))


SQL_U = "(('0x' || substr(md5(doc_id::VARCHAR || ':101'), 1, 13))::BIGINT / 4503599627370496.0)"
SQL_TRAIN_CUM = f"""(select label, sum(count(*)) over (order by label rows between unbounded preceding and current row)
  / (select count(*) from {SQL_FULLT} where split = 'train') as hi from {SQL_FULLT} where split = 'train' group by label)"""
SQL_TRAIN_CLS = f"(select list(distinct label order by label) as a from {SQL_FULLT} where split = 'train')"


@register("M6", f"""select 'prior' as strategy, doc_id as id, label as y_true, {SQL_MODE} as y_pred from {SQL_FULLT} where split = 'valid'
  union all select 'constant', doc_id, label, 1 from {SQL_FULLT} where split = 'valid'
  union all select 'uniform', doc_id, label, (select a from {SQL_TRAIN_CLS})[(floor({SQL_U} * len((select a from {SQL_TRAIN_CLS}))) + 1)::INTEGER]
    from {SQL_FULLT} where split = 'valid'
  union all select 'stratified', doc_id, label, coalesce((select min(c.label) from {SQL_TRAIN_CUM} c where c.hi > {SQL_U}),
    (select max(label) from {SQL_TRAIN_CUM})) from {SQL_FULLT} where split = 'valid'""")
def q_m6(spark, d):
    s = _full(spark, d)
    tr, va = _part(s, "train"), _part(s, "valid")
    out = None
    for strat in ("prior", "constant", "uniform", "stratified"):
        p = mo.baseline(tr, va, strat, id_col="doc_id", constant=1).select(F.lit(strat).alias("strategy"), "id", "y_true", "y_pred")
        out = p if out is None else out.unionByName(p)
    return out


def _trials(spark, d):
    return fx.trials(spark, d)


@register("M9", """select trial_id, run, metric from (select *, row_number() over (partition by user_id order by value desc, event_id) as r,
  event_id as trial_id, user_id as run, value as metric from events where value is not null) where r = 1""")
def q_m9(spark, d):
    return mo.best_trial(_trials(spark, d), "metric", "max", by=["run"]).select("trial_id", "run", "metric")


@register("M10", """select p_partkey, p_retailprice, p_size from part p where not exists (select 1 from part q
  where q.p_retailprice <= p.p_retailprice and q.p_size >= p.p_size and (q.p_retailprice < p.p_retailprice or q.p_size > p.p_size))""")
def q_m10(spark, d):
    part = fx.table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    return mo.pareto_front(part, {"p_retailprice": "min", "p_size": "max"})


@register("M10_3", """with e as (select vec_id, embedding[1]::DOUBLE as a, embedding[2]::DOUBLE as b, embedding[3]::DOUBLE as c from embeddings)
  select vec_id from e p where not exists (select 1 from e q where q.a <= p.a and q.b >= p.b and q.c >= p.c
    and (q.a < p.a or q.b > p.b or q.c > p.c))""")
def q_m10_3(spark, d):
    emb = fx.table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")])
    return mo.pareto_front(emb, {"a": "min", "b": "max", "c": "max"}).select("vec_id")


@register("M11", """with t as (select user_id as run, event_id, ts, value as metric,
    max(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as prev,
    row_number() over (partition by user_id order by ts, event_id) as pos from events),
  i as (select *, prev is null or metric - prev > 0.01 as imp from t),
  l as (select *, pos - max(case when imp then pos end) over (partition by run order by ts, event_id rows between unbounded preceding and current row) as streak from i)
  select run, count(*)::BIGINT as n_rows, max(metric) as best, min(case when streak >= 3 then pos end)::BIGINT as stop_pos,
    arg_min(case when streak >= 3 then event_id end, case when streak >= 3 then pos end) as stop_trial from l group by run""")
def q_m11(spark, d):
    es = mo.early_stop(_trials(spark, d), "run", ["ts", "trial_id"], "metric", "max", 3, 0.01)
    return es.select("run", "n_rows", "best", F.col("stop_pos").cast("bigint").alias("stop_pos"), F.col("stop_at.trial_id").alias("stop_trial"))


@register("M12", """select user_id as run, arg_max(event_id, value) as best_step, max(value) as best_metric from
  (select * from events where value is not null qualify row_number() over (partition by user_id order by value desc, event_id) = 1) group by user_id""")
def q_m12(spark, d):
    return mo.best_checkpoint(_trials(spark, d), "run", "trial_id", "metric", "max")


SQL_NORM = """lower(replace(trim(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '\\(\\)|\\[\\]|\\{\\}', '', 'g'), '[\\r\\n]+', ' ', 'g'), ' {2,}', ' ', 'g'), ' '), ' ', '<_>'))"""


@register("K3", f"select page_id, {SQL_NORM} as text from pages")
def q_k3(spark, d):
    return fx.table(spark, d, "pages").select("page_id", normalize_col("html", space_token="<_>", lower=True).alias("text"))


SQL_TRAIN_FREQ = f"""(select w as word, count(*) as frequency from (select unnest(regexp_extract_all(lower(text), '{WORD_RE}')) as w
  from {SQL_FULLT} where split = 'train') group by w)"""
SQL_VOCAB = f"""(select * from (values ('<pad>', 0), ('<unk>', 1), ('<s>', 2), ('</s>', 3)) v(token, id)
  union all select word, (row_number() over (order by frequency desc, word) + 3)::INTEGER from
  (select * from {SQL_TRAIN_FREQ} order by frequency desc, word limit 1000))"""


def _vocab(spark, d):
    return mo.build_vocab(_part(_full(spark, d), "train"), "text", size=1000)


@register("K4", f"select token, id::INTEGER as id from {SQL_VOCAB}")
def q_k4(spark, d):
    return _vocab(spark, d)


@register("K5", f"""with toks as (select doc_id, unnest(t) as tok, unnest(range(len(t))) as pos from
    (select doc_id, regexp_extract_all(lower(text), '{WORD_RE}') as t from {SQL_LABELLED})),
  ids as (select doc_id, list(coalesce(v.id, 1) order by pos) as ids from toks left join {SQL_VOCAB} v on v.token = toks.tok group by doc_id),
  alldocs as (select l.doc_id, coalesce(i.ids, []) as ids from {SQL_LABELLED} l left join ids i using (doc_id)),
  m as (select max(least(len(ids), 416)) as n from alldocs)
  select doc_id, array_to_string(list_concat(ids[1:416], list_transform(range(greatest((select n from m) - len(ids[1:416]), 0)), lambda x: 0)), ',') as input_ids,
    array_to_string(list_concat(list_transform(range(least(len(ids), (select n from m))), lambda x: 1),
      list_transform(range(greatest((select n from m) - least(len(ids), (select n from m)), 0)), lambda x: 0)), ',') as attention_mask from alldocs""")
def q_k5(spark, d):
    enc = mo.encode(fx.labelled(spark, d), _vocab(spark, d), "text", 416)
    return enc.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("attention_mask", ",").alias("attention_mask"))


@register("K6", f"""select doc_id, len(regexp_extract_all(lower(text), '{WORD_RE}'))::INTEGER as n_tokens,
  round(avg(len(regexp_extract_all(lower(text), '{WORD_RE}'))) over (), 6) as mean_tokens from documents""")
def q_k6(spark, d):
    t = mo.token_lengths(fx.table(spark, d, "documents"))
    return t.select("doc_id", "n_tokens", r6(t.agg(F.avg("n_tokens").alias("m")).select("m").scalar()).alias("mean_tokens"))


@register("F18", f"""select doc_id, array_to_string(list_concat(l[1:5], list_transform(range(greatest(5 - len(l[1:5]), 0)), lambda x: 0)), ',') as ids,
  array_to_string(list_concat(list_transform(range(least(len(l), 5)), lambda x: 1), list_transform(range(greatest(5 - least(len(l), 5), 0)), lambda x: 0)), ',') as mask
  from (select doc_id, list_transform(regexp_extract_all(text, '{WORD_RE}'), lambda w: length(w)) as l from documents)""")
def q_f18(spark, d):
    docs = fx.table(spark, d, "documents")
    lens = F.transform(tokens("text", WORD_PATTERN), lambda w: F.length(w))
    return docs.select("doc_id", F.array_join(truncate_pad(lens, 5, 0), ",").alias("ids"),
                       F.array_join(attention_mask(lens, 5), ",").alias("mask"))


@register("A11", f"""select count(*) filter (where split = 'train')::BIGINT as n_train, count(*) filter (where split = 'valid')::BIGINT as n_valid,
  count(*) filter (where split = 'test')::BIGINT as n_test, count(distinct case when split = 'train' then label end)::BIGINT as n_classes,
  round(avg(len(regexp_extract_all(lower(text), '{WORD_RE}'))), 6) as avg_tokens, round(avg(length(text)), 6) as avg_chars from {SQL_X2T}""")
def q_a11(spark, d):
    st = dataset_stats(_x2(spark, d))
    return st.select("n_train", "n_valid", "n_test", "n_classes", r6("avg_tokens").alias("avg_tokens"), r6("avg_chars").alias("avg_chars"))


@register("K2", r"""with d as (select distinct unnest(regexp_extract_all(lower(text), '{WORD}')) as w from benchmark),
  p as (select '(?s)(?:' || string_agg(w, '|' order by length(w) desc, w) || '|.)' as re from d)
  select w as word, count(*)::BIGINT as frequency from (select unnest(regexp_extract_all(regexp_replace(lower(text), '\s+', '', 'g'), p.re)) as w
    from documents, p) group by w""".replace("{WORD}", WORD_RE))  # alternatives by length: the first that matches is the longest
def q_k2(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.regexp_replace(F.lower("text"), r"\s+", "").alias("text"))
    bench = fx.table(spark, d, "benchmark")
    dictionary = bench.select(F.explode(tokens("text", WORD_PATTERN, lower=True)).alias("w")).distinct()
    seg = segment(docs, "text", dictionary, "tokens")
    return word_freq(seg, "tokens", remove_stop_words=False, tokenizer=lambda c: c)


def _classifier(spark, d, patience=3):
    s = _x2(spark, d)
    return tr.train_classifier(_part(s, "train"), _part(s, "valid"), epochs=12, patience=patience), _part(s, "test")


@register("M7")  # trained with validation and early stop, best epoch scored on test (rows-only)
def q_m7(spark, d):
    model, test = _classifier(spark, d)
    return classification_report(tr.predict(model, test, id_col="doc_id"))


@register("M7_log")  # the training log with its best and its stopping epoch, by M12 and M11 (rows-only)
def q_m7_log(spark, d):
    model, _ = _classifier(spark, d)
    return model.log.select("epoch", r6("loss").alias("loss"), r6("metric").alias("metric"), (F.col("epoch") == model.best_epoch).alias("best"),
                            F.coalesce(F.col("epoch") == F.lit(model.stopped_at), F.lit(False)).alias("stopped"))


@register("M7_multi")  # two labels per row (quality, toxic) by sigmoids, reported by E8 (rows-only)
def q_m7_multi(spark, d):
    s = _full(spark, d).withColumn("label", F.array(F.expr("label div 2").cast("int"), (F.col("label") % 2).cast("int")))
    model = tr.train_classifier(_part(s, "train"), _part(s, "valid"), multilabel=True, epochs=12)
    pred = tr.predict(model, _part(s, "test"), id_col="doc_id")
    rep = multilabel_report(pred)
    return rep.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("M8")  # batch scoring with argmax (rows-only)
def q_m8(spark, d):
    s = _x2(spark, d)
    model = mo.train_text_classifier(_part(s, "train"), max_iter=20)
    return mo.score(model, _part(s, "valid"), id_col="doc_id").select("id", "y_true", "y_pred", r6("confidence").alias("confidence"))
