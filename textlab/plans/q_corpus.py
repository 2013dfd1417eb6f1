"""Registered corpus queries: tokenising, counting, comparing."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab import fixtures as fx
from textlab.functions.text import TOKEN_PATTERN, WORD_PATTERN, tokens
from textlab.operators import compare as cmp
from textlab.operators import freq as fq
from textlab.operators.ranks import value_ranks
from textlab.plans.compare_corpora import compare_corpora
from textlab.plans.registry import (EXCL_SQL, PUNCT_SQL, SQL_ALIGNED, SQL_FA, SQL_FA_F, SQL_FB, SQL_FB_F,
                                    SQL_FREQ, SQL_LL, STOP_SQL, TOKEN_RE, WORD_RE, r6, register)
from textlab.session import materialize


def _freq(spark, d):
    return fq.word_freq(fx.table(spark, d, "documents"), "text", remove_stop_words=False, pattern=WORD_PATTERN, lower=True)


def _fab(spark, d):
    fa = fq.word_freq(fx.corpus(spark, d, "a"), remove_stop_words=False, pattern=WORD_PATTERN, lower=True)
    fb = fq.word_freq(fx.corpus(spark, d, "b"), remove_stop_words=False, pattern=WORD_PATTERN, lower=True)
    return fa, fb


def _aligned(spark, d):
    fa, fb = _fab(spark, d)
    return cmp.align_vocab(fq.filter_vocab(fa), fq.filter_vocab(fb))


@register("A1", SQL_FREQ)
def q_a1(spark, d):
    return _freq(spark, d)


@register("A2", SQL_FREQ)
def q_a2(spark, d):
    # partial counts per source "file" in one scan, merged: the same table as A1
    return fq.merge_freq(fq.word_freq_by(fx.table(spark, d, "documents"), "source", pattern=WORD_PATTERN, lower=True))


@register("A3", f"""select word, sum(frequency)::BIGINT as frequency from
  (select * from {SQL_FA} union all select * from {SQL_FB}) group by word""")
def q_a3(spark, d):
    fa, fb = _fab(spark, d)
    return fq.merge_freq(fa, fb)


@register("K1", f"""select doc_id, len(t)::INTEGER as n_tokens,
  len(list_filter(t, lambda x: regexp_full_match(x, '{WORD_RE}')))::INTEGER as n_words,
  array_to_string(t, '') = text as lossless
  from (select doc_id, text, regexp_extract_all(text, '{TOKEN_RE}', 1) as t from documents)""")
def q_k1(spark, d):
    docs = fq.tokenize(fx.table(spark, d, "documents"), "text", TOKEN_PATTERN)
    return docs.select("doc_id", F.size("tokens").alias("n_tokens"),
                       F.size(F.filter("tokens", lambda t: t.rlike(r"^[\p{L}\p{M}\p{N}]+$"))).alias("n_words"),
                       (F.array_join("tokens", "") == F.col("text")).alias("lossless"))


@register("P7", f"""select w as word, count(*)::BIGINT as frequency
  from (select unnest(regexp_extract_all(text, '{TOKEN_RE}', 1)) as w from documents)
  where instr({PUNCT_SQL}, w) = 0 and w not in {STOP_SQL} group by w""")
def q_p7(spark, d):
    return fq.word_freq(fx.table(spark, d, "documents"), "text", remove_stop_words=True,
                        stopwords=fx.STOPWORDS_10, pattern=TOKEN_PATTERN)


@register("P8", f"select * from {SQL_FREQ} where frequency > 5 and word not in {EXCL_SQL}")
def q_p8(spark, d):
    return fq.filter_vocab(_freq(spark, d))


@register("T1", SQL_FREQ)
def q_t1(spark, d):
    return fq.most_common(_freq(spark, d))


@register("T2", f"""select * from (
  select 'a' as corpus, row_number() over (order by frequency desc, word)::INTEGER as rank, word, frequency from {SQL_FA_F}
  union all
  select 'b', row_number() over (order by frequency desc, word)::INTEGER, word, frequency from {SQL_FB_F}) where rank <= 30""")
def q_t2(spark, d):
    fa, fb = _fab(spark, d)
    from pyspark.sql import Window
    out = None
    for name, f in (("a", fa), ("b", fb)):
        top = fq.most_common(fq.filter_vocab(f), 30)
        top = top.select(F.lit(name).alias("corpus"),
                         F.row_number().over(Window.orderBy(F.desc("frequency"), "word")).alias("rank"),
                         "word", "frequency")  # window over the 30-row result only
        out = top if out is None else out.unionByName(top)
    return out


@register("A12", f"""with f as {SQL_FREQ}, s as (select min(frequency)::DOUBLE mn, max(frequency)::DOUBLE mx from f),
  c as (select least(floor((frequency - mn) / ((mx - mn) / 300.0)), 299)::INTEGER as bin, count(*) as n from f, s group by 1)
  select g.bin::INTEGER as bin, round(mn + g.bin * ((mx - mn) / 300.0), 6) as lo,
         round(mn + (g.bin + 1) * ((mx - mn) / 300.0), 6) as hi, coalesce(n, 0)::BIGINT as n
  from (select range as bin from range(300)) g cross join s left join c on g.bin = c.bin""")
def q_a12(spark, d):
    h = fq.histogram(_freq(spark, d), "frequency", 300)
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@register("J1", SQL_ALIGNED)
def q_j1(spark, d):
    return _aligned(spark, d)


@register("J2", f"""select 1 as side, word, frequency from {SQL_FA_F} where word not in (select word from {SQL_FB_F})
  union all select 2, word, frequency from {SQL_FB_F} where word not in (select word from {SQL_FA_F})""")
def q_j2(spark, d):
    fa, fb = _fab(spark, d)
    return cmp.exclusive_vocab(fq.filter_vocab(fa), fq.filter_vocab(fb))


@register("U2", f"select word from {SQL_FA_F} intersect select word from {SQL_FB_F}")
def q_u2(spark, d):
    fa, fb = _fab(spark, d)
    return cmp.common_words(fq.filter_vocab(fa), fq.filter_vocab(fb))


@register("U3", f"""select 1 as side, word from (select word from {SQL_FA_F} except select word from {SQL_FB_F})
  union all select 2, word from (select word from {SQL_FB_F} except select word from {SQL_FA_F})""")
def q_u3(spark, d):
    fa, fb = _fab(spark, d)
    a, b = fq.filter_vocab(fa), fq.filter_vocab(fb)
    return (cmp.only_in(a, b).select(F.lit(1).alias("side"), "word")
            .unionByName(cmp.only_in(b, a).select(F.lit(2).alias("side"), "word")))


SQL_SIZES = f"""select * from (values
  ('raw_words_1', (select count(*) from {SQL_FA})::DOUBLE),
  ('raw_words_2', (select count(*) from {SQL_FB})::DOUBLE),
  ('filtered_words_1', (select count(*) from {SQL_FA_F})::DOUBLE),
  ('filtered_words_2', (select count(*) from {SQL_FB_F})::DOUBLE),
  ('common_words', (select count(*) from {SQL_ALIGNED})::DOUBLE),
  ('exclusive_words_1', (select count(*) from {SQL_FA_F} where word not in (select word from {SQL_FB_F}))::DOUBLE),
  ('exclusive_words_2', (select count(*) from {SQL_FB_F} where word not in (select word from {SQL_FA_F}))::DOUBLE)
  ) t(metric, value)"""


@register("A13", SQL_SIZES)
def q_a13(spark, d):
    fa, fb = _fab(spark, d)
    return cmp.vocab_report(fa, fb, fq.filter_vocab(fa), fq.filter_vocab(fb))


@register("A14", f"select word, o1, o2, round(e1, 6) as e1, round(e2, 6) as e2, round(ll, 6) as ll from {SQL_LL}")
def q_a14(spark, d):
    ll = cmp.log_likelihood(_aligned(spark, d))
    return ll.select("word", "o1", "o2", r6("e1").alias("e1"), r6("e2").alias("e2"), r6("ll").alias("ll"))


SQL_PD = f"""(select sum((o1 - e1) * (o1 - e1) / e1 + (o2 - e2) * (o2 - e2) / e2) as chi2,
  2.0 * sum(o1 * ln(o1 / e1) + o2 * ln(o2 / e2)) as g,
  (2.0 / ((2.0 / 3.0) * (2.0 / 3.0 + 1.0))) * sum(o1 * (pow(o1 / e1, 2.0 / 3.0) - 1.0) + o2 * (pow(o2 / e2, 2.0 / 3.0) - 1.0)) as cressie_read,
  count(*) - 1 as dof from {SQL_LL})"""


@register("A15", f"select round(chi2, 6) as chi2, dof::BIGINT as dof from {SQL_PD}")
def q_a15(spark, d):
    s = cmp.power_divergence(_aligned(spark, d), {"chi2": 1.0})
    return s.select(r6("chi2").alias("chi2"), F.col("dof").cast("bigint").alias("dof"))


@register("A16", f"select round(g, 6) as g, dof::BIGINT as dof from {SQL_PD}")
def q_a16(spark, d):
    s = cmp.power_divergence(_aligned(spark, d), {"g": 0.0})
    return s.select(r6("g").alias("g"), F.col("dof").cast("bigint").alias("dof"))


@register("A17", f"select round(cressie_read, 6) as cressie_read, dof::BIGINT as dof from {SQL_PD}")
def q_a17(spark, d):
    s = cmp.power_divergence(_aligned(spark, d), {"cressie_read": 2.0 / 3.0})
    return s.select(r6("cressie_read").alias("cressie_read"), F.col("dof").cast("bigint").alias("dof"))


# ln p by closed series over lgamma: the upper gamma tail as a sum of falling powers, the beta tail as a power series
SQL_RHO = f"""(with a as {SQL_ALIGNED},
    v1 as (select o1, count(*) as c from a group by o1), v2 as (select o2, count(*) as c from a group by o2),
    r1 as (select o1, coalesce(sum(c) over (order by o1 rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as x from v1),
    r2 as (select o2, coalesce(sum(c) over (order by o2 rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as y from v2)
    select count(*) as n, corr(x, y) as rho from a join r1 using (o1) join r2 using (o2))"""


@register("A18", f"""with s as materialized {SQL_PD},
  k as (select unnest(['chi2', 'g', 'cressie_read']) as name, unnest([chi2, g, cressie_read]) / 2 as x, dof / 2.0::DOUBLE as a from s),
  tj as (select name, x, (a - 1 - j) * ln(x) - lgamma(a - j) as t from (select *, unnest(generate_series(0, ceil(a)::BIGINT - 1)) as j from k)),
  c as (select name, any_value(-x) + max(t) + ln(sum(exp(t - m))) as ln_p from (select *, max(t) over (partition by name) as m from tj) group by name),
  r as materialized (select n, rho, (n - 2) / 2.0::DOUBLE as a, 1 - rho * rho as x from {SQL_RHO}),
  b as (select ln(sum(exp(lgamma(a + 0.5 + i) - lgamma(a + 0.5) + lgamma(a + 1) - lgamma(a + 1 + i) + i * ln(x)))) as ln_f, any_value(a) as a, any_value(x) as x
    from (select *, unnest(generate_series(0, 40000)) as i from r)),
  sp as (select ln_f + lgamma(a + 0.5) - lgamma(a) - ln(pi()) / 2 + a * ln(x) + ln(1 - x) / 2 - ln(2 * a) as ln_p from b)
  select {", ".join(f"round(exp((select ln_p from c where name = '{n}')), 6) as {n}_p, round((select ln_p from c where name = '{n}'), 3) as {n}_ln_p"
                    for n in ("chi2", "g", "cressie_read"))},
    dof::BIGINT as dof, round(exp((select ln_p from sp)), 6) as spearman_p, round((select ln_p from sp), 3) as spearman_ln_p from s""")
def q_a18(spark, d):
    al = _aligned(spark, d)
    s = cmp.with_pvalues(cmp.power_divergence(al))
    sp = materialize(cmp.spearman(al), "spearman")
    r3 = lambda c: F.round(c, 3)
    return s.select(*[x for n in ("chi2", "g", "cressie_read") for x in (r6(f"{n}_p").alias(f"{n}_p"), r3(f"{n}_ln_p").alias(f"{n}_ln_p"))],
                    F.col("dof").cast("bigint").alias("dof"), r6(sp.select("p").scalar()).alias("spearman_p"),
                    r3(sp.select("ln_p").scalar()).alias("spearman_ln_p"))


@register("A19", f"""select round(ll_sum, 6) as ll_sum, round(g, 6) as g, abs(ll_sum - g) <= 1e-6 * greatest(1.0, abs(g)) as equal
  from (select sum(ll) as ll_sum from {SQL_LL}), {SQL_PD}""")
def q_a19(spark, d):
    al = _aligned(spark, d)
    ll_sum = cmp.log_likelihood(al).agg(F.sum("ll").alias("ll_sum"))
    g = cmp.power_divergence(al, {"g": 0.0}).select("g")
    one = ll_sum.select("ll_sum", g.scalar().alias("g"))
    return one.select(r6("ll_sum").alias("ll_sum"), r6("g").alias("g"),
                      (F.abs(F.col("ll_sum") - F.col("g")) <= F.lit(1e-6) * F.greatest(F.lit(1.0), F.abs("g"))).alias("equal"))


@register("W6", f"""with a as {SQL_ALIGNED}, v as (select o1, count(*)::BIGINT as cnt from a group by o1)
  select o1, cnt, (coalesce(sum(cnt) over (order by o1 rows between unbounded preceding and 1 preceding), 0))::BIGINT as before,
  round(coalesce(sum(cnt) over (order by o1 rows between unbounded preceding and 1 preceding), 0) + (cnt + 1) / 2.0, 6) as avg_rank from v""")
def q_w6(spark, d):
    vr = value_ranks(_aligned(spark, d), "o1")
    return vr.select("o1", "cnt", "before", r6("avg_rank").alias("avg_rank"))


@register("A20", f"""select n::BIGINT as n, round(rho, 6) as rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 6) as t
  from (with a as {SQL_ALIGNED},
    v1 as (select o1, count(*) as c from a group by o1), v2 as (select o2, count(*) as c from a group by o2),
    r1 as (select o1, coalesce(sum(c) over (order by o1 rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as x from v1),
    r2 as (select o2, coalesce(sum(c) over (order by o2 rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as y from v2)
    select count(*) as n, corr(x, y) as rho from a join r1 using (o1) join r2 using (o2))""")
def q_a20(spark, d):
    s = cmp.spearman(_aligned(spark, d), pvalue=False)
    return s.select(F.col("n").cast("bigint").alias("n"), r6("rho").alias("rho"), r6("t").alias("t"))


@register("A21", f"""select metric, round(value, 6) as value from (
  {SQL_SIZES}
  union all select 'chi2', chi2 from {SQL_PD}
  union all select 'g', g from {SQL_PD}
  union all select 'cressie_read', cressie_read from {SQL_PD}
  union all select 'dof', dof::DOUBLE from {SQL_PD}
  union all select 'll_sum', sum(ll) from {SQL_LL}
  union all select 'spearman_rho', rho from (select * from (with a as {SQL_ALIGNED},
    v1 as (select o1, count(*) as c from a group by o1), v2 as (select o2, count(*) as c from a group by o2),
    r1 as (select o1, coalesce(sum(c) over (order by o1 rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as x from v1),
    r2 as (select o2, coalesce(sum(c) over (order by o2 rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as y from v2)
    select count(*) as n, corr(x, y) as rho from a join r1 using (o1) join r2 using (o2)))
  union all select 'spearman_t', rho * sqrt((n - 2) / (1 - rho * rho)) from (with a as {SQL_ALIGNED},
    v1 as (select o1, count(*) as c from a group by o1), v2 as (select o2, count(*) as c from a group by o2),
    r1 as (select o1, coalesce(sum(c) over (order by o1 rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as x from v1),
    r2 as (select o2, coalesce(sum(c) over (order by o2 rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as y from v2)
    select count(*) as n, corr(x, y) as rho from a join r1 using (o1) join r2 using (o2)))""")
def q_a21(spark, d):
    fa, fb = _fab(spark, d)
    rep = compare_corpora(fa, fb, pvalues=False)
    return rep.select("metric", r6("value").alias("value"))


@register("T3", f"""select * from (
  select 'highest' as direction, row_number() over (order by round(ll, 9) desc, word)::INTEGER as rank, word, o1, o2, round(ll, 6) as ll from {SQL_LL}
  union all
  select 'lowest', row_number() over (order by round(ll, 9) asc, word)::INTEGER, word, o1, o2, round(ll, 6) from {SQL_LL}) where rank <= 15""")
def q_t3(spark, d):
    ex = cmp.ll_extremes(cmp.log_likelihood(_aligned(spark, d)), 15)
    return ex.select("direction", "rank", "word", "o1", "o2", r6("ll").alias("ll"))


@register("Z3", r"""select w as word, count(*)::BIGINT as frequency from
  (select unnest(string_split_regex(lower(text), '[^a-z]+')) as w from documents) where w != '' group by w""")
def q_z3(spark, d):
    # a caller's tokenizer: any Column -> Column that yields an array of words
    plain = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: w != "")
    return fq.word_freq(fx.table(spark, d, "documents"), remove_stop_words=False, tokenizer=plain)
