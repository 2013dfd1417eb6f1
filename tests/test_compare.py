"""Corpus comparison statistics against hand-computed goldens (FIXTURES section 4)."""

import math

import pytest
from pyspark.sql import functions as F

from textlab.functions.special import chi2_sf, t_sf
from textlab.operators import compare as cmp

SELF_CHECK = [("a", 35, 10), ("b", 15, 30), ("c", 50, 60)]


@pytest.fixture
def aligned(spark):
    return spark.createDataFrame(SELF_CHECK, "word string, o1 bigint, o2 bigint")


def test_per_word_log_likelihood(aligned):
    ll = {r["word"]: r["ll"] for r in cmp.log_likelihood(aligned).collect()}
    assert ll["a"] == pytest.approx(14.70968834, abs=1e-7)
    assert ll["b"] == pytest.approx(5.09697110, abs=1e-7)
    assert ll["c"] == pytest.approx(0.91034726, abs=1e-7)


def test_power_divergence_family(aligned):
    r = cmp.power_divergence(aligned).first()
    assert r["chi2"] == pytest.approx(19.797979798, abs=1e-8)
    assert r["g"] == pytest.approx(20.717006697, abs=1e-8)
    assert r["cressie_read"] == pytest.approx(19.992861709, abs=1e-8)
    assert r["dof"] == 2


def test_pvalues_dof2(aligned):
    r = cmp.with_pvalues(cmp.power_divergence(aligned)).first()
    for name in ("chi2", "g", "cressie_read"):
        assert r[f"{name}_p"] == pytest.approx(math.exp(-r[name] / 2), rel=1e-9)
    assert r["chi2_p"] == pytest.approx(5.02254e-5, rel=1e-4)


def test_ll_sum_equals_g(aligned):
    s = cmp.log_likelihood(aligned).agg(F.sum("ll")).first()[0]
    assert s == pytest.approx(cmp.power_divergence(aligned).first()["g"], rel=1e-12)


def test_spearman_golden(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 2, 2), ("c", 2, 5), ("d", 7, 3), ("e", 7, 9)], "word string, o1 bigint, o2 bigint")
    r = cmp.spearman(df).first()
    assert r["rho"] == pytest.approx(0.675922588, abs=1e-8)
    assert r["t"] == pytest.approx(1.588569534, abs=1e-8)
    assert r["p"] == pytest.approx(0.105183603, abs=1e-8)


def test_special_functions():
    assert chi2_sf(19.797979798, 2) == pytest.approx(math.exp(-19.797979798 / 2), rel=1e-10)
    for x, k in ((2685.0, 2685), (2800.0, 2685), (150.0, 120)):  # Wilson-Hilferty for large dof
        z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
        assert chi2_sf(x, k) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=2e-3)
    assert t_sf(0.0, 10) == pytest.approx(0.5)
    assert t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-8)


def test_extremes_and_vocab_sets(spark):
    f1 = spark.createDataFrame([("x", 10), ("y", 8), ("z", 7), ("only1", 9)], "word string, frequency bigint")
    f2 = spark.createDataFrame([("x", 6), ("y", 20), ("z", 7), ("only2", 9)], "word string, frequency bigint")
    ex = cmp.exclusive_vocab(f1, f2)
    assert sorted((r["side"], r["word"]) for r in ex.collect()) == [(1, "only1"), (2, "only2")]
    al = cmp.align_vocab(f1, f2)
    ext = cmp.ll_extremes(cmp.log_likelihood(al), 1).collect()
    assert {r["direction"] for r in ext} == {"highest", "lowest"}


def test_empty_intersection_gives_null_row(spark):
    empty = spark.createDataFrame([], "word string, o1 bigint, o2 bigint")
    r = cmp.power_divergence(empty).first()
    assert r["chi2"] is None and r["dof"] == -1


def test_log_tails_keep_their_accuracy():
    """Against closed forms where the tail itself is 0: even degrees of freedom, two degrees of t, and sums in log space."""
    from textlab.functions.special import ln_chi2_sf, ln_t_sf

    def log_sum(terms):
        m = max(terms)
        return m + math.log(math.fsum(math.exp(t - m) for t in terms))

    for dof in (2, 4, 60, 2000, 40_000):
        for ratio in (0.5, 1.01, 1.3, 3, 50, 400):
            x = dof * ratio / 2
            want = -x + log_sum([k * math.log(x) - math.lgamma(k + 1) for k in range(dof // 2)])
            assert ln_chi2_sf(2 * x, dof) == pytest.approx(want, rel=1e-6, abs=1e-9)
    assert ln_chi2_sf(1e5, 3) == pytest.approx(-5e4 + 0.5 * math.log(2e5 / math.pi), abs=1e-4)
    assert ln_chi2_sf(4e6, 2e6) < -3e5 and ln_chi2_sf(4e6, 2e6) == pytest.approx(ln_chi2_sf(4e6, 2e6 + 2), rel=1e-4)
    for t in (0.5, 3, 1e3, 1e9):
        assert ln_t_sf(t, 2) == pytest.approx(math.log(1 / (math.sqrt(2 + t * t) * (math.sqrt(2 + t * t) + t))), rel=1e-9)
    for dof in (50, 5000, 300_000):
        for rho2 in (0.01, 0.2, 0.9):
            a, x = dof / 2, 1 - rho2
            terms = [math.lgamma(a + 0.5 + i) - math.lgamma(a + 0.5) + math.lgamma(a + 1) - math.lgamma(a + 1 + i) + i * math.log(x) for i in range(6000)]
            want = log_sum(terms) + math.lgamma(a + 0.5) - math.lgamma(a) - math.log(math.pi) / 2 + a * math.log(x) + math.log(rho2) / 2 - math.log(2 * a)
            assert ln_t_sf(math.sqrt(dof * rho2 / x), dof) == pytest.approx(want, rel=1e-6)
    assert ln_t_sf(-1.0, 10) == pytest.approx(math.log(1 - math.exp(ln_t_sf(1.0, 10))), rel=1e-9)
    assert math.isnan(ln_chi2_sf(float("nan"), 3)) and ln_chi2_sf(math.inf, 3) == -math.inf and ln_chi2_sf(0, 3) == 0
