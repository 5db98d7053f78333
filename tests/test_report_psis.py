"""Report-table helpers and Pareto-smoothed LOO."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitlab.operators import compare as CM
from traitlab.operators import report as RP

def neg_xy():
    return CM.neg_loglik(F.col("x"), F.col("y"))



def test_label_map_back_transform_and_header(spark):
    df = spark.createDataFrame([("b_Intercept", 1.0, 0.5, 1.5, 0.0004), ("b_x", 0.2, -0.1, 0.5, 0.2),
                                ("sigma", 3.0, 2.0, 4.0, 0.0)],
                               "term string, estimate double, conf_low double, conf_high double, p double")
    lab = RP.label_map(df, "term", {"b_Intercept": "Intercept", "b_x": "Effect of x"})
    assert lab.count() == 2
    bt = RP.back_transform(lab, ["estimate", "conf_low", "conf_high"], F.col("parameter") == "Intercept")
    r = {x.parameter: x for x in RP.clamp_p(bt, "p").collect()}
    assert r["Intercept"].estimate == pytest.approx(math.e) and r["Effect of x"].estimate == 0.2
    assert r["Intercept"].p == 0.0 and r["Intercept"].p_raw == 0.0004
    txt = RP.number_text(RP.clamp_p(bt, "p"), {"est": "estimate", "lo": "conf_low", "hi": "conf_high", "pt": "p"})
    t = {x.parameter: x for x in txt.select("parameter", "est", RP.interval_text("lo", "hi").alias("iv"),
                                            RP.p_cell("p", "pt").alias("pc")).collect()}
    assert (t["Intercept"].est, t["Intercept"].iv, t["Intercept"].pc) == ("2.72", "1.65 - 4.48", "< 0.001")
    assert (t["Effect of x"].est, t["Effect of x"].pc) == ("0.2", "0.2")
    body = txt.select(F.lit(1).alias("sort_key"), "parameter", "est")
    h = RP.add_header_row(body, {"parameter": "", "est": "units"}).orderBy("sort_key").collect()
    assert (h[0].sort_key, h[0].parameter, h[0].est) == (0, "", "units")


def test_mean_se_cells(spark):
    df = spark.createDataFrame([(596.75, 106.606265, 4), (0.0829803380, 0.0235121383, 3)],
                               "m double, s double, n long")
    got = [r.cell for r in RP.mean_se_cells(df, {"cell": ("m", "s", "n")}).collect()]
    assert got == ["597 $\\pm$ 107 (4)", "0.083 $\\pm$ 0.0235 (3)"]


# ------------------------------------------------------------ brute force of the smoothing, one observation

def _gpd_fit(x):
    """Generalised Pareto fit to positive exceedances ``x`` (sorted
    ascending) by the Zhang & Stephens (2009) profile method, with the
    weakly informative shrinkage of k toward 0.5 used for PSIS (Vehtari,
    Gelman and Gabry 2017).  Returns (k, sigma)."""
    n = len(x)
    m = 30 + int(np.sqrt(n))
    j = np.arange(1, m + 1)
    xstar = x[max(int(n / 4 + 0.5) - 1, 0)]
    theta = 1.0 / x[-1] + (1.0 - np.sqrt(m / (j - 0.5))) / 3.0 / xstar
    kk = np.mean(np.log1p(-theta[:, None] * x[None, :]), axis=1)
    prof = n * (np.log(-theta / kk) - kk - 1.0)
    w = 1.0 / np.sum(np.exp(prof[None, :] - prof[:, None]), axis=1)
    theta_hat = float(np.sum(theta * w))
    k = float(np.mean(np.log1p(-theta_hat * x)))
    sigma = -k / theta_hat
    k = (k * n + 0.5 * 10) / (n + 10)
    return k, sigma


def _gpd_quantile(p, k, sigma):
    if abs(k) < 1e-12:
        return -sigma * np.log1p(-p)
    return sigma * np.expm1(-k * np.log1p(-p)) / k


def psis_elpd_row(neg_ll):
    """elpd_i and Pareto k of one observation from its -log-likelihoods.

    Log importance ratios are -ll (up to a constant); the largest
    M = ceil(min(S/5, 3 sqrt(S))) are replaced by expected order statistics
    of the fitted tail, capped at the largest raw ratio."""
    lw = np.asarray(neg_ll, dtype=float)
    ll = -lw
    s = lw.size
    lw = lw - lw.max()
    m = int(np.ceil(min(s / 5.0, 3.0 * np.sqrt(s))))
    k = np.nan
    if m >= 5 and s > m:
        order = np.argsort(lw, kind="stable")
        tail_idx = order[-m:]
        cutoff = lw[order[-m - 1]]
        exceed = np.exp(lw[tail_idx]) - np.exp(cutoff)
        if np.all(exceed > 0) and np.ptp(exceed) > 0:
            k, sigma = _gpd_fit(np.sort(exceed))
            if np.isfinite(k) and sigma > 0:
                p = (np.arange(1, m + 1) - 0.5) / m
                smoothed = np.log(_gpd_quantile(p, k, sigma) + np.exp(cutoff))
                lw = lw.copy()
                lw[tail_idx] = np.minimum(smoothed, 0.0)
    lw_norm = lw - (np.log(np.sum(np.exp(lw - lw.max()))) + lw.max())
    a = lw_norm + ll
    elpd = float(np.log(np.sum(np.exp(a - a.max()))) + a.max())
    return elpd, float(k)


def test_psis_constant_likelihood():
    neg = np.full(400, 1.3)
    elpd, _ = psis_elpd_row(neg)
    assert elpd == pytest.approx(-1.3, rel=1e-12)


def test_psis_close_to_plain_is_for_light_tails():
    rng = np.random.default_rng(5)
    neg = rng.normal(2.0, 0.05, 1000)
    plain = -math.log(np.mean(np.exp(neg)))
    elpd, k = psis_elpd_row(neg)
    assert elpd == pytest.approx(plain, abs=1e-3)
    assert k < 0.5


def test_psis_flags_heavy_tails():
    rng = np.random.default_rng(6)
    neg = np.log(rng.pareto(1.2, 4000) + 1.0)   # ratios with a Pareto tail of shape ~ 1/1.2
    _, k = psis_elpd_row(neg)
    assert k > 0.6


def test_elpd_psis_distributed_matches_row_helper(spark):
    rng = np.random.default_rng(9)
    draws = spark.createDataFrame([(i, float(rng.normal(1, 0.3)), float(rng.normal(2, 0.3)),
                                    float(abs(rng.normal(0.5, 0.1))) + 0.05) for i in range(300)],
                                  "iter int, b0 double, b1 double, sigma double")
    obs = spark.createDataFrame([(1, 0.5, 2.1), (2, 1.0, 3.2), (3, 3.0, 9.0)], "id int, x double, y double")
    got = {r.id: r for r in CM.elpd_psis(obs, draws, neg_xy(), ["id"]).collect()}
    d = draws.toPandas()
    for r in obs.collect():
        z = (r.y - d.b0 - d.b1 * r.x) / d.sigma
        neg = 0.5 * math.log(2 * math.pi) + np.log(d.sigma) + 0.5 * z * z
        e, k = psis_elpd_row(neg.values)
        assert got[r.id].elpd == pytest.approx(e, rel=1e-9)
        assert got[r.id].pareto_k == pytest.approx(k, rel=1e-8)
    plain = {r.id: r.elpd for r in CM.elpd_loo(obs, draws, neg_xy(), ["id"]).collect()}
    assert got[1].elpd == pytest.approx(plain[1], abs=0.05)


def test_elpd_psis_of_few_or_equal_draws_is_plain(spark):
    obs = spark.createDataFrame([(1, 0.5, 2.1)], "id int, x double, y double")
    for rows in ([(i, 1.0, 2.0, 0.5) for i in range(60)], [(1, 1.0, 2.0, 0.5)], [(i, 1.0 + i, 2.0, 0.5) for i in range(4)]):
        draws = spark.createDataFrame(rows, "iter int, b0 double, b1 double, sigma double")
        got = CM.elpd_psis(obs, draws, neg_xy(), ["id"]).first()
        assert got.elpd == pytest.approx(CM.elpd_loo(obs, draws, neg_xy(), ["id"]).first().elpd, rel=1e-12)
        assert got.pareto_k is None


def _noise(*key):
    h = hashlib.md5("_".join(map(str, key)).encode()).hexdigest()
    u1, u2 = int(h[:8], 16), int(h[8:16], 16)
    return math.sqrt(-2 * math.log((u1 + 1) / 2**32)) * math.cos(2 * math.pi * u2 / 2**32)


def test_predict_quantiles_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal(1, 0.2)), float(rng.normal(2, 0.1)), float(abs(rng.normal(0.5, 0.1)))) for i in range(500)]
    draws = spark.createDataFrame(rows, "iter int, b0 double, b1 double, sigma double")
    nd = spark.createDataFrame([(1, 0.0), (2, 1.5)], "id int, x double")
    got = {r.id: r for r in CM.predict_quantiles(nd, "x", draws, ("id",)).collect()}
    for i, x in ((1, 0.0), (2, 1.5)):
        pred = [b0 + b1 * x + s * _noise(i, it) for it, b0, b1, s in rows]
        assert got[i].pred_lower == pytest.approx(np.quantile(pred, 0.025), rel=1e-9)
        assert got[i].pred_upper == pytest.approx(np.quantile(pred, 0.975), rel=1e-9)
        assert abs(np.mean(pred) - (1 + 2 * x)) < 0.15


def test_predict_quantiles_single_draw_is_normal(spark):
    same = spark.range(20_000).selectExpr("id AS iter", "1D AS b0", "2D AS b1", "0.5D AS sigma")
    nd = spark.createDataFrame([(1, 1.5)], "id int, x double")
    r = CM.predict_quantiles(nd, "x", same, ("id",), probs=(0.025, 0.5, 0.975), names=("lo", "med", "hi")).first()
    assert [r.lo, r.med, r.hi] == [pytest.approx(4 + z * 0.5, abs=0.04) for z in (-1.96, 0.0, 1.96)]
