"""Re-aimed fits (K3-K8) and model comparison (K11-K13, K16) vs numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitlab.operators import compare as CM
from traitlab.operators import fit as FT


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):
        eff = rng.normal(0, 2)
        n = 5 + 3 * g
        for i in range(n):
            a = float(rng.integers(0, 2))
            b = float(rng.normal(10, 2))
            y = eff + 1.5 * a - 0.7 * b + rng.normal(0, 0.5)
            rows.append((f"g{g}", i, a, b, y))
    return spark.createDataFrame(rows, "grp string, k int, a double, b double, y double")


def test_gram(grouped):
    g = {r.grp: r for r in FT.gram(grouped, ["grp"], ["a", "b"], "y").collect()}
    pdf = grouped.toPandas()
    sub = pdf[pdf.grp == "g2"]
    assert g["g2"].n == len(sub)
    assert g["g2"].s_a_b == pytest.approx(float((sub.a * sub.b).sum()))
    assert g["g2"].s_y == pytest.approx(float(sub.y.sum()))
    assert g["g2"].s_b_y == pytest.approx(float((sub.b * sub.y).sum()))


def test_within_regression_equals_lstsq_with_group_dummies(grouped):
    pdf = grouped.toPandas()
    dummies = np.stack([(pdf.grp == g).astype(float) for g in sorted(pdf.grp.unique())], axis=1)
    X = np.column_stack([pdf.a, pdf.b, dummies])
    coef = np.linalg.lstsq(X, pdf.y, rcond=None)[0]
    r = FT.within_regression(grouped, ["grp"], "y", "a", "b").first()
    assert r.b_a == pytest.approx(coef[0], rel=1e-9)
    assert r.b_b == pytest.approx(coef[1], rel=1e-9)
    assert (r.n, r.groups) == (len(pdf), 6)


def test_within_regression_with_interaction_and_nulls(spark, grouped):
    df = grouped.withColumn("ab", F.col("a") * F.col("b"))
    df = df.unionByName(spark.createDataFrame([("g1", 99, None, 1.0, 2.0, None), (None, 1, 0.0, 3.0, 1.0, 0.0), (None, 2, 1.0, 5.0, 4.0, 5.0)],
                                              "grp string, k int, a double, b double, y double, ab double"))
    pdf = df.toPandas().dropna(subset=["a", "b", "y"])
    grp = pdf.grp.fillna("none")
    X = np.column_stack([pdf.a, pdf.b, pdf.ab, *[(grp == g).astype(float) for g in sorted(grp.unique())]])
    coef = np.linalg.lstsq(X, pdf.y, rcond=None)[0]
    r = FT.within_regression(df, ["grp"], "y", "a", "b", "ab").first()
    assert [r.b_a, r.b_b, r.b_ab] == [pytest.approx(c, rel=1e-8) for c in coef[:3]]
    assert (r.n, r.groups) == (len(pdf), 7)


def test_within_regression_singular_or_empty_is_null(grouped):
    r = FT.within_regression(grouped.withColumn("c", F.col("a") * 2), ["grp"], "y", "a", "c").first()
    assert r.b_c is None and r.b_a is None and r.groups == 6
    r = FT.within_regression(grouped.where("false"), ["grp"], "y", "a", "b").first()
    assert (r.b_a, r.b_b, r.n, r.groups) == (None, None, 0, 0)


def test_pool_means_shrinks_between_group_and_grand_mean(grouped):
    out = FT.pool_means(grouped, "grp", "y").collect()
    pdf = grouped.toPandas()
    gm = pdf.y.mean()
    for r in out:
        lo, hi = sorted([r.mean, gm])
        assert lo - 1e-9 <= r.shrunk <= hi + 1e-9
    assert out[0].tau2 > 0


def test_pool_means_floor_at_zero(spark):
    # identical group means: between-group variance estimate is negative -> 0
    rows = [(g, v) for g in ("a", "b", "c") for v in (1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "grp string, y double")
    out = FT.pool_means(df, "grp", "y").collect()
    assert all(r.tau2 == 0.0 for r in out)
    assert all(r.shrunk == pytest.approx(2.0) for r in out)


def test_pool_effects(spark):
    rows = []
    for g, d in (("a", 0.0), ("b", 5.0), ("c", 10.0)):
        for i in range(4):
            rows.append((g, "F", float(i)))
            rows.append((g, "P", float(i) + d))
    df = spark.createDataFrame(rows, "grp string, t string, y double")
    out = {r.grp: r for r in FT.pool_effects(df, "grp", "y", "t", "P", "F").collect()}
    assert out["b"].d == pytest.approx(5.0)
    assert out["a"].tau2 > 0
    assert out["a"].d <= out["a"].shrunk <= 5.0


def test_among_within_correlation(grouped):
    r = FT.among_within_correlation(grouped, "grp", "b", "y").first()
    pdf = grouped.toPandas()
    m = pdf.groupby("grp")[["b", "y"]].mean()
    assert r.r_among == pytest.approx(np.corrcoef(m.b, m.y)[0, 1], rel=1e-9)
    res = pdf[["b", "y"]] - pdf.groupby("grp")[["b", "y"]].transform("mean")
    assert r.r_within == pytest.approx(np.corrcoef(res.b, res.y)[0, 1], rel=1e-9)


def test_bootstrap_deterministic_and_centred(grouped):
    a = FT.bootstrap_draws(grouped, "k", "y", "b", replicates=200).orderBy("iter").collect()
    b = FT.bootstrap_draws(grouped, "k", "y", "b", replicates=200).orderBy("iter").collect()
    assert a == b
    means = np.array([r.mean_y for r in a if r.mean_y is not None])
    est = grouped.agg(F.avg("y")).first()[0]
    assert abs(means.mean() - est) < 3 * means.std() / math.sqrt(len(means)) + 0.05
    assert len({r.n_w for r in a}) > 1   # weights really vary across replicates


@pytest.fixture(scope="module")
def coefs(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(rng.normal(1, 0.1)), float(rng.normal(2, 0.2)), float(abs(rng.normal(0.5, 0.05))))
            for i in range(60)]
    return spark.createDataFrame(rows, "iter int, b0 double, b1 double, sigma double")


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame([(1, 0.5, 2.1), (2, 1.0, 3.2), (3, 1.5, 3.9), (4, 2.0, 5.2)],
                                 "id int, x double, y double")


def test_predict_equals_brute_force(coefs, obs):
    c = coefs.toPandas()
    got = {r.id: r for r in CM.predict(obs, "x", CM.draw_moments(coefs)).collect()}
    for r in obs.collect():
        mu = c.b0 + c.b1 * r.x
        assert got[r.id].pred_mean == pytest.approx(mu.mean(), rel=1e-12)
        assert got[r.id].pred_sd == pytest.approx(math.sqrt(mu.var(ddof=1) + (c.sigma ** 2).mean()), rel=1e-9)


def neg_xy():
    return CM.neg_loglik(F.col("x"), F.col("y"))


def test_loglik_and_loo_brute_force(coefs, obs):
    c, o = coefs.toPandas(), obs.toPandas()
    ll = CM.pointwise_loglik(obs, coefs, neg_xy(), ["id"]).toPandas()
    assert len(ll) == len(c) * len(o)
    r = ll[(ll.id == 2) & (ll.iter == 7)].loglik.iloc[0]
    d = c[c.iter == 7].iloc[0]
    mu = d.b0 + d.b1 * 1.0
    assert r == pytest.approx(-0.5 * math.log(2 * math.pi) - math.log(d.sigma) - 0.5 * ((3.2 - mu) / d.sigma) ** 2)
    e = {x.id: x.elpd for x in CM.elpd_loo(obs, coefs, neg_xy(), ["id"]).collect()}
    for i in o.id:
        lli = ll[ll.id == i].loglik.values
        assert e[i] == pytest.approx(-math.log(np.mean(np.exp(-lli))), rel=1e-9)


def test_loo_constant_likelihood(spark, obs):
    # every draw identical: elpd_i equals that log-likelihood exactly
    same = spark.createDataFrame([(i, 1.0, 2.0, 0.5) for i in range(10)], "iter int, b0 double, b1 double, sigma double")
    e = CM.elpd_loo(obs, same, neg_xy(), ["id"])
    ll = {r.id: r.loglik for r in CM.pointwise_loglik(obs, same, neg_xy(), ["id"]).where("iter = 0").collect()}
    got = {x.id: x.elpd for x in e.collect()}
    assert got == {i: pytest.approx(v, rel=1e-12) for i, v in ll.items()}


def test_loo_compare_ranks_models_against_the_best(spark):
    rows = [(None, m, i, float(v)) for m, vs in (("a", (-1, -2, -3)), ("b", (-1, -1, -2)), ("c", (-3, -1, -1))) for i, v in enumerate(vs)]
    e = spark.createDataFrame(rows, "grp string, model string, id int, elpd double")
    got = {r.model: r for r in CM.loo_compare(e, "model", ["id"], ["grp"]).collect()}
    assert len(got) == 3 and got["b"].elpd_diff == 0.0 and got["b"].se_diff == 0.0 and got["b"].elpd_loo == -4.0
    assert got["a"].elpd_diff == -2.0 and got["a"].n == 3
    assert got["c"].se_diff == pytest.approx(math.sqrt(3) * np.std([-2.0, 0.0, 1.0], ddof=1))


def test_draws_meet_only_their_own_model(spark):
    obs = spark.createDataFrame([(1, "m"), (2, "m"), (3, None), (4, "z")], "id int, model string")
    draws = spark.createDataFrame([(i, m) for i in range(200) for m in ("m", None)], "iter int, model string")
    n = {r.id: r["count"] for r in CM.meet(obs, draws, ["model"]).groupBy("id").count().collect()}
    assert n == {1: 200, 2: 200, 3: 200}


def test_bivariate_loglik(spark):
    d = spark.createDataFrame([(1, 0.5, -1.0, 2.0, 0.7, 0.6)], "iter int, m1 double, m2 double, s1 double, s2 double, rho double")
    o = spark.createDataFrame([(1, 1.5, -0.2), (2, 0.0, 0.0)], "id int, y1 double, y2 double")
    cov = np.array([[4.0, 0.6 * 1.4], [0.6 * 1.4, 0.49]])
    for r in CM.pointwise_loglik(o, d, CM.neg_loglik_pair(F.col("y1"), F.col("y2")), ["id"]).collect():
        z = np.array({1: (1.5, -0.2), 2: (0.0, 0.0)}[r.id]) - (0.5, -1.0)
        want = -math.log(2 * math.pi) - 0.5 * math.log(np.linalg.det(cov)) - 0.5 * z @ np.linalg.solve(cov, z)
        assert r.loglik == pytest.approx(want, rel=1e-12)


def test_bayes_r2_brute_force(coefs, obs):
    c, o = coefs.toPandas(), obs.toPandas()
    got = {r.iter: r.r2 for r in CM.bayes_r2(coefs, CM.obs_moments(obs, "x", "y")).collect()}
    for _, d in c.head(5).iterrows():
        mu = d.b0 + d.b1 * o.x
        vm, vr = mu.var(ddof=1), (o.y - mu).var(ddof=1)
        assert got[int(d.iter)] == pytest.approx(vm / (vm + vr), rel=1e-9)


def test_bootstrap_fast_hash(grouped):
    a = FT.bootstrap_draws(grouped, "k", "y", replicates=300, hash_fn="xxhash64").orderBy("iter").collect()
    b = FT.bootstrap_draws(grouped, "k", "y", replicates=300, hash_fn="xxhash64").orderBy("iter").collect()
    assert a == b
    n = grouped.count()
    mean_w = np.mean([r.n_w for r in a]) / n
    assert 0.9 < mean_w < 1.1          # Poisson(1) weights average 1
