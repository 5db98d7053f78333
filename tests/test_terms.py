"""Models with several terms, bootstrap regression, correlated effects, and
the shortest interval and ESS on long draws, against numpy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitlab.functions import linalg as L
from traitlab.operators import compare as CM
from traitlab.operators import design as DS
from traitlab.operators import draws as D
from traitlab.operators import fit as FT
from traitlab.operators import ranking

RNG = np.random.default_rng


def test_regression_draws_with_and_without_group_intercepts(spark):
    rng = RNG(1)
    rows = [(i, int(g), float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(4) for g in rng.integers(0, 3, 20)]
    rows += [(0, 1, None, 1.0, 2.0), (9, 1, 1.0, 2.0, 3.0), (9, 1, 2.0, 4.0, 4.0), (None, 0, 1.0, 0.5, 2.0), (None, 0, 2.0, 0.1, 2.0),
             (None, 0, 0.0, 0.2, 1.0), (None, 0, 4.0, 0.9, 1.5)]
    df = spark.createDataFrame(rows, "iter int, g int, a double, b double, y double")
    for group in (None, "g"):
        got = {}
        for r in FT.regression_draws(df, ["iter"], "y", ["a", "b"], group=group, intercept="g" if group else "Intercept").collect():
            got.setdefault(r.iter, {})[r.term] = r.value
        assert 9 not in got  # collinear, no degree of freedom
        for it in (0, 1, 2, 3, None):
            some = [r for r in rows if r[0] == it and r[2] is not None]
            levels = sorted({r[1] for r in some}) if group else [0]
            x = np.array([[*(float(r[1] == v if group else 1) for v in levels), r[2], r[3]] for r in some])
            y = np.array([r[4] for r in some])
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            sigma = math.sqrt(((y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])) if len(y) > x.shape[1] else None
            names = [f"g[{v}]" for v in levels] if group else ["Intercept"]
            want = dict(zip([*names, "a", "b"], beta)) | {"sigma": sigma}
            assert got[it].keys() == want.keys()
            assert all(np.isclose(got[it][k], want[k], rtol=1e-7) for k in want)


def setting(spark, n_draws=40):
    """Two models over five observations; model 2 has a factor."""
    rng = RNG(2)
    obs = [(m, i, float(rng.normal()), float(i % 2), f"s{i % 3}" if i else None, float(rng.normal()) if i != 3 else None)
           for m in (1, 2) for i in range(5)]
    df = spark.createDataFrame(obs, "m int, id int, x double, w double, s string, y double")
    d1 = DS.long_design(df.where("m = 1"), ["m", "id"], {"Intercept": F.lit(1.0), "x": F.col("x"), "w": F.col("w"), "xw": F.col("x") * F.col("w")})
    d2 = DS.long_design(df.where("m = 2 AND s IS NOT NULL"), ["m", "id"], {"x": F.col("x")}, [F.concat(F.lit("r["), "s", F.lit("]"))])
    names = {1: ["Intercept", "w", "x", "xw"], 2: ["r[s0]", "r[s1]", "r[s2]", "x"]}
    coef = {(m, i): rng.normal(size=4) for m in (1, 2) for i in range(n_draws)}
    draws = [(m, i, t, float(v)) for (m, i), c in coef.items() for t, v in zip(names[m], c)]
    sig = {k: float(abs(rng.normal()) + 0.1) for k in coef}
    draws += [(m, i, "sigma", s) for (m, i), s in sig.items()] + [(1, 0, "unused", 5.0)]
    draws += [(1, 900, "x", 1.0), (2, 901, "x", None), (2, 901, "r[s0]", 1.0)]  # incomplete draws
    x = {}
    for m, i, xx, w, s, _ in obs:
        if m == 1:
            x[m, i] = np.array([1.0, w, xx, xx * w])
        elif s is not None:
            x[m, i] = np.array([*(float(s == z) for z in ("s0", "s1", "s2")), xx])
    return df, d1.unionByName(d2), spark.createDataFrame(draws, "m int, iter int, term string, value double"), x, coef, sig, obs


def test_linear_predictor_is_the_sparse_product(spark, monkeypatch):
    df, design, draws, x, coef, _, _ = setting(spark)
    for per in (2048, 3):  # one block, many blocks
        monkeypatch.setattr(CM, "BLOCK_DRAWS", per)
        got = {(r.m, r.id, r.iter): r.mu for r in DS.linear_predictor(design, draws, ["m", "id"], ["m"]).collect()}
        want = {(m, i, it): x[m, i] @ c for (m, i) in x for (mm, it), c in coef.items() if mm == m}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    empty = DS.linear_predictor(design.where("false"), draws, ["m", "id"], ["m"])
    assert empty.collect() == []


def test_null_predictor_stays_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 0.0)], "id int, x double")
    design = DS.long_design(df, ["id"], {"Intercept": F.lit(1.0), "x": F.col("x")})
    draws = spark.createDataFrame([(1, "Intercept", 1.0), (1, "x", 0.5)], "iter int, term string, value double")
    assert {r.id: r.mu for r in DS.linear_predictor(design, draws, ["id"]).collect()} == {1: 2.0, 2: None, 3: 1.0}


def test_prediction_and_r2_from_covariances(spark):
    df, design, draws, x, coef, sig, obs = setting(spark)
    got = {(r.m, r.id): (r.pred_mean, r.pred_sd) for r in DS.predict_terms(design, draws, ["m", "id"], ["m"]).collect()}
    assert got.keys() == x.keys()
    for (m, i), v in x.items():
        mu = np.array([v @ c for (mm, _), c in coef.items() if mm == m])
        s2 = np.mean([s * s for (mm, _), s in sig.items() if mm == m])
        assert np.allclose(got[m, i], (mu.mean(), math.sqrt(mu.var(ddof=1) + s2)))
    r2 = {(r.m, r.iter): r.r2 for r in DS.bayes_r2_terms(design, df, draws, ["m", "id"], "y", ["m"]).collect()}
    assert r2.keys() == coef.keys()
    for (m, it), c in coef.items():
        ids = [(o[1], o[5]) for o in obs if o[0] == m and o[5] is not None and (m, o[1]) in x]
        mu, y = np.array([x[m, i] @ c for i, _ in ids]), np.array([y for _, y in ids])
        assert np.isclose(r2[m, it], mu.var(ddof=1) / (mu.var(ddof=1) + (y - mu).var(ddof=1)))


def test_ribbon_of_any_terms(spark):
    _, design, draws, x, coef, _, _ = setting(spark, 60)
    got = {(r.m, r.id): r for r in DS.term_ribbon(design, draws, ["m", "id"], ["m"], link="exp", interval="quantile").collect()}
    for (m, i), v in x.items():
        mu = np.exp([v @ c for (mm, _), c in coef.items() if mm == m])
        assert np.allclose((got[m, i].point, got[m, i].lower, got[m, i].upper), np.quantile(mu, [0.5, 0.025, 0.975]))


def test_bootstrap_regression_replicates(spark):
    rng = RNG(3)
    rows = [(k, f"g{k % 3}", float(rng.normal()), float(rng.normal()), float(rng.normal()) + 1e6) for k in range(60)] + [(99, "g1", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, g string, a double, b double, y double")
    got = {}
    for r in FT.bootstrap_regression(df, "k", "g", "y", ["a", "b"], replicates=11).collect():
        assert (r.model, r.chain) == ("boot", 1)
        got.setdefault(r.iter, {})[r.par] = r.value
    assert sorted(got) == list(range(1, 12))
    for it, g in got.items():
        w = []
        for k, *_ in rows[:-1]:
            h = hashlib.sha256(f"{k}_{(it - 1) // 8}".encode()).hexdigest()
            u = int(h[(it - 1) % 8 * 8:][:8], 16) / 2 ** 32
            w.append(sum(u >= c for c in FT.POISSON1_CDF))
        w = np.array(w, float)
        x = np.array([[*(float(r[1] == f"g{j}") for j in range(3)), r[2], r[3]] for r in rows[:-1]])
        y = np.array([r[4] for r in rows[:-1]])
        s = np.sqrt(w)
        beta = np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0]
        sse = (w * (y - x @ beta) ** 2).sum()
        assert np.allclose([g["b_a"], g["b_b"], g["sigma"]], [*beta[3:], math.sqrt(sse / (w.sum() - 5))], rtol=1e-6)


@pytest.mark.parametrize("effects", ["both", "treatment"])
def test_correlated_effects_of_two_responses(spark, effects):
    rng = RNG(4)
    base = rng.multivariate_normal([1, 2, 0.5, -1], np.diag([1, 0.5, 1, 0.7]) + 0.4, 8)
    rows = [(g, t, float(base[g, 0] + (t == "b") * base[g, 1] + rng.normal()), float(base[g, 2] + (t == "b") * base[g, 3] + rng.normal()))
            for g in range(8) for t in "ab" for _ in range(6 + g)]
    rows += [(20, "a", 1.0, 2.0), (20, "b", 1.0, 2.0), (0, "a", None, 1.0), (0, "c", 5.0, 5.0), (None, "a", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, t string, u double, v double")
    got = {r.grp: r for r in FT.pool_correlated(df, "g", ["u", "v"], "t", "b", "a", effects).collect()}
    assert sorted(got) == list(range(8))
    theta, vs = [], []
    for g in range(8):
        a, b = (np.array([r[2:] for r in rows if r[0] == g and r[1] == t and r[2] is not None]) for t in "ab")
        va, vb = np.cov(a.T) / len(a), np.cov(b.T) / len(b)
        jac = np.array([[1, 0, 0, 0], [-1, 0, 1, 0], [0, 1, 0, 0], [0, -1, 0, 1]], float)  # mean, difference per response
        full = jac @ np.block([[va, np.zeros((2, 2))], [np.zeros((2, 2)), vb]]) @ jac.T
        e = jac @ np.r_[a.mean(axis=0), b.mean(axis=0)]
        keep = [0, 1, 2, 3] if effects == "both" else [1, 3]
        theta.append(e[keep])
        vs.append(full[np.ix_(keep, keep)])
    theta, m = np.array(theta), np.mean(theta, axis=0)
    w, q = np.linalg.eigh(np.cov(theta.T) - np.mean(vs, axis=0))
    t = (q * np.maximum(w, 0)) @ q.T
    for g in range(8):
        assert np.allclose(got[g].raw, theta[g]) and np.allclose(got[g].between, t, atol=1e-9)
        assert np.allclose(got[g].shrunk, m + t @ np.linalg.solve(t + vs[g], theta[g] - m))


def test_normal_density_of_any_dimension(spark):
    rng = RNG(5)
    for n in (1, 2, 5):
        a = rng.normal(size=(n, 2 * n))
        cov = a @ a.T
        sd = np.sqrt(np.diag(cov))
        corr = cov / np.outer(sd, sd)
        corr[np.diag_indices(n)] = 1.0
        y, m = rng.normal(size=n), rng.normal(size=n)
        df = spark.createDataFrame([(y.tolist(), m.tolist(), sd.tolist(), corr.tolist())], "y array<double>, m array<double>, s array<double>, c array<array<double>>")
        chol = L.cholesky(CM.covariance_of(F.col("s"), F.col("c")))
        got = df.withColumn("l", chol).select(CM.neg_loglik_normal(F.col("y"), F.col("m"), F.col("l"))).first()[0]
        z = y - m
        assert np.isclose(got, 0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + z @ np.linalg.solve(cov, z)))
        assert df.select(L.is_correlation(F.col("c"))).first()[0] == bool(np.array_equal(corr, corr.T))


def test_correlation_checks_count_invalid_draws(spark):
    ok, bad, part = [[1.0, 0.5], [0.5, 1.0]], [[1.0, 1.5], [1.5, 1.0]], [[1.0, None], [None, 1.0]]
    three = [[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]]  # pairs in bounds, matrix not valid
    df = spark.createDataFrame([("a", ok), ("a", bad), ("a", part), ("b", three), ("b", None)], "k string, c array<array<double>>")
    got = {r.k: tuple(r)[1:] for r in D.check_correlations(df, "c", ["k"]).collect()}
    assert got == {"a": (3, 1, 2), "b": (2, 1, 2)}


def plain_hpd(v, width):
    v = np.sort(v)
    k = math.floor(width * len(v))
    gaps = v[k:] - v[:len(v) - k]
    return v[int(gaps.argmin())], v[int(gaps.argmin()) + k]


def test_shortest_interval_ranks_the_ends_only(spark):
    rng = RNG(6)
    big, ties = rng.gamma(2, size=30000), rng.integers(0, 9, 5000).astype(float)
    rows = [("big", float(x)) for x in big] + [("ties", float(x)) for x in ties] + [("few", float(x)) for x in rng.normal(size=25)]
    rows += [("mid", float(x)) for x in rng.normal(size=700)] + [("one", 3.0), ("null", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "par string, value double")
    got = {r.par: (r.lower, r.upper) for r in D.hpd_interval(df).collect()}
    groups = {}
    for p, x in rows:
        groups.setdefault(p, []).append(x)
    for p in ("big", "ties", "few", "mid"):
        assert got[p] == plain_hpd(np.array(groups[p]), 0.95)
    assert "null" not in got and set(got) == {"big", "ties", "few", "mid", "one", None}
    ends = ranking.tails(df.where("par = 'big'"), ["par"], "value", 0.05)
    assert ends.count() < 0.12 * len(big)


def plain_ess(chains):
    x = np.array(chains)
    m, n = x.shape
    d = x - x.mean(axis=1, keepdims=True)
    w, bn = x.var(axis=1, ddof=1).mean(), x.mean(axis=1).var(ddof=1)
    varp = (n - 1) / n * w + bn
    last, rho = n // 2 - n // 2 % 2, []
    for t in range(last):
        rho.append(1 - (w - (d[:, :n - t] * d[:, t:]).sum(axis=1).mean() / n * n / (n - 1)) / varp)
    total, low = 0.0, math.inf
    for k in range(last // 2):
        p = rho[2 * k] + rho[2 * k + 1]
        if p < 0:
            break
        low = min(low, p)
        total += low
    return m * n / (-1 + 2 * total)


@pytest.mark.parametrize("block", [8, 64, 1024])
def test_ess_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    rng = RNG(7)
    chains = {}
    for par, phi in (("slow", 0.98), ("fast", 0.1), ("anti", -0.5)):
        x = rng.normal(size=(3, 500))
        for t in range(1, 500):
            x[:, t] += phi * x[:, t - 1]
        chains[par] = x
    rows = [(p, c, i * 3, float(v)) for p, x in chains.items() for c, r in enumerate(x) for i, v in enumerate(r)]
    df = spark.createDataFrame(rows, "par string, chain int, iter int, value double")
    got = {r.par: r.ess for r in D.ess(df).collect()}
    assert got.keys() == chains.keys()
    for p, x in chains.items():
        assert np.isclose(got[p], plain_ess(x), rtol=1e-9)


def test_quantiles_in_narrowing_rounds(spark, monkeypatch):
    rng = RNG(8)
    groups = {"normal": rng.normal(size=20000), "wide": np.exp(8 * rng.normal(size=20000)), "ties": rng.integers(0, 4, 9000).astype(float),
              "few": rng.normal(size=11), "same": np.full(5000, 2.5), None: rng.gamma(1, size=4000)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("null", None)], "g string, v double")
    monkeypatch.setattr(ranking, "MOST_CELLS", 5)
    monkeypatch.setattr(ranking, "SPLITS", 4)
    written = []
    keep = ranking.cut_lineage
    monkeypatch.setattr(ranking, "cut_lineage", lambda t, name: written.append(name) or keep(t, name))
    probs = [0.025, 0.5, 0.975]
    got = {r.g: tuple(r)[1:] for r in ranking.group_quantiles(df, ["g"], "v", probs).collect()}
    assert len(written) >= 1 + 2 * 3  # the sketch, and at least three rounds
    assert got.keys() == groups.keys()
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, probs), rtol=1e-12)


def test_a_sketch_that_is_off_falls_back_to_the_group(spark, monkeypatch):
    v = RNG(9).normal(size=3000)
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    d = df.select(F.struct("g").alias("_g"), F.col("v").alias("_v"))
    wrong = spark.createDataFrame([(3000, float(v.min()), float(v.max()), [(9.0, 9.5), (-9.0, -8.0)])],
                                  "_n long, _min double, _max double, _br array<struct<lo:double,hi:double>>")
    wrong = wrong.select(F.struct(F.lit("a").alias("g")).alias("_g"), "_n", "_min", "_max", "_br")
    monkeypatch.setattr(ranking, "MOST_CELLS", 100)
    lo, hi = zip(*ranking._narrowed(d, wrong, [0.3, 0.9]).first()._br)
    s = np.sort(v)
    for i, p in enumerate((0.3, 0.9)):
        at = (len(v) - 1) * p
        assert lo[i] <= s[math.floor(at)] and s[math.ceil(at)] <= hi[i]
        assert ((v >= lo[i]) & (v <= hi[i])).sum() <= 100


def test_density_pieces_of_a_mixture(spark):
    rng = RNG(10)
    two = np.r_[rng.normal(-5, 0.5, 3000), rng.normal(4, 1, 5000)]
    rows = [("two", float(x)) for x in two] + [("same", 1.5)] * 40 + [("two", None), (None, 1.0), (None, 2.0)]
    got = {}
    for r in D.hdr_density(spark.createDataFrame(rows, "par string, value double")).collect():
        got.setdefault(r.par, []).append((r.piece, r.lower, r.upper, r.mass))
    a, b = sorted(got["two"])
    assert (a[0], b[0]) == (1, 2) and a[1] < -5 < a[2] < 0 < b[1] < 4 < b[2]
    assert 0.95 <= a[3] + b[3] < 0.97 and abs(a[3] - 0.375) < 0.03
    assert got["same"] == [(1, 1.5, 1.5, 1.0)] and None in got


@pytest.mark.parametrize("kind", ["text", "number", "ties", "nulls"])
def test_large_buckets_are_split_again(spark, monkeypatch, kind):
    rng = RNG(11)
    n = 3000
    value = {"text": lambda i: "shared-prefix-" + ("é" if i % 2 else "") + "".join(rng.choice(list("abc"), 12)),
             "number": lambda i: float(np.exp(12 * rng.normal())), "ties": lambda i: 7.0 if i % 10 else float(i),
             "nulls": lambda i: None if i % 3 else float(rng.normal())}[kind]
    rows = [("g" if i % 4 else None, value(i), i) for i in range(n)]
    df = spark.createDataFrame(rows, f"g string, v {'string' if kind == 'text' else 'double'}, t int")
    monkeypatch.setattr(ranking, "CUTS", 4)
    sizes, real = [], ranking._split_more

    def watched(b, *args):
        out = real(b, *args)
        sizes.extend(r["count"] for r in out.groupBy("_g", "_b").count().collect())
        return out

    monkeypatch.setattr(ranking, "_split_more", watched)
    got = {(r.g, r.t): (r.rn, r.n) for r in ranking.rank_within(df, ["g"], "v", ["t"], bucket_rows=20).collect()}
    assert sizes and max(sizes) <= 40
    for g in ("g", None):
        own = [r for r in rows if r[0] == g]
        own.sort(key=lambda r: (r[1] is not None, (r[1].encode() if kind == "text" else r[1]) if r[1] is not None else 0, r[2]))
        assert [got[g, r[2]] for r in own] == [(i + 1, len(own)) for i in range(len(own))]
