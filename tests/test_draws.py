"""Draws operators against numpy brute force on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from traitlab.operators import draws as D
from traitlab.operators.ranking import group_quantiles, rank_within


def draws_df(spark, arrays, chains=4):
    """{par: values} -> long draws with chain / iter (iter dense per chain)."""
    rows = []
    for par, vals in arrays.items():
        for k, v in enumerate(vals):
            rows.append(("m", int(k % chains), int(k // chains) + 1, par, float(v)))
    return spark.createDataFrame(rows, "model string, chain int, iter long, par string, value double")


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def test_rank_within_matches_window_on_skewed_keys(spark, rng):
    # one key holds most rows; values carry ties
    keys = np.where(rng.random(3000) < 0.7, "hot", rng.choice(["a", "b", "c"], 3000))
    vals = np.round(rng.normal(size=3000), 1)
    df = spark.createDataFrame([(str(k), float(v), i) for i, (k, v) in enumerate(zip(keys, vals))],
                               "g string, v double, i long")
    w = Window.partitionBy("g").orderBy("v", "i")
    ref = df.select("i", F.row_number().over(w).alias("rn2"), F.count("*").over(Window.partitionBy("g")).alias("n2"))
    for rows in (7, 100, 1000, None):   # many buckets, some, only the hot key split, none
        ours = rank_within(df, ["g"], "v", ["i"], bucket_rows=rows).select("i", "rn", "n")
        bad = ours.join(ref, "i").where((F.col("rn") != F.col("rn2")) | (F.col("n") != F.col("n2"))).count()
        assert bad == 0 and ours.count() == 3000


def test_global_rank_of_strings(spark):
    df = spark.createDataFrame([(s,) for s in ["Brand#10", "Brand#1", "Brand#2", "Brand#100", "A"]], "s string")
    got = [r.s for r in rank_within(df, [], "s", bucket_rows=2).orderBy("rn").collect()]
    assert got == sorted(got) == ["A", "Brand#1", "Brand#10", "Brand#100", "Brand#2"]


@pytest.mark.parametrize("rows", [3, None])
def test_ranks_keep_null_keys_null_values_and_hot_ties(spark, rows):
    data = [(None, 5.0, i) for i in range(40)] + [("a", None, i) for i in range(9)] + [("a", float(i % 4), 50 + i) for i in range(60)]
    data += [("tie", 1.0, i) for i in range(200)] + [("tie", 0.0, 300), ("tie", 2.0, 301), (None, None, 99)]
    df = spark.createDataFrame(data, "g string, v double, i long")
    got = {(r.g, r.v, r.i): (r.rn, r.n) for r in rank_within(df, ["g"], "v", ["i"], bucket_rows=rows).collect()}
    want = {}
    for g in (None, "a", "tie"):
        mine = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        want.update({r: (k + 1, len(mine)) for k, r in enumerate(mine)})
    assert got == want
    both = {r.i: r.rn for r in rank_within(df.where("g = 'tie'"), [], "v", ["i"], bucket_rows=rows).collect()}
    assert both[300] == 1 and both[301] == 202 and both[0] == 2 and both[199] == 201


def test_quantiles_with_null_keys_ties_and_large_groups(spark, rng):
    vals = np.concatenate((np.round(rng.normal(size=20_000), 2), np.full(30_000, 0.5), rng.pareto(0.5, 10_000)))
    df = spark.createDataFrame([(None if i % 2 else "x", float(v)) for i, v in enumerate(vals)] + [("none", None), (None, None)],
                               "g string, value double")
    probs = [0.0, 0.025, 0.4, 0.5, 0.975, 1.0]
    got = {r.g: r[1:] for r in group_quantiles(df, ["g"], "value", probs).collect()}
    assert set(got) == {None, "x"}
    for g, part in ((None, vals[1::2]), ("x", vals[::2])):
        assert got[g] == pytest.approx(tuple(np.quantile(part, probs)), rel=1e-12)
    assert group_quantiles(df.limit(0), ["g"], "value", [0.5]).collect() == []


def test_quantiles_match_numpy(spark, rng):
    vals = {"a": rng.normal(size=501), "b": rng.exponential(size=40), "c": np.array([3.0])}
    df = draws_df(spark, vals)
    q = {r.par: r for r in group_quantiles(df, ["par"], "value", [0.025, 0.5, 0.975], ["lo", "md", "hi"]).collect()}
    for p, v in vals.items():
        ref = np.quantile(v, [0.025, 0.5, 0.975], method="linear")
        assert (q[p].lo, q[p].md, q[p].hi) == pytest.approx(tuple(ref), rel=1e-12)


def brute_hpd(v, w=0.95):
    s = np.sort(v)
    n = len(s)
    k = math.floor(w * n)
    widths = s[k:] - s[:n - k]
    r = int(np.argmin(widths))  # first minimum
    return s[r], s[r + k]


def test_hpd_matches_brute_force_with_ties(spark, rng):
    vals = {"skew": rng.gamma(2.0, size=400), "ties": np.round(rng.normal(size=300), 0),
            "small": np.array([1.0, 2.0, 2.0, 5.0])}
    got = {r.par: r for r in D.hpd_interval(draws_df(spark, vals)).collect()}
    for p, v in vals.items():
        lo, hi = brute_hpd(v)
        assert (got[p].lower, got[p].upper) == (lo, hi)
        if len(v) >= 100:  # with many draws HPD is never wider than the quantile interval
            q = np.quantile(v, [0.025, 0.975])
            assert hi - lo <= q[1] - q[0] + 1e-12


def test_tail_p(spark):
    vals = {"pos": np.arange(1, 101, dtype=float), "mixed": np.array([-3.0, -1.0, 0.0, 2.0, 5.0, 7.0]),
            "zero_median": np.array([-1.0, 0.0, 1.0])}
    got = {r.par: r.p for r in D.tail_p(draws_df(spark, vals)).collect()}
    assert got["pos"] == 0.0
    assert got["mixed"] == pytest.approx(2 * (1 - 3 / 6))
    assert got["zero_median"] == pytest.approx(2 * (1 - 1 / 3))   # median 0: count of negatives


def test_hdr_two_peaks(spark, rng):
    v = np.concatenate([rng.normal(-10, 1, 2000), rng.normal(10, 1, 2000)])
    got = D.hdr_pieces(draws_df(spark, {"x": v})).orderBy("piece").collect()
    assert len(got) == 2
    assert got[0].upper < 0 < got[1].lower
    assert sum(r.n_in for r in got) >= 0.95 * len(v)


def test_split_rhat(spark, rng):
    iid = rng.normal(size=4000)
    shifted = rng.normal(size=4000) + np.where(np.arange(4000) % 4 >= 2, 3.0, 0.0)  # chains 2, 3 shifted
    got = {r.par: r.rhat for r in D.split_rhat(draws_df(spark, {"iid": iid, "shift": shifted})).collect()}
    assert got["iid"] == pytest.approx(1.0, abs=0.01)
    assert got["shift"] > 1.5


def brute_ess(chains):
    m, n = chains.shape
    means = chains.mean(axis=1)
    W = chains.var(axis=1, ddof=1).mean()
    varp = (n - 1) / n * W + means.var(ddof=1)
    L = n // 2
    L -= L % 2
    d = chains - means[:, None]
    g = np.array([np.mean([np.sum(d[c, :n - t] * d[c, t:]) / n for c in range(m)]) for t in range(L)])
    rho = 1 - (W - g * n / (n - 1)) / varp
    P = rho[0::2] + rho[1::2]
    keep = []
    for p in P:
        if p < 0:
            break
        keep.append(p)
    keep = np.minimum.accumulate(np.array(keep))
    return m * n / (-1 + 2 * keep.sum())


def test_ess_matches_numpy_definition(spark, rng):
    n, m = 300, 4
    iid = rng.normal(size=(m, n))
    ar = np.zeros((m, n))
    for c in range(m):
        for i in range(1, n):
            ar[c, i] = 0.8 * ar[c, i - 1] + rng.normal()
    rows = []
    for name, arr in (("iid", iid), ("ar", ar)):
        for c in range(m):
            for i in range(n):
                rows.append(("m", c, i + 1, name, float(arr[c, i])))
    df = spark.createDataFrame(rows, "model string, chain int, iter long, par string, value double")
    got = {r.par: r.ess for r in D.ess(df).collect()}
    assert got["iid"] == pytest.approx(brute_ess(iid), rel=1e-9)
    assert got["ar"] == pytest.approx(brute_ess(ar), rel=1e-9)
    assert got["ar"] < got["iid"]
    assert 0.6 * m * n < got["iid"] < 1.6 * m * n


def test_diagnostics_of_thinned_draws_go_by_position(spark, rng):
    n, m = 6000, 4
    x = rng.normal(size=(m, n))
    x[:, 3 * n // 4 + 500:] += 3.0  # a level shift late in every chain
    rows = [("m", c, i + 1, "a", float(x[c, i])) for c in range(m) for i in range(n)]
    df = spark.createDataFrame(rows, "model string, chain int, iter long, par string, value double")
    t = D.thin(df, warmup=2000, every=10)
    kept = np.array([[x[c, i] for i in range(n) if i + 1 > 2000 and (i + 1) % 10 == 0] for c in range(m)])
    half = kept.shape[1] // 2
    parts = np.concatenate((kept[:, :half], kept[:, half:]))
    w, b = parts.var(axis=1, ddof=1).mean(), parts.mean(axis=1).var(ddof=1)
    assert D.split_rhat(t).first().rhat == pytest.approx(math.sqrt(((half - 1) / half * w + b) / w), rel=1e-9)
    assert D.split_rhat(t).first().rhat > 1.1
    assert D.ess(t).first().ess == pytest.approx(brute_ess(kept), rel=1e-9)


def test_dense_index_matches_row_number(spark, rng):
    ids = rng.permutation(2000)
    df = spark.createDataFrame([(int(i), int(i) % 3) for i in ids], "eid long, g int")
    ours = D.dense_index(df, ["g"], "eid", "iter")
    ref = df.withColumn("iter2", F.row_number().over(Window.partitionBy("g").orderBy("eid")))
    assert ours.join(ref, ["eid", "g"]).where(F.col("iter") != F.col("iter2")).count() == 0


def test_thin_and_checks(spark):
    rows = [("m", c, i, "a", float(i)) for c in range(2) for i in range(1, 11)] + [("m", 0, 11, "a", 99.0)]
    df = spark.createDataFrame(rows, "model string, chain int, iter long, par string, value double")
    t = D.thin(df, warmup=2, every=2)
    assert sorted({r.iter for r in t.collect()}) == [4, 6, 8, 10]
    chk = D.check_draws(df, lower=0.0, upper=50.0, clip=(0.0, 10.0)).first()
    assert (chk.n_draws, chk.n_chains, chk.min_chain_n, chk.max_chain_n) == (21, 2, 10, 11)
    assert (chk.n_out_of_bounds, chk.n_clipped, chk.equal_chains) == (1, 1, False)


def test_summarise_draws_columns(spark, rng):
    df = draws_df(spark, {"a": rng.normal(1, 1, 400), "b": rng.normal(-3, 1, 400)})
    s = D.summarise_draws(df, estimate="median", interval="hpd", rhat=True, with_ess=True)
    r = {x.term: x for x in s.collect()}
    assert set(s.columns) >= {"term", "estimate", "std_error", "conf_low", "conf_high", "rhat", "ess", "p",
                              "method", "interval"}
    assert r["a"].method == "median" and r["a"].interval == "hpd"
    assert r["a"].conf_low < r["a"].estimate < r["a"].conf_high
    assert r["b"].p < 0.05


def test_null_parameter_is_a_group_everywhere(spark):
    rows = [("m", c, i, p, float((i * 7 + c) % 23) - 3) for p in ("a", None) for c in (1, 2) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "model string, chain int, iter long, par string, value double")
    for stat in (D.hdr_pieces, D.split_rhat, D.ess, D.hpd_interval, D.quantile_interval, D.tail_p):
        got = {}
        for r in stat(df, ["par"]).collect():
            got.setdefault(r.par, set()).add(tuple(v for k, v in r.asDict().items() if k != "par"))
        assert set(got) == {"a", None} and got["a"] == got[None], stat.__name__
