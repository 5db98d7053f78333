"""Operators with no direct query coverage of their edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from traitlab.operators import draws as D
from traitlab.operators import factors as FA
from traitlab.operators import perdraw as PD
from traitlab.operators import reshape as R
from traitlab.operators import summary as S
from traitlab.operators import traits as TR


def test_null_safe_full_join(spark):
    a = spark.createDataFrame([("x", None, 1.0), ("y", "1", 2.0)], "spp string, rep string, sd double")
    b = spark.createDataFrame([("x", None, 10.0), ("z", "2", 20.0)], "spp string, rep string, gs double")
    plain = TR.join_plants(a, b, ["spp", "rep"], "full")
    safe = TR.join_plants(a, b, ["spp", "rep"], "full", null_safe=True, indicator="side")
    assert plain.count() == 4                     # NULL keys never match
    rows = {(r.spp, r.rep): r for r in safe.collect()}
    assert safe.count() == 3
    assert rows[("x", None)].sd == 1.0 and rows[("x", None)].gs == 10.0 and rows[("x", None)].side == "both"
    assert rows[("z", "2")].side == "right_only"


def test_design_columns_reference_level_and_unknown(spark):
    df = spark.createDataFrame([("F", 1.0), ("O", 2.0), ("P", 3.0), ("X", 4.0)], "t string, g double")
    d = FA.design_columns(df, "t", ["F", "O", "P"], interactions=["g"]).orderBy("t").collect()
    assert [(r.t_O, r.t_P) for r in d[:3]] == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    assert d[2].g_x_t_P == 3.0
    assert d[3].t_O is None                       # unknown level: removed by complete_cases
    assert FA.complete_cases(FA.design_columns(df, "t", ["F", "O", "P"]), ["t_O"]).count() == 3


def test_codes_shared_dictionary(spark):
    a = spark.createDataFrame([("b",), ("a",), ("b",)], "s string")
    b = spark.createDataFrame([("c",), (None,)], "s string")
    dic = FA.dictionary(a, b, name="s", code="code")
    assert sorted(map(tuple, dic.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    coded = FA.add_codes(a, "s", dic)
    assert sorted(r.code for r in coded.collect()) == [1, 2, 2]


def test_crossing_and_unite_separate(spark):
    df = spark.createDataFrame([("A",), ("B",), ("A",)], "spp string")
    c = PD.crossing(df, "treatment", ["WW", "WD"])
    assert sorted(map(tuple, c.collect())) == [("A", "WD"), ("A", "WW"), ("B", "WD"), ("B", "WW")]
    u = R.unite(c, "key", ["spp", "treatment"])
    s = R.separate(u, "key", ["spp", "treatment"])
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, c.collect()))


def test_centre_and_first(spark):
    df = spark.createDataFrame([("a", 1.0, "k"), ("a", 3.0, "k"), ("b", 10.0, "m")], "g string, x double, c string")
    glob = {r.x: r.x_c for r in S.centre(df, "x").collect()}
    assert glob[10.0] == pytest.approx(10.0 - 14.0 / 3)
    by = {(r.g, r.x): r.x_c for r in S.centre(df, "x", ["g"]).collect()}
    assert by[("a", 1.0)] == -1.0 and by[("b", 10.0)] == 0.0
    assert sorted(map(tuple, S.first_in_group(df, ["g"], "c").collect())) == [("a", "k"), ("b", "m")]


def test_add_base_and_ratio(spark):
    rows = [(i, "b_treatment", 10.0 * i) for i in (1, 2)] + [(i, f"r_spp[{k},treatment]", float(k) + i) for i in (1, 2) for k in (1, 2)]
    rows += [(1, "r_spp[1,Intercept]", 99.0), (3, "r_spp[1,treatment]", 5.0), (1, "b_Intercept", 7.0)]
    draws = spark.createDataFrame(rows, "iter int, par string, value double")
    got = {(r.iter, r.level): r.value for r in D.add_base(draws, r"^r_spp\[([^,]+),treatment\]$", "b_treatment").collect()}
    assert got == {(1, "1"): 12.0, (1, "2"): 13.0, (2, "1"): 23.0, (2, "2"): 24.0}
    r = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "a double, b double").select(D.ratio(F.col("a"), F.col("b")).alias("r"))
    assert [x.r for x in r.collect()] == [0.5, None]


def test_correlation_bounds_check(spark):
    df = spark.createDataFrame([(0.5,), (-1.0,), (1.2,)], "r double")
    assert [x[0] for x in df.select(D.correlation_bounds_ok(F.col("r"))).collect()] == [True, True, False]


def test_clip_to_limits(spark):
    from traitlab.operators import report as RP
    df = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (3.5,)], "x double")
    assert [r.x for r in RP.clip_to_limits(df, "x", 1.0, 3.0).collect()] == [1.0, 2.0]
    assert RP.clip_to_limits(df, "x", hi=1.0).count() == 2


def test_order_levels_descending_with_ties(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 5.0), ("c", 2.0)], "spp string, v double")
    asc = {r.spp: r.sort_key for r in FA.order_levels(df, "v", tiebreak=["spp"]).collect()}
    desc = {r.spp: r.sort_key for r in FA.order_levels(df, "v", desc=True, tiebreak=["spp"]).collect()}
    assert asc == {"a": 1, "c": 2, "b": 3}
    assert desc == {"b": 1, "a": 2, "c": 3}


def test_point_interval_variants(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    v = rng.normal(size=800)
    df = spark.createDataFrame([("m", int(i % 4), int(i // 4) + 1, "a", float(x)) for i, x in enumerate(v)],
                               "model string, chain int, iter long, par string, value double")
    m = D.point_interval(df, point="mean", interval="quantile").first()
    assert m.point == pytest.approx(float(v.mean()))
    lo, hi = np.quantile(v, [0.025, 0.975])
    assert (m.lower, m.upper) == pytest.approx((lo, hi))
    first = D.hdr_pieces(df).orderBy("piece").first()
    h = D.point_interval(df, interval="hdr").first()
    assert (h.lower, h.upper) == (first.lower, first.upper)
    h = D.point_interval(df, interval="hdr", piece="heaviest").first()
    assert h.interval_method == "hdr" and h.lower < h.point < h.upper


def test_ribbon_exp_link_and_loo_summary(spark):
    from traitlab.operators import compare as CM
    coefs = spark.createDataFrame([(i, 0.0, 1.0) for i in range(5)], "iter int, b0 double, b1 double")
    bounds = spark.createDataFrame([(0.0, 1.0)], "_glo double, _ghi double")
    rib = {r.x_id: r for r in PD.ribbon(coefs, ["iter"], "b0", "b1", bounds, n=3, link="exp").collect()}
    assert rib[2].point == pytest.approx(math.e) and rib[0].lower == pytest.approx(1.0)
    el = spark.createDataFrame([(1, -1.0), (2, -3.0)], "id int, elpd double")
    s = CM.loo_summary(el).first()
    assert s.elpd_loo == -4.0 and s.n == 2 and s.se == pytest.approx(math.sqrt(2) * math.sqrt(2.0))


def test_generated_quantities_of_long_draws(spark):
    from traitlab.functions.biophysics import B_CONST, M_CONST
    from traitlab.operators import perdraw as PD
    pop = {"b0_sd": 80.0, "b0_sp": 20.0, "b0_kcatc": 0.1, "b0_sco": -0.5}
    eff = {"r_1_sd": 5.0, "r_2_sd": -3.0, "r_1_sp": 1.0, "r_2_sp": 0.5, "b_kcatc": 0.2, "b_sco": 1.5}
    rows = [(1, p, None, v) for p, v in pop.items()] + [(1, p, s, v * k) for p, v in eff.items() for k, s in ((1, "A"), (2, "B"))]
    means = spark.createDataFrame([(2.5, 112.0)], "mean_kcatc double, mean_sco double")
    got = {r.spp: r for r in PD.generated_quantities(spark.createDataFrame(rows, "iter int, par string, spp string, value double"), means).collect()}
    for k, s in ((1, "A"), (2, "B")):
        g = lambda sd, sp: B_CONST * M_CONST * sd * (0.5 * (2 * sp) ** 2) ** 0.5
        assert abs(got[s].gsmax_ww - g(80 + 5 * k, 20 + k)) < 1e-12
        assert abs(got[s].gsmax_wd - g(80 + 2 * k, 20 + 1.5 * k)) < 1e-12
        assert abs(got[s].kcatc - (2.6 + 0.2 * k)) < 1e-12 and abs(got[s].sco - (111.5 + 1.5 * k)) < 1e-12
