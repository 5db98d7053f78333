"""Registered queries: draw diagnostics and per-draw computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.biophysics import gsmax_sql
from ..functions.numeric import safe_ln
from ..operators import draws as D
from ..operators import factors as FA
from ..operators import perdraw as PD
from ..operators import report as RP
from ..operators import reshape as R
from ..operators import traits as TR
from ..operators.ranking import group_quantiles, join_groups
from . import sqlgen as G
from . import views as V
from .registry import query

W = V.with_views

# ------------------------------------------------------------ highest-density pieces

_HDR_SQL = W("DR") + (
    ", st AS (SELECT par, min(value) AS mn, max(value) AS mx, count(*) AS n, "
    "(max(value) - min(value)) / CAST(50 AS DOUBLE) AS bw FROM dr WHERE value IS NOT NULL GROUP BY par), "
    "b AS (SELECT dr.par, CAST(coalesce(least(floor((dr.value - st.mn) / nullif(st.bw, 0)), 49), 0) AS INTEGER) AS bin "
    "FROM dr JOIN st ON dr.par = st.par WHERE dr.value IS NOT NULL), "
    "h AS (SELECT par, bin, count(*) AS c FROM b GROUP BY par, bin), "
    "hh AS (SELECT h.par, h.bin, h.c, st.mn, st.bw, st.n, coalesce(sum(h.c) OVER (PARTITION BY h.par "
    "ORDER BY h.c DESC, h.bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
    "FROM h JOIN st ON h.par = st.par), "
    "k AS (SELECT hh.*, bin - row_number() OVER (PARTITION BY par ORDER BY bin) AS island FROM hh "
    "WHERE before < CAST(0.95 AS DOUBLE) * n), "
    "pc AS (SELECT par, island, min(bin) AS b0, max(bin) AS b1, sum(c) AS n_in, min(mn) AS mn, min(bw) AS bw "
    "FROM k GROUP BY par, island) "
    "SELECT par, CAST(row_number() OVER (PARTITION BY par ORDER BY b0) AS INTEGER) AS piece, "
    "mn + b0 * bw AS lower, mn + (b1 + 1) * bw AS upper, CAST(n_in AS BIGINT) AS n_in FROM pc")


@query("interval_hdr_pieces", "par piece lower:d upper:d n_in", _HDR_SQL)
def interval_hdr_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Highest-density region pieces (histogram based) per parameter."""
    return D.hdr_pieces(V.draws_events(spark, d), ["par"], "value", 0.95, 50)


_KDE_SQL = W("DR") + (
    ", st AS (SELECT par, min(value) AS mn, max(value) AS mx, count(*) AS n, (max(value) - min(value)) / 127 AS step, "
    "0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * pow(count(*), -0.2) AS bw "
    "FROM dr WHERE value IS NOT NULL GROUP BY par), "
    "b AS (SELECT dr.par, least((value - mn) / step, 127.0::DOUBLE) AS x FROM dr JOIN st ON st.par = dr.par WHERE value IS NOT NULL), "
    "t AS (SELECT par, CAST(floor(x) AS INTEGER) AS i, 1 - (x - floor(x)) AS w FROM b UNION ALL "
    "SELECT par, CAST(floor(x) AS INTEGER) + 1, x - floor(x) FROM b WHERE x > floor(x)), "
    "h AS (SELECT par, i, sum(w) AS w FROM t GROUP BY par, i), "
    "k AS (SELECT h.par, CAST(j.range AS INTEGER) AS j, sum(h.w * exp(-0.5 * pow((h.i - j.range) * step / bw, 2))) AS y, min(mn) AS mn, "
    "min(step) AS step FROM h JOIN st ON st.par = h.par CROSS JOIN range(0, 128) j GROUP BY h.par, j.range), "
    "s AS (SELECT *, y / sum(y) OVER (PARTITION BY par) AS share FROM k), "
    "c AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY par ORDER BY y DESC, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS before FROM s), "
    "p AS (SELECT *, j - row_number() OVER (PARTITION BY par ORDER BY j) AS island FROM c WHERE before < CAST(0.95 AS DOUBLE)), "
    "g AS (SELECT par, island, min(j) AS j0, max(j) AS j1, sum(share) AS mass, min(mn) AS mn, min(step) AS step FROM p GROUP BY par, island) "
    "SELECT par, CAST(row_number() OVER (PARTITION BY par ORDER BY j0) AS INTEGER) AS piece, mn + j0 * step AS lower, "
    "mn + j1 * step AS upper, mass FROM g")


@query("interval_hdr_density", "par piece lower:d upper:d mass:d", _KDE_SQL)
def interval_hdr_density(spark: SparkSession, d: str) -> DataFrame:
    """D13 on a kernel density: pieces of the 95 % highest-density region per
    parameter, binned convolution."""
    return D.hdr_density(V.draws_events(spark, d), ["par"], "value", 0.95)


@query("axis_limits", "model chain iter par value:d",
       W("DR") + "SELECT model, chain, iter, par, value FROM dr WHERE value >= -20 AND value <= 40")
def axis_limits(spark: SparkSession, d: str) -> DataFrame:
    """The draws inside a plot's axis limits; those outside are not shown."""
    return RP.clip_to_limits(V.draws_events(spark, d), "value", -20.0, 40.0)


@query("vector_rows", "iter name response treatment value:d",
       W("PM") + "SELECT iter, 'b1' AS name, response, treatment, b1 AS value FROM pm UNION ALL "
       "SELECT iter, 'sigma', response, treatment, sigma FROM pm")
def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    """H6: vector parameters ``par[i,j]`` of a long table to rows with their
    base name and indices as columns."""
    pm = V.regression_draws(spark, d)
    index = F.concat(F.lit("["), "response", F.lit(","), "treatment", F.lit("]"))
    items = F.array(*[F.struct(F.concat(F.lit(p), index).alias("par"), F.col(p).alias("value")) for p in ("b1", "sigma")])
    long = pm.select("iter", F.explode(items).alias("_p")).select("iter", "_p.par", "_p.value")
    return R.split_index(long, "par", "name", ("response", "treatment"))


_ESS_BODY = (
    ", cs AS (SELECT par, chain, avg(value) AS cm, var_samp(value) AS cv, count(*) AS nc FROM dr GROUP BY par, chain), "
    "gs AS (SELECT par, min(nc) AS n, count(*) AS m, avg(cv) AS w, var_samp(cm) AS bn FROM cs GROUP BY par), "
    "gl AS (SELECT gs.*, floor(n / 2) - floor(n / 2) % 2 AS l FROM gs), "
    "dd AS (SELECT dr.par, dr.chain, dr.iter, dr.value - cs.cm AS d, cs.nc FROM dr JOIN cs "
    "ON dr.par = cs.par AND dr.chain = cs.chain), "
    "ac AS (SELECT a.par, a.chain, b.iter - a.iter AS t, sum(a.d * b.d) / min(a.nc) AS ac FROM dd a JOIN dd b "
    "ON a.par = b.par AND a.chain = b.chain AND b.iter >= a.iter AND b.iter <= a.iter + a.nc / 2 "
    "GROUP BY a.par, a.chain, b.iter - a.iter), "
    "g AS (SELECT par, t, avg(ac) AS g FROM ac GROUP BY par, t), "
    "r AS (SELECT g.par, g.t, 1 - (gl.w - g.g * gl.n / (gl.n - 1)) / "
    "nullif((gl.n - 1) / gl.n * gl.w + coalesce(gl.bn, 0), 0) AS rho, gl.m, gl.n "
    "FROM g JOIN gl ON g.par = gl.par WHERE g.t < gl.l), "
    "pk AS (SELECT par, floor(t / 2) AS k, sum(rho) AS p, min(m) AS m, min(n) AS n FROM r GROUP BY par, floor(t / 2)), "
    "st AS (SELECT par, min(k) FILTER (WHERE p < 0) AS stop FROM pk GROUP BY par), "
    "kept AS (SELECT pk.*, min(pk.p) OVER (PARTITION BY pk.par ORDER BY pk.k "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pm FROM pk JOIN st ON pk.par = st.par "
    "WHERE st.stop IS NULL OR pk.k < st.stop) "
    "SELECT par, min(m) * min(n) / nullif(-1 + 2 * sum(pm), 0) AS ess FROM kept GROUP BY par")
_ESS_SQL = W("DR") + _ESS_BODY


@query("ess", "par ess:d", _ESS_SQL)
def ess(spark: SparkSession, d: str) -> DataFrame:
    """Effective sample size per parameter (Geyer's initial positive
    sequence over split-free chains; also tested against numpy)."""
    return D.ess(V.draws_events(spark, d), ["par"])


_THINNED = (", tr AS (SELECT par, chain, row_number() OVER (PARTITION BY par, chain ORDER BY iter) AS iter, value "
            "FROM dr WHERE iter > 40 AND iter % 3 = 0)")


@query("thinned_diagnostics", "par rhat:d ess:d",
       W("DR") + _THINNED + ", " + G.rhat_cte("tr") + ", es AS (SELECT * FROM (WITH dr AS (SELECT * FROM tr)"
       + _ESS_BODY + ") x) SELECT rh.par, rh.rhat, es.ess FROM rh JOIN es ON rh.par = es.par")
def thinned_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """K18 + D19 + D20: split R-hat and effective sample size of thinned
    draws (warm-up 40, every 3rd), by position within the chain."""
    t = D.thin(V.draws_events(spark, d), warmup=40, every=3)
    return D.split_rhat(t, ["par"]).join(D.ess(t, ["par"]), "par")


# ------------------------------------------------------------ per-draw regression

_REG_NAMES = [(r, t, f"b0_{r}_{t}", f"b_{r}_gsmax_{t}") for r, t in V.PAIRS]


@query("per_draw_regression", "iter " + " ".join(f"{a}:d {b}:d" for _, _, a, b in _REG_NAMES),
       W("PM") + "SELECT iter, " + ", ".join(
           f"max(b0) FILTER (WHERE response = '{r}' AND treatment = '{t}') AS {a}, "
           f"max(b1) FILTER (WHERE response = '{r}' AND treatment = '{t}') AS {b}" for r, t, a, b in _REG_NAMES)
       + " FROM pm GROUP BY iter")
def per_draw_regression(spark: SparkSession, d: str) -> DataFrame:
    """D15 + H1: intercept and slope of each response on gsmax, per draw and
    treatment (one regression per (draw, response, treatment) group),
    spread to one row per draw."""
    pm = V.regression_draws(spark, d).withColumn("rt", F.concat_ws("_", "response", "treatment"))
    wide = (pm.groupBy("iter").pivot("rt", [f"{r}_{t}" for r, t in V.PAIRS])
            .agg(F.max("b0").alias("b0"), F.max("b1").alias("b")))
    ren = {}
    for r, t, a, b in _REG_NAMES:
        ren[f"{r}_{t}_b0"] = a
        ren[f"{r}_{t}_b"] = b
    return wide.withColumnsRenamed(ren)


# ------------------------------------------------------------ per-draw correlation

def _corr_sql(x: str, y: str) -> str:
    xc = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END"
    yc = f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END"
    return f"covar_samp({xc}, {yc}) / nullif(stddev_samp({xc}) * stddev_samp({yc}), 0)"


def _pdc_sql() -> str:
    c = ", ".join(f"{_corr_sql(f'gsmax_{t}', r)} AS r_{r}_{t}" for r, t in V.PAIRS)
    rl = " UNION ALL ".join(f"SELECT iter, '{r}' AS response, '{t}' AS treatment, r_{r}_{t} AS r FROM cr"
                            for r, t in V.PAIRS)
    return (W("DS", "PM") + f", cr AS (SELECT iter, {c} FROM ds GROUP BY iter), rl AS ({rl}), "
            "a AS (SELECT iter, spp, gsmax_wd / nullif(gsmax_ww, 0) AS gsmax_diff FROM ds), "
            "b AS (SELECT l_suppkey AS iter, l_linenumber AS spp, "
            "avg(l_tax) FILTER (WHERE l_linestatus = 'O') / nullif(avg(l_tax) FILTER (WHERE l_linestatus = 'F'), 0) "
            "AS gs_diff FROM lineitem GROUP BY l_suppkey, l_linenumber), "
            "fj AS (SELECT coalesce(a.iter, b.iter) AS iter, a.gsmax_diff, b.gs_diff FROM a FULL OUTER JOIN b "
            "ON a.iter = b.iter AND a.spp = b.spp), "
            f"rd AS (SELECT iter, 'delta' AS response, 'ratio' AS treatment, {_corr_sql('gsmax_diff', 'gs_diff')} AS r "
            "FROM fj GROUP BY iter), "
            "allr AS (SELECT * FROM rl UNION ALL SELECT * FROM rd), "
            "rs AS (SELECT response, treatment, median(r) AS r_median, median(r * r) AS r2_median "
            "FROM allr GROUP BY response, treatment), "
            f"ps AS (SELECT response, treatment, {G.tail_p_expr('b1')} AS p FROM pm GROUP BY response, treatment) "
            "SELECT coalesce(rs.response, ps.response) AS response, coalesce(rs.treatment, ps.treatment) AS treatment, "
            "rs.r_median, rs.r2_median, ps.p FROM rs FULL OUTER JOIN ps "
            "ON rs.response = ps.response AND rs.treatment = ps.treatment")


@query("per_draw_correlation", "response treatment r_median:d r2_median:d p:d", _pdc_sql())
def per_draw_correlation(spark: SparkSession, d: str) -> DataFrame:
    """D16 + C3 + C2: per-draw correlations of each response with gsmax
    (guarded against zero variance), the correlation of two per-draw
    ratios joined on (draw, species), medians of r and r^2, and a full
    join with the slopes' tail p-values on (response, treatment)."""
    ds = V.stored_species(spark, d)
    pc = PD.per_draw_correlation(ds, ["iter"], [(f"{r}_{t}", f"gsmax_{t}", r) for r, t in V.PAIRS])
    rl = R.gather(pc.select("iter", *[f"r_{r}_{t}" for r, t in V.PAIRS]), ["iter"], "name", "r")
    rl = rl.select("iter", F.regexp_extract("name", "^r_([a-z]+)_", 1).alias("response"),
                   F.regexp_extract("name", "_(w[wd])$", 1).alias("treatment"), "r")
    a = ds.select("iter", "spp", D.ratio(F.col("gsmax_wd"), F.col("gsmax_ww")).alias("gsmax_diff"))
    li = V.table(spark, d, "lineitem")
    st = F.col("l_linestatus")
    b = (li.groupBy(F.col("l_suppkey").alias("iter"), F.col("l_linenumber").alias("spp"))
         .agg(D.ratio(F.avg(F.when(st == "O", F.col("l_tax"))), F.avg(F.when(st == "F", F.col("l_tax"))))
              .alias("gs_diff")))
    fj = a.join(b, ["iter", "spp"], "full")
    rd = PD.per_draw_correlation(fj, ["iter"], [("delta", "gsmax_diff", "gs_diff")])
    rd = rd.select("iter", F.lit("delta").alias("response"), F.lit("ratio").alias("treatment"),
                   F.col("r_delta").alias("r"))
    # r and r^2 as one long table: both medians come from one pass
    allr = rl.unionByName(rd).withColumn("r2", F.col("r") * F.col("r"))
    keys = ["response", "treatment"]
    stats_long = R.gather(allr, ["iter", *keys], "stat", "v", ["r", "r2"])
    med = group_quantiles(stats_long, [*keys, "stat"], "v", [0.5], ["m"])
    rs = R.spread(med, keys, "stat", "m", ["r", "r2"], prefix="med_").withColumnsRenamed(
        {"med_r": "r_median", "med_r2": "r2_median"})
    pm = V.regression_draws(spark, d)
    ps = D.tail_p(pm, keys, "b1")
    return rs.join(ps, keys, "full")


# ------------------------------------------------------------ ribbon over a grid

def _ribbon_sql() -> str:
    return (W("DS", "PM") + ", sp AS (SELECT spp, avg(gsmax_wd) AS mwd, stddev_samp(gsmax_wd) AS swd, "
            "avg(gsmax_ww) AS mww, stddev_samp(gsmax_ww) AS sww FROM ds GROUP BY spp), "
            "bd AS (SELECT min(least(mwd - swd, mww - sww)) AS lo, max(greatest(mwd + swd, mww + sww)) AS hi FROM sp), "
            "gx AS (SELECT CAST(t.range AS INTEGER) AS x_id, lo + CAST(t.range AS DOUBLE) * (hi - lo) / CAST(99 AS DOUBLE) AS x "
            "FROM bd CROSS JOIN range(100) t), "
            "mu AS (SELECT pm.iter, pm.response, pm.treatment, gx.x_id, gx.x, pm.b0 + pm.b1 * gx.x AS mu "
            "FROM pm CROSS JOIN gx), "
            + G.hpd_cte("mu", ["response", "treatment", "x_id"], "mu", "iter") + ", "
            "md AS (SELECT response, treatment, x_id, min(x) AS x, median(mu) AS point FROM mu "
            "GROUP BY response, treatment, x_id) "
            "SELECT md.response, md.treatment, md.x_id, md.x, md.point, hpd.lower, hpd.upper FROM md JOIN hpd "
            "ON md.response = hpd.response AND md.treatment = hpd.treatment AND md.x_id = hpd.x_id")


@query("grid_ribbon", "response treatment x_id x:d point:d lower:d upper:d", _ribbon_sql())
def grid_ribbon(spark: SparkSession, d: str) -> DataFrame:
    """C8 + I16 + K10 (+ D14): each draw's regression line over a 100-point
    grid spanning the species' gsmax mean -/+ se, then median and shortest
    95 % interval per (response, treatment, grid point)."""
    ds = V.stored_species(spark, d)
    sp = ds.groupBy("spp").agg(F.avg("gsmax_wd").alias("mwd"), F.stddev_samp("gsmax_wd").alias("swd"),
                               F.avg("gsmax_ww").alias("mww"), F.stddev_samp("gsmax_ww").alias("sww"))
    bounds = PD.grid_bounds(sp, F.least(F.col("mwd") - F.col("swd"), F.col("mww") - F.col("sww")),
                            F.greatest(F.col("mwd") + F.col("swd"), F.col("mww") + F.col("sww")))
    pm = V.regression_draws(spark, d)
    return PD.ribbon(pm, ["iter", "response", "treatment"], "b0", "b1", bounds, n=100)


# ------------------------------------------------------------ treatment ratio

def _effects_long(spark: SparkSession, d: str) -> DataFrame:
    """(iter, par, value): the per-draw base ``b_treatment`` (log of mean
    quantity over mean price, a parameter of its own) and the effects
    ``r_spp[<species>,treatment]`` (log ratio of a species' gsmax, K15)."""
    li = V.table(spark, d, "lineitem")
    base = (li.groupBy(F.col("l_suppkey").alias("iter"))
            .agg(safe_ln(F.avg("l_quantity") / F.avg("l_extendedprice")).alias("value"))
            .select("iter", F.lit("b_treatment").alias("par"), "value"))
    ds = V.stored_species(spark, d)
    eff = ds.select("iter", F.concat(F.lit("r_spp["), F.col("spp").cast("string"), F.lit(",treatment]")).alias("par"),
                    safe_ln(D.ratio(F.col("gsmax_wd"), F.col("gsmax_ww"))).alias("value"))
    return base.unionByName(eff)


def _ratio_sql() -> str:
    return (W("DS") + ", bs AS (SELECT l_suppkey AS iter, ln(avg(l_quantity) / avg(l_extendedprice)) AS base FROM lineitem GROUP BY l_suppkey), "
            "r AS (SELECT iter, spp, gsmax_wd / nullif(gsmax_ww, 0) AS ratio FROM ds), "
            "v AS (SELECT r.iter, CAST(r.spp AS STRING) AS spp, exp(CASE WHEN ratio > 0 THEN ln(ratio) END + bs.base) AS value "
            "FROM r JOIN bs ON r.iter = bs.iter), "
            + G.hpd_cte("v", ["spp"], "value", "iter") + ", " + G.median_cte("v", ["spp"], "value") + ", "
            "o AS (SELECT med.spp AS spp1, med.point, hpd.lower, hpd.upper, "
            "CAST(row_number() OVER (ORDER BY med.point, med.spp) AS BIGINT) AS sort_key "
            "FROM med JOIN hpd ON med.spp = hpd.spp), "
            "dic AS (SELECT spp1, CAST(dense_rank() OVER (ORDER BY spp1) AS INTEGER) AS spp_code "
            "FROM (SELECT DISTINCT CAST(spp AS STRING) AS spp1 FROM ds) x) "
            "SELECT coalesce(o.spp1, dic.spp1) AS spp1, dic.spp_code, o.point, o.lower, o.upper, o.sort_key "
            "FROM o FULL OUTER JOIN dic ON o.spp1 = dic.spp1")


@query("treatment_ratio", "spp1 spp_code point:d lower:d upper:d sort_key", _ratio_sql())
def treatment_ratio(spark: SparkSession, d: str) -> DataFrame:
    """K14 + K15 + D14 + F1/F3 + C4: species effects and the population
    parameter of one long table, added per draw by name and exponentiated;
    median and HPD per species, species ordered by the median, full join with
    the species dictionary."""
    v = D.add_base(_effects_long(spark, d), r"^r_spp\[([^,\]]+),treatment\]$", "b_treatment")
    v = v.select("iter", F.col("level").alias("spp"), F.exp("value").alias("value"))
    pi = D.point_interval(v, ["spp"], "value", 0.95, "median", "hpd")
    ordered = FA.order_levels(pi, "point", "sort_key", tiebreak=["spp"]).withColumnRenamed("spp", "spp1")
    dic = FA.dictionary(V.stored_species(spark, d).select(F.col("spp").cast("string")), name="spp1", code="spp_code")
    return ordered.join(dic, "spp1", "full")


# ------------------------------------------------------------ generated quantities

#: Long parameter draws of K9 out of lineitem, each parameter from a measure
#: of its own: (parameter, per species, SQL aggregate).
_GQ_PARS = [
    ("b0_sd", False, "avg(l_quantity)"), ("b0_sp", False, "avg(l_extendedprice) / 1000"),
    ("b0_kcatc", False, "avg(l_tax)"), ("b0_sco", False, "avg(l_discount) * 10"),
    ("r_1_sd", True, "avg(l_tax) * 100"), ("r_2_sd", True, "avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) * 100"),
    ("r_1_sp", True, "avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) / 10"),
    ("r_2_sp", True, "avg(CASE WHEN l_linestatus = 'F' THEN l_tax END) * 10"),
    ("b_kcatc", True, "avg(l_discount)"), ("b_sco", True, "avg(l_tax) * 10"),
]


def _gq_draws(spark: SparkSession, d: str) -> DataFrame:
    li = V.table(spark, d, "lineitem").withColumn("iter", F.col("l_suppkey"))
    parts = []
    for species in (False, True):
        names = [(p, e) for p, s, e in _GQ_PARS if s == species]
        by = ["iter", F.col("l_linenumber").alias("spp")] if species else ["iter"]
        w = li.groupBy(*by).agg(*[F.expr(e).alias(p) for p, e in names])
        w = w if species else w.withColumn("spp", F.lit(None).cast("int"))
        parts.append(w.unpivot(["iter", "spp"], [p for p, _ in names], "par", "value"))
    return parts[0].unionByName(parts[1])


def _gq_sql() -> str:
    agg = {s: ", ".join(f"{e} AS {p}" for p, k, e in _GQ_PARS if k == s) for s in (False, True)}
    return (f"WITH p AS (SELECT l_suppkey AS iter, {agg[False]} FROM lineitem GROUP BY l_suppkey), "
            f"e AS (SELECT l_suppkey AS iter, l_linenumber AS spp, {agg[True]} FROM lineitem GROUP BY l_suppkey, l_linenumber), "
            "m AS (SELECT avg(p_size) AS mean_kcatc, avg(p_retailprice) AS mean_sco FROM part) "
            f"SELECT e.iter, e.spp, {gsmax_sql('(b0_sd + r_1_sd + r_2_sd)', '(b0_sp + r_1_sp + r_2_sp)')} AS gsmax_wd, "
            f"{gsmax_sql('(b0_sd + r_1_sd)', '(b0_sp + r_1_sp)')} AS gsmax_ww, "
            "b0_kcatc + b_kcatc + mean_kcatc AS kcatc, b0_sco + b_sco + mean_sco AS sco "
            "FROM e JOIN p ON e.iter = p.iter CROSS JOIN m")


@query("generated_quantities", "iter spp gsmax_wd:d gsmax_ww:d kcatc:d sco:d", _gq_sql())
def generated_quantities(spark: SparkSession, d: str) -> DataFrame:
    """K9 + D8: per draw and species, gsmax of both treatments from
    population, species and treatment parameters of density and pore length,
    and kcatc and sco with the data's mean added."""
    means = V.table(spark, d, "part").agg(F.avg("p_size").alias("mean_kcatc"), F.avg("p_retailprice").alias("mean_sco"))
    return PD.generated_quantities(_gq_draws(spark, d), means)


# ------------------------------------------------------------ validity checks

@query("draw_checks",
       "par n_draws n_chains min_chain_n max_chain_n n_out_of_bounds n_null n_clipped equal_chains",
       W("DR") + ", t AS (SELECT * FROM dr WHERE iter > 100 AND iter % 2 = 0), "
       "pc AS (SELECT par, chain, count(*) AS c, "
       "sum(CASE WHEN value < -30 OR value > 470 THEN 1 ELSE 0 END) AS bad, "
       "sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS nul, "
       "sum(CASE WHEN NOT (value BETWEEN -25 AND 300) THEN 1 ELSE 0 END) AS clip FROM t GROUP BY par, chain) "
       "SELECT par, CAST(sum(c) AS BIGINT) AS n_draws, count(*) AS n_chains, CAST(min(c) AS BIGINT) AS min_chain_n, "
       "CAST(max(c) AS BIGINT) AS max_chain_n, CAST(sum(bad) AS BIGINT) AS n_out_of_bounds, "
       "CAST(sum(nul) AS BIGINT) AS n_null, CAST(sum(clip) AS BIGINT) AS n_clipped, min(c) = max(c) AS equal_chains "
       "FROM pc GROUP BY par")
def draw_checks(spark: SparkSession, d: str) -> DataFrame:
    """K18 + K17 + B16: thin (warm-up 100, every 2nd draw), then counts per
    chain, bound violations and values outside the axis clip."""
    t = D.thin(V.draws_events(spark, d), warmup=100, every=2)
    return D.check_draws(t, ["par"], "value", lower=-30, upper=470, clip=(-25, 300))


# ------------------------------------------------------------ NULL keys

@query("null_group_statistics", "par estimate:d std_error:d conf_low:d conf_high:d p:d hpd_lower:d hpd_upper:d",
       "WITH t AS (SELECT coalesce(nullif(l_returnflag, 'A'), '') AS par, l_quantity - 25 AS value, "
       "l_orderkey * 10 + l_linenumber AS iter FROM lineitem), " + G.hpd_cte("t", ["par"], "value", "iter") + " "
       "SELECT nullif(t.par, '') AS par, median(value) AS estimate, stddev_samp(value) AS std_error, "
       "quantile_cont(value, 0.025) AS conf_low, quantile_cont(value, 0.975) AS conf_high, "
       + G.tail_p_expr("value") + " AS p, min(hpd.lower) AS hpd_lower, min(hpd.upper) AS hpd_upper "
       "FROM t JOIN hpd ON hpd.par = t.par GROUP BY t.par")
def null_group_statistics(spark: SparkSession, d: str) -> DataFrame:
    """D9-D12, E3 where a key is NULL and values are heavily tied: quantities
    (fifty values) by return flag, one flag made NULL."""
    t = V.table(spark, d, "lineitem").select(
        F.expr("nullif(l_returnflag, 'A')").alias("par"), (F.col("l_quantity") - 25).alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("iter"))
    hpd = D.hpd_interval(t, ["par"]).withColumnsRenamed({"lower": "hpd_lower", "upper": "hpd_upper"})
    return join_groups(D.summarise_draws(t, ["par"], estimate="median", term=None), hpd, ["par"])


@query("null_key_join", "size n_parts price:d n_items mean_price:d side",
       "WITH a AS (SELECT CASE WHEN p_size % 5 > 0 THEN p_size END AS size, count(*) AS n_parts, "
       "avg(p_retailprice) AS price FROM part GROUP BY ALL), "
       "b AS (SELECT CASE WHEN CAST(l_quantity AS INTEGER) % 7 > 0 THEN CAST(l_quantity AS INTEGER) END AS size, "
       "count(*) AS n_items, avg(l_extendedprice) AS mean_price FROM lineitem GROUP BY ALL) "
       "SELECT coalesce(a.size, b.size) AS size, n_parts, price, n_items, mean_price, CASE WHEN n_parts IS NULL THEN 'right_only' "
       "WHEN n_items IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.size IS NOT DISTINCT FROM b.size")
def null_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Full join of two keyed tables, NULL meeting NULL, keys missing on
    either side (sizes of parts, quantities of line items)."""
    size, qty = F.col("p_size"), F.col("l_quantity").cast("int")
    a = (V.table(spark, d, "part").groupBy(F.when(size % 5 > 0, size).alias("size"))
         .agg(F.count(F.lit(1)).alias("n_parts"), F.avg("p_retailprice").alias("price")))
    b = (V.table(spark, d, "lineitem").groupBy(F.when(qty % 7 > 0, qty).alias("size"))
         .agg(F.count(F.lit(1)).alias("n_items"), F.avg("l_extendedprice").alias("mean_price")))
    return TR.join_plants(a, b, ["size"], "full", null_safe=True, indicator="side")
