"""Registered queries: design columns, re-aimed fits, prediction and
model comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.biophysics import gsmax_sql
from ..functions.numeric import safe_ln, safe_ln_sql
from ..operators import compare as CM
from ..operators import draws as D
from ..operators import factors as FA
from ..operators import fit as FT
from ..operators import perdraw as PD
from ..operators import traits as TR
from ..operators.ranking import group_quantiles, join_groups
from ..session import cut_lineage
from . import sqlgen as G
from . import views as V
from .registry import query

W = V.with_views

LEVELS = ("F", "O", "P")  # reference level first
TREATED = "P"


def _plants_leaf(spark: SparkSession, d: str) -> DataFrame:
    """Collapsed plants with gsmax, joined to the leaf table (inner)."""
    return TR.add_gsmax(V.pair_collapse_p(spark, d)).join(V.leaf(spark, d), "k")


_PL_SQL = (W("C", "G") + ", pl AS (SELECT c.k, c.sd, c.sp, "
           f"{gsmax_sql('c.sd', 'c.sp')} AS gsmax, g.spp, g.treatment, g.gs FROM c JOIN g ON c.k = g.k), ")

_DESIGN_COLS = ["log_gs", "gsmax", "treated", "treatment_O", "treatment_P",
                "gsmax_x_treatment_O", "gsmax_x_treatment_P"]


def _design(spark: SparkSession, d: str) -> DataFrame:
    pl = _plants_leaf(spark, d).withColumn("log_gs", safe_ln("gs"))
    pl = pl.withColumn("treated", FA.indicator("treatment", TREATED, "treated"))
    des = FA.design_columns(pl, "treatment", LEVELS, interactions=["gsmax"])
    return FA.complete_cases(des, _DESIGN_COLS)


_DESIGN_SQL = _PL_SQL + (
    f"des AS (SELECT k, spp, treatment, {safe_ln_sql('gs')} AS log_gs, gsmax, "
    "CAST(treatment = 'P' AS DOUBLE) AS treated, "
    "CASE WHEN treatment IN ('F', 'O', 'P') THEN CAST(treatment = 'O' AS DOUBLE) END AS treatment_O, "
    "CASE WHEN treatment IN ('F', 'O', 'P') THEN CAST(treatment = 'P' AS DOUBLE) END AS treatment_P FROM pl), "
    "dz AS (SELECT des.*, gsmax * treatment_O AS gsmax_x_treatment_O, gsmax * treatment_P AS gsmax_x_treatment_P "
    "FROM des WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in
                                     ["log_gs", "gsmax", "treated", "treatment_O", "treatment_P"]) + ") ")


@query("design_columns", "k spp treatment " + " ".join(f"{c}:d" for c in _DESIGN_COLS),
       _DESIGN_SQL + "SELECT * FROM dz")
def design_columns(spark: SparkSession, d: str) -> DataFrame:
    """K1 + K2 + B14: log response, treatment dummies with F as reference,
    products with gsmax, listwise deletion on the model columns."""
    return _design(spark, d)


_GRAM_VARS = ["_one", "gsmax", "treated", "log_gs"]
_GRAM_COLS = []
for _i, _a in enumerate(_GRAM_VARS):
    for _b in _GRAM_VARS[_i:]:
        if _a == "_one":
            if _b != "_one":
                _GRAM_COLS.append((f"s_{_b}", _b))
        else:
            _GRAM_COLS.append((f"s_{_a}_{_b}", f"{_a} * {_b}"))


@query("gram_by_group", "spp n " + " ".join(f"{n}:d" for n, _ in _GRAM_COLS),
       _DESIGN_SQL + "SELECT spp, count(*) AS n, " + ", ".join(f"sum({e}) AS {n}" for n, e in _GRAM_COLS)
       + " FROM dz GROUP BY spp")
def gram_by_group(spark: SparkSession, d: str) -> DataFrame:
    """K3: per-species sums of products of (1, gsmax, treated, log gs)."""
    return FT.gram(_design(spark, d), ["spp"], ["gsmax", "treated"], "log_gs")


@query("within_group_regression", "b_treated:d b_gsmax:d n groups",
       _DESIGN_SQL + ", mg AS (SELECT spp, avg(log_gs) AS my, avg(treated) AS ma, avg(gsmax) AS mb FROM dz GROUP BY spp), "
       "dm AS (SELECT dz.log_gs - mg.my AS y, dz.treated - mg.ma AS a, dz.gsmax - mg.mb AS b FROM dz JOIN mg ON dz.spp = mg.spp), "
       "s AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay, sum(b * y) AS by_, "
       "count(*) AS n FROM dm) "
       "SELECT (bb * ay - ab * by_) / nullif(aa * bb - ab * ab, 0) AS b_treated, "
       "(aa * by_ - ab * ay) / nullif(aa * bb - ab * ab, 0) AS b_gsmax, n, (SELECT count(*) FROM mg) AS groups FROM s")
def within_group_regression(spark: SparkSession, d: str) -> DataFrame:
    """K4: log gs ~ treated + gsmax with species intercepts (within
    estimator), solved in closed form."""
    return FT.within_regression(_design(spark, d), ["spp"], "log_gs", "treated", "gsmax")


def _det(m) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cramer_sql() -> str:
    """Three within-group coefficients by Cramer's rule on demeaned sums."""
    xs = ["treated", "gsmax", "both"]
    means = ", ".join(f"avg({c}) AS m_{c}" for c in [*xs, "log_gs"])
    dev = ", ".join(f"d3.{c} - mg.m_{c} AS {c}" for c in [*xs, "log_gs"])
    a = [[f"sum({u} * {v})" for v in xs] for u in xs]
    r = [f"sum({u} * log_gs)" for u in xs]
    sums = ", ".join(f"{a[i][j]} AS a{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"{r[i]} AS r{i}" for i in range(3))
    m = [[f"a{i}{j}" for j in range(3)] for i in range(3)]
    sol = ", ".join(f"{_det([[f'r{i}' if j == k else m[i][j] for j in range(3)] for i in range(3)])} / nullif({_det(m)}, 0) AS b_{x}"
                    for k, x in enumerate(xs))
    return (_DESIGN_SQL + ", d3 AS (SELECT spp, log_gs, treated, gsmax / 1000 AS gsmax, treated * gsmax / 1000 AS \"both\" FROM dz), "
            f"mg AS (SELECT spp, {means} FROM d3 GROUP BY spp), dm AS (SELECT {dev} FROM d3 JOIN mg ON d3.spp = mg.spp), "
            f"s AS (SELECT {sums}, count(*) AS n FROM dm) SELECT {sol}, n, (SELECT count(*) FROM mg) AS groups FROM s"
            ).replace("both", "treated_gsmax")


@query("interaction_regression", "b_treated:d b_gsmax:d b_treated_gsmax:d n groups", _cramer_sql())
def interaction_regression(spark: SparkSession, d: str) -> DataFrame:
    """K4 with three predictors: log gs ~ treated * gsmax (in thousands) with
    species intercepts."""
    des = _design(spark, d).withColumn("gsmax", F.col("gsmax") / 1000)
    des = des.withColumn("treated_gsmax", F.col("treated") * F.col("gsmax"))
    return FT.within_regression(des, ["spp"], "log_gs", "treated", "gsmax", "treated_gsmax")


def _pool_sql(src: str, grp: str, y: str, source: str) -> str:
    """K5 in SQL: per-group moments, totals, between-group sum of squares,
    then the floored tau^2 and the shrunk means."""
    p = f"pp_{source}"
    return (f"{p}_g AS (SELECT {grp} AS grp, count(*) AS n, avg({y}) AS mean, "
            f"coalesce(var_samp({y}) * (count(*) - 1), 0) AS ss FROM {src} WHERE {y} IS NOT NULL GROUP BY {grp}), "
            f"{p}_t AS (SELECT CAST(sum(n) AS DOUBLE) AS nn, CAST(count(*) AS DOUBLE) AS kk, "
            f"sum(ss) / nullif(sum(n) - count(*), 0) AS s2, sum(n * mean) / sum(n) AS gm, sum(n * n) AS n2 FROM {p}_g), "
            f"{p}_b AS (SELECT sum(g.n * (g.mean - t.gm) * (g.mean - t.gm)) AS ssb FROM {p}_g g CROSS JOIN {p}_t t), "
            f"{p} AS (SELECT '{source}' AS source, CAST(g.grp AS STRING) AS grp, g.n, g.mean, t.gm, t.s2, "
            f"greatest((b.ssb / nullif(t.kk - 1, 0) - t.s2) * (t.kk - 1) / nullif(t.nn - t.n2 / t.nn, 0), 0) AS tau2 "
            f"FROM {p}_g g CROSS JOIN {p}_t t CROSS JOIN {p}_b b)")


def _pool_select(name: str) -> str:
    return (f"SELECT source, grp, n, mean, gm + coalesce(tau2 / nullif(tau2 + s2 / n, 0), 0) * (mean - gm) AS shrunk, "
            f"tau2, s2 FROM {name}")


@query("partial_pooling_means", "source grp n mean:d shrunk:d tau2:d s2:d",
       "WITH " + _pool_sql("supplier", "s_nationkey", "s_acctbal", "supplier") + ", "
       + _pool_sql("part", "p_brand", "p_retailprice", "part") + " "
       + _pool_select("pp_supplier") + " UNION ALL " + _pool_select("pp_part"))
def partial_pooling_means(spark: SparkSession, d: str) -> DataFrame:
    """K5: group means shrunk toward the grand mean (ANOVA moments):
    supplier balances by nation, part prices by brand (the second hits the
    between-group variance floor at 0)."""
    s = FT.pool_means(V.table(spark, d, "supplier"), "s_nationkey", "s_acctbal")
    p = FT.pool_means(V.table(spark, d, "part"), "p_brand", "p_retailprice")
    return s.withColumn("source", F.lit("supplier")).unionByName(p.withColumn("source", F.lit("part")))


@query("partial_pooling_effects", "grp n1 n0 d:d v:d shrunk:d tau2:d",
       W("G") + ", e AS (SELECT spp AS grp, count(gs) FILTER (WHERE treatment = 'P') AS n1, "
       "count(gs) FILTER (WHERE treatment = 'F') AS n0, "
       "avg(gs) FILTER (WHERE treatment = 'P') - avg(gs) FILTER (WHERE treatment = 'F') AS d, "
       "var_samp(gs) FILTER (WHERE treatment = 'P') / count(gs) FILTER (WHERE treatment = 'P') + "
       "var_samp(gs) FILTER (WHERE treatment = 'F') / count(gs) FILTER (WHERE treatment = 'F') AS v "
       "FROM g GROUP BY spp), t AS (SELECT avg(d) AS md, greatest(var_samp(d) - avg(v), 0) AS tau2 FROM e) "
       "SELECT grp, n1, n0, d, v, md + coalesce(tau2 / nullif(tau2 + v, 0), 0) * (d - md) AS shrunk, tau2 "
       "FROM e CROSS JOIN t")
def partial_pooling_effects(spark: SparkSession, d: str) -> DataFrame:
    """K6: per-priority treatment effect (P vs F) on order price, shrunk
    toward the mean effect."""
    return FT.pool_effects(V.leaf(spark, d), "spp", "gs", "treatment", TREATED, "F")


def _corr(x: str, y: str) -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


@query("among_within_correlation", "r_among:d groups r_within:d n",
       _PL_SQL + "d0 AS (SELECT * FROM pl WHERE gsmax IS NOT NULL AND gs IS NOT NULL), "
       "m AS (SELECT spp, avg(gsmax) AS mx, avg(gs) AS my FROM d0 GROUP BY spp), "
       f"a AS (SELECT {_corr('mx', 'my')} AS r_among, count(*) AS groups FROM m), "
       "r AS (SELECT d0.gsmax - m.mx AS rx, d0.gs - m.my AS ry FROM d0 JOIN m ON d0.spp = m.spp), "
       f"w AS (SELECT {_corr('rx', 'ry')} AS r_within, count(*) AS n FROM r) "
       "SELECT r_among, groups, r_within, n FROM a CROSS JOIN w")
def among_within_correlation(spark: SparkSession, d: str) -> DataFrame:
    """K7: among-species (group means) and within-species (residual)
    correlation of gsmax and gs."""
    return FT.among_within_correlation(_plants_leaf(spark, d), "spp", "gsmax", "gs")


_U = "CAST(('0x' || substr(md5(CAST(k AS STRING) || '_' || CAST(iter AS STRING)), 1, 8)) AS BIGINT) / 4294967296.0"


def _boot_sql() -> str:
    w = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in FT.POISSON1_CDF)
    return (_PL_SQL + "src AS (SELECT k, gs, gsmax FROM pl WHERE gs IS NOT NULL AND gsmax IS NOT NULL), "
            "ctr AS (SELECT avg(gsmax) AS cx, avg(gs) AS cy FROM src), "
            f"r AS (SELECT k, gs, gsmax - cx AS xs, gs - cy AS ys, CAST(t.range AS INTEGER) AS iter "
            f"FROM src CROSS JOIN ctr CROSS JOIN range(1, 101) t), "
            f"u AS (SELECT iter, gs, xs, ys, {_U} AS u FROM r), "
            f"wt AS (SELECT iter, gs, xs, ys, {w} AS w FROM u), "
            "s AS (SELECT iter, sum(w) AS sw, sum(w * gs) AS swy, sum(w * xs) AS swx, "
            "sum(w * xs * xs) AS swxx, sum(w * xs * ys) AS swxy, sum(w * ys) AS swys FROM wt GROUP BY iter) "
            "SELECT iter, CAST(sw AS BIGINT) AS n_w, swy / nullif(sw, 0) AS mean_gs, "
            "(sw * swxy - swx * swys) / nullif(sw * swxx - swx * swx, 0) AS b_gsmax FROM s")


@query("bootstrap_draws", "iter n_w mean_gs:d b_gsmax:d", _boot_sql())
def bootstrap_draws(spark: SparkSession, d: str) -> DataFrame:
    """K8: 100 Poisson-bootstrap draws (md5-seeded weights) of the mean of
    gs and of the slope of gs on gsmax."""
    return FT.bootstrap_draws(_plants_leaf(spark, d), "k", "gs", "gsmax", replicates=100)


def _boot_species_sql() -> str:
    w = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in FT.POISSON1_CDF)
    return (_PL_SQL + "src AS (SELECT k, spp, gs FROM pl WHERE gs IS NOT NULL), "
            "r AS (SELECT k, spp, gs, CAST(t.range AS INTEGER) AS iter FROM src CROSS JOIN range(1, 61) t), "
            f"u AS (SELECT spp, iter, gs, {_U} AS u FROM r), wt AS (SELECT spp, iter, gs, {w} AS w FROM u), "
            "b AS (SELECT 'mean_gs[' || spp || ']' AS par, iter, sum(w * gs) / nullif(sum(w), 0) AS value "
            "FROM wt GROUP BY spp, iter), " + G.hpd_cte("b", ["par"], "value", "iter") + " "
            "SELECT b.par AS term, avg(b.value) AS estimate, stddev_samp(b.value) AS std_error, min(hpd.lower) AS conf_low, "
            "min(hpd.upper) AS conf_high FROM b JOIN hpd ON b.par = hpd.par GROUP BY b.par")


@query("bootstrap_species", "term estimate:d std_error:d conf_low:d conf_high:d", _boot_species_sql())
def bootstrap_species(spark: SparkSession, d: str) -> DataFrame:
    """K8 + D17 + D12: 60 bootstrap replicates of each species' mean gs, as
    long draws (model, chain, iter, par, value), summarised by mean, standard
    error and shortest interval."""
    boot = FT.bootstrap_draws(_plants_leaf(spark, d), "k", "gs", replicates=60, by=["spp"])
    draws = cut_lineage(FT.as_draws(boot, "boot", {"mean_gs": "mean_gs"}, by=["spp"]), "boot-draws")
    return D.summarise_draws(draws, ["par"], estimate="mean", interval="hpd", p=False)


# ------------------------------------------------------------ prediction and comparison

RESPONSES, TREATMENTS = ("kcatc", "sco"), ("wd", "ww")
MODELS = ("line", "mean", "origin")
MODEL = ["model", "response", "treatment"]


def _species(spark: SparkSession, d: str) -> DataFrame:
    """One row per species: mean x under each treatment, mean responses."""
    li, st = V.table(spark, d, "lineitem"), F.col("l_linestatus")
    return (li.groupBy(F.col("l_linenumber").alias("spp"))
            .agg(F.avg(F.when(st == "O", F.col("l_quantity"))).alias("gsmax_ww"),
                 F.avg(F.when(st == "F", F.col("l_quantity"))).alias("gsmax_wd"),
                 (F.avg("l_extendedprice") / 1000).alias("kcatc"), (F.avg("l_discount") * 100).alias("sco")))


_SPECIES_SQL = ("o0 AS (SELECT l_linenumber AS spp, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS gsmax_ww, "
                "avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS gsmax_wd, avg(l_extendedprice) / 1000 AS kcatc, "
                "avg(l_discount) * 100 AS sco FROM lineitem GROUP BY l_linenumber)")


def _obs(spark: SparkSession, d: str, models: bool = False) -> DataFrame:
    """Observations: one row per species, response and treatment (and model)."""
    items = [F.struct(F.lit(r).alias("response"), F.lit(t).alias("treatment"), F.col(f"gsmax_{t}").alias("x"),
                      F.col(r).alias("y")) for r, t in V.PAIRS]
    o = _species(spark, d).select("spp", F.explode(F.array(*items)).alias("_p")).select("spp", "_p.*")
    o = o.where("x IS NOT NULL AND y IS NOT NULL")
    return PD.crossing(o, "model", list(MODELS)) if models else o


_OBS_SQL = _SPECIES_SQL + ", o AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT spp, '{r}' AS response, '{t}' AS treatment, gsmax_{t} AS x, {r} AS y FROM o0" for r, t in V.PAIRS
) + ") o1 WHERE x IS NOT NULL AND y IS NOT NULL)"
_DD_SQL = "dd AS (SELECT * FROM pm WHERE b0 IS NOT NULL AND b1 IS NOT NULL AND sigma > 0)"
_HALF_LOG_2PI = f"CAST({0.5 * math.log(2 * math.pi)!r} AS DOUBLE)"


def _negll_sql(b0: str, b1: str, sigma: str) -> str:
    z = f"((y - {b0} - {b1} * x) / {sigma})"
    return f"({_HALF_LOG_2PI} + ln({sigma}) + 0.5 * {z} * {z})"


_NEG = CM.neg_loglik


def _model_draws(spark: SparkSession, d: str) -> DataFrame:
    """Draws of three models of each response and treatment: a line, a mean
    without slope, a slope through the origin."""
    dsl = V.draws_species_long(V.stored_species(spark, d))
    line = CM.usable_draws(PD.per_draw_regression(dsl, ["iter", "response", "treatment"], "y", "x"))
    n, xx, xy, yy = F.count(F.lit(1)), F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("y")), F.sum(F.col("y") * F.col("y"))
    g = (dsl.where("x IS NOT NULL AND y IS NOT NULL").groupBy("iter", "response", "treatment")
         .agg(F.avg("y").alias("my"), F.stddev_samp("y").alias("sy"), (xy / F.nullif(xx, F.lit(0.0))).alias("slope"),
              F.sqrt(F.greatest(yy - xy * xy / F.nullif(xx, F.lit(0.0)), F.lit(0.0))
                     / F.nullif(n - 1, F.lit(0))).alias("so")))
    zero = F.lit(0.0)
    items = [F.struct(F.lit(m).alias("model"), b0.alias("b0"), b1.alias("b1"), sg.alias("sigma")) for m, b0, b1, sg in
             (("mean", F.col("my"), zero, F.col("sy")), ("origin", zero, F.col("slope"), F.col("so")))]
    other = g.select("iter", "response", "treatment", F.explode(F.array(*items)).alias("_p")).select(
        "iter", "response", "treatment", "_p.*")
    return line.select("iter", "response", "treatment", F.lit("line").alias("model"), "b0", "b1", "sigma").unionByName(
        CM.usable_draws(other))


_MD_SQL = (_DD_SQL + ", q AS (SELECT iter, response, treatment, avg(y) AS my, stddev_samp(y) AS sy, "
           "sum(x * y) / nullif(sum(x * x), 0) AS slope, "
           "sqrt(greatest(sum(y * y) - sum(x * y) * sum(x * y) / nullif(sum(x * x), 0), 0) / nullif(count(*) - 1, 0)) AS so "
           "FROM dsl WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY iter, response, treatment), "
           "md AS (SELECT iter, response, treatment, 'line' AS model, b0, b1, sigma FROM dd "
           "UNION ALL SELECT iter, response, treatment, 'mean' AS model, my, CAST(0 AS DOUBLE), sy FROM q WHERE my IS NOT NULL AND sy > 0 "
           "UNION ALL SELECT iter, response, treatment, 'origin' AS model, CAST(0 AS DOUBLE), slope, so FROM q "
           "WHERE slope IS NOT NULL AND so > 0), "
           "nl AS (SELECT md.model, o.response, o.treatment, o.spp, md.iter, "
           + _negll_sql("md.b0", "md.b1", "md.sigma") + " AS nl "
           "FROM o JOIN md ON md.response = o.response AND md.treatment = o.treatment)")


def _new_rows(spark: SparkSession, d: str) -> DataFrame:
    """New rows to predict: every (species, response, treatment) at the
    species' mean gsmax over draws."""
    xs = (V.stored_species(spark, d).groupBy("spp")
          .agg(F.avg("gsmax_ww").alias("ww"), F.avg("gsmax_wd").alias("wd")))
    nd = PD.crossing(PD.crossing(xs, "treatment", list(TREATMENTS)), "response", list(RESPONSES))
    return nd.select("spp", "response", "treatment",
                     F.when(F.col("treatment") == "ww", F.col("ww")).otherwise(F.col("wd")).alias("x"))


_ND_SQL = ("sm AS (SELECT spp, avg(gsmax_ww) AS ww, avg(gsmax_wd) AS wd FROM ds GROUP BY spp), "
           "nd AS (SELECT sm.spp, r.response, t.treatment, CASE WHEN t.treatment = 'ww' THEN sm.ww ELSE sm.wd END AS x "
           "FROM sm CROSS JOIN (VALUES ('wd'), ('ww')) t(treatment) CROSS JOIN (VALUES ('kcatc'), ('sco')) r(response))")


@query("predict_new_rows", "spp response treatment x:d pred_mean:d pred_sd:d",
       W("DS", "PM") + ", m AS (SELECT response, treatment, avg(b0) AS e0, avg(b1) AS e1, var_samp(b0) AS v0, "
       "var_samp(b1) AS v1, covar_samp(b0, b1) AS c01, avg(sigma * sigma) AS es2 FROM pm "
       "WHERE b0 IS NOT NULL AND b1 IS NOT NULL GROUP BY response, treatment), " + _ND_SQL +
       " SELECT nd.spp, nd.response, nd.treatment, nd.x, e0 + e1 * x AS pred_mean, "
       "sqrt(v0 + x * x * v1 + 2 * x * c01 + es2) AS pred_sd FROM nd JOIN m "
       "ON nd.treatment = m.treatment AND nd.response = m.response")
def predict_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """K11 + C7: predictive mean and sd of each response for every (species,
    treatment) at the species' mean gsmax, from draw moments."""
    keys = ("response", "treatment")
    return CM.predict(_new_rows(spark, d), "x", CM.draw_moments(V.regression_draws(spark, d), keys=keys), keys=keys)


_HASH = "md5(nd.spp || '_' || nd.response || '_' || nd.treatment || '_' || dd.iter)"


@query("predict_intervals", "spp response treatment pred_lower:d pred_upper:d",
       W("DS", "PM") + f", {_DD_SQL}, {_ND_SQL}, "
       f"u AS (SELECT nd.spp, nd.response, nd.treatment, dd.b0 + dd.b1 * nd.x AS mu, dd.sigma, "
       f"CAST('0x' || substr({_HASH}, 1, 8) AS BIGINT) AS u1, CAST('0x' || substr({_HASH}, 9, 8) AS BIGINT) AS u2 "
       "FROM nd JOIN dd ON nd.response = dd.response AND nd.treatment = dd.treatment), "
       "v AS (SELECT spp, response, treatment, mu + sigma * sqrt(-2 * ln((u1 + 1) / CAST(4294967296 AS DOUBLE))) "
       "* cos(2 * pi() * (u2 / CAST(4294967296 AS DOUBLE))) AS v FROM u) "
       "SELECT spp, response, treatment, quantile_cont(v, 0.025) AS pred_lower, quantile_cont(v, 0.975) AS pred_upper "
       "FROM v GROUP BY spp, response, treatment")
def predict_intervals(spark: SparkSession, d: str) -> DataFrame:
    """K11 quantiles: 95 % predictive interval of each response for every
    (species, treatment) at the species' mean gsmax, one prediction with
    hash-seeded noise per draw."""
    return CM.predict_quantiles(_new_rows(spark, d), "x", CM.usable_draws(V.regression_draws(spark, d)), ("spp",),
                                keys=("response", "treatment"))


@query("pointwise_loglik", "response treatment spp iter loglik:d",
       W("PM") + f", {_OBS_SQL}, {_DD_SQL} SELECT o.response, o.treatment, o.spp, dd.iter, "
       f"-{_negll_sql('b0', 'b1', 'sigma')} AS loglik "
       "FROM o JOIN dd ON o.response = dd.response AND o.treatment = dd.treatment")
def pointwise_loglik(spark: SparkSession, d: str) -> DataFrame:
    """Normal log-likelihood of each species observation under each draw
    of its regression (both responses and treatments)."""
    return CM.pointwise_loglik(_obs(spark, d), CM.usable_draws(V.regression_draws(spark, d)), _NEG(F.col("x"), F.col("y")),
                               ["spp"], ["response", "treatment"])


@query("bivariate_loglik", "spp iter loglik:d",
       W("DS") + f", {_SPECIES_SQL}, b AS (SELECT iter, avg(kcatc) AS m1, avg(sco) AS m2, stddev_samp(kcatc) AS s1, "
       f"stddev_samp(sco) AS s2, {_corr('kcatc', 'sco')} AS rho FROM ds WHERE kcatc IS NOT NULL AND sco IS NOT NULL GROUP BY iter), "
       "z AS (SELECT o0.spp, b.iter, b.s1, b.s2, b.rho, (o0.kcatc - m1) / s1 AS z1, (o0.sco - m2) / s2 AS z2 FROM o0 CROSS JOIN b "
       "WHERE rho * rho < 1 - 1e-9 AND o0.kcatc IS NOT NULL AND o0.sco IS NOT NULL) "
       f"SELECT spp, iter, -(2 * {_HALF_LOG_2PI} + ln(s1) + ln(s2) + 0.5 * ln(1 - rho * rho) "
       "+ (z1 * z1 - 2 * rho * z1 * z2 + z2 * z2) / (2 * (1 - rho * rho))) AS loglik FROM z")
def bivariate_loglik(spark: SparkSession, d: str) -> DataFrame:
    """K12, bivariate normal: log-likelihood of each species' (kcatc, sco)
    under each draw's means, sds and correlation."""
    both = V.stored_species(spark, d).dropna(subset=["kcatc", "sco"])
    draws = both.groupBy("iter").agg(
        F.avg("kcatc").alias("m1"), F.avg("sco").alias("m2"), F.stddev_samp("kcatc").alias("s1"),
        F.stddev_samp("sco").alias("s2"), PD.guarded_corr(F.col("kcatc"), F.col("sco")).alias("rho"))
    draws = draws.where(F.col("rho") * F.col("rho") < 1 - 1e-9)
    obs = _species(spark, d).dropna(subset=["kcatc", "sco"])
    return CM.pointwise_loglik(obs, draws, CM.neg_loglik_pair(F.col("kcatc"), F.col("sco")), ["spp"])


@query("loo_compare", "response treatment model elpd_loo:d se:d n elpd_diff:d se_diff:d",
       W("DS", "PM") + f", {_OBS_SQL}, {_MD_SQL}, "
       "e AS (SELECT model, response, treatment, spp, -(max(mx) + ln(avg(exp(nl - mx)))) AS elpd FROM (SELECT nl.*, "
       "max(nl) OVER (PARTITION BY model, response, treatment, spp) AS mx FROM nl) z GROUP BY model, response, treatment, spp), "
       "t AS (SELECT model, response, treatment, sum(elpd) AS elpd_loo, sqrt(CAST(count(*) AS DOUBLE)) * stddev_samp(elpd) AS se, "
       "count(*) AS n FROM e GROUP BY model, response, treatment), "
       "b AS (SELECT response, treatment, model AS best FROM (SELECT t.*, row_number() OVER (PARTITION BY response, treatment "
       "ORDER BY elpd_loo DESC, model) AS r FROM t) z WHERE r = 1), "
       "d AS (SELECT e.model, e.response, e.treatment, e.elpd - f.elpd AS diff FROM e JOIN b ON b.response = e.response "
       "AND b.treatment = e.treatment JOIN e f ON f.model = b.best AND f.response = e.response AND f.treatment = e.treatment "
       "AND f.spp = e.spp) "
       "SELECT t.response, t.treatment, t.model, t.elpd_loo, t.se, t.n, sum(d.diff) AS elpd_diff, "
       "sqrt(CAST(count(*) AS DOUBLE)) * stddev_samp(d.diff) AS se_diff FROM t JOIN d ON d.model = t.model "
       "AND d.response = t.response AND d.treatment = t.treatment GROUP BY ALL")
def loo_compare(spark: SparkSession, d: str) -> DataFrame:
    """Importance-sampling LOO of three models of each response and
    treatment: totals, standard errors, differences to the best model."""
    e = CM.elpd_loo(_obs(spark, d, True), _model_draws(spark, d), _NEG(F.col("x"), F.col("y")), ["spp"], MODEL)
    return CM.loo_compare(e, "model", ["spp"], ["response", "treatment"])


_G = "model, response, treatment, spp"


def _on(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in (*MODEL, "spp"))


_PSIS_SQL = (
    W("DS", "PM") + f", {_OBS_SQL}, {_MD_SQL}, "
    f"z AS (SELECT nl.*, max(nl) OVER (PARTITION BY {_G}) AS mx, CAST(count(*) OVER (PARTITION BY {_G}) AS DOUBLE) AS s, "
    f"row_number() OVER (PARTITION BY {_G} ORDER BY nl DESC) AS r FROM nl), "
    "w AS (SELECT z.*, nl - mx AS lw, ceil(least(s / 5, 3 * sqrt(s))) AS m FROM z), "
    f"mk AS (SELECT {_G}, max(exp(lw)) FILTER (WHERE r = m + 1) AS edge, max(exp(lw)) AS top, "
    "max(exp(lw)) FILTER (WHERE r = m - greatest(floor(m / 4 + 0.5), 1) + 1) AS low, "
    f"min(exp(lw)) FILTER (WHERE r <= m) AS mn FROM w GROUP BY {_G}), "
    "x AS (SELECT w.*, mk.edge, mk.top, mk.low, CASE WHEN r <= m AND m >= 5 AND mn > edge AND top > mn "
    f"THEN exp(lw) - edge END AS x FROM w JOIN mk ON {_on('w', 'mk')}), "
    "gr AS (SELECT x.*, j.j, 1 / (top - edge) + (1 - sqrt((30 + floor(sqrt(m))) / (j.j - 0.5::DOUBLE))) / 3 / (low - edge) AS theta "
    "FROM x JOIN range(1, 10000) j(j) ON j.j <= 30 + floor(sqrt(x.m)) WHERE x.x IS NOT NULL), "
    f"pf AS (SELECT {_G}, j, max(theta) AS theta, max(m) AS m, avg(ln(1 - theta * x)) AS k FROM gr GROUP BY {_G}, j), "
    "pr AS (SELECT pf.*, m * (ln(-theta / k) - k - 1) AS p FROM pf), "
    f"pw AS (SELECT pr.*, exp(p - max(p) OVER (PARTITION BY {_G})) AS wt FROM pr), "
    f"th AS (SELECT {_G}, sum(theta * wt) / sum(wt) AS t FROM pw GROUP BY {_G}), "
    f"sk AS (SELECT x.model, x.response, x.treatment, x.spp, avg(ln(1 - th.t * x.x)) AS k0, max(th.t) AS t, max(x.m) AS m "
    f"FROM x JOIN th ON {_on('x', 'th')} WHERE x.x IS NOT NULL GROUP BY x.model, x.response, x.treatment, x.spp), "
    "sh AS (SELECT sk.*, -k0 / t AS sg, (k0 * m + 5) / (m + 10) AS k FROM sk), "
    "sm AS (SELECT x.model, x.response, x.treatment, x.spp, x.mx, x.lw, sh.k, CASE WHEN x.x IS NOT NULL AND sh.sg > 0 THEN least(ln(edge + sh.sg "
    "* CASE WHEN abs(sh.k) < 1e-12 THEN -ln(1 - (x.m - r + 0.5) / x.m) "
    "ELSE (exp(-sh.k * ln(1 - (x.m - r + 0.5) / x.m)) - 1) / sh.k END), 0) ELSE x.lw END AS l2 "
    f"FROM x LEFT JOIN sh ON {_on('x', 'sh')}) "
    f"SELECT {_G}, ln(sum(exp(l2 - lw))) - ln(sum(exp(l2))) - max(mx) AS elpd, max(k) AS pareto_k FROM sm GROUP BY {_G}")


@query("loo_psis", "model response treatment spp elpd:d pareto_k:d", _PSIS_SQL)
def loo_psis(spark: SparkSession, d: str) -> DataFrame:
    """K13 (smoothed): Pareto-smoothed importance-sampling LOO per species
    observation of three models of each response and treatment, with the
    Pareto k diagnostics."""
    return CM.elpd_psis(_obs(spark, d, True), _model_draws(spark, d), _NEG(F.col("x"), F.col("y")), ["spp"], MODEL)


_R2_SQL = (W("PM") + f", {_OBS_SQL}, mo AS (SELECT response, treatment, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy "
           "FROM o GROUP BY response, treatment), "
           "r2 AS (SELECT pm.response, pm.treatment, iter, (b1 * b1 * vx) / nullif(b1 * b1 * vx + (vy + b1 * b1 * vx - 2 * b1 * cxy), 0) AS r2 "
           "FROM pm JOIN mo ON mo.response = pm.response AND mo.treatment = pm.treatment WHERE b1 IS NOT NULL) ")


@query("bayes_r2", "response treatment iter r2:d", _R2_SQL + "SELECT * FROM r2")
def bayes_r2(spark: SparkSession, d: str) -> DataFrame:
    """Bayesian R^2 of each regression draw over the species
    observations, from observation moments."""
    keys = ("response", "treatment")
    return CM.bayes_r2(V.regression_draws(spark, d), CM.obs_moments(_obs(spark, d), "x", "y", keys), keys=keys)


@query("bayes_r2_summary", "response treatment r2_mean:d r2_lower:d r2_median:d r2_upper:d",
       _R2_SQL + "SELECT response, treatment, avg(r2) AS r2_mean, quantile_cont(r2, 0.025) AS r2_lower, "
       "quantile_cont(r2, 0.5) AS r2_median, quantile_cont(r2, 0.975) AS r2_upper FROM r2 GROUP BY response, treatment")
def bayes_r2_summary(spark: SparkSession, d: str) -> DataFrame:
    """K16, summarised over draws: mean, median and 95 % interval."""
    keys = ["response", "treatment"]
    r2 = cut_lineage(bayes_r2(spark, d), "r2")
    q = group_quantiles(r2, keys, "r2", [0.025, 0.5, 0.975], ["r2_lower", "r2_median", "r2_upper"])
    return join_groups(r2.groupBy(*keys).agg(F.avg("r2").alias("r2_mean")), q, keys)
