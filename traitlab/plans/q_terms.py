"""Registered queries: models with several terms (K10-K13, K16), regression
per bootstrap replicate (K8), correlated group effects (K5, K6), and
densities and validity of any dimension (K12, K17).

Plots are lineitem rows per (supplier = draw, line number = species, line
status = treatment, F is drought): x = mean quantity, responses kcatc = mean
price in thousands and sco = mean discount in per cent.  Every draw's own
regressions of the responses are the models' draws; the observations are the
same means over all suppliers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.numeric import safe_ln, safe_ln_sql
from ..operators import compare as CM
from ..operators import design as DS
from ..operators import draws as D
from ..operators import fit as FT
from ..operators import perdraw as PD
from ..operators.ranking import group_quantiles, join_groups
from ..session import cut_lineage
from . import sqlgen as G
from . import views as V
from .q_models import _DESIGN_SQL, _PL_SQL, _design, _det, _plants_leaf
from .registry import query

RESPONSES = ("kcatc", "sco")
MODELS = ("additive", "interaction", "species")
HALF_LOG_2PI = f"CAST({0.5 * math.log(2 * math.pi)!r} AS DOUBLE)"
GRID = 50


def plots(spark: SparkSession, d: str, by: tuple[str, ...] = ("iter",)) -> DataFrame:
    """(iter, spp, drought, x, kcatc, sco), or without iter over all suppliers;
    one pass over lineitem, written."""
    li = V.table(spark, d, "lineitem").withColumn("drought", (F.col("l_linestatus") == "F").cast("double"))
    cols = {"iter": "l_suppkey", "spp": "l_linenumber"}
    return cut_lineage(li.groupBy(*[F.col(cols[c]).alias(c) for c in (*by, "spp")], "drought").agg(
        F.avg("l_quantity").alias("x"), (F.avg("l_extendedprice") / 1000).alias("kcatc"),
        (F.avg("l_discount") * 100).alias("sco")), "plots")


def by_response(p: DataFrame) -> DataFrame:
    keep = [c for c in p.columns if c not in RESPONSES]
    items = F.array(*[F.struct(F.lit(r).alias("response"), F.col(r).alias("y")) for r in RESPONSES])
    return p.select(*keep, F.explode(items).alias("_r")).select(*keep, "_r.*").withColumn("xd", F.col("x") * F.col("drought"))


def model_draws(spark: SparkSession, d: str) -> DataFrame:
    """(response, model, iter, term, value) of three models per response:
    1 + x + drought, the same with x:drought, and species intercepts + drought."""
    p = by_response(plots(spark, d))
    by = ["response", "iter"]
    parts = (FT.regression_draws(p, by, "y", ["x", "drought"]), FT.regression_draws(p, by, "y", ["x", "drought", "xd"]),
             FT.regression_draws(p, by, "y", ["drought"], group="spp", intercept="spp"))
    out = None
    for name, part in zip(MODELS, parts):
        part = part.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("response", "model", "iter", "term", "value")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return PD.crossing(by_response(plots(spark, d, ())), "model", list(MODELS))


OBS_IDS = ["response", "model", "spp", "drought"]
KEYS = ["response", "model"]


def model_design(obs: DataFrame) -> DataFrame:
    """The three models' sparse designs: a term that a model lacks is zero."""
    plain = F.col("model") != "species"
    return DS.long_design(obs, OBS_IDS, {
        "Intercept": F.when(plain, 1.0).otherwise(0.0), "x": F.when(plain, F.col("x")).otherwise(0.0),
        "drought": F.col("drought"), "xd": F.when(F.col("model") == "interaction", F.col("xd")).otherwise(0.0)}).unionByName(DS.long_design(obs.where(~plain), OBS_IDS, {}, [
            F.concat(F.lit("spp["), F.col("spp").cast("string"), F.lit("]"))]))


# ------------------------------------------------------------------ oracle text

def _plots_sql(iter_: bool) -> str:
    k = "l_suppkey AS iter, " if iter_ else ""
    return (f"SELECT {k}l_linenumber AS spp, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS drought, "
            "avg(l_quantity) AS x, avg(l_extendedprice) / 1000 AS kcatc, avg(l_discount) * 100 AS sco FROM lineitem GROUP BY ALL")


def _resp_sql(src: str, k: str) -> str:
    return " UNION ALL ".join(f"SELECT {k}spp, drought, x, x * drought AS xd, '{r}' AS response, {r} AS y FROM {src}" for r in RESPONSES)


def _solve_sql(name: str, src: str, by: str, xs: list, y: str, model: str) -> str:
    """Regression with an intercept by Cramer's rule on centred sums, at most
    three predictors: name(by, model, b0, b_<x>.., sigma)."""
    cols = [*xs, y]
    k = len(xs)
    sums = ", ".join(f"covar_pop({cols[i]}, {cols[j]}) * count(*) AS a{i}{j}, covar_pop({cols[i]}, {cols[j]}) * count(*) AS a{j}{i}"
                     if i != j else f"covar_pop({cols[i]}, {cols[i]}) * count(*) AS a{i}{i}" for i in range(k + 1) for j in range(i, k + 1))
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))
    m = [[f"a{i}{j}" for j in range(k)] for i in range(k)]

    def det(z):
        if k == 1:
            return z[0][0]
        return f"({z[0][0]} * {z[1][1]} - {z[0][1]} * {z[1][0]})" if k == 2 else _det(z)

    sol = ", ".join(f"{det([[f'a{i}{k}' if j == c else m[i][j] for j in range(k)] for i in range(k)])} / nullif({det(m)}, 0) AS b_{x}"
                    for c, x in enumerate(xs))
    b0 = f"m{k} - " + " - ".join(f"b_{x} * m{i}" for i, x in enumerate(xs))
    sse = f"a{k}{k} - " + " - ".join(f"b_{x} * a{i}{k}" for i, x in enumerate(xs))
    return (f"{name}_s AS (SELECT {by}, count(*) AS n, {means}, {sums} FROM {src} GROUP BY {by}), "
            f"{name}_c AS (SELECT *, {sol} FROM {name}_s), "
            f"{name} AS (SELECT {by}, '{model}' AS model, {b0} AS b0, {', '.join(f'b_{x}' for x in xs)}, "
            f"sqrt(greatest({sse}, 0) / (n - {k + 1})) AS sigma FROM {name}_c WHERE n > {k + 1} AND b_{xs[0]} IS NOT NULL)")


_MODELS_SQL = (
    f"p AS ({_plots_sql(True)}), o0 AS ({_plots_sql(False)}), pr AS ({_resp_sql('p', 'iter, ')}), o AS ({_resp_sql('o0', '')}), "
    + _solve_sql("ma", "pr", "response, iter", ["x", "drought"], "y", "additive") + ", "
    + _solve_sql("mi", "pr", "response, iter", ["x", "drought", "xd"], "y", "interaction") + ", "
    "g AS (SELECT response, iter, spp, avg(drought) AS md, avg(y) AS my FROM pr GROUP BY ALL), "
    "w AS (SELECT pr.response, pr.iter, pr.spp, drought - md AS dd, y - my AS dy FROM pr JOIN g USING (response, iter, spp)), "
    "ms AS (SELECT response, iter, 'species' AS model, sum(dd * dy) / nullif(sum(dd * dd), 0) AS b_drought, "
    "sqrt(greatest(sum(dy * dy) - sum(dd * dy) * sum(dd * dy) / nullif(sum(dd * dd), 0), 0) / (count(*) - count(DISTINCT spp) - 1)) AS sigma "
    "FROM w GROUP BY response, iter HAVING count(*) > count(DISTINCT spp) + 1 AND sum(dd * dd) > 0), "
    "sp AS (SELECT g.response, g.iter, g.spp, my - b_drought * md AS a FROM g JOIN ms USING (response, iter)), "
    # a draw counts for a model only with all of the model's coefficients
    "full_ AS (SELECT response, iter FROM sp GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT spp) FROM o)), "
    "mu AS (SELECT o.response, ma.model, o.spp, o.drought, ma.iter, o.y, b0 + b_x * o.x + b_drought * o.drought AS mu, sigma "
    "FROM o JOIN ma USING (response) UNION ALL "
    "SELECT o.response, mi.model, o.spp, o.drought, mi.iter, o.y, b0 + b_x * o.x + b_drought * o.drought + b_xd * o.xd AS mu, sigma "
    "FROM o JOIN mi USING (response) UNION ALL "
    "SELECT o.response, ms.model, o.spp, o.drought, ms.iter, o.y, sp.a + b_drought * o.drought AS mu, sigma "
    "FROM o JOIN ms USING (response) JOIN full_ USING (response, iter) JOIN sp USING (response, iter, spp))")


# ------------------------------------------------------------------ ribbons, prediction, comparison

_LOG_SQL = (f"WITH p AS ({_plots_sql(True)}), p2 AS (SELECT iter, drought, x, {safe_ln_sql('kcatc')} AS ly FROM p WHERE kcatc > 0), "
            + _solve_sql("m", "p2", "iter", ["x", "drought"], "ly", "log")
            + f", bd AS (SELECT min(x) AS lo, max(x) AS hi FROM ({_plots_sql(False)}) z), "
            "gr AS (SELECT CAST(i.range AS INTEGER) AS x_id, d.drought, "
            f"CASE WHEN i.range = {GRID - 1} THEN hi ELSE lo + i.range * ((hi - lo) / {GRID - 1}) END AS x "
            f"FROM bd CROSS JOIN range(0, {GRID}) i CROSS JOIN (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) d(drought)), "
            "mu AS (SELECT x_id, drought, x, iter, exp(b0 + b_x * x + b_drought * drought) AS mu FROM gr CROSS JOIN m), "
            + G.hpd_cte("mu", ["x_id", "drought"], "mu", "iter") + ", " + G.median_cte("mu", ["x_id", "drought"], "mu")
            + " SELECT gr.x_id, gr.drought, gr.x, med.point, hpd.lower, hpd.upper FROM gr "
            "JOIN med ON med.x_id = gr.x_id AND med.drought = gr.drought JOIN hpd ON hpd.x_id = gr.x_id AND hpd.drought = gr.drought")


@query("multi_term_ribbon", "x_id drought:d x:d point:d lower:d upper:d", _LOG_SQL)
def multi_term_ribbon(spark: SparkSession, d: str) -> DataFrame:
    """K10 with three terms: exp(Intercept + x * b_x + drought * b_drought) of
    every draw on a grid of x under both treatments, with median and
    shortest interval."""
    p = plots(spark, d).where("kcatc > 0").withColumn("ly", safe_ln("kcatc"))
    draws = FT.regression_draws(p, ["iter"], "ly", ["x", "drought"])
    bounds = PD.grid_bounds(plots(spark, d, ()), F.col("x"), F.col("x"))
    grid = PD.with_grid(spark.createDataFrame([(0.0,), (1.0,)], "drought double"), bounds, GRID)
    design = DS.long_design(grid, ["x_id", "drought"], {"Intercept": F.lit(1.0), "x": F.col("x"), "drought": F.col("drought")})
    out = DS.term_ribbon(design, draws, ["x_id", "drought"], link="exp")
    return out.join(grid, ["x_id", "drought"])


@query("multi_term_predict", "response model spp drought:d pred_mean:d pred_sd:d",
       f"WITH {_MODELS_SQL} SELECT response, model, spp, drought, avg(mu) AS pred_mean, "
       "sqrt(var_samp(mu) + avg(sigma * sigma)) AS pred_sd FROM mu GROUP BY ALL")
def multi_term_predict(spark: SparkSession, d: str) -> DataFrame:
    """K11 with several terms: predictive mean and sd of every (species,
    treatment) under three models per response, from coefficient covariances."""
    return DS.predict_terms(model_design(observations(spark, d)), model_draws(spark, d), OBS_IDS, KEYS)


_NEG_SQL = f"({HALF_LOG_2PI} + ln(sigma) + 0.5 * ((y - mu) / sigma) * ((y - mu) / sigma))"


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    obs = observations(spark, d)
    design = model_design(obs)
    codes = DS.term_codes(design, KEYS)
    x = join_groups(DS.design_vectors(design, codes, OBS_IDS, KEYS), obs.select(*OBS_IDS, "y"), OBS_IDS)
    b = DS.draw_vectors(model_draws(spark, d), codes, KEYS, extra=["sigma"]).where("sigma > 0")
    return x, b


@query("multi_term_loglik", "response model spp drought:d iter loglik:d",
       f"WITH {_MODELS_SQL} SELECT response, model, spp, drought, iter, -{_NEG_SQL} AS loglik FROM mu WHERE sigma > 0")
def multi_term_loglik(spark: SparkSession, d: str) -> DataFrame:
    """K12 with several terms: log-likelihood of every observation under every
    draw of three models per response."""
    x, b = _pairs(spark, d)
    neg = CM.neg_loglik_at(F.col("y"), DS.predictor(), F.col("sigma"))
    return CM.pointwise_loglik(x, b, neg, ["spp", "drought"], KEYS)


@query("multi_term_loo", "response model elpd_loo:d se:d n elpd_diff:d se_diff:d",
       f"WITH {_MODELS_SQL}, nl AS (SELECT response, model, spp, drought, {_NEG_SQL} AS nl FROM mu WHERE sigma > 0), "
       "e AS (SELECT response, model, spp, drought, -(max(mx) + ln(avg(exp(nl - mx)))) AS elpd FROM (SELECT nl.*, "
       "max(nl) OVER (PARTITION BY response, model, spp, drought) AS mx FROM nl) z GROUP BY ALL), "
       "t AS (SELECT response, model, sum(elpd) AS elpd_loo, sqrt(CAST(count(*) AS DOUBLE)) * stddev_samp(elpd) AS se, count(*) AS n "
       "FROM e GROUP BY ALL), "
       "b AS (SELECT response, model AS best FROM t QUALIFY row_number() OVER (PARTITION BY response ORDER BY elpd_loo DESC, model) = 1), "
       "dd AS (SELECT e.response, e.model, e.elpd - f.elpd AS diff FROM e JOIN b USING (response) JOIN e f ON f.response = e.response "
       "AND f.model = b.best AND f.spp = e.spp AND f.drought = e.drought) "
       "SELECT t.response, t.model, t.elpd_loo, t.se, t.n, sum(dd.diff) AS elpd_diff, "
       "sqrt(CAST(count(*) AS DOUBLE)) * stddev_samp(dd.diff) AS se_diff FROM t JOIN dd USING (response, model) GROUP BY ALL")
def multi_term_loo(spark: SparkSession, d: str) -> DataFrame:
    """K13 with several terms: leave-one-out comparison of an additive model,
    one with interaction and one with species intercepts, per response."""
    x, b = _pairs(spark, d)
    neg = CM.neg_loglik_at(F.col("y"), DS.predictor(), F.col("sigma"))
    e = CM.elpd_loo(x, b, neg, ["spp", "drought"], KEYS)
    return CM.loo_compare(e, "model", ["spp", "drought"], ["response"])


_R2_TERMS_SQL = (f"WITH {_MODELS_SQL}, r2 AS (SELECT response, model, iter, var_samp(mu) / nullif(var_samp(mu) + var_samp(y - mu), 0) AS r2 "
                 "FROM mu GROUP BY ALL) ")


@query("bayes_r2_terms", "response model iter r2:d", _R2_TERMS_SQL + "SELECT * FROM r2")
def bayes_r2_terms(spark: SparkSession, d: str) -> DataFrame:
    """K16 with several predictors, their product and species intercepts:
    Bayesian R^2 per draw from quadratic forms in the observations' covariance."""
    obs = observations(spark, d)
    return DS.bayes_r2_terms(model_design(obs), obs, model_draws(spark, d), OBS_IDS, "y", KEYS)


@query("bayes_r2_terms_summary", "response model r2_mean:d r2_lower:d r2_median:d r2_upper:d",
       _R2_TERMS_SQL + "SELECT response, model, avg(r2) AS r2_mean, quantile_cont(r2, 0.025) AS r2_lower, "
       "quantile_cont(r2, 0.5) AS r2_median, quantile_cont(r2, 0.975) AS r2_upper FROM r2 GROUP BY ALL")
def bayes_r2_terms_summary(spark: SparkSession, d: str) -> DataFrame:
    """K16 with several predictors, summarised over draws."""
    r2 = cut_lineage(bayes_r2_terms(spark, d), "r2")
    q = group_quantiles(r2, KEYS, "r2", [0.025, 0.5, 0.975], ["r2_lower", "r2_median", "r2_upper"])
    return join_groups(r2.groupBy(*KEYS).agg(F.avg("r2").alias("r2_mean")), q, KEYS)


# ------------------------------------------------------------------ bootstrap, correlated effects

REPLICATES = 60


def _boot_terms_sql() -> str:
    u = "CAST('0x' || substr(h, CAST(j.range AS BIGINT) * 8 + 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    w = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in FT.POISSON1_CDF)
    cols = ["treated", "gx", "log_gs"]
    n = len(cols)
    prods = ", ".join(f"sum(w * {cols[i]} * {cols[j]}) AS p{i}{j}" for i in range(n) for j in range(i, n))
    ones = ", ".join(f"sum(w * {c}) AS t{i}" for i, c in enumerate(cols))
    within = ", ".join(f"sum(p{i}{j} - t{i} * t{j} / sw) AS a{i}{j}" for i in range(n) for j in range(i, n))
    det = "nullif(a00 * a11 - a01 * a01, 0)"
    return (_DESIGN_SQL + f", z0 AS (SELECT k, spp, treated, gsmax / 1000 AS gx, log_gs FROM dz), "
            "ctr AS (SELECT avg(treated) AS c0, avg(gx) AS c1, avg(log_gs) AS c2 FROM z0), "
            "z AS (SELECT k, spp, treated - c0 AS treated, gx - c1 AS gx, log_gs - c2 AS log_gs FROM z0 CROSS JOIN ctr), "
            f"hs AS (SELECT z.*, b.range AS blk, sha256(CAST(k AS STRING) || '_' || CAST(b.range AS STRING)) AS h FROM z "
            f"CROSS JOIN range(0, {(REPLICATES - 1) // FT.PER_HASH + 1}) b), "
            f"us AS (SELECT spp, treated, gx, log_gs, CAST(blk * {FT.PER_HASH} + j.range + 1 AS BIGINT) AS iter, {u} AS u "
            f"FROM hs CROSS JOIN range(0, {FT.PER_HASH}) j WHERE blk * {FT.PER_HASH} + j.range < {REPLICATES}), "
            f"wt AS (SELECT *, {w} AS w FROM us), "
            f"gg AS (SELECT spp, iter, sum(w) AS sw, {ones}, {prods} FROM wt WHERE w > 0 GROUP BY spp, iter), "
            f"s AS (SELECT iter, sum(sw) AS n, count(*) AS g, {within} FROM gg GROUP BY iter), "
            f"cc AS (SELECT *, (a11 * a02 - a01 * a12) / {det} AS b_treated, (a00 * a12 - a01 * a02) / {det} AS b_gsmax FROM s), "
            "f AS (SELECT iter, b_treated, b_gsmax, sqrt(greatest(a22 - b_treated * a02 - b_gsmax * a12, 0) / (n - g - 2)) AS sigma FROM cc), "
            "bd AS (SELECT 'boot' AS model, 1 AS chain, iter, 'b_treated' AS par, b_treated AS value FROM f UNION ALL "
            "SELECT 'boot', 1, iter, 'b_gsmax', b_gsmax FROM f UNION ALL SELECT 'boot', 1, iter, 'sigma', sigma FROM f) ")


def _boot(spark: SparkSession, d: str) -> DataFrame:
    des = _design(spark, d).withColumn("gsmax", F.col("gsmax") / 1000)
    return FT.bootstrap_regression(des, "k", "spp", "log_gs", ["treated", "gsmax"], REPLICATES)


@query("bootstrap_regression", "model chain iter par value:d", _boot_terms_sql() + "SELECT * FROM bd")
def bootstrap_regression(spark: SparkSession, d: str) -> DataFrame:
    """K8 on K4: log gs ~ treated + gsmax with species intercepts in each of 60
    Poisson-bootstrap replicates, as draws."""
    return _boot(spark, d)


@query("bootstrap_regression_summary", "term estimate:d std_error:d conf_low:d conf_high:d",
       _boot_terms_sql() + ", " + G.hpd_cte("bd", ["par"], "value", "iter") +
       " SELECT bd.par AS term, avg(value) AS estimate, stddev_samp(value) AS std_error, min(hpd.lower) AS conf_low, "
       "min(hpd.upper) AS conf_high FROM bd JOIN hpd ON hpd.par = bd.par GROUP BY bd.par")
def bootstrap_regression_summary(spark: SparkSession, d: str) -> DataFrame:
    """K8 on K4, then D17 and D12 on the replicates' coefficients."""
    draws = cut_lineage(_boot(spark, d), "boot-draws")  # each statistic reads the draws, none weighs the rows again
    return D.summarise_draws(draws, ["par"], estimate="mean", interval="hpd", p=False)


_EFFECT_YS = ("gs", "gx")


def _correlated_sql() -> str:
    a, b = _EFFECT_YS
    s = "sqrt((ta - tb) * (ta - tb) + 4 * tc * tc)"
    return (_PL_SQL + "d0 AS (SELECT spp, treatment, gs / 1000 AS gs, gsmax * 10 AS gx FROM pl WHERE treatment IN ('F', 'P') "
            "AND gs IS NOT NULL AND gsmax IS NOT NULL), "
            f"ce AS (SELECT spp, treatment, count(*) AS n, avg({a}) AS ma, avg({b}) AS mb, var_samp({a}) / count(*) AS va, "
            f"var_samp({b}) / count(*) AS vb, covar_samp({a}, {b}) / count(*) AS vc FROM d0 GROUP BY ALL HAVING count(*) >= 2), "
            "e AS (SELECT t.spp AS grp, t.n AS n1, r.n AS n0, t.ma - r.ma AS da, t.mb - r.mb AS db, t.va + r.va AS va, "
            "t.vb + r.vb AS vb, t.vc + r.vc AS vc FROM ce t JOIN ce r ON r.spp = t.spp AND t.treatment = 'P' AND r.treatment = 'F'), "
            "m AS (SELECT avg(da) AS ea, avg(db) AS eb, var_samp(da) - avg(va) AS ta, var_samp(db) - avg(vb) AS tb, "
            "covar_samp(da, db) - avg(vc) AS tc FROM e), "
            # eigenvalues of the 2 x 2 matrix, negative ones cut; the projector of the larger one is (T - l2 I) / (l1 - l2)
            f"ev AS (SELECT m.*, (ta + tb + {s}) / 2 AS l1, (ta + tb - {s}) / 2 AS l2 FROM m), "
            "pj AS (SELECT ev.*, CASE WHEN l1 > l2 THEN (greatest(l1, 0) - greatest(l2, 0)) / (l1 - l2) ELSE 0 END AS f FROM ev), "
            "pt AS (SELECT ea, eb, f * (ta - l2) + greatest(l2, 0) AS ta, f * (tb - l2) + greatest(l2, 0) AS tb, f * tc AS tc FROM pj), "
            "x AS (SELECT e.*, pt.*, pt.ta + va AS a11, pt.tb + vb AS a22, pt.tc + vc AS a12, da - ea AS ra, db - eb AS rb FROM e CROSS JOIN pt), "
            "z AS (SELECT x.*, (a22 * ra - a12 * rb) / (a11 * a22 - a12 * a12) AS za, (a11 * rb - a12 * ra) / (a11 * a22 - a12 * a12) AS zb FROM x) "
            "SELECT grp, n1, n0, da AS raw_gs, db AS raw_gsmax, ea + ta * za + tc * zb AS shrunk_gs, eb + tc * za + tb * zb AS shrunk_gsmax, "
            "ta AS var_gs, tb AS var_gsmax, tc AS cov FROM z")


@query("correlated_effects", "grp n1 n0 raw_gs:d raw_gsmax:d shrunk_gs:d shrunk_gsmax:d var_gs:c var_gsmax:c cov:c", _correlated_sql())
def correlated_effects(spark: SparkSession, d: str) -> DataFrame:
    """K6 with correlated effects of two responses: per-species treatment
    effects on gs (in thousands) and gsmax (in tenths), shrunk together by
    their between-species covariance."""
    pl = _plants_leaf(spark, d).withColumns({"gs": F.col("gs") / 1000, "gx": F.col("gsmax") * 10})
    e = FT.pool_correlated(pl, "spp", list(_EFFECT_YS), "treatment", "P", "F", effects="treatment")

    def at(c, i, j=None):
        return F.get(c, F.lit(i)) if j is None else F.get(F.get(c, F.lit(i)), F.lit(j))

    return e.select("grp", "n1", "n0", at("raw", 0).alias("raw_gs"), at("raw", 1).alias("raw_gsmax"),
                    at("shrunk", 0).alias("shrunk_gs"), at("shrunk", 1).alias("shrunk_gsmax"),
                    at("between", 0, 0).alias("var_gs"), at("between", 1, 1).alias("var_gsmax"), at("between", 0, 1).alias("cov"))


# ------------------------------------------------------------------ densities and validity in four dimensions

VARS = ("gsmax_ww", "gsmax_wd", "kcatc", "sco")


def _chol_sql(src: str) -> str:
    """CTEs ending in ch(..., l00..l33): the Cholesky factor of corr c<i><j>,
    a row of the factor a step; NULL from the first bad pivot on."""
    n, out, prev = len(VARS), [], src
    for i in range(n):
        step = []
        for j in range(i):
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append(f"h{i}{j} AS (SELECT *, (c{j}{i}{rest}) / l{j}{j} AS l{i}{j} FROM {prev})")
            prev = f"h{i}{j}"
        d = "1" + "".join(f" - l{i}{k} * l{i}{k}" for k in range(i))
        step = f"CASE WHEN {d} > 1e-9 THEN sqrt({d}) END" if i else "CAST(1 AS DOUBLE)"
        out.append(f"h{i} AS (SELECT *, {step} AS l{i}{i} FROM {prev})")
        prev = f"h{i}"
    return ", ".join(out) + f", ch AS (SELECT * FROM {prev})"


_MVN_DRAWS_SQL = (
    V.with_views("DS") + ", full4 AS (SELECT * FROM ds WHERE " + " AND ".join(f"{v} IS NOT NULL" for v in VARS) + "), "
    "mv AS (SELECT iter, " + ", ".join(f"avg({v}) AS m{i}, stddev_samp({v}) AS s{i}" for i, v in enumerate(VARS)) + ", "
    + ", ".join(f"covar_samp({VARS[i]}, {VARS[j]}) / nullif(stddev_samp({VARS[i]}) * stddev_samp({VARS[j]}), 0) AS c{i}{j}"
                for i in range(4) for j in range(i + 1, 4)) + " FROM full4 GROUP BY iter), " + _chol_sql("mv"))


def _mvn_draws(spark: SparkSession, d: str) -> DataFrame:
    """Per draw: means, sds and correlation matrix over species, as arrays."""
    ds = V.stored_species(spark, d).dropna(subset=list(VARS))
    return ds.groupBy("iter").agg(
        F.array(*[F.avg(v) for v in VARS]).alias("mean"), F.array(*[F.stddev_samp(v) for v in VARS]).alias("sds"),
        F.array(*[F.array(*[F.lit(1.0) if i == j else PD.guarded_corr(F.col(VARS[min(i, j)]), F.col(VARS[max(i, j)])) for j in range(4)])
                  for i in range(4)]).alias("corr"))


def _mvn_sql() -> str:
    z, cols = [], []
    for i in range(4):
        rest = "".join(f" - l{i}{k} * z{k}" for k in range(i))
        z.append(f"y{i} AS (SELECT *, (o{i} - m{i}) / s{i} AS e{i} FROM {'oz' if not i else f'w{i - 1}'}), "
                 f"w{i} AS (SELECT *, (e{i}{rest}) / l{i}{i} AS z{i} FROM y{i})")
        cols.append(f"z{i} * z{i}")
    logs = " + ".join(f"ln(s{i}) + ln(l{i}{i})" for i in range(4))
    return (_MVN_DRAWS_SQL + ", ob AS (SELECT spp, " + ", ".join(f"avg({v}) AS o{i}" for i, v in enumerate(VARS)) + " FROM full4 GROUP BY spp), "
            "oz AS (SELECT ob.*, ch.* FROM ob CROSS JOIN ch WHERE l33 IS NOT NULL), " + ", ".join(z)
            + f" SELECT spp, iter, -(4 * {HALF_LOG_2PI} + {logs} + 0.5 * ({' + '.join(cols)})) AS loglik FROM w3")


@query("normal_loglik_4d", "spp iter loglik:d", _mvn_sql())
def normal_loglik_4d(spark: SparkSession, d: str) -> DataFrame:
    """K12 in four dimensions: log density of each species' mean (gsmax under
    both treatments, kcatc, sco) under each draw's means, sds and correlation
    matrix, by the Cholesky factor; invalid matrices give no rows."""
    draws = _mvn_draws(spark, d).where(L.is_positive_definite(F.col("corr"), 1e-9))
    draws = draws.select("iter", "mean", L.cholesky(CM.covariance_of(F.col("sds"), F.col("corr"))).alias("chol"))
    ds = V.stored_species(spark, d).dropna(subset=list(VARS))
    obs = ds.groupBy("spp").agg(F.array(*[F.avg(v) for v in VARS]).alias("y"))
    return CM.pointwise_loglik(obs, draws, CM.neg_loglik_normal(F.col("y"), F.col("mean"), F.col("chol")), ["spp"])


def _pairwise_sql() -> str:
    """Each correlation from the species that have both values, of different
    parity per pair, so that a draw's matrix need not be valid."""
    return (V.with_views("DS") + ", mv AS (SELECT iter, " + ", ".join(
        f"covar_samp({VARS[i]}, {VARS[j]}) FILTER (WHERE {_parity(i, j)}) / nullif(stddev_samp({VARS[i]}) FILTER (WHERE {_parity(i, j)} AND {VARS[j]} IS NOT NULL) "
        f"* stddev_samp({VARS[j]}) FILTER (WHERE {_parity(i, j)} AND {VARS[i]} IS NOT NULL), 0) AS c{i}{j}"
        for i in range(4) for j in range(i + 1, 4)) + " FROM ds GROUP BY iter), " + _chol_sql("mv")
        + " SELECT count(*) AS n_draws, count(*) FILTER (WHERE " + " OR ".join(f"c{i}{j} IS NULL" for i in range(4) for j in range(i + 1, 4))
        + ") AS n_incomplete, count(*) FILTER (WHERE l33 IS NULL) AS n_invalid FROM ch")


def _parity(i: int, j: int) -> str:
    return f"spp % 2 = {(i + j) % 2}"


@query("correlation_draw_checks", "n_draws n_incomplete n_invalid", _pairwise_sql())
def correlation_draw_checks(spark: SparkSession, d: str) -> DataFrame:
    """K17 for correlation matrices: how many draws have a matrix that is
    incomplete or not a valid correlation matrix (each entry from species of
    one parity, so that validity is not given)."""
    ds = V.stored_species(spark, d)

    def corr(i, j):
        a, b = VARS[min(i, j)], VARS[max(i, j)]
        ok = F.expr(_parity(i, j)) & F.col(a).isNotNull() & F.col(b).isNotNull()
        return PD.guarded_corr(F.when(ok, F.col(a)), F.when(ok, F.col(b)))

    m = ds.groupBy("iter").agg(F.array(*[F.array(*[F.lit(1.0) if i == j else corr(i, j) for j in range(4)]) for i in range(4)]).alias("corr"))
    return D.check_correlations(m, "corr", tiny=1e-9)
