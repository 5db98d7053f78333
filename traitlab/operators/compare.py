"""Prediction and model comparison from draws.

Draws of a model (one row per draw: b0, b1, sigma) may be as many as the data
make them; observations and new rows to predict are a stated, smaller set.

* Prediction moments (K11) and Bayesian R^2 (K16) use moment algebra, so no
  (draw, observation) pair is ever formed.
* Where a statistic needs every pair (K12, K13, K11 quantiles), ``meet`` joins
  the observations with the draws of their model in blocks: draws are dealt
  to blocks by a hash, each block meets its copy of the observations.  What
  follows is a partial aggregate per observation, so pairs live inside a
  task and no group of draws is gathered.
* Pareto smoothing (K13) ranks only the largest ratios of each observation,
  about ``3 sqrt(draws)`` of them, cut out by a mergeable sketch.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg
from ..session import cut_lineage
from .ranking import ACCURACY, MARGIN, group_quantiles, join_groups

BLOCK_DRAWS = 2048  # draws of one model in a block, on average
LOG_2PI = math.log(2 * math.pi)


def draw_moments(coefs: DataFrame, b0: str = "b0", b1: str = "b1", sigma: str = "sigma",
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """Means, variances and covariance of (b0, b1) and mean sigma^2."""
    c = coefs.where(F.col(b0).isNotNull() & F.col(b1).isNotNull())
    return c.groupBy(*keys).agg(
        F.avg(b0).alias("_e0"), F.avg(b1).alias("_e1"), F.var_samp(b0).alias("_v0"),
        F.var_samp(b1).alias("_v1"), F.covar_samp(b0, b1).alias("_c01"),
        F.avg(F.col(sigma) * F.col(sigma)).alias("_es2"))


def predict(newdata: DataFrame, x: str, moments: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Predictive mean and sd at each new row.

    mean = E[b0] + E[b1] x;  var = var(b0) + x^2 var(b1) + 2 x cov(b0, b1)
    + E[sigma^2] - exactly the sample variance of mu over draws plus the
    residual noise.
    """
    j = join_groups(newdata, moments, keys)
    xx = F.col(x)
    var = F.col("_v0") + xx * xx * F.col("_v1") + 2 * xx * F.col("_c01") + F.col("_es2")
    return (j.withColumn("pred_mean", F.col("_e0") + F.col("_e1") * xx)
            .withColumn("pred_sd", F.sqrt(var))
            .drop("_e0", "_e1", "_v0", "_v1", "_c01", "_es2"))


def usable_draws(coefs: DataFrame, b0: str = "b0", b1: str = "b1", sigma: str = "sigma") -> DataFrame:
    """Draws with all coefficients and a positive sigma."""
    return coefs.where(F.col(b0).isNotNull() & F.col(b1).isNotNull() & (F.col(sigma) > 0))


def meet(few: DataFrame, draws: DataFrame, keys: Sequence[str] = (), it: str = "iter",
         per_block: int | None = None) -> DataFrame:
    """Every row of ``few`` beside every draw of its model (equal ``keys``,
    NULL included), block by block; the number of a model's blocks follows
    the count of its draws."""
    keys = list(keys)
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(float(per_block or BLOCK_DRAWS))).cast("int")
    sizes = draws.groupBy(*keys).agg(blocks.alias("_blocks"))
    left = join_groups(few, sizes, keys).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    right = join_groups(draws, sizes, keys).withColumn("_block", F.pmod(F.xxhash64(it), "_blocks").cast("int")).drop("_blocks")
    return join_groups(right, left, [*keys, "_block"]).drop("_block")


def neg_loglik(x: Column, y: Column, b0: str = "b0", b1: str = "b1", sigma: str = "sigma") -> Column:
    """-log N(y | b0 + b1 x, sigma)."""
    return neg_loglik_at(y, F.col(b0) + F.col(b1) * x, F.col(sigma))


def neg_loglik_at(y: Column, mu: Column, sigma: Column) -> Column:
    """-log N(y | mu, sigma)."""
    z = (y - mu) / sigma
    return F.lit(0.5 * LOG_2PI) + F.log(sigma) + F.lit(0.5) * z * z


def neg_loglik_normal(y: Column, mean: Column, chol: Column) -> Column:
    """-log of the normal density of any dimension: ``y`` and ``mean`` arrays,
    ``chol`` the Cholesky factor of the covariance (``linalg.cholesky``)."""
    z = linalg.forward(chol, F.zip_with(y, mean, lambda a, b: a - b))
    return F.lit(0.5 * LOG_2PI) * F.size(y) + linalg.log_det_half(chol) + F.lit(0.5) * linalg.let(z, lambda x: linalg.dot(x, x))


def covariance_of(sds: Column, corr: Column) -> Column:
    """The covariance matrix of standard deviations and a correlation matrix."""
    return F.transform(corr, lambda row, i: F.zip_with(row, sds, lambda r, s: r * s * F.get(sds, i)))


def neg_loglik_pair(y1: Column, y2: Column, m1: str = "m1", m2: str = "m2", s1: str = "s1", s2: str = "s2",
                    rho: str = "rho") -> Column:
    """-log of the bivariate normal density of (y1, y2)."""
    z1, z2 = (y1 - F.col(m1)) / F.col(s1), (y2 - F.col(m2)) / F.col(s2)
    r = F.col(rho)
    rest = F.lit(1.0) - r * r
    return (F.lit(LOG_2PI) + F.log(F.col(s1)) + F.log(F.col(s2)) + F.lit(0.5) * F.log(rest)
            + (z1 * z1 - 2 * r * z1 * z2 + z2 * z2) / (2 * rest))


def pointwise_loglik(obs: DataFrame, draws: DataFrame, neg: Column, ids: Sequence[str],
                     keys: Sequence[str] = (), it: str = "iter") -> DataFrame:
    """(keys, ids, iter, loglik), the log-likelihood of every observation
    under every draw of its model; ``neg`` is minus it, in columns of both."""
    return meet(obs, draws, keys, it).select(*keys, *ids, it, (-neg).alias("loglik"))


def elpd_loo(obs: DataFrame, draws: DataFrame, neg: Column, ids: Sequence[str],
             keys: Sequence[str] = (), it: str = "iter") -> DataFrame:
    """K13 per observation: (keys, ids, elpd) with
    ``elpd_i = -(M_i + ln(avg_s exp(-ll_is - M_i)))``, ``M_i = max_s(-ll_is)``.

    Two passes, each a partial aggregate per observation: the shift, the sum.
    Draws and observations, read twice, are written once.
    """
    one = [*keys, *ids]
    obs, draws = cut_lineage(obs, "obs"), cut_lineage(draws, "draws")
    top = meet(obs, draws, keys, it).groupBy(*one).agg(F.max(neg).alias("_shift"))
    again = meet(join_groups(obs, top, one), draws, keys, it)
    s = again.groupBy(*one).agg(F.avg(F.exp(neg - F.col("_shift"))).alias("_a"), F.max("_shift").alias("_shift"))
    return s.select(*one, (-(F.col("_shift") + F.log("_a"))).alias("elpd"))


def loo_summary(elpd: DataFrame, col: str = "elpd", keys: Sequence[str] = ()) -> DataFrame:
    """K13 totals: elpd = sum, se = sqrt(n) * sd(elpd_i)."""
    return elpd.groupBy(*keys).agg(F.sum(col).alias("elpd_loo"),
                                   (F.sqrt(F.count(col).cast("double")) * F.stddev_samp(col)).alias("se"),
                                   F.count(col).alias("n"))


def loo_compare(elpd: DataFrame, model: str, ids: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """K13 comparison of any number of models: per (keys, model) the total,
    and the summed difference to the best model (largest total, then first
    name) with ``se_diff = sqrt(n) * sd(diff_i)``; the best model's are 0."""
    keys = list(keys)
    total = loo_summary(elpd, keys=[*keys, model])
    best = (total.withColumn("_r", F.row_number().over(
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("elpd_loo"), F.asc(model))))
        .where("_r = 1").select(*keys, F.col(model).alias("_best")))
    ref = join_groups(elpd, best, keys).where(F.col(model) == F.col("_best")).select(*keys, *ids, F.col("elpd").alias("_e"))
    d = join_groups(elpd, ref, [*keys, *ids]).withColumn("_d", F.col("elpd") - F.col("_e"))
    diff = d.groupBy(*keys, model).agg(F.sum("_d").alias("elpd_diff"),
                                       (F.sqrt(F.count("_d").cast("double")) * F.stddev_samp("_d")).alias("se_diff"))
    return join_groups(total, diff, [*keys, model])


def obs_moments(obs: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sample moments of the observations (var x, var y, cov) per ``keys``."""
    o = obs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return o.groupBy(*keys).agg(F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"), F.covar_samp(x, y).alias("_cxy"))


def bayes_r2(coefs: DataFrame, moments: DataFrame, b1: str = "b1", it: str = "iter",
             keys: Sequence[str] = ()) -> DataFrame:
    """K16 per draw: var(mu) / (var(mu) + var(y - mu)) over observations,
    from observation moments: var(mu) = b1^2 var(x), var(y - mu) =
    var(y) + b1^2 var(x) - 2 b1 cov(x, y)."""
    j = join_groups(coefs.where(F.col(b1).isNotNull()), moments, keys)
    b = F.col(b1)
    vmu = b * b * F.col("_vx")
    vres = F.col("_vy") + b * b * F.col("_vx") - 2 * b * F.col("_cxy")
    return j.select(*keys, it, (vmu / F.nullif(vmu + vres, F.lit(0.0))).alias("r2"))


# ------------------------------------------------------------ Pareto-smoothed LOO

# Where the sketch may cut off the tail: shares of the ratios left below.
TAIL_CUTS = (0.0, 0.5, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.97, 0.98, 0.99, 0.995, 0.998, 0.999, 0.9995)
LEAST_TAIL = 5  # ratios in a tail that is fitted


def elpd_psis(obs: DataFrame, draws: DataFrame, neg: Column, ids: Sequence[str],
              keys: Sequence[str] = (), it: str = "iter") -> DataFrame:
    """K13 with Pareto smoothing: (keys, ids, elpd, pareto_k).

    Importance ratios are exp(-ll - M_i), M_i the largest -ll.  Of S ratios
    the largest ``m = ceil(min(S / 5, 3 sqrt(S)))`` are replaced by expected
    order statistics of a generalised Pareto distribution fitted to what
    they exceed the next ratio by (Zhang & Stephens 2009, with the shrinkage
    of k towards 0.5 of Vehtari, Gelman & Gabry 2017), capped at the largest
    raw ratio.  Tails under ``LEAST_TAIL``, or with a ratio equal to the next
    one or all equal, stay as they are, with a NULL ``pareto_k``.

    Draws meet the observations three times: for the sketch, for the sum of
    the ratios below its cut, and for the few above it, which alone are
    ranked and fitted.  Both are written once.
    """
    one = [*keys, *ids]
    obs, draws = cut_lineage(obs, "obs"), cut_lineage(draws, "draws")
    s = F.col("_S").cast("double")
    size = (meet(obs, draws, keys, it).groupBy(*one)
            .agg(F.count(F.lit(1)).alias("_S"), F.max(neg).alias("_shift"),
                 F.percentile_approx(neg, list(TAIL_CUTS), ACCURACY).alias("_q"))
            .withColumn("_m", F.ceil(F.least(s / 5, 3 * F.sqrt(s)))))
    share = 1 - (F.col("_m") + 1) / s - MARGIN / ACCURACY  # the tail and one more lie above it
    at = F.size(F.filter(F.array(*[F.lit(c) for c in TAIL_CUTS]), lambda c: c <= share)) - 1
    size = size.withColumn("_cut", F.when(at > 0, F.get("_q", at))).drop("_q")
    pairs = meet(join_groups(obs, size, one), draws, keys, it).select(
        *one, "_S", "_shift", "_m", (neg - F.col("_shift")).alias("_lw"),
        F.coalesce(neg >= F.col("_cut"), F.lit(True)).alias("_high"))
    body = pairs.where(~F.col("_high")).groupBy(*one).agg(F.sum(F.exp("_lw")).alias("_body"))
    rank = F.row_number().over(Window.partitionBy(*one).orderBy(F.desc("_lw")))
    high = pairs.where("_high").withColumn("_r", rank)

    edge = F.max(F.when(F.col("_r") == F.col("_m") + 1, F.exp("_lw")))
    quarter = F.floor(F.col("_m") / 4 + 0.5)  # from below, 1-based
    marks = high.groupBy(*one).agg(
        edge.alias("_edge"), F.max(F.when(F.col("_r") == F.col("_m") - F.greatest(quarter, F.lit(1)) + 1, F.exp("_lw"))).alias("_low"),
        F.max(F.exp("_lw")).alias("_top"), F.min(F.when(F.col("_r") <= F.col("_m"), F.exp("_lw"))).alias("_min"))
    fitted = ((F.col("_m") >= LEAST_TAIL) & (F.col("_min") > F.col("_edge")) & (F.col("_top") > F.col("_min")))
    high = join_groups(high, marks, one).withColumn("_x", F.when(fitted & (F.col("_r") <= F.col("_m")), F.exp("_lw") - F.col("_edge")))

    # the profile over a grid of theta, one aggregate over (tail, grid)
    tail = high.where("_x IS NOT NULL").withColumn("_g", 30 + F.floor(F.sqrt(F.col("_m").cast("double"))))
    j = F.explode(F.sequence(F.lit(1), F.col("_g").cast("int")))
    grid = tail.withColumn("_j", j).withColumn(
        "_theta", 1 / (F.col("_top") - F.col("_edge"))
        + (1 - F.sqrt(F.col("_g") / (F.col("_j") - 0.5))) / 3 / (F.col("_low") - F.col("_edge")))
    prof = (grid.groupBy(*one, "_j").agg(F.max("_theta").alias("_theta"), F.max("_m").alias("_m"),
                                         F.avg(F.log1p(-F.col("_theta") * F.col("_x"))).alias("_k"))
            .withColumn("_p", F.col("_m") * (F.log(-F.col("_theta") / F.col("_k")) - F.col("_k") - 1)))
    most = prof.groupBy(*one).agg(F.max("_p").alias("_pm"))
    weight = F.exp(F.col("_p") - F.col("_pm"))
    theta = join_groups(prof, most, one).groupBy(*one).agg((F.sum(F.col("_theta") * weight) / F.sum(weight)).alias("_t"))
    shape = (join_groups(tail, theta, one).groupBy(*one)
             .agg(F.avg(F.log1p(-F.col("_t") * F.col("_x"))).alias("_k"), F.max("_t").alias("_t"), F.max("_m").alias("_m"))
             .select(*one, (-F.col("_k") / F.col("_t")).alias("_sigma"),
                     ((F.col("_k") * F.col("_m") + 5) / (F.col("_m") + 10)).alias("_k")))

    done = join_groups(high, shape, one, "left")
    k, below = F.col("_k"), F.log1p(-(F.col("_m") - F.col("_r") + 0.5) / F.col("_m"))
    q = F.col("_sigma") * F.when(F.abs(k) < 1e-12, -below).otherwise(F.expm1(-k * below) / k)
    smooth = F.when(F.col("_x").isNotNull() & (F.col("_sigma") > 0), F.least(F.log(q + F.col("_edge")), F.lit(0.0)))
    lw = F.coalesce(smooth, F.col("_lw"))
    # exp(lw + ll) of a ratio left as it is is exp(-M)
    parts = done.groupBy(*one).agg(F.max("_S").alias("_S"), F.max("_shift").alias("_shift"), F.count(F.lit(1)).alias("_n"),
                                   F.sum(F.exp(lw - F.col("_lw"))).alias("_num"), F.sum(F.exp(lw)).alias("_den"),
                                   F.max("_k").alias("pareto_k"))
    out = join_groups(parts, body, one, "left")
    num = F.col("_S") - F.col("_n") + F.col("_num")
    den = F.coalesce("_body", F.lit(0.0)) + F.col("_den")
    return out.select(*one, (F.log(num) - F.log(den) - F.col("_shift")).alias("elpd"), "pareto_k")


# ------------------------------------------------------------ predictive quantiles

def hash_normal(*key: Column) -> Column:
    """A standard normal number from md5 of the key's texts joined by ``_``
    (Box-Muller on its first two groups of eight hex digits)."""
    h = F.md5(F.concat_ws("_", *[k.cast("string") for k in key]))
    u1, u2 = (F.conv(F.substring(h, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.sqrt(-2 * F.log((u1 + 1) / F.lit(4294967296.0))) * F.cos(F.lit(2 * math.pi) * (u2 / F.lit(4294967296.0)))


def predict_quantiles(newdata: DataFrame, x: str, draws: DataFrame, ids: Sequence[str],
                      probs: Sequence[float] = (0.025, 0.975),
                      names: Sequence[str] = ("pred_lower", "pred_upper"),
                      keys: Sequence[str] = (), it: str = "iter") -> DataFrame:
    """K11 quantiles: (keys, ids, names...), quantiles of predictions of y at
    each new row with residual noise: one prediction per draw, its noise
    seeded by (ids, keys, iter).  Exact quantiles without gathering a row's
    predictions (``group_quantiles``)."""
    one = [*ids, *keys]
    seed = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*one, it)]
    pred = meet(newdata, draws, keys, it).select(
        *one, (F.col("b0") + F.col("b1") * F.col(x) + F.col("sigma") * hash_normal(*seed)).alias("_pred"))
    return group_quantiles(pred, one, "_pred", list(probs), list(names))
