"""Re-aimed model fits from distributed sums (K3-K8).

These answer the reference's multilevel-model questions with stated
closed-form estimators; they are **not** a posterior.  Everything is
partial + final aggregation: per-group sufficient statistics (one row per
group), then a tiny global step.  Per-group tables are joined back to rows
only as small dimension tables (AQE broadcasts them).
"""

from __future__ import annotations

import itertools
import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from .perdraw import guarded_corr
from .ranking import attach_scalars, join_groups

# Poisson(1) cumulative probabilities P(X <= k): the cut points that turn a
# uniform draw into a bootstrap weight, as many as a 32-bit uniform can reach.
POISSON1_CDF = tuple(p for p in itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(20))
                     if p <= 1 - 2.0 ** -32)


def gram(df: DataFrame, group: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """K3: per group n and all sums of products of (1, xs..., y)."""
    cols = ["_one", *xs, y]
    src = df.withColumn("_one", F.lit(1.0))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            if a == "_one":
                if b != "_one":
                    aggs.append(F.sum(F.col(b)).alias(f"s_{b}"))
                continue
            aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}"))
    return src.groupBy(*group).agg(*aggs)


def within_sums(df: DataFrame, group: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per group of the complete rows: ``n``, the means ``m_<i>`` and
    the sums of products of deviations from them ``s_<i>_<j>`` (i <= j,
    places in ``cols``).  One pass, no raw sums, so nothing cancels."""
    n = F.count(F.lit(1))
    aggs = [n.alias("n")] + [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    for i, a in enumerate(cols):
        aggs += [(F.covar_pop(a, cols[j]) * n).alias(f"s_{i}_{j}") for j in range(i, len(cols))]
    return df.dropna(subset=list(cols)).groupBy(*group).agg(*aggs)


def within_regression(df: DataFrame, group: Sequence[str], y: str, *xs: str) -> DataFrame:
    """K4: y ~ xs with group intercepts, by within-group least squares.

    Rows with a NULL in y or xs are left out; products (interactions) are
    columns like any other.  The within-group sums of products are added over
    groups and the normal equations solved by elimination, one step a
    projection of the one row.  Returns (b_<x>..., n, groups); a predictor
    that the ones before it determine makes the coefficients NULL.
    """
    cols, k = [*xs, y], len(xs)
    g = within_sums(df, group, cols)
    s = g.agg(*[F.sum(f"s_{i}_{j}").alias(f"a_{i}_{j}") for i in range(k) for j in range(i, k + 1)],
              F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("groups"))
    s = s.select("n", "groups", *[F.col(f"a_{min(i, j)}_{max(i, j)}").alias(f"a_{i}_{j}") for i in range(k) for j in range(k + 1)],
                 *[F.col(f"a_{i}_{i}").alias(f"d_{i}") for i in range(k)])
    for p in range(k):
        pivot = F.when(F.col(f"a_{p}_{p}") > 1e-11 * F.col(f"d_{p}"), F.col(f"a_{p}_{p}"))
        s = s.withColumns({f"a_{p}_{j}": F.col(f"a_{p}_{j}") / pivot for j in range(p, k + 1)})
        s = s.withColumns({f"a_{i}_{j}": F.col(f"a_{i}_{j}") - F.col(f"a_{i}_{p}") * F.col(f"a_{p}_{j}")
                           for i in range(k) if i != p for j in range(p + 1, k + 1)})
    return s.select(*[F.col(f"a_{i}_{k}").alias(f"b_{x}") for i, x in enumerate(xs)], "n", "groups")


def _normal_equations(k: int) -> tuple[Column, Column]:
    """Matrix and right side out of columns ``s_<i>_<j>`` (i <= j <= k, the
    last is y)."""
    m = F.array(*[F.array(*[F.col(f"s_{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)])
    return m, F.array(*[F.col(f"s_{i}_{k}") for i in range(k)])


def _solved(sums: DataFrame, k: int, n: Column, lost: Column, keep: Sequence) -> DataFrame:
    """(keep..., _b, sigma): coefficients of every row's system at once, and
    the residual sd with ``n - lost - k`` degrees of freedom."""
    m, r = _normal_equations(k)
    s = sums.withColumn("_b", L.solve(m, r)).withColumn("_r", r)
    sse = F.greatest(F.col(f"s_{k}_{k}") - L.dot(F.col("_b"), F.col("_r")), F.lit(0.0))
    free = n - lost - k
    return s.select(*keep, "_b", F.when(free > 0, F.sqrt(sse / free)).alias("sigma"))


def regression_draws(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], group: str | None = None,
                     intercept: str = "Intercept") -> DataFrame:
    """Coefficients of ``y ~ xs`` within each of ``by`` (a draw) as long draws
    (by..., term, value): terms ``Intercept``, the names in ``xs``, ``sigma``.

    With ``group`` there is an intercept per group instead, the term
    ``<intercept>[<group>]`` (K4 per draw): slopes from the within-group sums,
    intercepts from the group means.  Rows with a NULL are left out; where a
    predictor is determined by those before it, or no degree of freedom is
    left, there are no terms.
    """
    by, k, cols = list(by), len(xs), [*xs, y]
    inner = [*by, group] if group else by
    g = within_sums(df, inner, cols)
    sums = g.groupBy(*by).agg(*[F.sum(f"s_{i}_{j}").alias(f"s_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)],
                              F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_g"))
    fit = _solved(sums, k, F.col("_n"), F.col("_g"), by).where("sigma IS NOT NULL AND forall(_b, x -> x IS NOT NULL)")
    means = g.select(*inner, F.array(*[F.col(f"m_{i}") for i in range(k)]).alias("_m"), F.col(f"m_{k}").alias("_my"))
    level = join_groups(means, fit, by).select(
        *by, (F.concat(F.lit(f"{intercept}["), F.col(group).cast("string"), F.lit("]")) if group else F.lit(intercept)).alias("term"),
        (F.col("_my") - L.dot(F.col("_b"), F.col("_m"))).alias("value"))
    slopes = F.array(*[F.struct(F.lit(x).alias("term"), F.get("_b", F.lit(i)).alias("value")) for i, x in enumerate(xs)],
                     F.struct(F.lit("sigma").alias("term"), F.col("sigma").alias("value")))
    return level.unionByName(fit.select(*by, F.explode(slopes).alias("_t")).select(*by, "_t.term", "_t.value"))


def pool_means(df: DataFrame, group: str, y: str) -> DataFrame:
    """K5: partial pooling of group means (one-way ANOVA moments).

    ``s2 = sum(SS_g)/(N-K)``, ``n0 = N - sum(n_g^2)/N``,
    ``tau2 = max((MSB - s2)(K-1)/n0, 0)`` and each mean is shrunk toward the
    weighted grand mean by ``tau2 / (tau2 + s2/n_g)``.
    """
    g = df.where(F.col(y).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"),
        F.coalesce(F.var_samp(y) * (F.count(F.lit(1)) - 1), F.lit(0.0)).alias("_ss"))
    tot = g.agg(F.sum("n").alias("_N"), F.count(F.lit(1)).alias("_K"), F.sum("_ss").alias("_SSW"),
                (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_gm"),
                F.sum(F.col("n") * F.col("n")).alias("_n2"))
    j = attach_scalars(g, tot)
    ssb = j.groupBy().agg(F.sum(F.col("n") * (F.col("mean") - F.col("_gm")) * (F.col("mean") - F.col("_gm")))
                          .alias("_SSB"))
    j = attach_scalars(j, ssb)
    N, K = F.col("_N").cast("double"), F.col("_K").cast("double")
    s2 = F.col("_SSW") / F.nullif(N - K, F.lit(0.0))
    n0 = N - F.col("_n2") / N
    tau2 = F.greatest((F.col("_SSB") / F.nullif(K - 1, F.lit(0.0)) - s2) * (K - 1) / F.nullif(n0, F.lit(0.0)),
                      F.lit(0.0))
    j = j.withColumn("s2", s2).withColumn("tau2", tau2)
    w = F.col("tau2") / F.nullif(F.col("tau2") + F.col("s2") / F.col("n"), F.lit(0.0))
    return j.select(F.col(group).cast("string").alias("grp"), "n", "mean",
                    (F.col("_gm") + F.coalesce(w, F.lit(0.0)) * (F.col("mean") - F.col("_gm"))).alias("shrunk"),
                    "tau2", "s2")


def pool_effects(df: DataFrame, group: str, y: str, treat: str, treated: str, reference: str) -> DataFrame:
    """K6: partial pooling of per-group treatment effects.

    ``d_g`` = mean(treated) - mean(reference), ``v_g = var1/n1 + var0/n0``,
    ``tau2 = max(var_samp(d) - avg(v), 0)``, shrunk ``md + tau2/(tau2+v_g)
    (d_g - md)`` with ``md`` the mean effect.
    """
    t1, t0 = F.col(treat) == treated, F.col(treat) == reference
    yy = F.col(y)
    g = df.groupBy(group).agg(
        F.avg(F.when(t1, yy)).alias("_m1"), F.avg(F.when(t0, yy)).alias("_m0"),
        F.var_samp(F.when(t1, yy)).alias("_v1"), F.var_samp(F.when(t0, yy)).alias("_v0"),
        F.count(F.when(t1, yy)).alias("n1"), F.count(F.when(t0, yy)).alias("n0"))
    g = g.select(group, "n1", "n0", (F.col("_m1") - F.col("_m0")).alias("d"),
                 (F.col("_v1") / F.col("n1") + F.col("_v0") / F.col("n0")).alias("v"))
    tot = g.agg(F.avg("d").alias("_md"), F.greatest(F.var_samp("d") - F.avg("v"), F.lit(0.0)).alias("tau2"))
    j = attach_scalars(g, tot)
    w = F.col("tau2") / F.nullif(F.col("tau2") + F.col("v"), F.lit(0.0))
    return j.select(F.col(group).alias("grp"), "n1", "n0", "d", "v",
                    (F.col("_md") + F.coalesce(w, F.lit(0.0)) * (F.col("d") - F.col("_md"))).alias("shrunk"),
                    "tau2")


def among_within_correlation(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """K7: correlation of group means (among) and of residuals from group
    means (within), both guarded against zero variance (T1)."""
    g = within_sums(df, [group], [x, y])
    scale = F.nullif(F.sqrt(F.sum("s_0_0") * F.sum("s_1_1")), F.lit(0.0))
    return g.agg(guarded_corr(F.col("m_0"), F.col("m_1")).alias("r_among"), F.count(F.lit(1)).alias("groups"),
                 (F.sum("s_0_1") / scale).alias("r_within"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def hash_uniform(key: Column, rep: Column) -> Column:
    """A uniform number in [0, 1) from md5(key || '_' || rep): first 8 hex
    digits / 2^32.  Deterministic, no ``rand()``, independent across
    replicates (unlike a linear function of (key, rep))."""
    h = F.md5(F.concat(key.cast("string"), F.lit("_"), rep.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_uniform_fast(key: Column, rep: Column) -> Column:
    """A uniform number in [0, 1) from Spark's 64-bit ``xxhash64`` of (key,
    rep): no string building, much cheaper than md5 per (row, replicate).
    Deterministic, but other engines cannot reproduce it."""
    return F.pmod(F.xxhash64(key, rep), F.lit(4294967296)).cast("double") / F.lit(4294967296.0)


def poisson1_weight(u: Column) -> Column:
    """Inverse-CDF Poisson(1) weight of a uniform number."""
    w = F.lit(0)
    for c in POISSON1_CDF:
        w = w + F.when(u >= c, 1).otherwise(0)
    return w


def bootstrap_draws(df: DataFrame, key: str, y: str, x: str | None = None,
                    replicates: int = 100, hash_fn: str = "md5", by: Sequence[str] = ()) -> DataFrame:
    """K8: Poisson bootstrap draws of a weighted mean (and of a weighted
    simple slope of y on x).

    Every row emits its B replicate weights in place (``explode``), and the
    aggregation by replicate is partial on the map side, so only B partial
    sums per task (and per group of ``by``) are shuffled.  Returns (by...,
    iter, n_w, mean_<y>[, b_<x>]); ``as_draws`` gives the shared long shape.
    ``hash_fn="xxhash64"`` is the fast weight source for large inputs;
    ``md5`` (default) is reproducible by other engines.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("iter")
    src = df.where(F.col(y).isNotNull() & (F.col(x).isNotNull() if x else F.lit(True)))
    cols = [F.col(key), F.col(y), *[F.col(c) for c in by if c not in (key, y)]]
    if x:
        # The slope is shift-invariant: summing products of values shifted
        # by their (unweighted) means avoids the cancellation of raw sums.
        src = attach_scalars(src, src.agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy")))
        cols += [(F.col(x) - F.col("_cx")).alias("_xs"), (F.col(y) - F.col("_cy")).alias("_ys")]
    uni = hash_uniform_fast if hash_fn == "xxhash64" else hash_uniform
    w = src.select(*cols, rep).withColumn("_w", poisson1_weight(uni(F.col(key), F.col("iter"))))
    wy = F.col("_w") * F.col(y)
    aggs = [F.sum("_w").alias("_sw"), F.sum(wy).alias("_swy")]
    if x:
        wx = F.col("_w") * F.col("_xs")
        aggs += [F.sum(wx).alias("_swx"), F.sum(wx * F.col("_xs")).alias("_swxx"),
                 F.sum(wx * F.col("_ys")).alias("_swxy"), F.sum(F.col("_w") * F.col("_ys")).alias("_swys")]
    g = w.groupBy(*by, "iter").agg(*aggs)
    out = [*by, F.col("iter").cast("int").alias("iter"), F.col("_sw").cast("long").alias("n_w"),
           (F.col("_swy") / F.nullif(F.col("_sw"), F.lit(0))).alias(f"mean_{y}")]
    if x:
        num = F.col("_sw") * F.col("_swxy") - F.col("_swx") * F.col("_swys")
        den = F.col("_sw") * F.col("_swxx") - F.col("_swx") * F.col("_swx")
        out.append((num / F.nullif(den, F.lit(0.0))).alias(f"b_{x}"))
    return g.select(*out)


#: Uniform numbers out of one hash: groups of eight hex digits.
PER_HASH = 8


def bootstrap_weights(df: DataFrame, key: str, replicates: int) -> DataFrame:
    """Rows times replicates (``iter`` from 1) with a Poisson(1) weight ``_w``
    above zero.  One sha256 of the key and a block's number, ``<key>_<block>``,
    gives the weights of ``PER_HASH`` replicates."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // PER_HASH)))
    h = df.withColumn("_blk", blocks)
    h = h.withColumn("_h", F.sha2(F.concat(F.col(key).cast("string"), F.lit("_"), F.col("_blk").cast("string")), 256))
    h = h.withColumn("_j", F.explode(F.sequence(F.lit(0), F.least(F.lit(PER_HASH), replicates - F.col("_blk") * PER_HASH) - 1)))
    u = F.conv(F.substring("_h", F.col("_j") * 8 + 1, F.lit(8)), 16, 10).cast("long") / F.lit(4294967296.0)
    h = h.withColumn("_u", u).where(F.col("_u") >= POISSON1_CDF[0])
    w = F.lit(len(POISSON1_CDF))
    for i in reversed(range(1, len(POISSON1_CDF))):
        w = F.when(F.col("_u") < POISSON1_CDF[i], i).otherwise(w)
    return (h.withColumn("_w", w.cast("double")).withColumn("iter", F.col("_blk") * PER_HASH + F.col("_j") + 1)
            .drop("_blk", "_h", "_j", "_u"))


def bootstrap_regression(df: DataFrame, key: str, group: str, y: str, xs: Sequence[str], replicates: int = 100,
                         model: str = "boot", chain: int = 1) -> DataFrame:
    """K8 on K4: in each Poisson-bootstrap replicate the weighted regression
    ``y ~ xs`` with group intercepts, as long draws (model, chain, iter, par,
    value) with the parameters ``b_<x>`` and ``sigma``.

    Rows emit their weights in place; sums of products of values, shifted by
    their overall means, are added per (group, replicate) on the map side;
    what is left is one row per replicate, all systems solved in one
    projection.  Rows with a NULL are left out; a replicate in which a
    predictor is determined by those before it gives no rows.
    """
    k, cols = len(xs), [*xs, y]
    src = df.dropna(subset=cols)
    src = attach_scalars(src.select(key, group, *cols), src.agg(*[F.avg(c).alias(f"_c{i}") for i, c in enumerate(cols)]))
    src = src.select(key, group, *[(F.col(c) - F.col(f"_c{i}")).alias(f"z_{i}") for i, c in enumerate(cols)])
    w = bootstrap_weights(src, key, replicates)
    wz = [F.col("_w") * F.col(f"z_{i}") for i in range(k + 1)]
    g = w.groupBy(group, "iter").agg(F.sum("_w").alias("_sw"), *[F.sum(wz[i]).alias(f"t_{i}") for i in range(k + 1)],
                                     *[F.sum(wz[i] * F.col(f"z_{j}")).alias(f"p_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)])
    within = [F.sum(F.col(f"p_{i}_{j}") - F.col(f"t_{i}") * F.col(f"t_{j}") / F.col("_sw")).alias(f"s_{i}_{j}")
              for i in range(k + 1) for j in range(i, k + 1)]
    sums = g.groupBy("iter").agg(*within, F.sum("_sw").alias("_n"), F.count(F.lit(1)).alias("_g"))
    fit = _solved(sums, k, F.col("_n"), F.col("_g"), ["iter"])
    items = [F.struct(F.lit(f"b_{x}").alias("par"), F.get("_b", F.lit(i)).alias("value")) for i, x in enumerate(xs)]
    items.append(F.struct(F.lit("sigma").alias("par"), F.col("sigma").alias("value")))
    return (fit.select(F.col("iter").cast("long").alias("iter"), F.explode(F.array(*items)).alias("_p"))
            .select(F.lit(model).alias("model"), F.lit(chain).alias("chain"), "iter", "_p.par", "_p.value").where("value IS NOT NULL"))


def pool_correlated(df: DataFrame, group: str, ys: Sequence[str], treat: str, treated: str, reference: str,
                    effects: str = "both") -> DataFrame:
    """K5 / K6 with correlated group effects over several responses: (grp,
    n1, n0, raw, shrunk, between), arrays over the effects.

    A group's effects are, per response, the mean under ``reference`` and the
    difference that ``treated`` makes (``effects="both"``), or the
    differences only (``"treatment"``).  Their sampling covariance V_g comes
    from the covariances of the responses within (group, treatment); the
    between-group covariance by moments is T = cov(effects) - mean(V_g),
    with negative eigenvalues set to zero; each group's effects are shrunk
    to the mean effects m by ``m + T (T + V_g)^-1 (d_g - m)``.  Rows with a
    NULL in ys are left out, and groups with fewer than two rows of either
    treatment.  ``between`` is T.
    """
    r = len(ys)
    d = df.where(F.col(treat).isin(treated, reference)).dropna(subset=list(ys))
    cells = within_sums(d.withColumn("_t", (F.col(treat) == treated).cast("int")), [group, "_t"], list(ys))
    cells = cells.where("n >= 2").groupBy(group).agg(*[
        F.max(F.when(F.col("_t") == t, F.struct("n", F.array(*[F.col(f"m_{i}") for i in range(r)]).alias("m"), F.array(*[
            F.array(*[F.col(f"s_{min(i, j)}_{max(i, j)}") / (F.col("n") - 1) / F.col("n") for j in range(r)])
            for i in range(r)]).alias("v")))).alias(f"c{t}") for t in (0, 1)]).where("c0 IS NOT NULL AND c1 IS NOT NULL")

    def m(t, i):
        return F.get(F.col(f"c{t}.m"), F.lit(i))

    def v(t, i, j):
        return F.get(F.get(F.col(f"c{t}.v"), F.lit(i)), F.lit(j))

    kinds = ("mean", "diff") if effects == "both" else ("diff",)
    names = [(kind, i) for i in range(r) for kind in kinds]

    def cov(a, b):
        (ka, i), (kb, j) = a, b
        if ka == kb == "diff":
            return v(0, i, j) + v(1, i, j)
        return v(0, i, j) if ka == kb else -v(0, i, j)

    g = cells.select(F.col(group).alias("grp"), F.col("c1.n").alias("n1"), F.col("c0.n").alias("n0"),
                     F.array(*[m(0, i) if kind == "mean" else m(1, i) - m(0, i) for kind, i in names]).alias("raw"),
                     F.array(*[F.array(*[cov(a, b) for b in names]) for a in names]).alias("_v"))
    k = len(names)
    one = g.agg(F.array(*[F.avg(F.get("raw", F.lit(i))) for i in range(k)]).alias("_m"), F.array(*[F.array(*[
        F.covar_samp(F.get("raw", F.lit(i)), F.get("raw", F.lit(j))) - F.avg(F.get(F.get("_v", F.lit(i)), F.lit(j)))
        for j in range(k)]) for i in range(k)]).alias("_t"))
    one = one.select("_m", L.nearest_valid(F.col("_t")).alias("between"))
    j = attach_scalars(g, one).withColumn("_d", F.zip_with("raw", "_m", lambda a, b: a - b))
    j = j.withColumn("_s", L.times(F.col("between"), L.solve(L.matrix_add(F.col("between"), F.col("_v")), F.col("_d"))))
    return j.select("grp", "n1", "n0", "raw", F.zip_with("_m", "_s", lambda a, b: a + b).alias("shrunk"), "between")


def as_draws(boot: DataFrame, model: str, values: dict[str, str], by: Sequence[str] = (),
             chain: int = 1) -> DataFrame:
    """K8 output in the shared shape ``(model, chain, iter, par, value)``:
    ``values`` maps a column to its parameter's base name, which carries the
    groups of ``by`` as an index (``mean[A]``)."""
    index = F.concat(F.lit("["), F.concat_ws(",", *[F.col(c).cast("string") for c in by]), F.lit("]")) if by else F.lit("")
    items = [F.struct(F.concat(F.lit(name), index).alias("par"), F.col(c).cast("double").alias("value"))
             for c, name in values.items()]
    return (boot.select(F.col("iter").cast("long").alias("iter"), *by, F.explode(F.array(*items)).alias("_p"))
            .select(F.lit(model).alias("model"), F.lit(chain).alias("chain"), "iter", "_p.par", "_p.value"))
