"""Analytics over long draws ``(model, chain, iter, par, value)``.

D10-D14, D17-D20, E1, E3, K14, K15, K17-K19.  Draws stay long and every
statistic is a ``groupBy`` over the parameter keys.  Order statistics
(median, quantiles, shortest interval) use the exact, parallel methods of
``ranking``, so a parameter holding most of the draws is still spread over
many tasks; every later step works on per-parameter results that are tiny.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg
from ..session import cut_lineage
from .ranking import group_quantiles, join_groups, rank_within, tails

KEYS = ("par",)


def dense_index(df: DataFrame, keys: Sequence[str], order: str, out: str = "iter",
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """1-based draw number within ``keys`` ordered by ``order``.

    Prefer a stored (chain, iter); this derives one in parallel when the
    source has none.
    """
    return rank_within(df, keys, order, tiebreak, rank_col=out, count_col="_n").drop("_n")


def rank_draws(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
               tiebreak: Sequence[str] = ("chain", "iter")) -> DataFrame:
    """Rank values within each parameter (columns ``rn``, ``n``)."""
    tb = [t for t in tiebreak if t in draws.columns and t not in keys and t != value]
    src = draws.select(*keys, value, *tb)
    return rank_within(src.where(F.col(value).isNotNull()), keys, value, tb)


def tail_p(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
           median: DataFrame | None = None) -> DataFrame:
    """Two-sided tail probability of the draws.

    ``m > 0 ? 2 (1 - #{v > 0}/n) : 2 (1 - #{v < 0}/n)`` with NULLs removed
    first; zeros count toward neither sign (as in the reference).
    """
    keys = list(keys)
    v = F.col(value)
    cnt = (draws.where(v.isNotNull()).groupBy(*keys)
           .agg(F.sum(F.when(v > 0, 1).otherwise(0)).alias("_pos"),
                F.sum(F.when(v < 0, 1).otherwise(0)).alias("_neg"),
                F.count(F.lit(1)).alias("_n")))
    if median is None:
        median = group_quantiles(draws, keys, value, [0.5], ["median"])
    j = join_groups(cnt, median.select(*keys, "median"), keys)
    n = F.col("_n").cast("double")
    p = F.when(F.col("median") > 0, 2 * (1 - F.col("_pos") / n)).otherwise(2 * (1 - F.col("_neg") / n))
    return j.select(*keys, p.alias("p"))


def quantile_interval(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
                      width: float = 0.95, point: bool = True) -> DataFrame:
    """D11 (+ D9): linear-interpolation quantiles at (1-w)/2 and (1+w)/2."""
    probs = [(1 - width) / 2, (1 + width) / 2]
    names = ["lower", "upper"]
    if point:
        probs.append(0.5)
        names.append("median")
    return group_quantiles(draws, keys, value, probs, names)


def hpd_interval(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
                 width: float = 0.95) -> DataFrame:
    """D12 (+ E3): shortest interval holding ``floor(w n) + 1`` sorted draws
    (NULL bounds where there is no such pair).

    Sorted draws v_1..v_n, k = floor(w n); among pairs (v_r, v_{r+k}) the
    smallest difference wins, ties to the smallest r.  r is among the lowest
    n - k ranks and r + k among the highest, so only the two ends of each
    group (``ranking.tails``, about 1 - w of the draws each) are written and
    ranked.  The pairs come from an equi-join of the ends on (keys, r + k),
    which partitions on the rank, never on the parameter alone.
    """
    keys = list(keys)
    tb = [t for t in ("chain", "iter") if t in draws.columns and t not in keys and t != value]
    ends = cut_lineage(tails(draws, keys, value, 1 - width, tb), "ends")
    k = F.floor(F.lit(float(width)) * F.col("_n")).cast("long")
    r = rank_within(ends, ["_of", "_side"], value, tb, rank_col="_r", count_col="_c").withColumn("_k", k)
    a = r.where("_side = 0 AND _r <= greatest(_n - _k, 1)").select(
        "_of", (F.col("_r") + F.col("_k")).alias("_at"), "_r", F.col(value).alias("_lo"))
    b = r.where("_side = 1").select("_of", (F.col("_r") + F.col("_n") - F.col("_c")).alias("_at"), F.col(value).alias("_hi")).where("_at IS NOT NULL")
    pairs = a.join(b, ["_of", "_at"], "left")
    best = pairs.groupBy("_of").agg(F.min(F.when(F.col("_hi").isNotNull(), F.struct(
        (F.col("_hi") - F.col("_lo")).alias("_w"), "_r", "_lo", "_hi"))).alias("_m"))
    return best.select(*[F.col(f"_of.{c}").alias(c) for c in keys], F.col("_m._lo").alias("lower"),
                       F.col("_m._hi").alias("upper"))


def hdr_pieces(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
               width: float = 0.95, bins: int = 50) -> DataFrame:
    """Highest-density region from an equal-bin histogram; may have
    several pieces.

    Bins on [min, max] (last bin closed) are taken by count (ties by bin id)
    while the mass before them is < w n; runs of consecutive kept bins are
    the pieces, numbered from the lowest.  Only the histogram (groups x
    bins rows) is windowed.
    """
    keys = list(keys)
    v = F.col(value)
    d = draws.where(v.isNotNull())
    stats = d.groupBy(*keys).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"),
                                 F.count(F.lit(1)).alias("_n"))
    stats = stats.withColumn("_bw", (F.col("_mx") - F.col("_mn")) / F.lit(float(bins)))
    binned = join_groups(d, stats.select(*keys, "_mn", "_bw"), keys).withColumn(
        "_bin", F.coalesce(F.least(F.floor((v - F.col("_mn")) / F.nullif(F.col("_bw"), F.lit(0.0))),
                                   F.lit(bins - 1)), F.lit(0)).cast("int"))
    hist = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    hist = join_groups(hist, stats, keys)
    w_take = Window.partitionBy(*keys).orderBy(F.col("_c").desc(), F.col("_bin")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    kept = (hist.withColumn("_before", F.coalesce(F.sum("_c").over(w_take), F.lit(0)))
            .where(F.col("_before") < F.lit(float(width)) * F.col("_n")))
    w_isl = Window.partitionBy(*keys).orderBy("_bin")
    kept = kept.withColumn("_island", F.col("_bin") - F.row_number().over(w_isl))
    pieces = kept.groupBy(*keys, "_island").agg(
        F.min("_bin").alias("_b0"), F.max("_bin").alias("_b1"), F.sum("_c").alias("n_in"),
        F.first("_mn").alias("_mn"), F.first("_bw").alias("_bw"))
    pieces = pieces.withColumn("piece", F.row_number().over(Window.partitionBy(*keys).orderBy("_b0")))
    return pieces.select(*keys, F.col("piece").cast("int").alias("piece"),
                         (F.col("_mn") + F.col("_b0") * F.col("_bw")).alias("lower"),
                         (F.col("_mn") + (F.col("_b1") + 1) * F.col("_bw")).alias("upper"),
                         F.col("n_in").cast("long").alias("n_in"))


def hdr_density(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", width: float = 0.95,
                points: int = 128) -> DataFrame:
    """D13 on a kernel density: pieces (keys, piece, lower, upper, mass).

    Per group a Gaussian density on ``points`` even grid points from the least
    to the largest draw, bandwidth ``0.9 min(sd, (q75 - q25) / 1.34) n^-0.2``
    (sd where the quartiles are equal).  Draws are dealt to their two grid
    neighbours in proportion (linear binning), so the convolution runs over
    the histogram: groups x points^2 pairs, however many draws.  Grid points
    are taken by density (ties by position) while the share of density before
    them is under ``width``; runs of neighbours are the pieces, numbered from
    the lowest, and ``mass`` is their share.  A group whose draws are all
    equal is one piece of width 0; NULLs are left out.
    """
    keys = list(keys)
    v = F.col(value)
    d = draws.where(v.isNotNull()).select(*keys, v.cast("double").alias("_v"))
    st = join_groups(d.groupBy(*keys).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), F.stddev_samp("_v").alias("_sd"),
                                          F.count(F.lit(1)).alias("_n")),
                     group_quantiles(d, keys, "_v", [0.25, 0.75], ["_q1", "_q3"]), keys)
    iqr = (F.col("_q3") - F.col("_q1")) / 1.34
    low = F.when(iqr > 0, F.least("_sd", iqr)).otherwise(F.col("_sd"))
    st = st.select(*keys, "_mn", "_mx", "_n", ((F.col("_mx") - F.col("_mn")) / (points - 1)).alias("_step"),
                   (0.9 * low * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_bw"))
    at = F.when(F.col("_step") > 0, F.least((F.col("_v") - F.col("_mn")) / F.col("_step"), F.lit(points - 1.0))).otherwise(0.0)
    b = join_groups(d, st.select(*keys, "_mn", "_step"), keys).withColumn("_x", at).withColumn("_i", F.floor("_x").cast("int"))
    rest = F.col("_x") - F.col("_i")
    two = F.array(F.struct(F.col("_i").alias("i"), (1 - rest).alias("w")), F.struct((F.col("_i") + 1).alias("i"), rest.alias("w")))
    hist = (b.select(*keys, F.explode(two).alias("_b")).where("_b.w > 0")
            .groupBy(*keys, F.col("_b.i").alias("_i")).agg(F.sum("_b.w").alias("_w")))
    spread = join_groups(hist, st, keys).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (F.col("_i") - F.col("_j")) * F.col("_step") / F.col("_bw")
    kernel = F.when(F.col("_step") > 0, F.exp(-0.5 * z * z)).otherwise((F.col("_i") == F.col("_j")).cast("double"))
    dens = spread.groupBy(*keys, "_j").agg(F.sum(F.col("_w") * kernel).alias("_y"), F.first("_mn").alias("_mn"), F.first("_step").alias("_step"))
    every = Window.partitionBy(*keys)
    taken = every.orderBy(F.col("_y").desc(), F.col("_j")).rowsBetween(Window.unboundedPreceding, -1)
    kept = (dens.where("_y > 0").withColumn("_share", F.col("_y") / F.sum("_y").over(every))
            .withColumn("_before", F.coalesce(F.sum("_share").over(taken), F.lit(0.0))).where(F.col("_before") < F.lit(float(width))))
    kept = kept.withColumn("_island", F.col("_j") - F.row_number().over(every.orderBy("_j")))
    pieces = kept.groupBy(*keys, "_island").agg(F.min("_j").alias("_j0"), F.max("_j").alias("_j1"), F.sum("_share").alias("mass"),
                                                F.first("_mn").alias("_mn"), F.first("_step").alias("_step"))
    pieces = pieces.withColumn("piece", F.row_number().over(every.orderBy("_j0")).cast("int"))
    return pieces.select(*keys, "piece", (F.col("_mn") + F.col("_j0") * F.col("_step")).alias("lower"),
                         (F.col("_mn") + F.col("_j1") * F.col("_step")).alias("upper"), "mass")


def point_interval(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
                   width: float = 0.95, point: str = "median",
                   interval: str = "hpd", piece: str = "first") -> DataFrame:
    """Point estimate + interval for every group of a long table.

    ``interval`` is ``hpd`` (shortest, D12), ``quantile`` (D11) or ``hdr``:
    one D13 piece, the lowest (``piece="first"``) or the one holding the most
    draws (``"heaviest"``); all pieces: ``hdr_pieces``.
    """
    keys = list(keys)
    if point == "median":
        pt = group_quantiles(draws, keys, value, [0.5], ["point"])
    else:
        pt = draws.groupBy(*keys).agg(F.avg(value).alias("point"))
    if interval == "hpd":
        iv = hpd_interval(draws, keys, value, width)
    elif interval == "quantile":
        iv = quantile_interval(draws, keys, value, width, point=False)
    elif interval == "hdr":
        pieces = hdr_pieces(draws, keys, value, width)
        first = [F.col("piece")] if piece == "first" else [F.col("n_in").desc(), F.col("piece")]
        pick = Window.partitionBy(*keys).orderBy(*first)
        iv = (pieces.withColumn("_pick", F.row_number().over(pick)).where(F.col("_pick") == 1)
              .select(*keys, "lower", "upper"))
    else:
        raise ValueError(f"unknown interval {interval!r}")
    return (join_groups(pt, iv, keys)
            .withColumn("width", F.lit(float(width)))
            .withColumn("point_method", F.lit(point))
            .withColumn("interval_method", F.lit(interval)))


def split_rhat(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
               chain: str = "chain", it: str = "iter") -> DataFrame:
    """Split R-hat.

    Each chain is cut in halves by the position of its draws in ``it`` order
    (so thinned or renumbered draws give the same halves); per half the mean,
    variance and size; then ``W = avg(var)``, ``B/n = var(means)`` and
    ``sqrt(((n-1)/n W + B/n) / W)``.
    """
    keys = list(keys)
    x = rank_within(draws.select(*keys, chain, it, value), keys + [chain], it, rank_col="_at", count_col="_nc")
    x = x.withColumn("_half", F.when(F.col("_at") * 2 <= F.col("_nc"), 1).otherwise(2))
    per = x.groupBy(*keys, chain, "_half").agg(F.avg(value).alias("_m"),
                                               F.var_samp(value).alias("_s2"),
                                               F.count(F.lit(1)).alias("_k"))
    g = per.groupBy(*keys).agg(F.avg("_s2").alias("_W"), F.var_samp("_m").alias("_Bn"),
                               F.avg("_k").alias("_nbar"))
    nb = F.col("_nbar")
    rhat = F.sqrt(((nb - 1) / nb * F.col("_W") + F.col("_Bn")) / F.nullif(F.col("_W"), F.lit(0.0)))
    return g.select(*keys, rhat.alias("rhat"))


#: Draws of a chain in one array, for products at a lag.
BLOCK = 1024


def _chain_blocks(draws: DataFrame, keys: list, value: str, chain: str, it: str) -> DataFrame:
    """(keys..., chain, _blk, _d): deviations from the chain's mean in arrays
    of ``BLOCK`` consecutive draws (by position in ``it`` order), and the
    chain's ``_nc``, ``_cm``, ``_cv``."""
    at = rank_within(draws.select(*keys, chain, it, value), keys + [chain], it, rank_col="_at", count_col="_all")
    cs = draws.groupBy(*keys, chain).agg(F.avg(value).alias("_cm"), F.var_samp(value).alias("_cv"), F.count(F.lit(1)).alias("_nc"))
    d = join_groups(at.select(*keys, chain, "_at", F.col(value).alias("_v")), cs, keys + [chain])
    return (d.groupBy(*keys, chain, "_nc", "_cm", "_cv", F.floor((F.col("_at") - 1) / BLOCK).alias("_blk"))
            .agg(F.array_sort(F.collect_list(F.struct("_at", (F.col("_v") - F.col("_cm")).alias("d")))).alias("_s"))
            .select(*keys, chain, "_nc", "_cm", "_cv", "_blk", F.transform("_s", lambda x: x["d"]).alias("_d")))


def _ess_pairs(blocks: DataFrame, gs: DataFrame, keys: list, chain: str, lo: int, hi: int) -> DataFrame:
    """Geyer pair sums (keys..., _k, _P, _m, _n, _L) of lags lo <= t < hi (both
    even) below the group's lag cap.

    A block's draws meet those at lag t in the block t / BLOCK further on and
    the one after it, joined into one array: a join on (chain, block), then
    one product sum per (block, lag), added over blocks.
    """
    far = blocks.withColumn("_m", F.explode(F.sequence(F.lit(lo // BLOCK), F.lit((hi - 1) // BLOCK))))
    right = blocks.select(*[F.col(c).alias(f"_r_{c}") for c in (*keys, chain)], F.col("_blk").alias("_rb"), F.col("_d").alias("_rd"))

    def beside(df: DataFrame, step: int, name: str) -> DataFrame:
        cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in (*keys, chain)] + [F.col("_blk") + F.col("_m") + step == F.col("_rb")]
        return (df.join(right, cond, "inner" if step == 0 else "left").withColumnRenamed("_rd", name)
                .drop("_rb", *[f"_r_{c}" for c in (*keys, chain)]))

    both = beside(beside(far, 0, "_x"), 1, "_y")
    both = both.withColumn("_x", F.concat("_x", F.coalesce("_y", F.array().cast("array<double>"))))
    first, last = F.greatest(F.lit(lo), F.col("_m") * BLOCK), F.least(F.lit(hi), (F.col("_m") + 1) * BLOCK) - 1
    lagged = both.withColumn("_t", F.explode(F.sequence(first, last))).where(F.col("_t") - F.col("_m") * BLOCK < F.size("_x"))
    there = F.slice("_x", (F.col("_t") - F.col("_m") * BLOCK + 1).cast("int"), F.size("_d"))
    product = linalg.total(F.zip_with(there, "_d", lambda x, y: F.coalesce(x * y, F.lit(0.0))))
    acov = lagged.groupBy(*keys, chain, "_t").agg((F.sum(product) / F.first("_nc")).alias("_ac"))
    g = (join_groups(acov.groupBy(*keys, "_t").agg(F.avg("_ac").alias("_g")), gs, keys)
         .where(F.col("_t") < F.col("_L")))
    n = F.col("_n").cast("double")
    varp = (n - 1) / n * F.col("_W") + F.coalesce(F.col("_Bn"), F.lit(0.0))
    rho = 1 - (F.col("_W") - F.col("_g") * n / (n - 1)) / F.nullif(varp, F.lit(0.0))
    g = g.withColumn("_rho", rho).withColumn("_k", F.floor(F.col("_t") / 2))
    return g.groupBy(*keys, "_k").agg(F.sum("_rho").alias("_P"), F.first("_m").alias("_m"),
                                      F.first("_n").alias("_n"), F.first("_L").alias("_L"))


def ess(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
        chain: str = "chain", it: str = "iter", first_lags: int = 16) -> DataFrame:
    """Effective sample size with Geyer's initial positive sequence.

    Lags count positions within the chain in ``it`` order, so thinning does
    not change them.  Lag-t autocovariances (t < L, L = even part of n/2) are
    sums of products over blocks of ``BLOCK`` draws, each with the part of the
    chain t further on; the blocks are written once.
    ``rho_t = 1 - (W - g_t n/(n-1)) / var+``; pairs ``P_k = rho_2k +
    rho_2k+1`` are kept up to the first negative one, made non-increasing
    by a running minimum, and ``ESS = m n / (-1 + 2 sum P_k)``.

    Lags are computed in rounds up to four times as far each, only the new
    ones: the sum stops at the first negative pair, so once every group has
    stopped inside the computed lags (or has no more), later lags cannot
    change the result.  A round's table (groups x new lags / 2 rows) is
    written, as the check and the result both read it.
    """
    keys = list(keys)
    blocks = cut_lineage(_chain_blocks(draws, keys, value, chain, it), "ess-blocks")
    cs = blocks.groupBy(*keys, chain).agg(*[F.first(c).alias(c) for c in ("_nc", "_cm", "_cv")])
    gs = cs.groupBy(*keys).agg(F.min("_nc").alias("_n"), F.count(F.lit(1)).alias("_m"),
                               F.avg("_cv").alias("_W"), F.var_samp("_cm").alias("_Bn"))
    gs = gs.withColumn("_L", F.floor(F.col("_n") / 2))
    gs = gs.withColumn("_L", F.col("_L") - F.col("_L") % 2)
    done, lo, hi = None, 0, first_lags + first_lags % 2
    while True:
        new = cut_lineage(_ess_pairs(blocks, gs, keys, chain, lo, hi), "ess-pairs")
        done = new if done is None else done.unionByName(new)
        state = done.groupBy(*keys).agg(F.min(F.when(F.col("_P") < 0, F.col("_k"))).alias("_stop"), F.first("_L").alias("_L"))
        if state.where(F.col("_stop").isNull() & (F.col("_L") > hi)).limit(1).count() == 0:
            break
        lo, hi = hi, hi * 4
    pk = join_groups(done, state.drop("_L"), keys).where(F.col("_stop").isNull() | (F.col("_k") < F.col("_stop")))
    wk = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    pk = pk.withColumn("_Pm", F.min("_P").over(wk))
    tot = pk.groupBy(*keys).agg(F.sum("_Pm").alias("_S"), F.first("_m").alias("_m"),
                                F.first("_n").alias("_n"))
    e = F.col("_m") * F.col("_n") / F.nullif(-1 + 2 * F.col("_S"), F.lit(0.0))
    return tot.select(*keys, e.alias("ess"))


def summarise_draws(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
                    estimate: str = "mean", interval: str = "quantile", width: float = 0.95,
                    rhat: bool = False, with_ess: bool = False, p: bool = True,
                    term: str | None = "term") -> DataFrame:
    """D17/D18 + D11/D12 + D10 (+ D19, D20): the estimate table.

    ``estimate`` is ``mean`` or ``median`` (a ``method`` column records which,
    Q6); ``interval`` is ``quantile`` or ``hpd`` (recorded in ``interval``,
    Q5).  Each statistic is a small per-key table; they are joined on the
    keys (C5: p-values are left-joined).
    """
    keys = list(keys)
    v = F.col(value)
    # one pass for the moments and the tail-p sign counts (NULLs skipped)
    mom = draws.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("std_error"),
                                   F.sum(F.when(v > 0, 1).otherwise(0)).alias("_pos"),
                                   F.sum(F.when(v < 0, 1).otherwise(0)).alias("_neg"),
                                   F.count(v).alias("_cnt"))
    if interval == "hpd":
        q = join_groups(group_quantiles(draws, keys, value, [0.5], ["median"]),
                        hpd_interval(draws, keys, value, width), keys)
    else:
        q = quantile_interval(draws, keys, value, width, point=True)
    out = join_groups(mom, q, keys)
    est = F.col("_mean") if estimate == "mean" else F.col("median")
    n = F.col("_cnt").cast("double")
    tail = F.when(F.col("median") > 0, 2 * (1 - F.col("_pos") / n)).otherwise(2 * (1 - F.col("_neg") / n))
    cols = [*keys, est.alias("estimate"), "std_error",
            F.col("lower").alias("conf_low"), F.col("upper").alias("conf_high")]
    if p:
        cols.append(tail.alias("p"))   # D10, same rule as ``tail_p``
    out = out.select(*cols)
    if rhat:
        out = join_groups(out, split_rhat(draws, keys, value), keys, "left")
    if with_ess:
        out = join_groups(out, ess(draws, keys, value), keys, "left")
    out = (out.withColumn("method", F.lit(estimate))
           .withColumn("interval", F.lit(interval)))
    if term and len(keys) == 1 and keys[0] != term:
        out = out.withColumnRenamed(keys[0], term)
    return out


def add_base(draws: DataFrame, effect: str, base: str, by: Sequence[str] = ("iter",), par: str = "par",
             value: str = "value") -> DataFrame:
    """Population + group effect per draw, both out of one long table.

    Rows of the effect are those whose parameter matches the pattern
    ``effect`` (its first group is the level); the base is the parameter named
    ``base``.  Returns (by..., level, value): effect + base of the same draw.
    """
    by = list(by)
    b = draws.where(F.col(par) == base).select(*by, F.col(value).alias("_base"))
    e = (draws.where(F.col(par).rlike(effect))
         .select(*by, F.regexp_extract(F.col(par), effect, 1).alias("level"), F.col(value).alias("_e")))
    return join_groups(e, b, by).select(*by, "level", (F.col("_e") + F.col("_base")).alias(value))


def ratio(num: Column, den: Column) -> Column:
    """Ratio that is NULL on a zero denominator."""
    return num / F.nullif(den, F.lit(0.0))


def thin(draws: DataFrame, warmup: int = 0, every: int = 1, it: str = "iter") -> DataFrame:
    """Keep every k-th iteration after warm-up (a sampling operator)."""
    c = F.col(it)
    return draws.where((c > warmup) & (c % every == 0))


def check_draws(draws: DataFrame, keys: Sequence[str] = KEYS, value: str = "value",
                lower: float | None = None, upper: float | None = None,
                chain: str = "chain", clip: tuple[float, float] | None = None) -> DataFrame:
    """K17 (+ B16): validity report per parameter.

    Counts per chain (equal counts required when draws of separate fits
    are paired by position, Q3), bound violations, and how many values an
    axis clip would hide.
    """
    keys = list(keys)
    v = F.col(value)
    per_chain = draws.groupBy(*keys, chain).agg(
        F.count(F.lit(1)).alias("_c"),
        F.sum(F.when(((v < lower) if lower is not None else F.lit(False))
                     | ((v > upper) if upper is not None else F.lit(False)), 1).otherwise(0)).alias("_bad"),
        F.sum(F.when(v.isNull(), 1).otherwise(0)).alias("_null"),
        F.sum(F.when(~v.between(clip[0], clip[1]), 1).otherwise(0)).alias("_clip")
        if clip else F.lit(0).alias("_clip"))
    g = per_chain.groupBy(*keys).agg(
        F.sum("_c").cast("long").alias("n_draws"), F.count(F.lit(1)).alias("n_chains"),
        F.min("_c").cast("long").alias("min_chain_n"), F.max("_c").cast("long").alias("max_chain_n"),
        F.sum("_bad").cast("long").alias("n_out_of_bounds"), F.sum("_null").cast("long").alias("n_null"),
        F.sum("_clip").cast("long").alias("n_clipped"))
    return g.withColumn("equal_chains", F.col("min_chain_n") == F.col("max_chain_n"))


def check_correlations(draws: DataFrame, corr: str, keys: Sequence[str] = (), tiny: float = linalg.TINY) -> DataFrame:
    """K17 for drawn correlation matrices (an array column): per ``keys`` the
    draws, those with a NULL entry, and those that are not a valid
    correlation matrix (bounds, symmetry, positive definite; NULLs included)."""
    c = F.col(corr)
    whole = F.coalesce(F.forall(c, lambda row: F.forall(row, lambda x: x.isNotNull())), F.lit(False))
    valid = linalg.is_correlation(c, tiny)
    checked = draws.select(*keys, whole.alias("_whole"), valid.alias("_valid"))
    return checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_draws"), F.count_if(~F.col("_whole")).alias("n_incomplete"),
                                      F.count_if(~F.col("_valid")).alias("n_invalid"))


def correlation_bounds_ok(col: Column) -> Column:
    """A correlation draw lies in [-1, 1]."""
    return col.between(-1.0, 1.0)
