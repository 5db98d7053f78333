"""The registered queries over the driver's tables.

Each function builds the Spark plan; the ``sql`` next to it is the oracle
with the same meaning.  Views come from ``views`` (DataFrame) and
``views.SQL`` (text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..functions.biophysics import gsmax_sql
from ..operators import draws as D
from ..operators import summary as S
from ..operators import traits as TR
from . import views as V
from .registry import query

W = V.with_views


# ------------------------------------------------------------------ trait tables

@query("pair_collapse", "k sd:d sp:d", W("C") + "SELECT k, sd, sp FROM c")
def pair_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces F/O of each order collapsed to one row (sum / mean)."""
    return V.pair_collapse_p(spark, d)


@query("join_full_plants", "k sd:d sp:d spp treatment gs:d side",
       W("C", "G") + "SELECT coalesce(c.k, g.k) AS k, c.sd, c.sp, g.spp, g.treatment, g.gs, "
       "CASE WHEN c.k IS NOT NULL AND g.k IS NOT NULL THEN 'both' WHEN c.k IS NOT NULL "
       "THEN 'left_only' ELSE 'right_only' END AS side FROM c FULL OUTER JOIN g ON c.k = g.k")
def join_full_plants(spark: SparkSession, d: str) -> DataFrame:
    """Full join of collapsed plants with the leaf table, with the
    side each row came from (key overlap)."""
    return TR.join_plants(V.pair_collapse_p(spark, d), V.leaf(spark, d), ["k"], "full",
                          indicator="side")


@query("gsmax_trait", "k sd:d sp:d gsmax:d",
       W("C") + f"SELECT k, sd, sp, {gsmax_sql('sd', 'sp')} AS gsmax FROM c")
def gsmax_trait(spark: SparkSession, d: str) -> DataFrame:
    """Anatomical maximum conductance with unit check."""
    return TR.add_gsmax(V.pair_collapse_p(spark, d))


@query("unit_conversion", "k sd_m2:d sp_mm:d gsmax_mmol:d",
       W("C") + f"SELECT k, sd * 1e6 AS sd_m2, sp * 1e-3 AS sp_mm, {gsmax_sql('sd', 'sp')} * 1e3 AS gsmax_mmol FROM c")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Columns carry units; density to 1/m^2, pore length to mm and gsmax
    to mmol, then plain numbers."""
    pl = TR.add_gsmax(V.pair_collapse_p(spark, d))
    for col, unit in (("sd", "1/m^2"), ("sp", "mm"), ("gsmax", "mmol/m^2/s")):
        pl = units.convert(pl, col, unit)
    pl = units.drop_units(pl)
    return pl.select("k", F.col("sd").alias("sd_m2"), F.col("sp").alias("sp_mm"), F.col("gsmax").alias("gsmax_mmol"))


def _plants_complete(spark: SparkSession, d: str) -> DataFrame:
    pl = TR.add_gsmax(V.pair_collapse_p(spark, d)).join(V.leaf(spark, d), "k")
    return pl.dropna(subset=["sd", "sp"])


_SUM_COLS = ("sd", "sp", "gsmax")


def _trait_summary_sql() -> str:
    parts = []
    for c in _SUM_COLS:
        se = f"stddev_samp({c}) / sqrt(count(*))"
        parts += [f"avg({c}) AS {c}", f"stddev_samp({c}) AS sd_{c}", f"{se} AS se_{c}",
                  f"avg({c}) - {se} AS lower_{c}", f"avg({c}) + {se} AS upper_{c}"]
    return (W("C", "G") + ", pl AS (SELECT c.k, g.spp, g.treatment, c.sd, c.sp, "
            f"{gsmax_sql('c.sd', 'c.sp')} AS gsmax FROM c JOIN g ON c.k = g.k "
            "WHERE c.sd IS NOT NULL AND c.sp IS NOT NULL) "
            f"SELECT spp, treatment, {', '.join(parts)}, count(*) AS n FROM pl GROUP BY spp, treatment")


@query("trait_summary",
       "spp treatment " + " ".join(f"{c}:d sd_{c}:d se_{c}:d lower_{c}:d upper_{c}:d" for c in _SUM_COLS) + " n",
       _trait_summary_sql())
def trait_summary(spark: SparkSession, d: str) -> DataFrame:
    """Flagship (Figure S2 table): collapse, gsmax, complete cases, then
    mean / sd / se / n and error-bar bounds per (spp, treatment)."""
    return S.group_summary(_plants_complete(spark, d), ["spp", "treatment"], list(_SUM_COLS),
                           null_skipping=False)


# ------------------------------------------------------------------ draws

_DRAW_SUMMARY_SQL = W("DR") + (
    ", s AS (SELECT par AS term, avg(value) AS estimate, stddev_samp(value) AS std_error, "
    "quantile_cont(value, 0.025) AS conf_low, quantile_cont(value, 0.975) AS conf_high, "
    "median(value) AS med, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS pos, "
    "sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS neg, count(value) AS n FROM dr GROUP BY par) "
    "SELECT term, estimate, std_error, conf_low, conf_high, "
    "CASE WHEN med > 0 THEN 2 * (1 - CAST(pos AS DOUBLE) / n) ELSE 2 * (1 - CAST(neg AS DOUBLE) / n) END AS p, "
    "'mean' AS method, 'quantile' AS interval FROM s")


@query("draw_summary", "term estimate:d std_error:d conf_low:d conf_high:d p:d method interval",
       _DRAW_SUMMARY_SQL)
def draw_summary(spark: SparkSession, d: str) -> DataFrame:
    """D17 + D11 + D10 (C5, D6): estimate table of the draws."""
    return D.summarise_draws(V.draws_events(spark, d), ["par"], estimate="mean", interval="quantile")


_HPD_SQL = W("DR") + (
    ", r AS (SELECT par, value, row_number() OVER (PARTITION BY par ORDER BY value, chain, iter) AS rn, "
    "count(*) OVER (PARTITION BY par) AS n FROM dr), "
    "pr AS (SELECT a.par, a.rn, a.value AS lo, b.value AS hi, b.value - a.value AS w FROM r a JOIN r b "
    "ON a.par = b.par AND b.rn = a.rn + CAST(floor(CAST(0.95 AS DOUBLE) * a.n) AS BIGINT)), "
    "best AS (SELECT par, lo, hi, row_number() OVER (PARTITION BY par ORDER BY w, rn) AS o FROM pr), "
    "m AS (SELECT par, median(value) AS point FROM dr GROUP BY par) "
    "SELECT best.par, m.point, best.lo AS lower, best.hi AS upper, CAST(0.95 AS DOUBLE) AS width "
    "FROM best JOIN m ON best.par = m.par WHERE o = 1")


@query("interval_hpd", "par point:d lower:d upper:d width:d", _HPD_SQL)
def interval_hpd(spark: SparkSession, d: str) -> DataFrame:
    """D12 + E3 + D14 + D9: median and shortest 95 % interval per parameter."""
    return D.point_interval(V.draws_events(spark, d), ["par"], "value", 0.95, "median", "hpd")


_RHAT_SQL = W("DR") + (
    ", nc AS (SELECT par, chain, count(*) AS nc FROM dr GROUP BY par, chain), "
    "h AS (SELECT dr.par, dr.chain, CASE WHEN dr.iter * 2 <= nc.nc THEN 1 ELSE 2 END AS half, dr.value "
    "FROM dr JOIN nc ON dr.par = nc.par AND dr.chain = nc.chain), "
    "per AS (SELECT par, chain, half, avg(value) AS m, var_samp(value) AS s2, count(*) AS k "
    "FROM h GROUP BY par, chain, half), "
    "g AS (SELECT par, avg(s2) AS w, var_samp(m) AS bn, avg(k) AS nbar FROM per GROUP BY par) "
    "SELECT par, sqrt(((nbar - 1) / nbar * w + bn) / nullif(w, 0)) AS rhat FROM g")


@query("split_rhat", "par rhat:d", _RHAT_SQL)
def split_rhat(spark: SparkSession, d: str) -> DataFrame:
    """D19 + E1: split R-hat per parameter over the 4 chains."""
    return D.split_rhat(V.draws_events(spark, d), ["par"])
