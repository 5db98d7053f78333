"""Trait tables: pair collapse, plant join, derived trait.

The surface table has one row per (plant key, surface).  ``pair_collapse``
turns it into one row per plant in a single ``groupBy`` with conditional
aggregates (partial aggregation on the map side, one shuffle on the key).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import biophysics, units


class PairError(ValueError):
    pass


def pair_collapse(surfaces: DataFrame, keys: Sequence[str], surface: str = "surface",
                  sides: tuple[str, str] = ("aB", "aD"), sum_cols: Sequence[str] = ("sd",),
                  mean_cols: Sequence[str] = ("sp",), strict: bool = False,
                  keep_side_counts: bool = False) -> DataFrame:
    """Two rows per key to one.

    ``sum_cols`` add the two sides, ``mean_cols`` average them; a missing
    side (or a NULL value on either side) gives NULL, as in the reference.
    ``strict`` adds a check column ``_pair_ok`` that is false when a key does
    not have exactly one row per side (the reference errors there); use
    ``assert_pairs`` to fail on it.
    """
    a, b = sides
    s = F.col(surface)
    aggs = []
    for c in list(sum_cols) + list(mean_cols):
        aggs.append(F.max(F.when(s == a, F.col(c))).alias(f"_{c}_a"))
        aggs.append(F.max(F.when(s == b, F.col(c))).alias(f"_{c}_b"))
    aggs.append(F.sum(F.when(s == a, 1).otherwise(0)).alias("_na"))
    aggs.append(F.sum(F.when(s == b, 1).otherwise(0)).alias("_nb"))
    g = surfaces.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys]
    for c in sum_cols:
        out.append((F.col(f"_{c}_a") + F.col(f"_{c}_b")).alias(c))
    for c in mean_cols:
        out.append(((F.col(f"_{c}_a") + F.col(f"_{c}_b")) / 2).alias(c))
    if strict:
        out.append(((F.col("_na") == 1) & (F.col("_nb") == 1)).alias("_pair_ok"))
    if keep_side_counts:
        out += [F.col("_na").alias("n_" + a), F.col("_nb").alias("n_" + b)]
    return g.select(*out)


def assert_pairs(collapsed: DataFrame) -> DataFrame:
    """Fail if any key lacked exactly one row per side (strict mode)."""
    bad = collapsed.where(~F.col("_pair_ok")).limit(1).count()
    if bad:
        raise PairError("some keys do not have exactly one row per surface")
    return collapsed.drop("_pair_ok")


def join_plants(left: DataFrame, right: DataFrame, keys: Sequence[str],
                how: str = "full", null_safe: bool = False,
                indicator: str | None = None) -> DataFrame:
    """Equi-join on the plant key with the keys coalesced.

    ``null_safe`` matches NULL keys to each other (``<=>``), like dplyr.
    ``indicator`` adds a column telling which side(s) a row came from.
    Both sides are keyed tables (one row per key), so a sort-merge or
    shuffled hash join on the keys is the plan; neither side is assumed small.
    """
    keys = list(keys)
    if indicator:
        left = left.withColumn("_in_l", F.lit(True))
        right = right.withColumn("_in_r", F.lit(True))
    if not null_safe:
        j = left.join(right, keys, how)
    else:
        l2 = left.select(*[F.col(c).alias("_l_" + c) if c in keys else F.col(c) for c in left.columns])
        r2 = right.select(*[F.col(c).alias("_r_" + c) if c in keys else F.col(c) for c in right.columns])
        cond = None
        for k in keys:
            c = F.col("_l_" + k).eqNullSafe(F.col("_r_" + k))
            cond = c if cond is None else cond & c
        j = l2.join(r2, cond, how)
        j = j.select(*[F.coalesce(F.col("_l_" + k), F.col("_r_" + k)).alias(k) for k in keys],
                     *[c for c in j.columns if not (c.startswith("_l_") or c.startswith("_r_"))])
    if indicator:
        j = (j.withColumn(indicator,
                          F.when(F.col("_in_l") & F.col("_in_r"), "both")
                          .when(F.col("_in_l"), "left_only").otherwise("right_only"))
             .drop("_in_l", "_in_r"))
    return j


def add_gsmax(df: DataFrame, sd: str = "sd", sp: str = "sp", out: str = "gsmax",
              sd_unit: str = "1/mm^2", sp_unit: str = "um",
              out_unit: str = "mol/m^2/s") -> DataFrame:
    """J3 + J4 (B8 derived column): gsmax from density and pore length,
    unit checked.

    The unit algebra is done at plan time: b (mol/m/s) x sd x sp must be
    ``out_unit``; the resulting factor (1 for the default units) is folded
    into the expression as a literal.
    """
    k = units.check_product(out_unit, "mol/m/s", sd_unit, sp_unit)
    expr = biophysics.gsmax(F.col(sd), F.col(sp))
    if k != 1.0:
        expr = expr * F.lit(k)
    res = df.withColumn(out, expr)
    res = units.with_unit(res, sd, sd_unit)
    res = units.with_unit(res, sp, sp_unit)
    return units.with_unit(res, out, out_unit)


def plants(surfaces: DataFrame, keys: Sequence[str] = ("spp", "treatment", "rep"),
           sides: tuple[str, str] = ("aB", "aD")) -> DataFrame:
    """The plant table: pair collapse then gsmax (one row per plant)."""
    return add_gsmax(pair_collapse(surfaces, keys, sides=sides))
