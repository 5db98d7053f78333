"""Group summaries.

All of these are one ``groupBy`` with built-in aggregates (partial + final
aggregation, NULLs skipped natively).  Medians go through the exact,
skew-safe ranking in ``ranking.group_quantiles`` rather than a
percentile buffer per group.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import group_quantiles, join_groups

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns (the ``is.numeric`` test)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def se(sd_col: Column, n_col: Column) -> Column:
    """D3: standard error sd / sqrt(n)."""
    return sd_col / F.sqrt(n_col.cast("double"))


def group_summary(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  null_skipping: bool = True, bounds: bool = True) -> DataFrame:
    """D2-D4 (+ B17): per group mean, sample sd, n, se and mean -/+ se.

    With ``null_skipping`` each column keeps its own n (count of non-NULL
    values); otherwise n is the row count of the group (the caller has
    already dropped incomplete rows).
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(c), F.stddev_samp(c).alias(f"sd_{c}")]
        if null_skipping:
            aggs.append(F.count(c).alias(f"n_{c}"))
    if not null_skipping:
        aggs.append(F.count(F.lit(1)).alias("n"))
    g = df.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys]
    for c in cols:
        n = F.col(f"n_{c}") if null_skipping else F.col("n")
        out += [F.col(c), F.col(f"sd_{c}"), se(F.col(f"sd_{c}"), n).alias(f"se_{c}")]
        if null_skipping:
            out.append(F.col(f"n_{c}"))
        if bounds:
            out += [(F.col(c) - se(F.col(f"sd_{c}"), n)).alias(f"lower_{c}"),
                    (F.col(c) + se(F.col(f"sd_{c}"), n)).alias(f"upper_{c}")]
    if not null_skipping:
        out.append(F.col("n"))
    return g.select(*out)


def summarise_numeric(df: DataFrame, keys: Sequence[str],
                      f: Callable[[str], Sequence[Column]]) -> DataFrame:
    """Apply one summary to every numeric non-key column."""
    aggs = []
    for c in numeric_columns(df, exclude=keys):
        aggs += list(f(c))
    return df.groupBy(*keys).agg(*aggs)


def global_stats(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """D7 + D9: min, max, count, mean and exact median (per key or global)."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(F.min(col).alias("min"), F.max(col).alias("max"),
                                 F.count(col).alias("n"), F.avg(col).alias("mean"))
    med = group_quantiles(df, keys, col, [0.5], names=["median"])
    return join_groups(base, med, keys, "left")


def centre(df: DataFrame, col: str, keys: Sequence[str] = (), out: str | None = None,
           stats: DataFrame | None = None) -> DataFrame:
    """Subtract the (group or global) mean.

    The mean is a one-row-per-group aggregate attached back by a broadcast
    join - never an unpartitioned window.  ``stats`` (of ``global_stats``) saves
    the aggregate; its other columns are attached too.
    """
    out = out or f"{col}_c"
    keys = list(keys)
    means = df.groupBy(*keys).agg(F.avg(col).alias("mean")) if stats is None else stats
    means = means.withColumnRenamed("mean", "_mean")
    return join_groups(df, means, keys).withColumn(out, F.col(col) - F.col("_mean")).drop("_mean")


def scalar(df: DataFrame, agg: Column, name: str) -> DataFrame:
    """A single cell as a one-row DataFrame (attach with
    ``attach_scalars``), instead of pulling it to the driver."""
    return df.agg(agg.alias(name))


def first_in_group(df: DataFrame, keys: Sequence[str], col: str, out: str | None = None) -> DataFrame:
    """The (constant) value of ``col`` in each group, made
    deterministic with ``min``."""
    return df.groupBy(*keys).agg(F.min(col).alias(out or col))
