"""Categories, codes and design columns.

Codes are built once over the distinct values (a shared dictionary, so
two tables never disagree on a code) and attached with a join.  The
dictionary's ranking is the parallel ``rank_within``: no single-partition
window even when there are many categories.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import rank_within


def dictionary(*cols: DataFrame, name: str = "value", code: str = "code") -> DataFrame:
    """Alphabetical codes 1..k over the distinct values of one-column
    DataFrames (their union), i.e. ``as.integer(as.factor(x))``."""
    u = None
    for d in cols:
        d1 = d.select(F.col(d.columns[0]).alias(name))
        u = d1 if u is None else u.unionByName(d1)
    distinct = u.where(F.col(name).isNotNull()).distinct()
    ranked = rank_within(distinct, [], name, rank_col=code, count_col="_k")
    return ranked.select(name, F.col(code).cast("int").alias(code))


def add_codes(df: DataFrame, col: str, dict_df: DataFrame, code: str = "code") -> DataFrame:
    """Attach codes from a dictionary; the dictionary has one row per
    category, so the join never fans out (AQE broadcasts it when small)."""
    d = dict_df.withColumnRenamed(dict_df.columns[0], col).withColumnRenamed(dict_df.columns[1], code)
    return df.join(d, col, "left")


def indicator(col: str, level: str, out: str | None = None) -> Column:
    """0/1 dummy for one level (as double)."""
    return (F.col(col) == F.lit(level)).cast("double").alias(out or f"{col}_{level}")


def design_columns(df: DataFrame, factor: str, levels: Sequence[str],
                   numeric: Sequence[str] = (), interactions: Sequence[str] = (),
                   prefix: str | None = None) -> DataFrame:
    """K1: treatment-coded dummies for every non-reference level (the first
    level is the reference) and products with numeric predictors.

    Rows whose factor value is not a listed level get NULL dummies (and
    are removed by ``complete_cases`` on the model columns).
    """
    prefix = prefix if prefix is not None else factor
    ref, *rest = list(levels)
    known = F.col(factor).isin(list(levels))
    res = df
    dums = []
    for lv in rest:
        name = f"{prefix}_{lv}"
        res = res.withColumn(name, F.when(known, (F.col(factor) == F.lit(lv)).cast("double")))
        dums.append(name)
    for x in interactions:
        for d in dums:
            res = res.withColumn(f"{x}_x_{d}", F.col(x) * F.col(d))
    return res


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Listwise deletion on the model columns."""
    return df.dropna(subset=list(cols))


def order_levels(df: DataFrame, by: str, out: str = "sort_key", desc: bool = False,
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """F1 + F3: category order taken from sorted rows, carried as a key
    column (1 = first), computed with the parallel ranking."""
    src = df.withColumn("_neg", -F.col(by)) if desc else df
    ranked = rank_within(src, [], "_neg" if desc else by, tiebreak, rank_col=out, count_col="_n")
    return ranked.drop("_n", "_neg") if desc else ranked.drop("_n")
