"""Reshaping and column-set operations.

Pivots always take their values explicitly (no extra job to discover
them).  Regex-driven column selection is resolved on the schema in the
driver, which costs nothing: it is plan building, not data.
"""

from __future__ import annotations

import re
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import join_groups
from .summary import numeric_columns


class SpreadError(ValueError):
    pass


def spread(df: DataFrame, ids: Sequence[str], key: str, value: str,
           values: Sequence[str], strict: bool = False,
           prefix: str = "") -> DataFrame:
    """H1: long to wide; missing cells are NULL.

    ``values`` are the pivot values (required).  With ``strict`` a column
    ``_dup`` counts cells that had more than one row (the reference errors);
    use ``assert_no_duplicates`` to fail on it.
    """
    g = df.groupBy(*ids)
    if strict:
        cnt = (df.groupBy(*ids, key).agg(F.count(F.lit(1)).alias("_c"))
               .groupBy(*ids).agg(F.sum(F.when(F.col("_c") > 1, 1).otherwise(0)).alias("_dup")))
    wide = g.pivot(key, list(values)).agg(F.max(value))
    if prefix:
        wide = wide.select(*ids, *[F.col(f"`{v}`").alias(prefix + v) for v in values])
    if strict:
        wide = join_groups(wide, cnt, ids)
    return wide


def assert_no_duplicates(wide: DataFrame) -> DataFrame:
    if wide.where(F.col("_dup") > 0).limit(1).count():
        raise SpreadError("duplicate identifiers in spread")
    return wide.drop("_dup")


def gather(df: DataFrame, ids: Sequence[str], key: str = "key", value: str = "value",
           cols: Sequence[str] | None = None) -> DataFrame:
    """H2: wide to long (``unpivot``); value columns must share a type."""
    ids = list(ids)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ids]
    return df.unpivot(ids, cols, key, value)


def unite(df: DataFrame, out: str, cols: Sequence[str], sep: str = "_",
          remove: bool = True) -> DataFrame:
    """H3: paste columns into one key."""
    res = df.withColumn(out, F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))
    return res.drop(*cols) if remove else res


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str = "_",
             remove: bool = True, limit: int = -1) -> DataFrame:
    """H4: split a key into columns (``sep`` is a regex)."""
    parts = F.split(F.col(col), sep, limit if limit > 0 else -1)
    res = df
    for i, name in enumerate(into):
        res = res.withColumn(name, parts.getItem(i))
    return res.drop(col) if remove and col not in into else res


def split_index(df: DataFrame, col: str = "par", name: str = "name",
                index: Sequence[str] = ("i",)) -> DataFrame:
    """H6: ``base[i]`` / ``base[i,j]`` to (name, i[, j]) in one projection."""
    res = df.withColumn(name, F.regexp_extract(col, r"^([^\[]+)", 1))
    for k, idx in enumerate(index):
        pat = r"\[" + r"[^,\]]*,\s*" * k + r"([^,\]]+)"
        res = res.withColumn(idx, F.nullif(F.regexp_extract(col, pat, 1), F.lit("")))
    return res


def select_matching(df: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Keep columns whose name matches ``pattern`` (plus ``keep``)."""
    rx = re.compile(pattern)
    return df.select(*keep, *[c for c in df.columns if rx.search(c) and c not in keep])


def mutate_numeric(df: DataFrame, f: Callable[[Column], Column],
                   exclude: Sequence[str] = ()) -> DataFrame:
    """Apply ``f`` to every numeric column (names kept)."""
    targets = set(numeric_columns(df, exclude))
    return df.select(*[f(F.col(c)).alias(c) if c in targets else F.col(c) for c in df.columns])


def mutate_matching(df: DataFrame, pattern: str, f: Callable[[Column], Column]) -> DataFrame:
    """Apply ``f`` to columns whose name matches ``pattern``."""
    rx = re.compile(pattern)
    return df.select(*[f(F.col(c)).alias(c) if rx.search(c) else F.col(c) for c in df.columns])


def rename_regex(df: DataFrame, pattern: str, repl: str,
                 only_numeric: bool = False) -> DataFrame:
    """Rename by a regex over (optionally only numeric) columns."""
    targets = set(numeric_columns(df)) if only_numeric else set(df.columns)
    mapping = {c: re.sub(pattern, repl, c) for c in df.columns if c in targets}
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k != v})


def bind_rows(*dfs: DataFrame) -> DataFrame:
    """G1: union by name, missing columns filled with NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def copy_to_levels(df: DataFrame, col: str, levels: Sequence[str], when: Column,
                   default: Column | None = None) -> DataFrame:
    """Rows matching ``when`` are copied to every level of ``col``
    (one pass with ``explode``); other rows keep ``default`` or their own
    value."""
    arr = F.array(*[F.lit(v) for v in levels])
    keep = default if default is not None else F.array(F.col(col))
    return df.withColumn(col, F.explode(F.when(when, arr).otherwise(keep)))
