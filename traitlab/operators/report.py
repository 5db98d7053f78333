"""Report tables.

Estimate tables become presentation tables: parameters are labelled from
a mapping (unlabelled rows dropped), selected rows are back-transformed,
p-values clamped, numbers turned into significant-digit text (the
decimal-cast rules in ``functions.text``), and a header row is put first.
All of it is column expressions on small per-parameter tables.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX


def label_map(df: DataFrame, col: str, mapping: Mapping[str, str], out: str = "parameter",
              drop_unmatched: bool = True) -> DataFrame:
    """B12 + B13: multi-branch label from a mapping; rows without a label
    are dropped (``case_when`` then ``filter(!is.na())``)."""
    lab = None
    for k, v in mapping.items():
        lab = F.when(F.col(col) == k, v) if lab is None else lab.when(F.col(col) == k, v)
    res = df.withColumn(out, lab if lab is not None else F.lit(None).cast("string"))
    return res.where(F.col(out).isNotNull()) if drop_unmatched else res


def back_transform(df: DataFrame, cols: Sequence[str], when: Column,
                   f: Callable[[Column], Column] = F.exp) -> DataFrame:
    """Apply ``f`` (default ``exp``) to ``cols`` on rows where ``when``."""
    return df.withColumns({c: F.when(when, f(F.col(c))).otherwise(F.col(c)) for c in cols})


def clamp_p(df: DataFrame, col: str = "p", floor: float = 0.001, keep: str | None = "p_raw") -> DataFrame:
    """Q7: p below ``floor`` becomes 0 (printed later as ``< 0.001``); the
    raw value is kept in ``keep``."""
    if keep:
        df = df.withColumn(keep, F.col(col))
    return df.withColumn(col, F.when(F.col(col) < floor, F.lit(0.0)).otherwise(F.col(col)))


def number_text(df: DataFrame, cells: Mapping[str, str], digits: int = 3, pad: bool = False,
                fg: bool = False) -> DataFrame:
    """I4 + T5 (+ I14 / U3 with ``pad``, I12 with ``fg``): numbers to text."""
    return TX.text_cells(df, dict(cells), digits, pad=pad, fg=fg)


def interval_text(lo: str, hi: str) -> Column:
    """``"low - high"`` from two text columns."""
    return F.concat_ws(TX.INTERVAL_SEP, F.col(lo), F.col(hi))


def p_cell(p: str, p_text: str) -> Column:
    """Q7 cell: ``< 0.001`` where the (clamped) p is 0, else its text."""
    return F.when(F.col(p) == 0, F.lit(TX.P_SMALL_CELL)).otherwise(F.col(p_text))


def mean_se_cells(df: DataFrame, pairs: Mapping[str, tuple[str, str, str]], digits: int = 3) -> DataFrame:
    """``"mean $\\pm$ se (n)"`` cells; ``pairs`` maps output to
    (mean, se, n) columns."""
    cells = {}
    for o, (m, s, _) in pairs.items():
        cells[f"__m_{o}"] = m
        cells[f"__s_{o}"] = s
    df = TX.text_cells(df, cells, digits, fg=True)
    df = df.withColumns({o: F.concat(F.col(f"__m_{o}"), F.lit(TX.PM), F.col(f"__s_{o}"), F.lit(" ("),
                                     F.col(n).cast("string"), F.lit(")"))
                         for o, (_, _, n) in pairs.items()})
    return df.drop(*cells)


def add_header_row(df: DataFrame, values: Mapping[str, object], sort_col: str = "sort_key") -> DataFrame:
    """a header row (e.g. units) placed first - sort key 0, other
    columns NULL unless given.  Data rows keep their own sort key (>= 1)."""
    spark = df.sparkSession
    cols = []
    for f in df.schema.fields:
        if f.name == sort_col:
            cols.append(F.lit(0).cast(f.dataType).alias(f.name))
        elif f.name in values:
            cols.append(F.lit(values[f.name]).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return spark.range(1).select(*cols).unionByName(df)


def clip_to_limits(df: DataFrame, col: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Keep rows inside axis limits (points outside are not shown);
    ``check_draws(clip=...)`` counts how many a clip would hide."""
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= lo)
    if hi is not None:
        cond = cond & (c <= hi)
    return df.where(cond)
