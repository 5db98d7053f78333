"""Unit-carrying columns.

A unit lives in the column's metadata (``{"unit": "..."}``).  Conversion
multiplies by a literal taken from a small factor table; converting between
different dimensions raises at plan-building time, before any job runs.
Most expressions drop metadata, so functions returning a unit column call
``with_unit`` again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Factor to SI and dimension signature (m, s, mol) per unit.
UNITS = {
    "m": (1.0, (1, 0, 0)),
    "mm": (1e-3, (1, 0, 0)),
    "um": (1e-6, (1, 0, 0)),
    "1/m^2": (1.0, (-2, 0, 0)),
    "1/mm^2": (1e6, (-2, 0, 0)),
    "m^2/s": (1.0, (2, -1, 0)),
    "m^3/mol": (1.0, (3, 0, -1)),
    "mol/m/s": (1.0, (-1, -1, 1)),
    "mol/m^2/s": (1.0, (-2, -1, 1)),
    "mmol/m^2/s": (1e-3, (-2, -1, 1)),
    "1": (1.0, (0, 0, 0)),
}


class UnitError(ValueError):
    pass


def _lookup(unit: str):
    try:
        return UNITS[unit]
    except KeyError as e:
        raise UnitError(f"unknown unit {unit!r}") from e


def with_unit(df: DataFrame, col: str, unit: str) -> DataFrame:
    """Attach ``unit`` to ``col`` (value unchanged)."""
    _lookup(unit)
    meta = dict(df.schema[col].metadata)
    meta["unit"] = unit
    return df.withColumn(col, F.col(col).alias(col, metadata=meta))


def unit_of(df: DataFrame, col: str) -> str | None:
    return df.schema[col].metadata.get("unit")


def factor(from_unit: str, to_unit: str) -> float:
    f1, d1 = _lookup(from_unit)
    f2, d2 = _lookup(to_unit)
    if d1 != d2:
        raise UnitError(f"cannot convert {from_unit} to {to_unit}")
    return f1 / f2


def convert(df: DataFrame, col: str, to_unit: str) -> DataFrame:
    """Convert ``col`` to ``to_unit``; raises when dimensions differ."""
    frm = unit_of(df, col)
    if frm is None:
        raise UnitError(f"column {col!r} carries no unit")
    k = factor(frm, to_unit)
    out = df.withColumn(col, F.col(col) * F.lit(k)) if k != 1.0 else df
    return with_unit(out, col, to_unit)


def product_unit(*units: str) -> tuple[float, tuple[int, int, int]]:
    """SI factor and dimension of a product of units."""
    f, d = 1.0, (0, 0, 0)
    for u in units:
        fu, du = _lookup(u)
        f *= fu
        d = tuple(a + b for a, b in zip(d, du))
    return f, d


def check_product(result_unit: str, *units: str) -> float:
    """Factor that turns a product of ``units`` into ``result_unit``.

    Square roots are handled by the caller (pass the unit of the root).
    """
    f, d = product_unit(*units)
    fr, dr = _lookup(result_unit)
    if d != dr:
        raise UnitError(f"{' * '.join(units)} is not {result_unit}")
    return f / fr


def drop_units(df: DataFrame) -> DataFrame:
    """Strip unit metadata from every column."""
    cols = []
    for f_ in df.schema.fields:
        if "unit" in f_.metadata:
            meta = {k: v for k, v in f_.metadata.items() if k != "unit"}
            cols.append(F.col(f_.name).alias(f_.name, metadata=meta))
        else:
            cols.append(F.col(f_.name))
    return df.select(*cols)
