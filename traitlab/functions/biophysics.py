"""Biophysical constants and the anatomical maximum conductance.

Both constant functions accept Python numbers or Columns, so they fold to
literals when given literals (Catalyst constant folding) and still work
per row when given columns.
"""

from __future__ import annotations

import math
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Union[float, int, Column]

# Diffusivity of water vapour in air (m^2/s) and molar volume
# of air (m^3/mol), and the pore-geometry defaults c = h = j = 0.5.
D_WV = 24.9e-6
V_AIR = 2.24e-2
GEOMETRY_DEFAULT = (0.5, 0.5, 0.5)


def biophysical_constant(d_wv: Num = D_WV, v: Num = V_AIR) -> Num:
    """b = D / v, in mol m^-1 s^-1."""
    return d_wv / v


def morphological_constant(c: Num = 0.5, h: Num = 0.5, j: Num = 0.5) -> Num:
    """m = pi c^2 / (sqrt(j) (4 h j + pi c))."""
    if any(isinstance(x, Column) for x in (c, h, j)):
        c, h, j = (x if isinstance(x, Column) else F.lit(float(x)) for x in (c, h, j))
        return (F.lit(math.pi) * c * c) / (F.sqrt(j) * (4 * h * j + F.lit(math.pi) * c))
    return (math.pi * c ** 2) / (j ** 0.5 * (4 * h * j + math.pi * c))


B_CONST = biophysical_constant()
M_CONST = morphological_constant()


def gsmax(sd: Column, sp: Column, b: Num = B_CONST, m: Num = M_CONST) -> Column:
    """gsmax = b * m * sd * sqrt(0.5 * (2 sp)^2).

    sd in mm^-2 and sp in um give mm^-2 * um = 1/m, so with b in mol/m/s the
    result is already mol m^-2 s^-1 (conversion factor exactly 1).
    """
    b = b if isinstance(b, Column) else F.lit(float(b))
    m = m if isinstance(m, Column) else F.lit(float(m))
    s = F.lit(0.5) * F.pow(F.lit(2.0) * sp, 2)
    return b * m * sd * F.sqrt(s)


def gsmax_sql(sd: str, sp: str) -> str:
    """The same formula as SQL text (for oracles and ``selectExpr``)."""
    return f"({B_CONST!r} * {M_CONST!r} * {sd} * sqrt(0.5 * power(2.0 * {sp}, 2)))"
