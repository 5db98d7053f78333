"""Numeric scalar helpers.

Each helper exists twice: as a Column builder and as SQL text.  The SQL
text uses only functions whose semantics agree between Spark SQL and
ANSI engines (no backslashes, no dialect-only names), so the same text is
usable in ``F.expr`` and in an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signif_sql(x: str, digits: int) -> str:
    """I4: round to significant digits; 0 and NULL pass through.

    ``round`` needs a constant scale (T4), so the value is scaled by an
    exact power of ten and rounded to an integer.  Negative exponents divide
    instead of multiplying by an inexact 10^-k.
    """
    e = f"(CAST({digits - 1} AS DOUBLE) - floor(log10(abs({x}))))"
    return (f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} "
            f"WHEN {e} >= 0 THEN round({x} * power(10.0, {e})) / power(10.0, {e}) "
            f"ELSE round({x} / power(10.0, -{e})) * power(10.0, -{e}) END)")


def signif(x, digits: int) -> Column:
    """Column form of ``signif_sql``."""
    c = _c(x)
    e = F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(c))).cast("double")
    p_pos = F.pow(F.lit(10.0), e)
    p_neg = F.pow(F.lit(10.0), -e)
    return (F.when(c.isNull() | (c == 0), c)
            .when(e >= 0, F.round(c * p_pos) / p_pos)
            .otherwise(F.round(c / p_neg) * p_neg))


def round_half_even(x, digits: int = 0) -> Column:
    """I3, R's round: half to even at the given number of digits."""
    return F.bround(_c(x), digits)


def safe_ln(x) -> Column:
    """I1 with T2: ln of a non-positive value is NULL, never -Inf/NaN."""
    c = _c(x)
    return F.when(c > 0, F.log(c))


def safe_ln_sql(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


def grid_value(lo: Column, hi: Column, idx: Column, n: int) -> Column:
    """I16: point ``idx`` (0-based) of ``n`` even points from lo to hi."""
    if n == 1:
        return lo
    return lo + idx.cast("double") * (hi - lo) / F.lit(float(n - 1))


def signif_columns(df, cols, digits: int, keep_integer_digits: bool = False):
    """``signif`` of several columns in two small projections: the decimal
    exponent first, then the rounding that uses it.  Each expression stays
    small (the exponent is not repeated inline), which keeps generated code
    short when many columns are rounded at once; both steps are one
    ``selectExpr`` each, so building the plan costs two calls.

    ``keep_integer_digits`` never rounds into the integer part (the
    ``formatC(format="fg")`` rule)."""
    cols = list(cols)
    if not cols:
        return df

    def q(c: str) -> str:
        return "`" + c.replace("`", "``") + "`"

    def exp(c: str) -> str:
        e = f"(CAST({digits - 1} AS DOUBLE) - floor(log10(abs({q(c)}))))"
        return f"greatest({e}, CAST(0 AS DOUBLE))" if keep_integer_digits else e

    names = [f"__e_{i}" for i in range(len(cols))]
    staged = df.selectExpr("*", *[f"{exp(c)} AS {n}" for c, n in zip(cols, names)])
    rnd = {}
    for c, e in zip(cols, names):
        x = q(c)
        rnd[c] = (f"CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} "
                  f"WHEN {e} >= 0 THEN round({x} * power(10.0, {e})) / power(10.0, {e}) "
                  f"ELSE round({x} / power(10.0, -{e})) * power(10.0, -{e}) END AS {q(c)}")
    return staged.selectExpr(*[rnd.get(c, q(c)) for c in df.columns])


def round_fixed_sql(x: str, decimals: int) -> str:
    """Round to a fixed number of decimals as ``round(x * 10^d) / 10^d``
    (the same IEEE operations in Spark SQL and other engines)."""
    return f"(round({x} * power(10.0, {decimals})) / power(10.0, {decimals}))"


def round_fixed_columns(df, cols, decimals: int):
    """``round_fixed_sql`` for several columns in one projection."""
    cols = set(cols)
    if not cols:
        return df
    q = lambda c: "`" + c.replace("`", "``") + "`"
    return df.selectExpr(*[f"{round_fixed_sql(q(c), decimals)} AS {q(c)}" if c in cols else q(c)
                           for c in df.columns])
