"""Text formatting of numbers for report tables.

Numbers become text through decimal digits, never through the engine's
double-to-string (which prints ``1.0E-4``).  All helpers are SQL
text shared by Spark (``F.expr``) and by the oracles; they avoid
backslashes (``[.]`` instead of an escaped dot) so both dialects read them
the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import signif_columns, signif_sql

# The text pieces used by the reference's tables.
PM = " $\\pm$ "
INTERVAL_SEP = " - "
P_SMALL = " < 0.001"
P_SMALL_CELL = "< 0.001"


def _lit(s: str) -> str:
    """SQL string literal; backslashes become ``chr(92)`` because Spark SQL
    un-escapes them inside literals while other engines keep them."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\\")]
    return "(" + " || chr(92) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def clean_sql(x: str) -> str:
    """Round to 13 significant digits: removes last-bit noise of summation
    order before a coarser rounding (a decimal tie stays a tie everywhere)."""
    return signif_sql(x, 13)


def num_text_sql(x: str) -> str:
    """T5: plain decimal text without trailing zeros (``0.0123``, ``100``),
    for numbers that a decimal with 10 places holds.  ``x`` may be a long
    expression; ``num_text_any_sql`` takes numbers of any size."""
    s = f"CAST(CAST({x} AS DECIMAL(38,10)) AS STRING)"
    return f"regexp_replace({s}, '[.]?0+$', '')"


def num_text_any_sql(x: str) -> str:
    """T5 for a column of any magnitude: large and small numbers are printed
    from their 13 leading digits and their exponent.  ``x`` is repeated many
    times, so it should be a column, not an expression."""
    e = f"CAST(floor(log10(abs({x}))) AS INTEGER)"
    d = f"CAST(CAST(round(abs({x}) / power(10.0, {e}) * 1e12) AS BIGINT) AS STRING)"
    lead = f"regexp_replace({d}, '0+$', '')"
    up = f"({e} + length({d}) - 13)"  # one more if rounding made a fourteenth digit
    minus = f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END)"
    return (f"(CASE WHEN {x} <> 0 AND abs({x}) < 1e-3 THEN {minus} || '0.' || repeat('0', -{up} - 1) || {lead} "
            f"WHEN abs({x}) >= 1e14 THEN {minus} || {lead} || repeat('0', {up} + 1 - length({lead})) "
            f"ELSE {num_text_sql(x)} END)")


def fg_sql(x: str, digits: int) -> str:
    """I12, ``formatC(format="fg")``: significant digits, never fewer than
    the integer digits, printed without trailing zeros."""
    x = clean_sql(x)
    e = f"(CAST({digits - 1} AS DOUBLE) - floor(log10(abs({x}))))"
    r = (f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN {x} "
         f"WHEN {e} >= 0 THEN round({x} * power(10.0, {e})) / power(10.0, {e}) "
         f"ELSE round({x}) END)")
    return num_text_sql(r)


def signif_text_sql(x: str, digits: int) -> str:
    """``signif(x, d)`` then ``as.character``."""
    return num_text_sql(signif_sql(clean_sql(x), digits))


def add_zeroes_sql(s: str, digits: int) -> str:
    """Pad a number's text to ``digits`` significant digits.

    Digits are counted from the first non-zero digit (so ``100`` already has
    three); text with enough digits is returned unchanged.  This is the
    corrected rule (the original stripped trailing zeros before counting and
    failed when digits were exceeded).
    """
    n = f"length(regexp_replace(regexp_replace({s}, '[-.]', ''), '^0+', ''))"
    n = f"greatest({n}, 1)"
    with_dot = f"(CASE WHEN instr({s}, '.') > 0 THEN {s} ELSE {s} || '.' END)"
    return (f"(CASE WHEN {s} IS NULL THEN NULL WHEN {n} >= {digits} THEN {s} "
            f"ELSE {with_dot} || repeat('0', {digits} - {n}) END)")


def p_label_sql(p: str) -> str:
    """``" < 0.001"`` or ``" = p"`` with p rounded to 3 decimals."""
    return (f"(CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.001 THEN {_lit(P_SMALL)} "
            f"ELSE ' = ' || {num_text_sql(f'round({p}, 3)')} END)")


def p_cell_sql(p: str, digits: int = 3, floor: float | None = 0.001) -> str:
    """Q7: p as a table cell; values under ``floor`` (or exactly 0 when
    ``floor`` is None) read ``< 0.001``."""
    cut = f"{p} < {floor}" if floor is not None else f"{p} = 0"
    return (f"(CASE WHEN {p} IS NULL THEN NULL WHEN {cut} THEN {_lit(P_SMALL_CELL)} "
            f"ELSE {signif_text_sql(p, digits)} END)")


def interval_text_sql(lo: str, hi: str) -> str:
    """``"low - high"``."""
    return f"concat_ws({_lit(INTERVAL_SEP)}, {lo}, {hi})"


def mean_se_cell_sql(mean: str, se: str, n: str, digits: int = 3) -> str:
    """``"mean $\\pm$ se (n)"``; NULL parts stay NULL."""
    return (f"({fg_sql(mean, digits)} || {_lit(PM)} || {fg_sql(se, digits)}"
            f" || ' (' || CAST({n} AS STRING) || ')')")


def template_sql(parts: list[str]) -> str:
    """A template as concatenation of literal and expression parts.

    Parts starting with ``=`` are SQL expressions, others literal text.
    """
    pieces = [p[1:] if p.startswith("=") else _lit(p) for p in parts]
    return "(" + " || ".join(pieces) + ")"


def expr(sql: str) -> Column:
    return F.expr(sql)


def text_cells(df: DataFrame, cells: dict[str, str], digits: int, pad: bool = False,
               fg: bool = False) -> DataFrame:
    """Column form of ``signif_text_sql`` / ``fg_sql`` (+ ``add_zeroes_sql``)
    for several cells at once, computed in stages (clean, round, text, pad)
    so that no expression repeats another inline.  ``cells`` maps output
    name to source column; each stage is one ``selectExpr``."""
    tmp = {out: f"__x_{i}" for i, out in enumerate(cells)}
    base = list(df.columns)
    df = df.selectExpr("*", *[f"CAST(`{src}` AS DOUBLE) AS {tmp[o]}" for o, src in cells.items()])
    df = signif_columns(df, tmp.values(), 13)
    df = signif_columns(df, tmp.values(), digits, keep_integer_digits=fg)
    df = df.selectExpr(*[f"`{c}`" for c in base],
                       *[f"{num_text_any_sql(t)} AS {t}" for t in tmp.values()])
    final = [f"`{c}`" for c in base if c not in cells]
    for o, t in tmp.items():
        final.append(f"{add_zeroes_sql(t, digits) if pad else t} AS `{o}`")
    return df.selectExpr(*final)
