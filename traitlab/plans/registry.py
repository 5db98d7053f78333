"""Query registry: each query has a Spark builder, an output spec and,
where SQL can say the same thing, an oracle text.

The output spec fixes column order and names on both sides; columns marked
``:d`` are doubles, rounded on both sides so that summation order (which
differs between engines in the last bits) does not change a value hash:
first to 13 significant digits, which removes last-bit noise (so a value
that is exactly a decimal tie stays exactly that tie on both sides), then
to 9.  Columns marked ``:c`` are differences of nearly equal numbers
(centred values): their noise is large relative to the value, so they are
rounded absolutely instead - 11 decimals, then 6.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_fixed_columns, round_fixed_sql, signif_columns, signif_sql

SIG = 9


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    cols: list[str]
    sql: str | None
    doc: str = ""

    def _spec(self):
        for c in self.cols:
            name, _, kind = c.partition(":")
            yield name, kind

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        sel, dbl, cen = [], [], []
        for name, kind in self._spec():
            col = F.col(f"`{name}`")
            if kind in ("d", "c"):
                col = col.cast("double")
                (dbl if kind == "d" else cen).append(name)
            sel.append(col.alias(name))
        out = df.select(*sel)
        out = signif_columns(signif_columns(out, dbl, 13), dbl, SIG)
        return round_fixed_columns(round_fixed_columns(out, cen, 11), cen, 6)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        sel = []
        for name, kind in self._spec():
            q = f'q."{name}"'
            if kind == "d":
                q = signif_sql(signif_sql(f"CAST({q} AS DOUBLE)", 13), SIG)
            elif kind == "c":
                q = round_fixed_sql(round_fixed_sql(f"CAST({q} AS DOUBLE)", 11), 6)
            sel.append(q + f' AS "{name}"')
        return f"SELECT {', '.join(sel)} FROM ({self.sql}) q"


REGISTRY: dict[str, Query] = {}


def query(name: str, cols: str, sql: str | None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``cols`` is a space-separated spec, e.g. ``"k sd:d sp:d"``.
    """
    def deco(fn):
        REGISTRY[name] = Query(name, fn, cols.split(), sql, (fn.__doc__ or "").strip())
        return fn
    return deco
