"""Oracle SQL fragments shared by several queries (plain ANSI text)."""

from __future__ import annotations

from typing import Sequence


def hpd_cte(src: str, keys: Sequence[str], value: str, tiebreak: str, width: float = 0.95,
            name: str = "hpd") -> str:
    """CTEs ending in ``name(keys..., lower, upper)``: the shortest interval
    over the sorted values (rank self-join, T3)."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    ak = ", ".join(f"a.{x}" for x in keys)
    return (f"{name}_r AS (SELECT {k}, {value} AS v, row_number() OVER (PARTITION BY {k} "
            f"ORDER BY {value}, {tiebreak}) AS rn, count(*) OVER (PARTITION BY {k}) AS n "
            f"FROM {src} WHERE {value} IS NOT NULL), "
            f"{name}_p AS (SELECT {ak}, a.rn, a.v AS lo, b.v AS hi, b.v - a.v AS w FROM {name}_r a "
            f"JOIN {name}_r b ON {on} AND b.rn = a.rn + CAST(floor(CAST({width} AS DOUBLE) * a.n) AS BIGINT)), "
            f"{name} AS (SELECT {k}, lo AS lower, hi AS upper FROM (SELECT {name}_p.*, row_number() OVER "
            f"(PARTITION BY {k} ORDER BY w, rn) AS o FROM {name}_p) x WHERE o = 1)")


def median_cte(src: str, keys: Sequence[str], value: str, name: str = "med", alias: str = "point") -> str:
    k = ", ".join(keys)
    return f"{name} AS (SELECT {k}, median({value}) AS {alias} FROM {src} GROUP BY {k})"


def tail_p_expr(value: str) -> str:
    """Aggregate expression of the D10 tail p-value over ``value``."""
    return (f"CASE WHEN median({value}) > 0 THEN 2 * (1 - CAST(sum(CASE WHEN {value} > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count({value})) "
            f"ELSE 2 * (1 - CAST(sum(CASE WHEN {value} < 0 THEN 1 ELSE 0 END) AS DOUBLE) / count({value})) END")


def rhat_cte(src: str, name: str = "rh") -> str:
    """CTEs ending in ``name(par, rhat)``: split R-hat."""
    return (f"{name}_nc AS (SELECT par, chain, count(*) AS nc FROM {src} GROUP BY par, chain), "
            f"{name}_h AS (SELECT s.par, s.chain, CASE WHEN s.iter * 2 <= c.nc THEN 1 ELSE 2 END AS half, s.value "
            f"FROM {src} s JOIN {name}_nc c ON s.par = c.par AND s.chain = c.chain), "
            f"{name}_per AS (SELECT par, chain, half, avg(value) AS m, var_samp(value) AS s2, count(*) AS k "
            f"FROM {name}_h GROUP BY par, chain, half), "
            f"{name}_g AS (SELECT par, avg(s2) AS w, var_samp(m) AS bn, avg(k) AS nbar FROM {name}_per GROUP BY par), "
            f"{name} AS (SELECT par, sqrt(((nbar - 1) / nbar * w + bn) / nullif(w, 0)) AS rhat FROM {name}_g)")
