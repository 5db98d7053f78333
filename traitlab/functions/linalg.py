"""Small dense linear algebra on array columns (``array<array<double>>``).

For matrices of a model's terms: a row of the table holds a system of its
own, so a projection solves the systems of all groups, draws or replicates at
once.  Everything is built-in higher-order functions; the expression's size
does not grow with the matrix.  A NULL anywhere, or a pivot that is not
positive, makes the result NULL.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot below this share of its original diagonal counts as zero.
TINY = 1e-11
#: Rounds over all pairs in the Jacobi rotations.
SWEEPS = 12


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a column that is computed once per row, however often ``fn``
    uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of equal length."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def times(m: Column, v: Column) -> Column:
    """Matrix times vector."""
    return F.transform(m, lambda row: dot(row, v))


def quadratic(m: Column, v: Column) -> Column:
    """v' M v."""
    return dot(times(m, v), v)


def sparse_dot(entries: Column, v: Column) -> Column:
    """Product of an array of (i, v) structs with a vector."""
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["v"] * F.get(v, e["i"]))


def matrix_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p + q))


def solve(m: Column, rhs: Column) -> Column:
    """x with M x = rhs for a positive definite M, by elimination without
    exchanges, one row of the augmented matrix as pivot after another."""
    wide = F.zip_with(m, rhs, lambda row, r: F.concat(row, F.array(r)))

    def step(aug: Column, p: Column) -> Column:
        row = F.get(aug, p)
        pivot = F.get(row, p)
        floor = TINY * F.abs(F.get(F.get(m, p), p))
        unit = F.transform(row, lambda x: x / F.when(pivot > floor, pivot))
        return let(unit, lambda u: F.transform(aug, lambda r, i: F.when(i == p, u).otherwise(
            let(F.get(r, p), lambda f: F.zip_with(r, u, lambda x, y: x - f * y)))))

    done = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), wide, step)
    return F.when(F.size(m) > 0, F.transform(done, lambda r: F.get(r, F.size(r) - 1)))


def cholesky(m: Column, tiny: float = TINY) -> Column:
    """The lower triangle L with L L' = M, row by row (row i has i + 1
    numbers); a pivot that is not above ``tiny`` times its diagonal makes it
    and all that follows NULL."""
    def row(done: Column, i: Column) -> Column:
        given = F.get(m, i)

        def entry(mine: Column, j: Column) -> Column:
            rest = F.get(given, j) - F.when(j > 0, dot(mine, F.slice(F.get(done, j), 1, F.greatest(j, F.lit(1))))).otherwise(0.0)
            return F.concat(mine, F.array(rest / F.get(F.get(done, j), j)))

        left = F.aggregate(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))), F.array().cast("array<double>"),
                           lambda mine, j: F.when(j < i, entry(mine, j)).otherwise(mine))
        return let(left, lambda x: F.concat(done, F.array(F.concat(x, F.array(
            let(F.get(given, i) - F.coalesce(F.when(F.size(x) > 0, dot(x, x)), F.when(F.size(x) == 0, F.lit(0.0))),
                lambda d: F.sqrt(F.when(d > tiny * F.get(given, i), d))))))))

    return F.when(F.size(m) > 0, F.aggregate(
        F.sequence(F.lit(0), F.size(m) - 1), F.array().cast("array<array<double>>"), row))


def is_positive_definite(m: Column, tiny: float = TINY) -> Column:
    """Whether every pivot of the Cholesky factor is positive; false for a
    matrix with a NULL."""
    return F.coalesce(F.forall(cholesky(m, tiny), lambda r: F.get(r, F.size(r) - 1).isNotNull()), F.lit(False))


def is_correlation(m: Column, tiny: float = TINY) -> Column:
    """Whether a matrix is a valid correlation matrix: symmetric, ones on the
    diagonal, nothing outside [-1, 1], positive definite."""
    ok = F.forall(F.transform(m, lambda row, i: F.forall(F.transform(row, lambda x, j: F.coalesce(
        F.when(i == j, x == 1.0).otherwise(x.between(-1.0, 1.0) & (x == F.get(F.get(m, j), i))), F.lit(False))),
        lambda b: b)), lambda b: b)
    return F.coalesce(ok, F.lit(False)) & is_positive_definite(m, tiny)


def forward(chol: Column, v: Column) -> Column:
    """z with L z = v for a Cholesky factor as ``cholesky`` gives it."""
    def step(z: Column, i: Column) -> Column:
        row = F.get(chol, i)
        known = F.when(i > 0, dot(z, F.slice(row, 1, F.greatest(i, F.lit(1))))).otherwise(0.0)
        return F.concat(z, F.array((F.get(v, i) - known) / F.get(row, i)))

    return F.aggregate(F.sequence(F.lit(0), F.size(v) - 1), F.array().cast("array<double>"), step)


def log_det_half(chol: Column) -> Column:
    """Half the log determinant of L L'."""
    return total(F.transform(chol, lambda r: F.log(F.get(r, F.size(r) - 1))))


def nearest_valid(m: Column) -> Column:
    """The symmetric matrix with its negative eigenvalues set to zero (the
    closest positive semidefinite one), by cyclic Jacobi rotations."""
    size = F.size(m)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda p: F.transform(
        F.filter(F.sequence(F.lit(0), size - 1), lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    all_pairs = F.flatten(F.array_repeat(pairs, SWEEPS))
    unit = F.transform(m, lambda row, i: F.transform(row, lambda x, j: F.when(i == j, 1.0).otherwise(0.0)))
    start = F.struct(m.alias("a"), unit.alias("v"))

    def columns(x: Column, p: Column, q: Column, cs: Column) -> Column:
        """X times the rotation of columns p and q."""
        c, s = cs["c"], cs["s"]
        return F.transform(x, lambda row: F.transform(row, lambda e, j: F.when(
            j == p, c * e - s * F.get(row, q)).when(j == q, s * F.get(row, p) + c * e).otherwise(e)))

    def rows(x: Column, p: Column, q: Column, cs: Column) -> Column:
        c, s = cs["c"], cs["s"]
        return F.transform(x, lambda row, i: F.when(
            i == p, F.zip_with(row, F.get(x, q), lambda a, b: c * a - s * b)).when(
            i == q, F.zip_with(F.get(x, p), row, lambda a, b: s * a + c * b)).otherwise(row))

    def rotate(state: Column, pq: Column) -> Column:
        p, q, a = pq["p"], pq["q"], state["a"]
        off = F.get(F.get(a, p), q)
        tau = (F.get(F.get(a, q), q) - F.get(F.get(a, p), p)) / (2 * off)
        t = F.when(tau >= 0, 1.0).otherwise(-1.0) / (F.abs(tau) + F.sqrt(1 + tau * tau))
        small = F.abs(off) <= 1e-300
        cs = let(F.when(small, 0.0).otherwise(t), lambda t_: F.struct(
            (1 / F.sqrt(1 + t_ * t_)).alias("c"), (t_ / F.sqrt(1 + t_ * t_)).alias("s")))
        return let(cs, lambda k: F.struct(let(columns(a, p, q, k), lambda x: rows(x, p, q, k)).alias("a"),
                                          columns(state["v"], p, q, k).alias("v")))

    def rebuilt(s: Column) -> Column:
        kept = F.transform(s["a"], lambda row, i: F.greatest(F.get(row, i), F.lit(0.0)))
        return let(kept, lambda lam: F.transform(s["v"], lambda x: F.transform(
            s["v"], lambda y: total(F.zip_with(F.zip_with(x, y, lambda u, w: u * w), lam, lambda u, e: u * e)))))

    whole = F.forall(m, lambda row: F.forall(row, lambda x: x.isNotNull()))
    return F.when(whole, let(F.aggregate(all_pairs, start, rotate), rebuilt))


def matrix_of(entries: Column, n: Column) -> Column:
    """A matrix of n columns out of an array of (i, j, x) structs that has
    every place once."""
    flat = F.transform(F.array_sort(entries), lambda e: e["x"])
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * n + 1, n))
