"""Models with any number of terms (K8, K10-K13, K16): sparse designs and
draws in long form, and their products.

A design is long, (ids..., term, value), one row per nonzero entry: a numeric
predictor is a term, a factor level (a species' intercept) a term of its own
that most rows lack.  Draws are long too, (iter, term, value).  Terms get
dense codes; a draw becomes one array over the codes and a row of the design
an array of (code, value) pairs, so a (row, draw) pair is one sparse dot
product inside a task.  Rows and draws meet in blocks whose number follows
the count of draws (``compare.meet``); nothing is shuffled after that.

Statistics that need only means and covariances (prediction moments, Bayesian
R^2) use a covariance matrix in one array column and quadratic forms: no
(row, draw) pair exists.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..session import cut_lineage
from .compare import meet
from .draws import point_interval
from .ranking import join_groups


def long_design(rows: DataFrame, ids: Sequence[str], terms: dict[str, Column],
                factors: Sequence[Column] = ()) -> DataFrame:
    """(ids..., term, value): ``terms`` maps a term's name to its value in the
    row, ``factors`` name the one term of a factor that is 1 in the row.

    Zeros are left out; a NULL value stays, so that the row's predictor is
    NULL; a NULL factor level is a NULL value of the term ``NULL``.
    """
    items = [F.struct(F.lit(t).alias("term"), c.cast("double").alias("value")) for t, c in terms.items()]
    items += [F.struct(F.coalesce(f, F.lit("NULL")).alias("term"), F.when(f.isNotNull(), 1.0).alias("value")) for f in factors]
    return (rows.select(*ids, F.explode(F.array(*items)).alias("_t")).select(*ids, "_t.term", "_t.value")
            .where("value IS NULL OR value <> 0"))


def term_codes(design: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., term, _i, _n): dense codes of a model's terms in name order,
    and how many there are.  The window runs over distinct terms only."""
    keys = list(keys)
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    return (design.select(*keys, "term").distinct()
            .withColumn("_i", (F.row_number().over(by.orderBy("term")) - 1).cast("int"))
            .withColumn("_n", F.count(F.lit(1)).over(by).cast("int")))


def design_vectors(design: DataFrame, codes: DataFrame, ids: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(ids..., _x): a row's nonzero entries as an array of (i, v); ``ids``
    includes ``keys`` and tells rows apart."""
    coded = join_groups(design, codes, [*keys, "term"])
    return coded.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("value").alias("v")))).alias("_x"))


def draw_vectors(draws: DataFrame, codes: DataFrame, keys: Sequence[str] = (), it: str = "iter",
                 extra: Sequence[str] = (), term: str = "term", value: str = "value") -> DataFrame:
    """(keys..., it, _b, extra...): the draw's coefficients over the codes;
    parameters named in ``extra`` (a residual sd) become columns, others that
    the design lacks are left out.  A draw that lacks a coefficient, has it
    twice or has a NULL one is left out."""
    d = join_groups(draws.select(*keys, it, F.col(term).alias("term"), F.col(value).alias("_v")), codes, [*keys, "term"], "left")
    coef = F.when(F.col("_i").isNotNull(), F.struct("_i", "_v"))
    g = d.groupBy(*keys, it).agg(
        F.array_sort(F.collect_list(coef)).alias("_c"), F.count(F.when(F.col("_i").isNotNull(), F.col("_v"))).alias("_full"),
        F.count_distinct("_i").alias("_own"), F.max("_n").alias("_n"),
        *[F.max(F.when(F.col("term") == e, F.col("_v"))).alias(e) for e in extra])
    ok = (F.size("_c") == F.col("_n")) & (F.col("_full") == F.col("_n")) & (F.col("_own") == F.col("_n"))
    return g.where(ok).select(*keys, it, F.transform("_c", lambda c: c["_v"]).alias("_b"), *extra)


def predictor() -> Column:
    """The linear predictor of a (row, draw) pair, from ``_x`` and ``_b``."""
    return L.sparse_dot(F.col("_x"), F.col("_b"))


def linear_predictor(design: DataFrame, draws: DataFrame, ids: Sequence[str], keys: Sequence[str] = (),
                     it: str = "iter") -> DataFrame:
    """(ids..., it, mu): design times draws, every row with every draw of its
    model (equal ``keys``)."""
    codes = term_codes(design, keys)
    x = design_vectors(design, codes, ids, keys)
    b = draw_vectors(draws, codes, keys, it)
    return meet(x, b, keys, it).select(*ids, it, predictor().alias("mu"))


def term_ribbon(design: DataFrame, draws: DataFrame, ids: Sequence[str], keys: Sequence[str] = (), it: str = "iter",
                link: str = "identity", width: float = 0.95, interval: str = "hpd") -> DataFrame:
    """K10 with any terms: point and interval of the (back-transformed)
    predictor per row of the design.  The predictors, read several times, are
    written once."""
    mu = cut_lineage(linear_predictor(design, draws, ids, keys, it), "predictor")
    if link == "exp":
        mu = mu.withColumn("mu", F.exp("mu"))
    return point_interval(mu, list(ids), "mu", width, "median", interval)


def covariance(rows: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """(keys..., mean, cov): mean vector and sample covariance matrix of an
    array column.  Each row emits its upper triangle in place, one partial
    aggregate per (keys, i, j) follows."""
    keys = list(keys)
    pairs = F.flatten(F.transform(vec, lambda a, i: F.transform(
        F.slice(F.col(vec), i + 1, F.size(vec) - i), lambda b, j: F.struct(i.alias("i"), (i + j).alias("j"), a.alias("a"), b.alias("b")))))
    at, i, j = F.struct("_p.i", "_p.j"), F.col("_at.i"), F.col("_at.j")
    g = (rows.select(*keys, F.explode(pairs).alias("_p")).groupBy(*keys, at.alias("_at"))
         .agg(F.covar_samp("_p.a", "_p.b").alias("_cv"), F.avg("_p.a").alias("_av")))
    x = F.col("_cv").alias("x")
    both = F.when(i == j, F.array(F.struct(i.alias("i"), j.alias("j"), x))).otherwise(
        F.array(F.struct(i.alias("i"), j.alias("j"), x), F.struct(j.alias("i"), i.alias("j"), x)))
    return (g.groupBy(*keys).agg(
        F.flatten(F.collect_list(both)).alias("_e"),
        F.array_sort(F.collect_list(F.when(i == j, F.struct(i.alias("i"), F.col("_av").alias("m"))))).alias("_m"))
        .select(*keys, F.transform("_m", lambda e: e["m"]).alias("mean"), L.matrix_of(F.col("_e"), F.size("_m")).alias("cov")))


def predict_terms(design: DataFrame, draws: DataFrame, ids: Sequence[str], keys: Sequence[str] = (), it: str = "iter",
                  sigma: str = "sigma") -> DataFrame:
    """K11 with any terms: (ids..., pred_mean, pred_sd).  With m and S the mean
    and covariance of the draws' coefficients, the mean is x'm and the
    variance x'Sx + E[sigma^2]."""
    codes = term_codes(design, keys)
    x = design_vectors(design, codes, ids, keys)
    b = draw_vectors(draws, codes, keys, it, [sigma])
    mom = join_groups(covariance(b, keys, "_b"), b.groupBy(*keys).agg(F.avg(F.col(sigma) * F.col(sigma)).alias("_es2")), keys)
    j = join_groups(x, mom, keys)
    half = F.transform("cov", lambda row: L.sparse_dot(F.col("_x"), row))
    return j.select(*ids, L.sparse_dot(F.col("_x"), F.col("mean")).alias("pred_mean"),
                    F.sqrt(L.sparse_dot(F.col("_x"), half) + F.col("_es2")).alias("pred_sd"))


def bayes_r2_terms(design: DataFrame, obs: DataFrame, draws: DataFrame, ids: Sequence[str], y: str,
                   keys: Sequence[str] = (), it: str = "iter") -> DataFrame:
    """K16 with any terms: (keys..., it, r2), var(mu) / (var(mu) + var(y - mu))
    over the observations.

    With S the covariance of the design's columns and c theirs with y,
    var(mu) = b'Sb and var(y - mu) = var(y) + b'Sb - 2 b'c; the matrix of
    (columns, y) comes from the observations once.  ``obs`` holds ``ids`` and
    ``y``; observations with a NULL in y or the design are left out.
    """
    keys = list(keys)
    codes = term_codes(design, keys)
    x = join_groups(design_vectors(design, codes, ids, keys), codes.select(*keys, "_n").distinct(), keys)
    x = join_groups(x, obs.where(F.col(y).isNotNull()).select(*ids, F.col(y).alias("_y")), ids)
    x = x.where(F.forall("_x", lambda e: e["v"].isNotNull()))
    dense = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.aggregate(
        F.filter("_x", lambda e: e["i"] == i), F.lit(0.0), lambda acc, e: acc + e["v"]))
    mom = covariance(x.select(*keys, F.concat(dense, F.array("_y")).alias("_v")), keys, "_v")
    j = join_groups(draw_vectors(draws, codes, keys, it), mom, keys)
    k = F.size("_b")
    inner = F.transform(F.slice("cov", 1, k), lambda row: F.slice(row, 1, k))
    j = j.select(*keys, it, L.quadratic(inner, F.col("_b")).alias("_vmu"),
                 L.dot(F.slice(F.get("cov", k), 1, k), F.col("_b")).alias("_bc"), F.get(F.get("cov", k), k).alias("_vy"))
    return j.select(*keys, it, (F.col("_vmu") / F.nullif(2 * F.col("_vmu") + F.col("_vy") - 2 * F.col("_bc"), F.lit(0.0))).alias("r2"))
