"""Role views over the driver's tables.

The driver's tables have no leaves or draws, so each role is mapped onto
them; every view is defined twice, here as DataFrame code and in
``SQL`` as the oracle's text, with the same meaning.

* P  surface rows: lineitem aggregated per (order, line status)
* G  leaf table: orders
* T  long traits: part unpivoted to (size, price)
* DR draws: events as (model, chain, iter, par, value)
* DS draws by species: lineitem aggregated per (supplier, line number): draws grow with the data
* PM regression draws: one regression per DS draw and (response, treatment)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import draws as D
from ..operators import perdraw
from ..operators.traits import pair_collapse
from ..session import cut_lineage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def surface_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: (k, surface, sd, sp); surfaces are line statuses F / O."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("surface"))
            .agg(F.sum("l_quantity").alias("sd"), (F.avg("l_extendedprice") / 1000).alias("sp")))


def leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G: (k, spp, treatment, gs)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("spp"),
                    F.col("o_orderstatus").alias("treatment"), F.col("o_totalprice").alias("gs"))


def long_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: (id, spp, trait, value) with trait in (size, price)."""
    p = table(spark, sf_dir, "part")
    wide = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("spp"),
                    F.col("p_size").cast("double").alias("size"),
                    F.col("p_retailprice").alias("price"))
    return wide.unpivot(["id", "spp"], ["size", "price"], "trait", "value")


def draws_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DR: draws from events; chain = event_id % 4, iter dense per chain; written
    once."""
    e = table(spark, sf_dir, "events")
    base = e.select(F.col("event_type").alias("par"), (F.col("event_id") % 4).cast("int").alias("chain"),
                    "event_id", (F.col("value") - 30).alias("value"))
    idx = D.dense_index(base, ["par", "chain"], "event_id", out="iter")
    return cut_lineage(idx.select(F.lit("events").alias("model"), "chain", "iter", "par", "value"), "draws-events")


def draws_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DS: (iter, spp, gsmax_ww, gsmax_wd, kcatc, sco)."""
    li = table(spark, sf_dir, "lineitem")
    st = F.col("l_linestatus")
    return (li.groupBy(F.col("l_suppkey").alias("iter"), F.col("l_linenumber").alias("spp"))
            .agg(F.avg(F.when(st == "O", F.col("l_quantity"))).alias("gsmax_ww"),
                 F.avg(F.when(st == "F", F.col("l_quantity"))).alias("gsmax_wd"),
                 (F.avg("l_extendedprice") / 1000).alias("kcatc"),
                 (F.avg("l_discount") * 100).alias("sco")))


def stored_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DS written once, for statistics that read the draws several times."""
    return cut_lineage(draws_species(spark, sf_dir), "draws-species")


# (response, treatment) pairs of the per-draw regressions (fixed values).
PAIRS = (("kcatc", "wd"), ("sco", "wd"), ("kcatc", "ww"), ("sco", "ww"))


def draws_species_long(ds: DataFrame) -> DataFrame:
    """DS as (iter, spp, response, treatment, x = gsmax_<t>, y = <response>),
    built in one pass with ``explode`` (no self-union)."""
    items = [F.struct(F.lit(r).alias("response"), F.lit(t).alias("treatment"),
                      F.col(f"gsmax_{t}").alias("x"), F.col(r).alias("y")) for r, t in PAIRS]
    return ds.select("iter", "spp", F.explode(F.array(*items)).alias("_p")).select("iter", "spp", "_p.*")


def regression_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PM: (iter, response, treatment, b0, b1, sigma, n)."""
    return perdraw.per_draw_regression(draws_species_long(stored_species(spark, sf_dir)),
                                       ["iter", "response", "treatment"], "y", "x")


def pair_collapse_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P collapsed: one row per order, surfaces F / O."""
    return pair_collapse(surface_rows(spark, sf_dir), ["k"], sides=("F", "O"))


# ---------------------------------------------------------------- oracle text

SQL = {
    "P": ("SELECT l_orderkey AS k, l_linestatus AS surface, sum(l_quantity) AS sd, "
          "avg(l_extendedprice) / 1000 AS sp FROM lineitem GROUP BY l_orderkey, l_linestatus"),
    "G": ("SELECT o_orderkey AS k, o_orderpriority AS spp, o_orderstatus AS treatment, "
          "o_totalprice AS gs FROM orders"),
    "T": ("SELECT p_partkey AS id, p_brand AS spp, 'size' AS trait, CAST(p_size AS DOUBLE) AS value FROM part "
          "UNION ALL SELECT p_partkey AS id, p_brand AS spp, 'price' AS trait, p_retailprice AS value FROM part"),
    "DR": ("SELECT 'events' AS model, CAST(event_id % 4 AS INTEGER) AS chain, "
           "CAST(row_number() OVER (PARTITION BY event_type, event_id % 4 ORDER BY event_id) AS BIGINT) AS iter, "
           "event_type AS par, value - 30 AS value FROM events"),
    "DS": ("SELECT l_suppkey AS iter, l_linenumber AS spp, "
           "avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS gsmax_ww, "
           "avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS gsmax_wd, "
           "avg(l_extendedprice) / 1000 AS kcatc, avg(l_discount) * 100 AS sco "
           "FROM lineitem GROUP BY l_suppkey, l_linenumber"),
}
SQL["C"] = ("SELECT k, max(sd) FILTER (WHERE surface = 'F') + max(sd) FILTER (WHERE surface = 'O') AS sd, "
            "(max(sp) FILTER (WHERE surface = 'F') + max(sp) FILTER (WHERE surface = 'O')) / 2 AS sp "
            f"FROM ({SQL['P']}) p GROUP BY k")
SQL["DSL"] = " UNION ALL ".join(
    f"SELECT iter, spp, '{r}' AS response, '{t}' AS treatment, gsmax_{t} AS x, {r} AS y FROM ds"
    for r, t in PAIRS)
SQL["PM"] = (
    "SELECT iter, response, treatment, "
    "CASE WHEN regr_count(y, x) >= 3 AND regr_sxx(y, x) > 0 THEN regr_intercept(y, x) END AS b0, "
    "CASE WHEN regr_count(y, x) >= 3 AND regr_sxx(y, x) > 0 THEN regr_slope(y, x) END AS b1, "
    "CASE WHEN regr_count(y, x) >= 3 AND regr_sxx(y, x) > 0 THEN "
    "sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) / (regr_count(y, x) - 2)) END AS sigma, "
    "CAST(regr_count(y, x) AS BIGINT) AS n "
    "FROM dsl GROUP BY iter, response, treatment")


def with_views(*names: str) -> str:
    """A WITH clause defining the named role views for an oracle query."""
    lower = {"P": "p", "G": "g", "T": "t", "DR": "dr", "DS": "ds", "C": "c", "DSL": "dsl", "PM": "pm"}
    need = []
    deps = {"DSL": ["DS"], "PM": ["DS", "DSL"]}
    for n in names:
        for d in deps.get(n, []) + [n]:
            if d not in need:
                need.append(d)
    return "WITH " + ", ".join(f"{lower[n]} AS ({SQL[n]})" for n in need) + " "
