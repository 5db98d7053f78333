"""Helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: ASCII white space; words are the runs of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches of whole texts that a Python worker holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lost executors
    cost a re-read, and the lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column without nulls as a matrix of doubles ``dim`` wide;
    shorter lists go on with 0."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(n), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


#: A group with more rows than this share of all is dealt to several tasks.
HOT_SHARE = 2000


def join_hot(rows: DataFrame, groups: DataFrame, keys: list, count: str) -> DataFrame:
    """``rows`` joined with ``groups`` on ``keys`` by shuffle; ``groups`` (a
    written table) has a row per key with its number of rows, ``count``.  A
    group with more than one in ``HOT_SHARE`` of the counted rows, of which
    there are at most ``HOT_SHARE``, is broadcast by key, its rows are dealt
    to as many parts, and its row of ``groups`` is copied to each."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    most = max(1000, total // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("_parts")))
    left = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), "_parts"), F.lit(0)).cast("int"))
    right = groups.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return left.drop("_parts").join(right.drop("_parts").hint("shuffle_hash"), [*keys, "_salt"]).drop("_salt")


def let(value, fn):
    """``fn`` of a column that is computed once per row, however often ``fn``
    uses it (also inside the function of a higher-order function, where a
    plain expression would be computed again for every element)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components: ``(id, component)``, the smallest id reachable,
    one row per id that occurs in an edge.

    Alternating large-star / small-star rounds on a DataFrame of edges kept
    as (u, v) with u > v.  Each round aggregates a minimum per vertex (with
    map-side combine) and joins it back, and writes its edges to the shared
    folder; the loop ends when a round changes nothing (every vertex then
    points straight at the smallest id of its component).  Only a count and
    a checksum reach the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = written(e, "edges")
    seen = _mark(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.u", "x.v").where("u > v").distinct())
        e = written(small, "edges")
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: no fixed point; raise max_rounds")
    return (e.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(r[0]), r[1]


def forest(n: int, a, b):
    """Which of the pairs (a[i], b[i]) over 0..n-1 join two trees when taken
    in order: at most n - 1 pairs keep every connection of all of them."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return keep
