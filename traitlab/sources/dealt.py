"""Draws dealt by draw: a bucketed, sorted store whose joins need no exchange.

``io.write_draws`` lays draws out by parameter, for statistics over all
draws of a parameter.  Per-draw work (C3, C5, D15, D16) goes the other way:
it joins and groups by (chain, iter).  Here every model's draws are written
once into the same number of buckets by those columns, sorted within a
bucket, one file per (model, bucket).  Every later join on exactly (chain,
iter), and every grouping by (chain, iter) and more, reads its bucket and
shuffles nothing.

The layout is known to the session's catalog only, which needs no service:
a manifest beside the data says how the store was dealt, and
``read_dealt`` registers the files again in a session that does not know
them.
"""

from __future__ import annotations

import json
import uuid
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_small, remove_file, write_small
from .io import DRAWS_SCHEMA

#: Columns that name a draw, and by which the store is dealt.
DRAW = ("chain", "iter")
#: Manifest file beside the data; readers skip names with an underscore.
MANIFEST = "_DEALT.json"
#: Rows of all models that one bucket holds, about.
BUCKET_ROWS = 1 << 22
#: Spark's own limit of buckets (spark.sql.sources.bucketing.maxBuckets).
MOST_BUCKETS = 100_000


def _manifest(spark: SparkSession, root: str) -> dict:
    text = read_small(spark, f"{root}/{MANIFEST}")
    if text is None:
        raise ValueError(f"{root}: no finished store of dealt draws")
    return json.loads(text)


def _write(draws: DataFrame, root: str, table: str, buckets: int, mode: str) -> None:
    # dealt by Spark's own bucket rule first: a task writes whole buckets, one file per model in each
    (draws.select(*DRAWS_SCHEMA.fieldNames())
     .select(*[F.col(f.name).cast(f.dataType) for f in DRAWS_SCHEMA.fields])
     .repartition(buckets, *DRAW)
     .write.mode(mode).format("parquet")
     .partitionBy("model").bucketBy(buckets, *DRAW).sortBy(*DRAW)
     .option("path", root).saveAsTable(table))


def write_dealt(draws: DataFrame, root: str, buckets: int | None = None) -> None:
    """Write long draws of any number of models, over a store that is there.

    ``buckets`` follows the number of rows (one more pass over ``draws``)
    unless given.  The manifest goes first and comes back last, so a store
    whose writing was interrupted is never read.  A draw's rows, one per
    parameter and model, are in one bucket; a null chain or iter is a draw
    of its own there, which joins with none.  A null model stays null.
    """
    spark, root = draws.sparkSession, root.rstrip("/")
    if buckets is None:
        buckets = max(1, min(MOST_BUCKETS, -(-draws.count() // BUCKET_ROWS)))
    old = read_small(spark, f"{root}/{MANIFEST}")
    if old is not None:
        spark.sql(f"DROP TABLE IF EXISTS {json.loads(old)['table']}")
        remove_file(spark, f"{root}/{MANIFEST}")
    table = f"dealt_draws_{uuid.uuid4().hex}"
    _write(draws, root, table, buckets, "overwrite")
    write_small(spark, f"{root}/{MANIFEST}", json.dumps({"table": table, "buckets": buckets, "by": list(DRAW)}))


def add_dealt(draws: DataFrame, root: str) -> None:
    """Add the draws of further models to a store, dealt the same way.

    A model that the store has already is an error: its draws would be
    there twice.
    """
    spark, root = draws.sparkSession, root.rstrip("/")
    m, there = _manifest(spark, root), read_dealt(spark, root)
    twice = (draws.select("model").distinct()
             .join(there.select("model").distinct(), "model", "left_semi").limit(5).collect())
    if twice:
        raise ValueError(f"{root}: has draws of {', '.join(sorted(r.model for r in twice))}")
    remove_file(spark, f"{root}/{MANIFEST}")
    _write(draws, root, m["table"], m["buckets"], "append")
    write_small(spark, f"{root}/{MANIFEST}", json.dumps(m))


def read_dealt(spark: SparkSession, root: str, models: Iterable[str] | None = None) -> DataFrame:
    """Read a store of dealt draws; a model filter prunes partitions.

    The result is partitioned by (chain, iter) for as long as both columns
    are kept under their names.
    """
    root = root.rstrip("/")
    m = _manifest(spark, root)
    if not spark.catalog.tableExists(m["table"]):
        cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DRAWS_SCHEMA.fields)
        by, place = ", ".join(m["by"]), root.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {m['table']} ({cols}) USING parquet PARTITIONED BY (model) "
                  f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {m['buckets']} BUCKETS LOCATION '{place}'")
        spark.catalog.recoverPartitions(m["table"])
    df = spark.table(m["table"])
    if models is not None:
        df = df.where(F.col("model").isin(list(models)))
    return df.select(*DRAWS_SCHEMA.fieldNames())


def side_by_side(dealt: DataFrame, sets: dict[str, Column], value: str = "value") -> DataFrame:
    """C3 over one store: a row per (chain, iter, par), a column per draw set.

    ``sets`` names each set and the rows it takes, e.g. ``{"a": F.col("model")
    == "m1"}``.  This is the full join of the sets on (chain, iter, par) as one
    grouping of the store's own buckets, so no set is shuffled; a parameter
    that a set lacks is null there, and rows of no set are left out.  Of a
    value that a set has several times the largest is taken.
    """
    anyone = F.lit(False)
    for rows in sets.values():
        anyone = anyone | rows
    return (dealt.where(anyone).groupBy(*DRAW, "par")
            .agg(*[F.max(F.when(rows, F.col(value))).alias(name) for name, rows in sets.items()]))
