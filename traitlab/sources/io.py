"""Sources and sinks.

* CSV scans always take an explicit schema; the literal ``NA`` is NULL.
* Draws are stored long, ``(model, chain, iter, par, value)``, as parquet
  partitioned by ``model`` so that reading one model prunes the others.
* ``materialize`` is the compute-or-reuse switch: write once, then read.
"""

from __future__ import annotations

import json
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import file_length, path_exists, read_small, remove_file, write_small

# Schemas of the three trait tables and of long draws (fixed values).
SURFACE_SCHEMA = T.StructType([
    T.StructField("spp", T.StringType()),
    T.StructField("treatment", T.StringType()),
    T.StructField("rep", T.StringType()),
    T.StructField("surface", T.StringType()),
    T.StructField("sd", T.DoubleType()),
    T.StructField("si", T.DoubleType()),
    T.StructField("sp", T.DoubleType()),
])

LEAF_SCHEMA = T.StructType([
    T.StructField("spp", T.StringType()),
    T.StructField("treatment", T.StringType()),
    T.StructField("rep", T.StringType()),
    T.StructField("LA1", T.DoubleType()),
    T.StructField("gs", T.DoubleType()),
])

LONG_TRAIT_SCHEMA = T.StructType([
    T.StructField("spp", T.StringType()),
    T.StructField("trait", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

DRAWS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("chain", T.IntegerType()),
    T.StructField("iter", T.LongType()),
    T.StructField("par", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             strict: bool = True) -> DataFrame:
    """A1: columns by header name, types from ``schema``, ``NA`` as NULL.

    The header line is read first (one line): the file's columns may come in
    any order and may be more than ``schema`` names; a missing one is an
    error.  A UTF-8 byte-order mark and CRLF line ends are handled.
    ``strict`` fails on malformed rows instead of nulling them.
    """
    head = spark.read.option("header", True).option("encoding", "UTF-8").csv(path).columns
    names = [c.lstrip("\ufeff").strip() for c in head]
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in header {', '.join(names)}")
    kinds = {f.name: f.dataType for f in schema.fields}
    in_file = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    df = (spark.read.schema(in_file)
          .option("header", True)
          .option("nullValue", "NA")
          .option("mode", "FAILFAST" if strict else "PERMISSIVE")
          .option("encoding", "UTF-8")
          .csv(path))
    return df.select(*[f.name for f in schema.fields])


def read_excel_twin(spark: SparkSession, csv_twin: str,
                    schema: T.StructType = LONG_TRAIT_SCHEMA) -> DataFrame:
    """A2: the workbook is read through its CSV twin (same columns)."""
    return read_csv(spark, csv_twin, schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a table as CSV with a header; NULL is written as ``NA``."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)


def write_draws(draws: DataFrame, root: str, mode: str = "overwrite") -> None:
    """A4: long draws, partitioned by model.

    Rows are range-partitioned on (model, par, chain, iter) before the
    write: each file holds a narrow run of parameters (row-group statistics
    on ``par`` then skip most of a file in per-parameter scans), and because
    the range boundaries are sampled from the data, a parameter holding a
    large share of the draws is split over many write tasks instead of one.
    Dynamic partition overwrite replaces only the models being written.
    """
    (draws.select(*[f.name for f in DRAWS_SCHEMA.fields])
     .repartitionByRange("model", "par", "chain", "iter")
     .write.mode(mode)
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy("model")
     .parquet(root))


def read_draws(spark: SparkSession, root: str,
               models: Iterable[str] | None = None) -> DataFrame:
    """A3: read the draws store; a model filter prunes partitions (a model's
    name stays text, also where it looks like a number)."""
    df = spark.read.schema(DRAWS_SCHEMA).parquet(root)
    if models is not None:
        df = df.where(F.col("model").isin(list(models)))
    return df.select(*[f.name for f in DRAWS_SCHEMA.fields])


def fingerprint(df: DataFrame) -> dict:
    """What a table holds, whatever the order of its rows: schema, row count,
    and two checksums (sum and xor of 64-bit row hashes), from one scan; with
    the names and lengths of the files under it."""
    spark, names = df.sparkSession, df.columns
    cols = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in df.schema[c].dataType.simpleString() else F.col(f"`{c}`") for c in names]
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.lit(0), *cols).cast("decimal(38,0)")),
               F.bit_xor(F.xxhash64(F.lit(1), *cols))).first()
    files = sorted([f, file_length(spark, f)] for f in df.inputFiles())
    return {"schema": df.schema.simpleString(), "rows": r[0], "sum": str(r[1]), "xor": str(r[2]), "files": files}


#: Manifest file beside a stored result; readers skip names with an underscore.
MANIFEST = "_MANIFEST.json"


def materialize(spark: SparkSession, path: str, builder: Callable[[], DataFrame],
                rerun: bool = False, partition_by: Iterable[str] = (),
                writer: Callable[[DataFrame, str], None] | None = None,
                inputs: dict[str, DataFrame] | None = None, params: dict | None = None) -> DataFrame:
    """A5: compute-or-reuse, the switch between fitting again and reading a
    saved result.

    The DataFrame is built and written when ``rerun`` is set, when ``path``
    has no finished copy (the ``_SUCCESS`` marker of Spark's committer), or
    when the copy is stale; then the stored copy is read.  With ``inputs``
    (named tables the builder reads) or ``params`` (its settings) a manifest
    of both lies beside the data, ``MANIFEST``: each input's ``fingerprint``
    and the parameters.  A copy whose manifest differs, or that has none, is
    stale.  The manifest goes before the data is rewritten and comes back
    last, so an interrupted run never leaves a manifest on data it does not
    describe.  ``writer(df, folder)`` replaces the default parquet write
    (e.g. ``write_draws``).
    """
    path = path.rstrip("/")
    tracked = inputs is not None or params is not None
    want = json.dumps({"inputs": {k: fingerprint(v) for k, v in sorted((inputs or {}).items())}, "params": params or {}},
                      sort_keys=True, default=str) if tracked else None
    fresh = path_exists(spark, f"{path}/_SUCCESS") and (not tracked or read_small(spark, f"{path}/{MANIFEST}") == want)
    if rerun or not fresh:
        remove_file(spark, f"{path}/{MANIFEST}")
        if writer is not None:
            writer(builder(), path)
        else:
            parts = list(partition_by)
            w = builder().write.mode("overwrite")
            (w.partitionBy(*parts) if parts else w).parquet(path)
        if tracked:
            write_small(spark, f"{path}/{MANIFEST}", want)
    return spark.read.parquet(path)


def base_name(par: Column) -> Column:
    """Name of a parameter without its ``[i]`` / ``[i,j]`` index."""
    return F.regexp_replace(par, r"\[[^\]]*\]$", "")


def select_pars(draws: DataFrame, pars: Iterable[str], par_col: str = "par") -> DataFrame:
    """Keep the chosen parameters; a base name selects all its elements
    (equality and prefix tests, which reach the scan)."""
    p, keep = F.col(par_col), F.lit(False)
    for name in pars:
        keep = keep | (p == name) | (p.startswith(f"{name}[") & p.endswith("]"))
    return draws.where(keep)


def write_table(df: DataFrame, path: str, order_by: Iterable[str] = ()) -> None:
    """A presentation table (string cells) written as CSV with header.

    With ``order_by`` the parts are range-sorted, so the files read in name
    order give the rows in order; no task holds the whole table.
    """
    keys = list(order_by)
    write_csv(df.orderBy(*keys) if keys else df, path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read a table written by ``write_table`` (``NA`` is NULL, so empty
    cells stay empty strings)."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
