"""Spark session and shared-folder helpers.

Everything in traitlab is lazy DataFrame code; the session only carries
the settings that matter at scale (AQE, skew handling) and the location of
the shared checkpoint folder.  On a cluster that folder is named by
``spark.checkpoint.dir``; we only pick one ourselves when it is unset
(local runs and tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "traitlab", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every query relies on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir);
    only when neither is set, and the master is local, do we make one and
    register it: on a cluster a machine-local folder would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="traitlab-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut_lineage(df, name: str = "cut"):
    """Write an intermediate as a table in the shared folder and read it back.

    Used where one expensive intermediate (a ranked table) feeds several
    statistics: it is computed once (a single job, unlike an RDD checkpoint
    of an unpersisted plan, which computes it twice), survives executor
    loss, and plans built on it start from a leaf instead of repeating its
    whole lineage.  Never a machine-local folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_root(spark: SparkSession) -> str:
    """This session's scratch folder under the shared folder (one per
    application, so ``cleanup_scratch`` removes only this session's files)."""
    return f"{shared_root(spark)}/traitlab/scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under this session's scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cleanup_scratch(spark: SparkSession) -> None:
    """Delete this session's scratch tables (lineage cuts, round trips).

    Call when the DataFrames built on them are no longer needed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system the session uses."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def file_length(spark: SparkSession, path: str) -> int:
    fs, p = _file(spark, path)
    return int(fs.getFileStatus(p).getLen())


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small text file's content; None if there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file, over one that is there."""
    fs, p = _file(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def remove_file(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, False)
