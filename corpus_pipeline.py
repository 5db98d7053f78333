"""Corpus pipeline: five stages from documents to packed bins.

Each stage takes (spark, docs, sf_dir), calls one operator of
``traitlab.llm`` with production parameters on all rows it is given, and
returns a DataFrame; all but the last keep the columns of ``documents``.  A
stage's rows are written as Parquet before the next one reads them.

Every stage takes null or repeated ids, null, empty and very long texts,
repeated rows, an empty table and further columns of any name (which it
carries, up to the packing): a null text is scored as an empty one, has no
lines, words or bytes to lose, counts as a text without words for the near
duplicates, and takes no place in a bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlab.llm.common import table, written
from traitlab.llm.line_dedup import line_dedup
from traitlab.llm.packing import pack
from traitlab.llm.quality_model import keep_good
from traitlab.llm.simhash_dedup import keep_first
from traitlab.llm.suffix_dedup import drop_repeats


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` counted anew."""
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of two lines or of 20 words go from the texts."""
    return _same_columns(line_dedup(docs, min_words=20), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest id."""
    return keep_first(docs, shingle=3, budget=3)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in repeated 200-byte strings go from the texts."""
    return _same_columns(drop_repeats(docs, length=200), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into bins, a row per piece."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The first stage is a fitted model, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
