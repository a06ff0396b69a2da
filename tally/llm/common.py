"""Shared helpers: table reads, staged tables, Python code shipped by value."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from tally.session import stage as stage_as_is

#: A word is a run of bytes other than space and the five ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "read", "stage", "stage_as_is", "ship", "small", "word_count", "pack",
           "unpack"]


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


#: Rows per batch between Spark and Python: texts are long, and both sides
#: hold whole batches (off the heap, and kept by their allocators).
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(*modules: str) -> None:
    """Pickle the functions of these modules by value, so that executors need
    no installation of this package, and bound the session's batches."""
    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])
    spark = SparkSession.getActiveSession()
    if spark is not None and not 0 < int(spark.conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def stage(df: DataFrame, name: str) -> DataFrame:
    """``tally.session.stage`` for the result of a shuffle: at most four files
    (and last tasks) per core. ``stage_as_is`` writes one per task, for scans."""
    return stage_as_is(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), name)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (cheap to count: a staged table) marked for broadcast when it
    has at most ``rows`` rows; beyond that the planner joins it by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pack(docs: DataFrame) -> DataFrame:
    """``doc_id, text, rest``: all other columns (and ``doc_id`` as it came) in
    one, so that their names cannot clash with those of an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))


def unpack(packed: DataFrame, columns: list[str], text=None) -> DataFrame:
    """The columns of the frame that ``pack`` took, perhaps with a new text."""
    text = F.col("text") if text is None else text
    return packed.select(*[(text if c == "text" else F.col("rest")[c]).alias(c) for c in columns])


def word_count(text):
    """Words of a text column; null counts 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
