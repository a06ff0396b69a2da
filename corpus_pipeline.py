"""Corpus pipeline: documents in, the words that a training mix takes out.

``STAGES`` are (name, function) pairs; every function takes
``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns
of ``documents``; the last returns ``doc_id, source, size, source_size, target,
taken``.

Nulls, empty and very long texts, repeated rows, clashing column names and
empty tables are handled as the operators define. After line dedup a document
that lost all its lines has an empty text; near-dedup keeps one of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tally.llm.common import read, stage
from tally.llm.decontaminate import drop_leaks
from tally.llm.line_dedup import dedup_lines
from tally.llm.minhash_dedup import drop_near_duplicates
from tally.llm.mixing import mix_sources
from tally.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that they
    remove; ``n_chars`` follows the text."""
    out = keep_good(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The edit join, the sampling and the latent search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}")
    return docs
