"""One registered query per operator: ``opN_<name>(spark, sf_dir)``.

Every query reads its whole table and gives the operator's full result; texts
and files that an operator makes are reported by digests and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tally.llm.chat_format import conversations, format_preferences, swapped_replies
from tally.llm.chunk_dedup import MIN_RUN, REACH, dedup_chunks
from tally.llm.common import read
from tally.llm.decontaminate import find_leaks
from tally.llm.exact_dedup import find_copies
from tally.llm.hard_negatives import mine_hard_negatives
from tally.llm.html_extract import extract_main_text
from tally.llm.line_dedup import line_report
from tally.llm.minhash_dedup import find_near_duplicates
from tally.llm.mixing import mix_sources
from tally.llm.quality_rules import quality_rules
from tally.llm.suffix_dedup import dedup_substrings
from tally.llm.vector_codes import compress_vectors, label_errors
from tally.llm.warc_audit import audit, write_order


def _kept_digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _ranges(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs made from all conversations (from one of its replies
    on against the next conversation's last reply), formatted."""
    told = conversations(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    out = format_preferences(swapped_replies(told, earlier=True), "conv_id", "donor_id")
    return out.select("conv_id", "donor_id", "n_prompt_turns", "prompt", "chosen", "rejected",
                      _ranges(F.col("chosen_mask")).alias("chosen_mask"),
                      _ranges(F.col("rejected_mask")).alias("rejected_mask"), "trainable")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_digest(dedup_substrings(read(spark, sf_dir, "documents", "doc_id", "text")))


def damaged(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of all pages and those of a replica with known damage: of
    every 97 ids one record has a byte overwritten and one is lost."""
    primary = write_order(pages)
    turn = F.pmod(F.col("page_id") * 31 + 7, F.lit(97))
    rot = F.when((turn == 5) & (F.length("html") > 0), F.concat(F.lit("\u007f"), F.expr("substring(html, 2)"))).otherwise(
        F.col("html"))
    # The replica's records lie where the catalogue puts them: both are written
    # from the same row, so repeated and missing ids need no join.
    both = write_order(pages, replica=rot)
    seen = both.filter(F.coalesce(turn, F.lit(0)) != 11)
    return primary, seen.select("file", "offset", F.col("replica_length").alias("length"),
                                F.col("replica_digest").alias("digest"), "page_id")


def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage found in a replica of all pages as WARC records."""
    return audit(*damaged(read(spark, sf_dir, "pages", "page_id", "url", "html")))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select(*[c for c in out.columns if c != "lost_words"], "lost_words")


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept_digest(dedup_chunks(read(spark, sf_dir, "documents", "doc_id", "text"), min_run=MIN_RUN,
                                      reach=REACH))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(read(spark, sf_dir, "documents", "doc_id", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth id as anchor; labels of every seventh id are off by one."""
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), anchors=F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return label_errors(codes).select("vec_id", "code", "error", "label_error",
                                      F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_minhash_dedup, op3_decontaminate, op4_mixing, op5_suffix_dedup, op6_warc_audit,
    op7_html_extract, op8_line_dedup, op9_quality_rules, op10_chunk_dedup, op11_exact_dedup, op12_hard_negatives, op13_vector_codes)}
