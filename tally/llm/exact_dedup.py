"""Exact dedup: counting quotient filters find what may repeat, bytes decide.

1. Every partition normalises its texts (all ASCII white space deleted) and
   counts their fingerprints (the first bits of the SHA-256) in a counting
   quotient filter of its own. The filter is cut by the first bits of the
   fingerprint into shards.
2. The filters of a shard are merged without loss (sorted remainders, counts
   added). What leaves the merge are the fingerprints with a count above one.
3. Only rows with such a fingerprint are routed to verification, with their
   bytes. Texts are compared as grouping keys; a fingerprint that turns out to
   hold several texts is told apart by the bytes, all others need no further
   look at the texts.

Scale: a text that a third of all rows hold is one entry of a partition's
filter, one entry of the merged filter, and one row per task of the verifying
aggregation, which combines before it shuffles. A shard of the merged filters
has about ``SHARD_ROWS`` fingerprints, whatever the size of the table. Unrouted
rows are never shuffled. The repeated fingerprints are broadcast only when
counted to be at most ``BROADCAST_ROWS`` (32 MB); beyond that rows meet them in
a shuffled join. The join that brings the verdict back carries no texts, and its
small side is written first, so Spark may split a hot key.

Defined cases: a null text counts as empty, and all texts without a character
other than white space are equal; very long texts are handled whole. Of equal
texts the row with the most code points in the text as it came stays, then the
smallest ``doc_id`` (null last); of rows equal in that too exactly one stays.
Repeated and null ids are rows like any other. An empty table gives an empty
result. Other columns are ignored by ``find_copies`` and kept, whatever their
names, by ``drop_copies``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tally.llm.common import pack, ship, small, stage, stage_as_is, unpack
from tally.llm.quotient_filter import CountingQuotientFilter, summed
from tally.llm.textkernel import _SPACE, slices

BITS = 64
SHARD_ROWS = 1 << 18
BROADCAST_ROWS = 1 << 22


def normalised(column: pa.Array) -> Iterator[bytes]:
    """The bytes of every text without ASCII white space."""
    for _, data, offsets in slices(column):
        keep = ~_SPACE[data]
        left = data[keep].tobytes()
        ends = np.concatenate([[0], np.cumsum(keep)])[offsets].tolist()
        for start, end in zip(ends, ends[1:]):
            yield left[start:end]


def code_points(column: pa.Array) -> pa.Array:
    """Code points of every text (bytes that do not continue a character)."""
    counts = [np.zeros(0, np.int64)]
    for _, data, offsets in slices(column):
        counts.append(np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]))
    return pa.array(np.concatenate(counts), pa.int64())


def shard_bits(rows: int) -> int:
    """First bits of a fingerprint that name its shard: 16 shards at least."""
    return max(4, int(np.ceil(np.log2(max(1, rows) / SHARD_ROWS))))


def partition_filters(docs: DataFrame, bits: int, shards: int) -> DataFrame:
    """``shard, filter``: the counting quotient filters of every partition, one
    for each shard (``shards``: bits) that has a fingerprint there."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            new = np.array([int.from_bytes(hashlib.sha256(text).digest()[:8], "big")
                            for text in normalised(batch.column(0))], np.uint64) >> np.uint64(64 - bits)
            values, counts = summed(np.concatenate([values, new]),
                                    np.concatenate([counts, np.ones(len(new), np.uint64)]))
        rest = np.uint64(bits - shards)
        shard = (values >> rest).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else shard
        made = [CountingQuotientFilter.of(values[a:b] & ((np.uint64(1) << rest) - np.uint64(1)), bits - shards,
                                          counts[a:b]).to_bytes()
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(shard)])]
        yield pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int64()), pa.array(made, pa.binary())],
                                         ["shard", "filter"])

    ship("tally.llm.textkernel", "tally.llm.quotient_filter", __name__)
    return docs.select("text").mapInArrow(build, "shard long, filter binary")


def merged_repeats(filters: DataFrame, bits: int, shards: int) -> DataFrame:
    """``fp, seen``: fingerprints whose counts over all filters exceed one. The
    filters of a shard come one after another; they are merged whenever they
    hold ``SHARD_ROWS`` slots, so a task holds one merged filter and some more."""

    def emit(shard: int, held: list[CountingQuotientFilter]) -> pa.RecordBatch:
        values, counts = CountingQuotientFilter.merge(held).items()
        again = counts > 1
        values = values[again] | (np.uint64(shard) << np.uint64(bits - shards))
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64), pa.int64()),
                                           pa.array(counts[again].astype(np.int64), pa.int64())], ["fp", "seen"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, slots = None, [], 0
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != shard:
                    if held:
                        yield emit(shard, held)
                    shard, held, slots = key, [], 0
                held.append(CountingQuotientFilter.from_bytes(raw))
                slots += len(held[-1].slots)
                if slots > 2 * SHARD_ROWS and len(held) > 1:
                    held = [CountingQuotientFilter.merge(held)]
                    slots = 0
        if held:
            yield emit(shard, held)

    ship("tally.llm.quotient_filter", __name__)
    return (filters.repartition("shard").sortWithinPartitions("shard")
            .mapInArrow(merge, "fp long, seen long"))


def digests(docs: DataFrame, bits: int, *others: str) -> DataFrame:
    """``others``, then ``chars, sha, fp, norm`` of every text."""
    n = len(others)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = list(normalised(batch.column(n)))
            sha = [hashlib.sha256(text).digest() for text in norm]
            fp = np.array([int.from_bytes(x[:8], "big") for x in sha], np.uint64) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], code_points(batch.column(n)), pa.array(sha, pa.binary()),
                 pa.array(fp.view(np.int64), pa.int64()), pa.array(norm, pa.binary())],
                [*others, "chars", "sha", "fp", "norm"])

    ship("tally.llm.textkernel", "tally.llm.quotient_filter", __name__)
    schema = T.StructType(list(docs.select(*others).schema.fields))
    for name, kind in (("chars", T.LongType()), ("sha", T.BinaryType()), ("fp", T.LongType()),
                       ("norm", T.BinaryType())):
        schema = schema.add(name, kind)
    return docs.select(*others, "text").mapInArrow(digest, schema)


def _classes(docs: DataFrame, bits: int, *others: str) -> DataFrame:
    """``doc_id, others, sha, keep_id, group_size, kept`` of every row."""
    filters = stage_as_is(partition_filters(docs, bits, shards := min(shard_bits(docs.count()), bits - 4)), "filters")
    repeats = stage(merged_repeats(filters, bits, shards).select(F.col("fp").alias("_fp")), "repeats")
    rows = digests(docs, bits, "doc_id", *others)
    marked = rows.join(small(repeats, BROADCAST_ROWS), F.col("fp") == F.col("_fp"), "left")
    marked = stage_as_is(marked.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", *others, "chars", "sha", "fp",
        F.col("_fp").isNotNull().alias("routed"), F.when(F.col("_fp").isNotNull(), F.col("norm")).alias("norm")),
        "routed")
    alone = marked.filter("NOT routed").select("doc_id", *others, "sha", F.col("doc_id").alias("keep_id"),
                                               F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    routed = marked.filter("routed")
    # Byte verification: a text is a grouping key; one row of it per task is shuffled.
    texts = routed.groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("_n"))
    several = stage(texts.groupBy("fp").agg(F.count(F.lit(1)).alias("_t")).filter("_t > 1").select(
        F.col("fp").alias("_fp")), "several-texts")
    if several.isEmpty():
        routed = routed.withColumn("apart", F.lit(None).cast("binary"))
    else:
        routed = routed.join(small(several, BROADCAST_ROWS), F.col("fp") == F.col("_fp"), "left").withColumn(
            "apart", F.when(F.col("_fp").isNotNull(), F.col("norm")))
    order = F.struct(-F.col("chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))
    # Written, so that the join shuffles both sides anew and may split a hot text.
    best = stage(routed.groupBy("fp", "apart").agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("group_size"))
                 .select(F.col("fp").alias("_key"), F.col("apart").alias("_apart"),
                         F.col("_best")["doc_id"].alias("keep_id"), F.col("_best")["uid"].alias("_keep"),
                         "group_size"), "copies")
    met = routed.join(best, (F.col("fp") == F.col("_key")) & F.col("apart").eqNullSafe(F.col("_apart")))
    return alone.unionByName(met.select("doc_id", *others, "sha", "keep_id", "group_size",
                                        (F.col("uid") == F.col("_keep")).alias("kept")))


def find_copies(docs: DataFrame, *, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept,
    text_sha256`` (of the normalised text, lowercase hex). ``bits`` (8 to 64) is
    the width of the fingerprints; it changes the work, never the result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _classes(docs, bits).select("doc_id", "keep_id", "group_size", "kept",
                                       F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, *, bits: int = BITS) -> DataFrame:
    """The rows that stay, with all columns of ``docs`` (which pass through
    the table of digests, so they are written once more)."""
    packed = pack(docs).select("doc_id", "text", F.struct("text", "rest").alias("_row"))
    kept = _classes(packed, bits, "_row").filter("kept")
    return unpack(kept.select(F.col("_row")["text"].alias("text"), F.col("_row")["rest"].alias("rest")), docs.columns)
