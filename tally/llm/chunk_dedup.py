"""Substring dedup by content-defined chunks (gear rolling hash).

Every text is cut, as UTF-8 bytes, where the low bits of a gear hash of the
last 32 bytes are zero, so an insertion moves only the cuts near it. Chunks are
keyed by a 128-bit digest; the first occurrence of a chunk (smallest document,
then smallest offset) stays. The others go where adjacent ones make a run of at
least ``min_run`` bytes or the whole text: a shorter run is a phrase that texts
share by chance, and cutting it out would leave a broken sentence. A passage
begins and ends within chunks, so with ``reach`` a run first grows at both ends,
byte by byte, as far as the text beside it is that beside the first occurrence.

Scale: digests are reduced by a partial aggregation to those that occur twice
(count and first place), a hot digest is one number per task; only occurrences
of such digests are joined back, where Spark may split a hot digest. To grow
runs, ``reach`` bytes beside first occurrences go to the ends of runs.

Defined cases: a null or empty text has no chunk; a text shorter than
``min_bytes`` is one chunk; very long texts are cut like any other, a chunk ends
after ``max_bytes`` at the latest; documents that share a ``doc_id`` are treated
as one document's parts: pass a unique id (repeated rows then differ by
``part``, which numbers the rows of an id by text). Among occurrences of a
chunk there is no tie, as no two have the same place. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tally.llm.common import ship, stage, stage_as_is
from tally.llm.textkernel import mix64, slices

#: Bytes of the shortest passage to remove, some twenty words.
MIN_RUN = 128
#: Bytes by which a run grows at most at an end: those of the longest chunk.
REACH = 512

_GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def gear_cuts(data: np.ndarray, mask_bits: int) -> np.ndarray:
    """Offsets after which the gear hash of the 32 bytes before has
    ``mask_bits`` leading zero bits (hash = hash * 2 + gear[byte], 32 bits
    wide, so it depends on 32 bytes). Doubling needs five passes."""
    value = _GEAR[data]
    step = 1
    while step < 32:
        shifted = np.zeros_like(value)
        shifted[step:] = value[:-step] << np.uint32(step)
        value = value + shifted
        step *= 2
    return np.flatnonzero(value >> np.uint32(32 - mask_bits) == 0) + 1


def chunk_ends(data: np.ndarray, mask_bits: int, min_bytes: int, max_bytes: int) -> list[int]:
    """Ends of the chunks of one text: the first cut at least ``min_bytes``
    after the last end, else ``max_bytes`` after it, else the end of the text."""
    ends, at, n = [], 0, len(data)
    for cut in gear_cuts(data, mask_bits).tolist():
        while cut - at > max_bytes:
            at += max_bytes
            ends.append(at)
        if cut - at >= min_bytes:
            ends.append(cut)
            at = cut
    while n - at > max_bytes:
        at += max_bytes
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks(docs: DataFrame, *, mask_bits: int, min_bytes: int, max_bytes: int) -> DataFrame:
    """``doc_id, part, start, length, digest`` of every chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0), batch.column(1)
            for row, data, offsets in slices(batch.column(2)):
                rows, starts, lengths, digests = [], [], [], []
                for i in range(len(offsets) - 1):
                    text = data[offsets[i]:offsets[i + 1]]
                    raw, at = text.tobytes(), 0
                    for end in chunk_ends(text, mask_bits, min_bytes, max_bytes):
                        rows.append(row + i)
                        starts.append(at)
                        lengths.append(end - at)
                        digests.append(hashlib.blake2b(raw[at:end], digest_size=16).digest())
                        at = end
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), parts.take(take), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                     pa.array(digests, pa.binary())], ["doc_id", "part", "start", "length", "digest"])

    ship("tally.llm.textkernel", __name__)
    return docs.mapInArrow(cut, "doc_id long, part int, start long, length long, digest binary")


def number_parts(docs: DataFrame, *others: str) -> DataFrame:
    """``doc_id, part, text`` and the columns ``others``: ``part`` is 0 where an
    id is unique; the rows of a repeated id are numbered by text. Only rows of
    repeated ids are shuffled with their texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others)
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    if twice.isEmpty():
        return docs.select("doc_id", F.lit(0).alias("part"), "text", *others)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    twice = twice.select(F.col("doc_id").alias("_id"))
    once = docs.join(twice, same, "left_anti").select("doc_id", F.lit(0).alias("part"), "text", *others)
    again = docs.join(twice, same, "left_semi").withColumn(
        "part", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *others)) - 1)
    return once.unionByName(again.select("doc_id", "part", "text", *others))


def span_runs(spans: list[dict] | None, size: int, min_run: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) that sorted, perhaps overlapping spans cover,
    of ``min_run`` bytes at least or of the whole text."""
    runs: list[list[int]] = []
    for span in spans or ():
        start, end = span["start"], span["start"] + span["length"]
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs if b - a >= min(min_run, size)]


def grown_spans(text: bytes, spans: list[dict] | None) -> list[dict]:
    """Spans, sorted; those with ``beside`` (the bytes before, ``side`` -1, or
    after ``start`` at another place) as long as the text agrees with these."""
    out = []
    for span in spans or ():
        at, beside = span["start"], span["beside"]
        if beside is not None:
            if span["side"] < 0:
                n = len(commonprefix([text[max(0, at - len(beside)):at][::-1], beside[::-1]]))
                span = {"start": at - n, "length": n}
            else:
                span = {"start": at, "length": len(commonprefix([text[at:at + len(beside)], beside]))}
        out.append(span)
    return sorted(out, key=lambda span: span["start"])


def remove_spans(parts: DataFrame, spans: DataFrame, min_run: int = 0) -> DataFrame:
    """Texts without the byte spans (``doc_id, part, start, length``; they may
    overlap) that make runs of ``min_run`` bytes or the whole text: ``doc_id,
    n_bytes, n_removed, n_spans, kept`` (binary), where ``n_spans`` counts
    maximal removed runs. Spans may have ``side, beside`` (``grown_spans``)."""
    key = ["doc_id", "part"]
    grown = "beside" in spans.columns
    told = F.collect_list(F.struct("start", "length", *(["side", "beside"] if grown else [])))
    lists = spans.groupBy(*key).agg((told if grown else F.sort_array(told)).alias("_spans"))
    joined = (parts.select(F.col("doc_id"), F.col("part"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_b"))
              .join(lists.select(F.col("doc_id").alias("_id"), F.col("part").alias("_p"), "_spans"),
                    F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_p")), "left"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone = span_runs(grown_spans(raw, spans) if grown else spans, len(raw), min_run)
                edges = [0, *(x for run in gone for x in run), len(raw)]
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in gone))
                runs.append(len(gone))
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    ship("tally.llm.textkernel", __name__)
    return joined.select("doc_id", "_b", "_spans").mapInArrow(
        apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def beside_firsts(parts: DataFrame, again: DataFrame, reach: int) -> DataFrame:
    """``doc_id, part, start, side, beside``: for both ends of every run of
    adjacent chunks in ``again``, up to ``reach`` bytes beside the first
    occurrence of the chunk there."""
    run = Window.partitionBy("doc_id", "part").orderBy("start")
    end = F.col("start") + F.col("length")
    ends = again.withColumns({"_before": F.lag(end).over(run), "_after": F.lead("start").over(run), "_end": end})

    def side(open_, at, first_at, sign):
        return ends.filter(open_).select("doc_id", "part", at.alias("start"), F.lit(sign).alias("side"),
                                         F.col("first.doc_id").alias("_id"), F.col("first.part").alias("_p"),
                                         first_at.alias("_at"))

    at = F.col("first.start")
    wanted = stage(side(~F.col("_before").eqNullSafe(F.col("start")), F.col("start"), at, -1).unionByName(
        side(~F.col("_after").eqNullSafe(F.col("_end")), F.col("_end"), at + F.col("length"), 1)), "run-ends")
    places = wanted.groupBy("_id", "_p").agg(F.collect_set(F.struct("_at", "side")).alias("_places"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    low = F.when(F.col("_place.side") < 0, F.greatest(F.col("_place._at") - reach, F.lit(0))).otherwise(F.col("_place._at"))
    size = F.when(F.col("_place.side") < 0, F.col("_place._at") - low).otherwise(F.lit(reach))
    beside = (parts.select("doc_id", "part", "text")
              .join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_p")))
              .select(F.col("doc_id").alias("f_id"), F.col("part").alias("f_p"), raw.alias("_b"),
                      F.explode("_places").alias("_place"))
              .select("f_id", "f_p", F.col("_place._at").alias("f_at"), F.col("_place.side").alias("f_side"),
                      F.substring(F.col("_b"), (low + 1).cast("int"), size.cast("int")).alias("beside")))
    # Written, so that the join shuffles both sides anew and may split a hot place.
    beside = stage(beside, "beside-firsts")
    return wanted.join(beside, F.col("_id").eqNullSafe(F.col("f_id")) & (F.col("_p") == F.col("f_p"))
                       & (F.col("_at") == F.col("f_at")) & (F.col("side") == F.col("f_side"))).select(
        "doc_id", "part", "start", "side", "beside")


def dedup_chunks(docs: DataFrame, *, mask_bits: int = 5, min_bytes: int = 16, max_bytes: int = 512,
                 min_run: int = 0, reach: int = 0) -> DataFrame:
    """Documents without the runs of chunks seen before (grown by up to
    ``reach`` bytes at their ends): one row per row of ``docs`` (``doc_id, n_bytes, n_removed, n_spans, kept``)."""
    parts = number_parts(docs)
    found = stage_as_is(chunks(parts, mask_bits=mask_bits, min_bytes=min_bytes, max_bytes=max_bytes), "chunks")
    first = (found.groupBy("digest").agg(F.min(F.struct("doc_id", "part", "start")).alias("_first"),
                                         F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").select("digest", "_first"))
    # Written, so that the join shuffles both sides anew and may split a hot digest.
    first = stage(first, "chunk-firsts")
    again = (found.join(first, "digest")
             .filter(~F.struct("doc_id", "part", "start").eqNullSafe(F.col("_first")))
             .select("doc_id", "part", "start", "length", F.col("_first").alias("first")))
    spans = again.drop("first")
    if reach:
        again = stage(again, "chunks-again")
        none = {"side": F.lit(None).cast("int"), "beside": F.lit(None).cast("binary")}
        spans = again.drop("first").withColumns(none).unionByName(
            beside_firsts(parts, again, reach).withColumn("length", F.lit(0).cast("long")))
    return remove_spans(parts, spans, min_run)
