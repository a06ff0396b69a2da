"""Quality rules by cross-document line frequency.

Lines are hashed after normalising (ASCII letters in lower case, white space
collapsed). For every host the distinct documents that hold a line are
counted; lines above the host's limit are removed, and a document that loses
too many of its words is rejected. A few counts over the single text (words,
symbols, repeated lines and windows) come from the same pass.

Distinct documents are those of different texts (by a digest of the whole
text), so exact copies count once: a text that was copied a thousand times is
not boilerplate, a line that stands in a thousand different texts is.

Scale: one pass over the texts gives a narrow table (counts and line hashes);
the counts are two partial aggregations, so a line or host with a third of
all rows is one number per task; lines above the limit are joined back by
(host, line), where Spark may split a hot line.

Defined cases: a null text has no words and fails; a null host is a host of
its own; rows with one ``doc_id`` are judged one by one (``part``); empty
lines are never counted; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tally.llm.chunk_dedup import number_parts
from tally.llm.common import pack, ship, small, stage, stage_as_is, unpack
from tally.llm.textkernel import mix64, sequence_hashes, slices, span_hashes, words

WINDOW = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

_STATS = ("doc_id long, part int, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, digest long, lines array<struct<hash:long,words:int,number:int>>")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: the value occurs twice or more; the value occurred before."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = np.concatenate([[False], ordered[1:] == ordered[:-1]]) if len(key) else np.zeros(0, bool)
    before, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order] = same
    twice[order] = same | np.append(same[1:], False) if len(key) else same
    return twice, before


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of every row of a slice, and its lines that have a word."""
    starts, ends, first = words(data, offsets)
    n_rows, n_words = len(offsets) - 1, len(starts)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    salt = mix64(np.arange(1, n_rows + 1, dtype=np.uint64))
    inside = ~_BLANK[data]

    # Windows of eight words and the words they cover.
    begin = np.flatnonzero(np.arange(n_words) + WINDOW <= first[row + 1]) if n_words else np.zeros(0, np.int64)
    window = sequence_hashes(span_hashes(data, starts, ends), begin, begin + WINDOW)
    twice, _ = _again(window ^ salt[row[begin]])
    change = np.zeros(n_words + 1, np.int64)
    hit = begin[twice]
    np.add.at(change, hit, 1)
    np.add.at(change, hit + WINDOW, -1)
    covered = np.cumsum(change)[:-1] > 0

    # Lines: between row starts and line feeds.
    # Empty rows have none; what follows a line feed at a row's end is no line.
    feeds = np.flatnonzero(data == 10)
    row_start = offsets[:-1][np.diff(offsets) > 0]
    line_start = np.union1d(row_start, feeds + 1)
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, line_start)],
                          offsets[np.minimum(line_row + 1, n_rows)])
    line_end = np.maximum(line_end, line_start)
    low, high = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    real = high > low
    line_start, line_end, line_row, low, high = (x[real] for x in (line_start, line_end, line_row, low, high))
    _, before = _again(span_hashes(data, line_start, line_end) ^ salt[line_row])
    lower = sequence_hashes(span_hashes(_LOWER[data], starts, ends), low, high)

    line_first = np.searchsorted(line_row, np.arange(n_rows + 1))
    number = np.searchsorted(feeds, line_start) - np.searchsorted(feeds, offsets[line_row])
    return {"n_words": np.diff(first), "word_chars": _sums(inside & (data & 0xC0 != 0x80), offsets),
            "n_symbols": _sums(_SYMBOL[data], offsets), "n_dup_lines": _sums(before, line_first),
            "n_repeat_words": _sums(covered, first),
            "line_first": line_first, "line_hash": lower.view(np.int64), "line_words": high - low,
            "line_number": number}


def line_stats(parts: DataFrame) -> DataFrame:
    """``_STATS`` of every row of ``parts`` (``doc_id, part, text, host``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(2)):
                n = len(offsets) - 1
                s = text_stats(data, offsets)
                raw = data.tobytes()
                s["digest"] = np.frombuffer(b"".join(hashlib.blake2b(raw[offsets[i]:offsets[i + 1]], digest_size=8)
                                                     .digest() for i in range(n)), np.int64)
                lines = pa.ListArray.from_arrays(
                    pa.array(s["line_first"].astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(s["line_hash"]),
                                                pa.array(s["line_words"].astype(np.int32)),
                                                pa.array(s["line_number"].astype(np.int32))],
                                               ["hash", "words", "number"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), batch.column(3).slice(row, n)]
                    + [pa.array(s[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                                 "n_repeat_words", "digest")] + [lines],
                    ["doc_id", "part", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     "digest", "lines"])

    ship("tally.llm.textkernel", __name__)
    return parts.select("doc_id", "part", "text", "host").mapInArrow(scan, _STATS)


def judge(parts: DataFrame, *, min_words: int = 20, max_repeat_pct: int = 30, min_docs: int = 20,
          host_share: float = 0.01, max_lost: float = 0.7, short_words: int = 100) -> DataFrame:
    """Verdicts of ``parts`` (``doc_id, part, text, host``, see
    ``number_parts``): the counts, ``base_failed``, ``lost_words`` (words in
    removed lines) and ``kept`` and ``gone`` (numbers of the removed
    lines, counted by line feeds from 0; null for none).

    A line is removed on a host when more than ``min_docs`` and more than
    ``host_share`` of the host's distinct documents hold it. A document is
    kept unless it fails the base rules or loses over ``max_lost`` of its words.
    A document of up to ``short_words`` words that loses one line only is kept as
    long as it has words of its own: a single common line outweighs little text.
    """
    stats = stage_as_is(line_stats(parts), "quality-stats")
    hosts = (stats.groupBy("host", "digest").agg(F.lit(1).alias("_one"))
             .groupBy("host").agg(F.count(F.lit(1)).alias("_docs"))
             .select(F.col("host").alias("_host"), F.greatest(F.lit(float(min_docs)), F.col("_docs") * host_share)
                     .alias("_limit")))
    hosts = small(stage(hosts, "quality-hosts"), 10_000)
    lines = stats.select("doc_id", "part", "host", "digest", F.explode("lines").alias("_l")).select(
        "doc_id", "part", "host", "digest", "_l.hash", "_l.words", "_l.number")
    frequent = (lines.groupBy("host", "hash", "digest").agg(F.lit(1).alias("_one"))
                .groupBy("host", "hash").agg(F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") > min_docs)
                .join(hosts, F.col("host").eqNullSafe(F.col("_host")))
                .filter(F.col("_n") > F.col("_limit"))
                .select(F.col("_host"), F.col("hash").alias("_hash")))
    lost = (lines.join(frequent, (F.col("hash") == F.col("_hash")) & F.col("host").eqNullSafe(F.col("_host")))
            .groupBy(F.col("doc_id").alias("_id"), F.col("part").alias("_p")).agg(F.sum("words").alias("_lost"),
                                                                       F.collect_set("number").alias("gone")))
    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words")))
    lost_words = F.coalesce("_lost", F.lit(0)).cast("long")
    short = (F.col("n_words") <= short_words) & (F.size("gone") == 1) & (lost_words < F.col("n_words"))
    rich = (lost_words <= max_lost * F.col("n_words")) | F.coalesce(short, F.lit(False))
    return (stats.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_p")), "left")
            .select("doc_id", "part", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), lost_words.alias("lost_words"),
                    (~failed & rich).alias("kept"), "gone"))


def quality_rules(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """One row per row of ``docs``; see ``judge``."""
    parts = number_parts(docs.select("doc_id", "text", F.col(host).alias("host")), "host")
    return judge(parts, **limits).drop("part", "gone")


def keep_good(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns and the
    texts without the removed lines."""
    parts = number_parts(pack(docs), "rest")
    verdict = judge(parts.select("doc_id", "part", "text", F.col("rest")[host].alias("host")), **limits)
    changed = verdict.filter(~F.col("kept") | F.col("gone").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col("part").alias("_p"), F.col("kept").alias("_kept"), F.col("gone").alias("_gone"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_p"))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    return unpack(parts.join(changed, same, "left").filter(F.coalesce("_kept", F.lit(True))), docs.columns,
                  F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
