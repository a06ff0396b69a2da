"""Exact substring dedup: bytes covered by a string of ``length`` bytes that
also starts somewhere else.

Method. Suffixes are sorted to a bounded depth, which gives a Burrows-Wheeler
transform; intervals of suffixes that share a prefix are expanded breadth
first by one symbol to the left at a time, so common-prefix lengths become
known in increasing order, and the expansion stops at ``length``: where no
value was found, two neighbours share ``length`` bytes.

Scale. A transform over the whole corpus would be one job without shards, so
strings are first brought together: every window of ``length`` bytes belongs
to the smallest hash of a 32-byte gram inside it, and equal windows have equal
grams at equal offsets. The windows of one gram occurrence form a *fragment*.
Fragments whose gram occurs once need no more work; equal fragments are
aggregated to one with a multiplicity; fragments that share no more than the
gram with another (a common line in different contexts) drop out by their
cores; the other distinct fragments of a gram go to one shard of about ``shard_bytes``, where the transform runs with the
multiplicities. A gram with more than ``split_rows`` distinct fragments is
split: windows are keyed by the longer
core that all windows of a piece of the fragment share, down to the window
itself, so no group grows with the corpus and no pair of equal windows is
separated.

Defined cases: null texts are empty; texts under ``length`` bytes keep every
byte; matches never cross rows; rows with one ``doc_id`` are separate parts;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tally.llm.chunk_dedup import number_parts, remove_spans
from tally.llm.common import ship, small, stage, stage_as_is
from tally.llm.textkernel import gram_hashes, mix64, slices, span_hashes

GRAM = 32
START = 7  # symbols compared at once before the expansion begins
_FRAGMENT = "doc_id long, part int, start int, n int, anchor int, gram long, digest long"


def window_minima(value: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        value = np.minimum(value[:-done], value[done:])
        done *= 2
    rest = width - done
    return np.minimum(value[:-rest], value[rest:]) if rest else value


def fragments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window start (in the row), number of windows, offset of the
    gram from the first start, gram hash and digest of every fragment."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    gram = gram_hashes(data, GRAM)
    # Order by 40 bits of the hash, then by place: equal windows choose the
    # same offset. A slice is under 2**24 bytes, see ``pieces``.
    order = (gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n - GRAM + 1, dtype=np.uint64)
    chosen = (window_minima(order, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(chosen)]
    start = np.flatnonzero(np.arange(len(chosen)) + length <= offsets[row + 1])
    if not len(start):
        return none, none, none, none, none, none
    place = chosen[start]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    digest = span_hashes(data, begin, begin + count - 1 + length)
    rows = row[begin]
    return (rows, begin - offsets[rows], count, place[first] - begin, gram[place[first]].view(np.int64),
            mix64(digest ^ np.uint64(0x51)).view(np.int64))


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, limit: int = 1 << 23):
    """A slice as it is, or a very long text in pieces that overlap by
    ``length - 1`` bytes, so that every window is in exactly one piece."""
    if len(data) <= limit:
        yield 0, data, offsets
        return
    for at in range(0, len(data), limit):
        part = data[at:at + limit + length - 1]
        if len(part) >= length:
            yield at, part, np.array([0, len(part)])


def find_fragments(parts: DataFrame, length: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(2), 1 << 18):
                for shift, piece, ends in pieces(data, offsets, length):
                    rows, start, count, anchor, gram, digest = fragments(piece, ends, length)
                    take = pa.array(rows + row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take),
                         pa.array((start + shift).astype(np.int32)), pa.array(count.astype(np.int32)),
                         pa.array(anchor.astype(np.int32)), pa.array(gram), pa.array(digest)],
                        ["doc_id", "part", "start", "n", "anchor", "gram", "digest"])

    return parts.mapInArrow(scan, _FRAGMENT)


def bounded_suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``depth`` symbols or more (ties in any order);
    ranks double in reach and only suffixes that still tie are sorted. Also
    the first ``START`` symbols of every suffix in that order, as numbers."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, symbols.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(START):
        key = (key << 9) | padded[j:j + n]
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.zeros(n + 1, np.int64)
    heads = np.flatnonzero(new)
    rank[sa] = np.repeat(heads, np.diff(np.append(heads, n))) + 1
    reach = START
    single = new & np.append(new[1:], True)
    slots = np.flatnonzero(~single)  # places in ``sa`` that still tie
    while reach < depth and len(slots):
        suffix = sa[slots]
        key = (rank[suffix] << 32) | rank[np.minimum(suffix + reach, n)]
        order = np.argsort(key)
        suffix, key = suffix[order], key[order]
        sa[slots] = suffix
        new = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(new)
        rank[suffix] = np.repeat(slots[heads], np.diff(np.append(heads, len(slots)))) + 1
        single = new & np.append(new[1:], True)
        slots = slots[~single]
        reach *= 2
    return sa, ordered


def bounded_prefix_breaks(symbols: np.ndarray, sa: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of every suffix in ``sa`` with the one before it, as far
    as it is under ``length``; -1 where at least ``length`` symbols agree.

    Breadth first over the intervals of the transform: the rows of an interval
    with prefix w move, by the last-to-first mapping, to the intervals of cw.
    An interval whose right border has no value yet sets it to the present
    length and lives on; the others are known already. Values under ``START``
    (at most ``length``) come from the suffixes' first symbols; the intervals
    of their length that would live on are the first ones.
    """
    n = len(symbols)
    bwt = symbols[sa - 1]
    forward = np.empty(n, np.int32)
    forward[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    border = np.full(n + 1, -1, np.int64)  # border[i]: between suffixes i - 1 and i
    differ = starts[1:] ^ starts[:-1]
    inner = np.flatnonzero(differ) + 1
    border[inner] = sum((differ[inner - 1] >> (9 * j) == 0).astype(np.int64) for j in range(START - 1, 0, -1))
    border[0] = border[n] = 0
    heads = np.append(0, inner)
    sizes = np.diff(np.append(heads, n))
    keep = np.repeat(border[heads + sizes] == START - 1, sizes)
    keep[n - sizes[-1]:] = False
    rows = np.flatnonzero(keep).astype(np.int32)
    owner = np.repeat(np.arange(len(heads), dtype=np.int32), sizes)[keep]
    for level in range(START, length):
        if not len(rows):
            break
        symbol = bwt[rows]
        order = np.argsort(symbol, kind="stable")  # also the order of the rows they move to
        to, owner, symbol = forward[rows[order]], owner[order], symbol[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(to)))
        right = to[heads + sizes - 1] + 1
        open_ = border[right] < 0
        border[right[open_]] = level
        keep = np.repeat(open_, sizes)
        rows = to[keep]
        owner = np.repeat(np.arange(len(heads), dtype=np.int32), sizes)[keep]
    return border[:n]


def repeated_starts(texts: list[bytes], windows: np.ndarray, copies: np.ndarray,
                    length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every text (given ``copies`` times in the corpus) the starts below
    its ``windows`` whose ``length`` bytes start elsewhere too, as runs: text,
    first start and number of starts. A text is longer than its windows."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    used, symbols = np.unique(flat, return_inverse=True)
    symbols = symbols.astype(np.uint8 if len(used) < 256 else np.uint16) + 1  # 0 ends a text
    symbols[begin[1:] - 1] = 0
    which = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(begin[-1]) - begin[which]
    weight = np.where(inside < windows[which], copies[which], 0)
    sa, starts = bounded_suffix_order(symbols, length + 1)
    breaks = bounded_prefix_breaks(symbols, sa, starts, length)
    breaks[0] = 0
    heads = np.flatnonzero(breaks >= 0)
    total = np.add.reduceat(weight[sa], heads)
    twice = np.zeros(begin[-1], np.int8)
    twice[sa] = np.repeat(total >= 2, np.diff(np.append(heads, len(sa))))
    twice[weight == 0] = 0
    change = np.diff(twice, prepend=0, append=0)
    start, end = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
    return which[start], inside[start], end - start


_PIECE = "gram long, digest long, n int, anchor int, copies long, bytes binary"
_CORED = _PIECE + ", left long, right long"
_RUN = "gram long, digest long, runs array<struct<start:int,n:int>>"


def shard_runs(distinct: DataFrame, length: int, shards: int) -> DataFrame:
    """Repeated runs of distinct fragments (``gram, digest, n, copies, bytes``);
    all fragments of a gram meet in one shard."""

    def run(table: pa.Table) -> pa.Table:
        text, start, n = repeated_starts(table.column("bytes").to_pylist(), table.column("n").to_numpy(),
                                         table.column("copies").to_numpy(), length)
        ends = np.searchsorted(text, np.arange(table.num_rows + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                                          ["start", "n"])
        return pa.table({"gram": table.column("gram"), "digest": table.column("digest"),
                         "runs": pa.ListArray.from_arrays(pa.array(ends), runs)})

    return (distinct.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
            .groupBy("shard").applyInArrow(run, _RUN).filter(F.size("runs") > 0))


def cores(data: bytes, n: int, anchor: int, length: int) -> tuple[int | None, int | None]:
    """Hashes of what all windows of a fragment contain whose gram lies in
    their right half (the gram and as much before it), and of what all others
    contain (the gram and as much after it); None without such windows."""
    half = (length - GRAM) // 2
    raw = np.frombuffer(data, np.uint8)
    one = np.zeros(1, np.int64)

    def of(a: int, b: int) -> int:
        return int(span_hashes(raw[a:b], one, one + (b - a)).view(np.int64)[0])

    return (of(anchor - half, anchor + GRAM) if anchor >= half else None,
            of(anchor, anchor + length - half) if anchor - n + 1 < half else None)


def with_partners(distinct: DataFrame) -> DataFrame:
    """Fragments (``_CORED``) that may hold a repeated window: those with
    copies, and those that share a core with another one."""
    parts = distinct.select("gram", "digest", "copies", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.col("left").alias("core")),
        F.struct(F.lit("r").alias("side"), F.col("right").alias("core")))).alias("_c")).select(
        "gram", "digest", "copies", "_c.side", "_c.core").filter("core is not null")
    shared = (parts.groupBy("gram", "side", "core").agg(F.sum("copies").alias("_all")).filter("_all > 1")
              .drop("_all"))
    wanted = parts.join(shared, ["gram", "side", "core"]).select("gram", "digest").distinct()
    return distinct.join(wanted, ["gram", "digest"]).drop("left", "right")


def split_fragments(hot: DataFrame, length: int, step: int) -> DataFrame:
    """Fragments in pieces of at most ``step`` windows. The new ``gram`` is the
    hash of the core that all ``step`` windows of a piece contain, so equal
    windows still meet. Keeps the fragment as ``of_gram``, ``of_digest`` and
    the piece's place in it as ``shift``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                # Window s has the gram at offset anchor - s; piece j has offsets j * step to j * step + step - 1.
                s = 0
                while s < r["n"]:
                    offset = r["anchor"] - s
                    j = offset // step
                    end = min(r["n"], r["anchor"] - j * step + 1)
                    data = np.frombuffer(r["bytes"][s:end - 1 + length], np.uint8)
                    low = s - (j * step + step - 1 - offset)  # start of the widest window, may be before the piece
                    core = np.frombuffer(r["bytes"][low + step - 1:low + length], np.uint8)
                    one = np.zeros(1, np.int64)
                    part = np.array([r["gram"] + j], np.int64).view(np.uint64)
                    key = mix64(span_hashes(core, one, one + len(core)) ^ mix64(part))
                    out.append({"gram": int(key.view(np.int64)[0]),
                                "digest": int(span_hashes(data, one, one + len(data)).view(np.int64)[0]),
                                "n": end - s, "anchor": offset, "copies": r["copies"], "bytes": data.tobytes(),
                                "of_gram": r["gram"], "of_digest": r["digest"], "shift": s})
                    s = end
            yield pa.RecordBatch.from_pylist(out, schema=_split_schema())

    return hot.select("gram", "digest", "n", "anchor", "copies", "bytes").mapInArrow(
        cut, _PIECE + ", of_gram long, of_digest long, shift int")


def _split_schema() -> pa.Schema:
    return pa.schema([("gram", pa.int64()), ("digest", pa.int64()), ("n", pa.int32()), ("anchor", pa.int32()),
                      ("copies", pa.int64()), ("bytes", pa.binary()), ("of_gram", pa.int64()),
                      ("of_digest", pa.int64()), ("shift", pa.int32())])


def distinct_runs(distinct: DataFrame, length: int, shard_bytes: int, split_rows: int,
                  steps: tuple[int, ...]) -> DataFrame:
    """Runs of all fragments: grams with up to ``split_rows`` distinct ones go
    to shards as they are, the others are split and tried again."""
    per_gram = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("_rows"))
    wide = stage(per_gram.filter(F.col("_rows") > split_rows).select("gram"), "suffix-wide")
    split = bool(steps) and not wide.isEmpty()
    near = distinct.join(small(wide, 10_000), "gram", "left_anti") if split else distinct
    size = near.agg(F.sum(F.length("bytes"))).first()[0] or 0
    runs = shard_runs(near, length, max(1, -(-size // shard_bytes)))
    if not split:
        return runs
    cut = stage(split_fragments(distinct.join(small(wide, 10_000), "gram"), length, steps[0]), "suffix-split")
    again = (cut.groupBy("gram", "digest")
             .agg(F.first("n").alias("n"), F.first("anchor").alias("anchor"), F.sum("copies").alias("copies"),
                  F.first("bytes").alias("bytes")))
    twice = cut.groupBy("gram").agg(F.sum("copies").alias("_all")).filter("_all > 1").select("gram")
    again = stage(again.join(twice, "gram"), "suffix-pieces")
    back = (cut.select("gram", "digest", "of_gram", "of_digest", "shift")
            .join(distinct_runs(again, length, shard_bytes, split_rows, steps[1:]), ["gram", "digest"])
            .select("of_gram", "of_digest", F.explode("runs").alias("_r"), "shift")
            .groupBy(F.col("of_gram").alias("gram"), F.col("of_digest").alias("digest"))
            .agg(F.collect_list(F.struct((F.col("_r.start") + F.col("shift")).alias("start"),
                                         F.col("_r.n").alias("n"))).alias("runs")))
    return runs.unionByName(back)


def dedup_substrings(docs: DataFrame, *, length: int = 200, shard_bytes: int = 1 << 20, split_rows: int = 2048,
                     steps: tuple[int, ...] = (24, 1)) -> DataFrame:
    """Documents without the repeated bytes: one row per row of ``docs``
    (``doc_id, n_bytes, n_removed, n_spans, kept``). All copies lose the bytes,
    the first included; strings are judged on the input."""
    ship("tally.llm.textkernel", "tally.llm.chunk_dedup", __name__)
    parts = number_parts(docs)
    found = stage_as_is(find_fragments(parts, length), "suffix-fragments")
    # Written, so that the join below shuffles both sides anew and may split a hot gram.
    twice = stage(found.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("gram"),
                  "suffix-grams")
    near = stage(found.join(twice, "gram"), "suffix-candidates")
    one = near.groupBy("gram", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "part", "start", "n", "anchor")).alias("_at"))
    wanted = (one.select("_at.doc_id", "_at.part", F.struct("gram", "digest", "copies", "_at.start", "_at.n",
                                                            "_at.anchor").alias("_f"))
              .groupBy("doc_id", "part").agg(F.collect_list("_f").alias("_fragments")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("gram", pa.int64()), ("digest", pa.int64()), ("n", pa.int32()), ("anchor", pa.int32()),
                            ("copies", pa.int64()), ("bytes", pa.binary()), ("left", pa.int64()),
                            ("right", pa.int64())])
        for batch in batches:
            rows = []
            for raw, want in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = raw.as_py()
                for w in want:
                    data = raw[w["start"]:w["start"] + w["n"] - 1 + length]
                    left, right = cores(data, w["n"], w["anchor"], length)
                    rows.append({"gram": w["gram"], "digest": w["digest"], "n": w["n"], "anchor": w["anchor"],
                                 "copies": w["copies"], "bytes": data, "left": left, "right": right})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    texts = parts.select(F.col("doc_id").alias("_id"), F.col("part").alias("_p"),
                         F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("_raw"))
    distinct = stage_as_is(
        texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_p") == F.col("part")))
        .select("_raw", "_fragments").mapInArrow(cut, _CORED), "suffix-distinct")
    distinct = stage(with_partners(distinct), "suffix-partners")
    runs = distinct_runs(distinct, length, shard_bytes, split_rows, steps)
    spans = (near.select("gram", "digest", "doc_id", "part", "start").join(runs, ["gram", "digest"])
             .select("doc_id", "part", "start", F.explode("runs").alias("_r"))
             .select("doc_id", "part", (F.col("start") + F.col("_r.start")).cast("long").alias("start"),
                     (F.col("_r.n") - 1 + length).cast("long").alias("length")))
    return remove_spans(parts, spans)
