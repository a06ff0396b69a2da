"""Line dedup by a segment-partition edit join.

A line is near another when few edits (bytes inserted, deleted or replaced)
turn one into the other: one for lines of 16 bytes and more, two from 32 and
three from 64 (``BOUNDS``, by the shorter line), none below. A line cut into
threshold-plus-one segments must share one of them, at nearly the same place,
with any line that near. So
every
line files its segments under (length, segment number, bytes) and looks up,
for every length it may be near to, the substrings that can match a segment
(the multi-match-aware window). Lines that meet are verified with a banded
bit-parallel edit distance; linked lines form classes, and the first line of a
class (smallest document, then place) stays.

Scale: lines go by a digest, so a line that stands in a third of all documents
is one item of the join and one partial aggregate elsewhere. Keys are shuffled
once, in packs of 13 bytes a key dealt by ranges of keys; only those that two
lines share become rows. A key that many lines of a pack hold is known there
and does not go to its bucket but for two of them, and a bucket gives out what
it knows to be shared before it holds too much, so no hot segment fills a task.
``links`` avoids all pairs; only lines that met another are fetched as text.

Defined cases: lines are compared without white space at their ends; blank
lines are never removed; null texts stay null; a document may lose all its
lines and stays with an empty text; rows that share a ``doc_id`` are told
apart by ``part``; an empty table gives an empty result; other columns keep
their values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tally.llm.chunk_dedup import number_parts
from tally.llm.common import pack, ship, stage, stage_as_is, unpack
from tally.llm.links import link_classes
from tally.llm.textkernel import lines, mix64, slices, span_hasher

#: Least bytes of a line (of the shorter of two) and the edits from there on.
BOUNDS = ((16, 1), (32, 2), (64, 3))
#: Words of 64 bits in a line's sign.
SIGN = 4

#: Keys that a task packs together, and a bucket of keys on average.
PACK = 1 << 19
BUCKET = 1 << 17
#: Lines of one pack that make a key known as shared on the spot.
HOT = 64
#: Keys of a bucket that a task holds before it gives out what is shared.
HELD = 1 << 22

_BLANK = b"\t\n\x0b\x0c\r "


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``i`` of ``edits + 1`` of a line: sizes differ
    by one at most, the longer ones last."""
    size, longer = length // (edits + 1), length % (edits + 1)
    shorter = edits + 1 - longer
    return i * size + np.maximum(0, i - shorter), size + (i >= shorter)


def join_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray,
              bounds: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of what the lines file and look up."""
    found: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    length = end - start
    hashes = span_hasher(data)
    above = [low for low, _ in bounds[1:]] + [np.iinfo(np.int64).max]
    for (least, edits), most in zip(bounds, above):
        for less in range(edits + 1):  # the other line is so many bytes shorter
            here = np.flatnonzero((length - less >= least) & (length - less < most))
            other = length[here] - less
            for i in range(edits + 1):
                place, size = segment(other, i, edits)
                low = np.maximum(place - i, place + less - (edits - i))
                high = np.minimum(place + i, place + less + (edits - i))
                for step in range(2 * edits + 1):
                    at = low + step
                    ok = (at <= high) & (at >= 0) & (at + size <= length[here])
                    if not ok.any():
                        continue
                    line = here[ok]
                    begin = start[line] + at[ok]
                    value = hashes(begin, begin + size[ok])
                    salt = (other[ok] * (edits + 1) + i).astype(np.uint64)
                    found.append(line)
                    keys.append(mix64(value ^ mix64(salt + np.uint64(1))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found), np.concatenate(keys)


def sign(line: bytes) -> np.ndarray:
    """Parity of the byte pairs of a line in 256 buckets, as four words. An
    edit takes away at most two pairs and adds two, so it turns at most four
    bits."""
    raw = np.frombuffer(line, np.uint8).astype(np.uint64)
    pair = mix64((raw[:-1] << np.uint64(8)) + raw[1:] + np.uint64(1)) >> np.uint64(56)
    bits = np.bincount(pair.astype(np.int64), minlength=64 * SIGN) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def possible_edits(edits: int):
    """Which lines of two blocks of signs may be within ``edits``."""

    def possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count((a[:, None] ^ b[None]).view(np.uint64)).sum(axis=2, dtype=np.int64) <= 4 * edits

    return possible


def sign_parts(edits: int):
    """A sign cut into one part more than ``edits`` edits can change bits."""

    def finer(sign: Column) -> Column:
        n = 4 * edits + 1
        cuts = [64 * SIGN * i // n for i in range(n + 1)]
        parts = []
        for low, high in zip(cuts, cuts[1:]):
            words = []
            while low < high:
                word, at = divmod(low, 64)
                size = min(high - low, 64 - at)
                words.append(F.shiftright(F.get(sign, F.lit(word)), at).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1)))
                low += size
            parts.append(F.xxhash64(*words))
        return F.array(*parts)

    return finer


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """Edits between ``a`` and ``b``, or ``most + 1`` if there are more.

    Common ends are cut off; then the table's band of 2 ``most`` + 1 rows runs
    down the diagonal as two bit vectors of vertical differences.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    if a == b:
        return 0
    n = 0
    while n < len(a) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n = 0
    while n < len(a) and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[:len(a) - n], b[:len(b) - n]
    if len(a) <= most:
        row = list(range(len(a) + 1))
        for j, c in enumerate(b, 1):
            before, row[0] = row[0], j
            for i, d in enumerate(a, 1):
                before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (c != d))
        return min(row[-1], most + 1)
    width = 2 * most + 1
    full = (1 << width) - 1
    place: dict[int, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << (i + most)
    plus, minus = full & ~((1 << most) - 1), 0
    distance, across = most, 1 << (width - 2) if width > 1 else 0
    for j, c in enumerate(b):
        match = place.get(c, 0) >> j & full
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & full
        right_plus = (minus | ~(zero | plus)) & full
        right_minus = zero & plus
        if j < len(a) - most:
            distance += not zero >> (width - 1)
            if distance > 2 * most + len(b) - len(a):
                return most + 1
        else:
            distance += bool(right_plus & across)
            distance -= bool(right_minus & across)
            across >>= 1
        plus = (right_minus | ~((zero >> 1) | right_plus)) & full
        minus = (zero >> 1) & right_plus
    return min(distance, most + 1)


def line_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Digests (16 bytes each) of lines, and their first halves as numbers."""
    raw = data.tobytes()
    joined = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest()
                      for a, b in zip(start.tolist(), end.tolist()))
    return joined, np.frombuffer(joined, np.int64).reshape(-1, 2)[:, 0]


def line_table(parts: DataFrame) -> DataFrame:
    """``doc_id, part, line_no, digest, id`` of every line with a word; ``id`` is
    half of the digest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(2)):
                start, end, line_row, number = lines(data, offsets)
                joined, ids = line_ids(data, start, end)
                take = pa.array(line_row + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(number.astype(np.int32)),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(start), [None, pa.py_buffer(joined)])
                     .cast(pa.binary()), pa.array(ids)],
                    ["doc_id", "part", "line_no", "digest", "id"])

    return parts.select("doc_id", "part", "text").mapInArrow(
        scan, "doc_id long, part int, line_no int, digest binary, id long")


def distinct_members(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, id) in order, and how many ids the key of each has."""
    order = np.argsort(key)
    key, ids = key[order], ids[order]
    run = np.cumsum(np.concatenate([np.zeros(min(1, len(key)), bool), key[1:] != key[:-1]]))
    many = np.flatnonzero(np.bincount(run)[run] > 1) if len(key) else run
    ids[many] = ids[many[np.lexsort((ids[many], run[many]))]]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids, run = key[new], ids[new], run[new]
    return key, ids, np.bincount(run)[run] if len(key) else run


def _ends_of_runs(key: np.ndarray) -> np.ndarray:
    """Which entries are the first or the last of their key."""
    edge = np.ones(len(key) + 1, bool)
    edge[1:-1] = key[1:] != key[:-1]
    return edge[:-1] | edge[1:]


def shared_members(parts: DataFrame, bounds: tuple[tuple[int, int], ...], n_lines: int) -> DataFrame:
    """``key, id`` (perhaps repeated) of the lines and their keys, for the keys
    that two different lines have. A key is cut to 40 bits and those of its
    bucket: keys that are the same by chance only give a pair more to verify."""
    edits = max(e for _, e in bounds)
    bits = min(24, max(6, (2 * (edits + 1) ** 2 * n_lines // BUCKET).bit_length()))
    buckets = 1 << bits

    def pack(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        key, ids, size = distinct_members(key >> np.uint64(24 - bits), ids)
        rows, keys, lines_ = [], [], []
        hot = size > HOT
        here, who = key[hot], ids[hot]
        for at in range(0, len(here), 1 << 16):
            rows.append(buckets + int(who[at]) % buckets)
            keys.append(here[at:at + (1 << 16)].tobytes())
            lines_.append(who[at:at + (1 << 16)].tobytes())
        stay = ~hot | _ends_of_runs(key)
        key, ids = key[stay], ids[stay]
        bucket = (key >> np.uint64(40)).astype(np.int64)
        low = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :5])
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(key)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            rows.append(int(bucket[a]))
            keys.append(low[a:b].tobytes())
            lines_.append(ids[a:b].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(keys, pa.binary()),
                                           pa.array(lines_, pa.binary())], ["bucket", "keys", "ids"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                start, end, _, _ = lines(data, offsets)
                whose, one = np.unique(line_ids(data, start, end)[1], return_index=True)
                which, key = join_keys(data, start[one], end[one], bounds)
                keys.append(key)
                ids.append(whose[which])
                n += len(key)
                if n >= PACK:
                    yield pack(np.concatenate(keys), np.concatenate(ids))
                    keys, ids, n = [], [], 0
        if n:
            yield pack(np.concatenate(keys), np.concatenate(ids))

    def told(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids)], ["key", "id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, most = -1, [], 0, HELD

        def close() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return distinct_members(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held]))

        for batch in batches:
            for bucket, keys, ids in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, np.int64)
                if bucket >= buckets:
                    yield told(np.frombuffer(keys, np.uint64), ids)
                    continue
                if bucket != now:
                    if held:
                        key, who, size = close()
                        yield told(key[size > 1], who[size > 1])
                    now, held, n, most = bucket, [], 0, HELD
                key = np.zeros((len(ids), 8), np.uint8)
                key[:, :5] = np.frombuffer(keys, np.uint8).reshape(-1, 5)
                held.append((key.view(np.uint64).ravel() | np.uint64(bucket << 40), ids))
                n += len(ids)
                if n > most:
                    key, who, size = close()
                    yield told(key[size > 1], who[size > 1])
                    stay = (size == 1) | _ends_of_runs(key)
                    held, n = [(key[stay], who[stay])], int(stay.sum())
                    most = max(HELD, 2 * n)
        if held:
            key, who, size = close()
            yield told(key[size > 1], who[size > 1])

    packs = parts.select("text").mapInArrow(scan, "bucket int, keys binary, ids binary")
    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key long, id long")


def line_decisions(parts: DataFrame, *, max_edits: int | None = None, near_bytes: int = 32,
                   bounds: tuple[tuple[int, int], ...] = BOUNDS) -> DataFrame:
    """``doc_id, part, line_no, removed, near`` of every line with a word;
    ``near`` tells lines whose class holds different lines. ``max_edits`` sets
    one bound for all lines of at least ``near_bytes`` in place of ``bounds``."""
    ship("tally.llm.textkernel", __name__)
    if max_edits is not None:
        bounds = ((near_bytes, max_edits),)
    max_edits = max(edits for _, edits in bounds)
    table = stage_as_is(line_table(parts), "lines")
    members = stage(shared_members(parts, bounds, table.count()), "line-keys")
    texts: list[DataFrame] = []  # of all lines that met another, from the first call on

    def fetch(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        place = (table.join(wanted, "id").groupBy("id")
                 .agg(F.min(F.struct("digest", "doc_id", "part", "line_no")).alias("_at")))
        by_doc = (place.groupBy(F.col("_at.doc_id").alias("_d"), F.col("_at.part").alias("_p"))
                  .agg(F.collect_list(F.struct("id", "_at.line_no")).alias("_lines")))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = [], []
                for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    all_lines = text.encode().split(b"\n")
                    for w in wanted:
                        ids.append(w["id"])
                        texts.append(all_lines[w["line_no"]].strip(_BLANK))
                signs = pa.array(np.concatenate([np.zeros(0, np.int64), *map(sign, texts)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(texts, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * SIGN), signs)],
                    ["id", "line", "sign"])

        return stage(parts.select("doc_id", "part", "text").join(
            by_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("part") == F.col("_p")))
            .select("text", "_lines").mapInArrow(pick, "id long, line binary, sign array<long>"), "candidate-lines")

    def bound_of(a: bytes, b: bytes) -> int:
        return max((e for low, e in bounds if min(len(a), len(b)) >= low), default=0)

    def linked(found: list[bytes]):
        return lambda i, j: edit_distance(found[i], found[j], max_edits) <= bound_of(found[i], found[j])

    def measure(pairs: DataFrame) -> DataFrame:
        if not texts:
            texts.append(fetch(pairs))
        found = texts[0]
        both = (pairs.join(found.select(F.col("id").alias("b"), F.col("line").alias("_lb")), "b")
                .join(found.select(F.col("id").alias("a"), F.col("line").alias("_la")), "a"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away, link = [], []
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    away.append(float(edit_distance(a, b, max_edits)))
                    link.append(away[-1] <= bound_of(a, b))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away, pa.float64()),
                                                  pa.array(link, pa.bool_())], ["a", "b", "d", "link"])

        return both.select("a", "b", "_la", "_lb").mapInArrow(compare, "a long, b long, d double, link boolean")

    classes = link_classes(members, measure, max_edits, signs=lambda: texts[0].select("id", "sign", F.col("line").alias("item")),
                           possible=possible_edits(max_edits), finer=sign_parts(max_edits), linked=linked)
    # The half digest names the class; a line that only shares the half digest
    # with a verified one stays on its own.
    known = (table.join(classes, "id").groupBy("id").agg(F.min("digest").alias("_digest"), F.min("root").alias("root")))
    placed = (table.select("doc_id", "part", "line_no", "digest", "id")
              .join(known, "id", "left")
              .withColumn("near", F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False)))
              .withColumn("class", F.when(F.col("near"), F.struct(F.col("root").alias("a"), F.lit(None).cast("binary")
                                                                  .alias("b")))
                          .otherwise(F.struct(F.lit(None).cast("long").alias("a"), F.col("digest").alias("b"))))
              .select("doc_id", "part", "line_no", "near", F.xxhash64("class.a", "class.b").alias("class"),
                      F.coalesce("class.b", F.encode(F.col("class.a").cast("string"), "UTF-8")).alias("name")))
    first = placed.groupBy("class", "name").agg(F.min(F.struct("doc_id", "part", "line_no")).alias("_first"),
                                                F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # Written, so that the join shuffles both sides anew and may split a hot class.
    first = stage(first, "line-firsts")
    return (placed.join(first, ["class", "name"], "left")
            .select("doc_id", "part", "line_no", "near",
                    F.coalesce(F.col("_first").isNotNull()
                               & ~F.struct("doc_id", "part", "line_no").eqNullSafe(F.col("_first")), F.lit(False))
                    .alias("removed")))


def line_report(docs: DataFrame, **parameters) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines`` (with a word),
    ``n_removed, n_near``."""
    parts = number_parts(docs)
    counts = (line_decisions(parts, **parameters)
              .groupBy(F.col("doc_id").alias("_id"), F.col("part").alias("_p"))
              .agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("removed").alias("n_removed"),
                   F.count_if("near").alias("n_near")))
    return (parts.select("doc_id", "part")
            .join(counts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_p")), "left")
            .select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_removed", "n_near")]))


def dedup_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with its columns, texts without the removed lines."""
    parts = number_parts(pack(docs), "rest")
    gone = (line_decisions(parts.select("doc_id", "part", "text"), **parameters).filter("removed")
            .groupBy(F.col("doc_id").alias("_id"), F.col("part").alias("_p"))
            .agg(F.collect_set("line_no").alias("_gone")))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    joined = parts.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_p")), "left")
    return unpack(joined, docs.columns, F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
