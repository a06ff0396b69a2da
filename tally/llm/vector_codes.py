"""Vector code compression: product codes by Lloyd's rounds over resident members.

Vectors are cut into equal consecutive parts; every part position has a codebook
of its own. A part of a vector is a member of the entry that is nearest to it
and lives in a block of its owner, the key ``(position, entry, salt)``:

1. The first assignment packs the parts of every partition by owner; the packs
   are shuffled once and joined into blocks (at most ``block_rows`` members).
2. Owners update: every block adds up its own members, and sums and counts per
   entry (as many numbers as the codebooks have) give the next entries.
3. The next assignment runs where the members are. Those whose entry stays
   remain in their block, which is not shuffled; the others leave in packs for
   their new owners, and only these packs go through the next shuffle.

Scale: a block is a row of packed arrays, so a shuffle moves arrays, not rows of
parts; the salt (from the partition a pack was made in) and ``block_rows`` keep
the blocks of an entry that a third of all vectors share apart and small. What
the driver sees is bounded by the codebooks: their first entries, their sums.
The tables of a round are written, so a lost executor repeats reads only. The
last step shuffles one small row per vector and position.

Defined cases: rows with a null vector or a null or non-finite component are left
out. Vectors shorter than the longest one, rounded up to a multiple of ``parts``,
end in zeros (an empty vector is all zeros). The first entries are the parts of
the rows with the smallest ids (null last, equal ids by their components); with
fewer rows than ``entries`` the codebooks have as many entries as rows. Ties of
distance go to the lower index; an entry without members stays. Repeated and
null ids are rows like any other. Distances are exact integers; sums of squared
errors must fit a long. An empty table gives an empty result and empty
codebooks. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tally.llm.common import ship, small, stage, stage_as_is
from tally.llm.vectors import EXACT, integer_vectors, matrix

_BLOCK = "pos int, entry int, salt int, moved boolean, uids binary, members binary"
_NAMES = ["pos", "entry", "salt", "moved", "uids", "members"]


def nearest(members: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of every member's nearest entry (the lowest of equals) and the
    squared distance, exact for integers of any size."""
    reach = 2 * int(max(np.abs(members).max(initial=0), np.abs(entries).max(initial=0)))
    if reach * reach * members.shape[1] < EXACT:
        x, c = members.astype(np.float64), entries.astype(np.float64)
        far = (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)
    else:
        far = ((members[:, None, :].astype(object) - entries[None, :, :].astype(object)) ** 2).sum(2)
    best = np.argmin(far, 1)
    return best, far[np.arange(len(best)), best].astype(np.int64)


def _by_entry(pos: int, salt: int, moved: bool, entry: np.ndarray, uids: np.ndarray, members: np.ndarray) -> list:
    """One row of ``_BLOCK`` for each entry that occurs."""
    order = np.argsort(entry, kind="stable")
    entry, uids, members = entry[order], uids[order], members[order]
    first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else entry
    return [(pos, int(entry[a]), salt, moved, uids[a:b].tobytes(), members[a:b].tobytes())
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(entry)])]


def _rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], _NAMES)


@dataclass
class Codebooks:
    """``entries[position, index]``: integer components; ``kind``: the type that
    holds every component of the table."""
    entries: np.ndarray
    kind: str

    def sha256(self) -> str:
        """Of the decimal components, in order, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def first_packs(vectors: DataFrame, books: Codebooks, salts: int, pack_rows: int) -> DataFrame:
    """The parts of all vectors, packed by their nearest entry."""
    parts, _, size = books.entries.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % salts

        def packs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            uids, v = (np.concatenate(x) for x in zip(*held))
            rows = []
            for p in range(parts):
                own = np.ascontiguousarray(v[:, p * size:(p + 1) * size])
                rows += _by_entry(p, salt, True, nearest(own, books.entries[p])[0], uids, own.astype(books.kind))
            return _rows(rows)

        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), matrix(batch.column(1), parts * size)))
            n += batch.num_rows
            if n >= pack_rows:
                yield packs(held)
                held, n = [], 0
        if n:
            yield packs(held)

    return vectors.select("uid", "v").mapInArrow(assign, _BLOCK)


def joined(packs: DataFrame, size: int, kind: str, block_rows: int) -> DataFrame:
    """Packs shuffled to their owners and joined into blocks."""
    wide = size * np.dtype(kind).itemsize

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, uids, members, n, out = None, [], [], 0, []

        def block() -> list:
            return [(*key, False, b"".join(uids), b"".join(members))] if n else []

        for batch in batches:
            for *here, more_uids, more in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                if here != key or n >= block_rows:
                    out += block()
                    key, uids, members, n = here, [], [], 0
                uids.append(more_uids)
                members.append(more)
                n += len(more) // wide
            yield _rows(out)
            out = []
        yield _rows(block())

    owner = ["pos", "entry", "salt"]
    return packs.repartition(*owner).sortWithinPartitions(*owner).mapInArrow(join, _BLOCK)


def migrate(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """Every block with the members whose entry stays, and packs of those that
    change it (``moved``)."""
    size = books.entries.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pos, entry, salt, _, uids, members in zip(*(c.to_pylist() for c in batch.columns)):
                uids, members = np.frombuffer(uids, np.int64), np.frombuffer(members, books.kind).reshape(-1, size)
                now = nearest(members.astype(np.int64), books.entries[pos])[0]
                stay = now == entry
                rows += _by_entry(pos, salt, False, now[stay], uids[stay], members[stay])
                rows += _by_entry(pos, salt, True, now[~stay], uids[~stay], members[~stay])
            yield _rows(rows)

    return blocks.mapInArrow(assign, _BLOCK)


def updated(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """The entries as the floored means of their resident members. As many
    numbers as the codebooks have come to the driver."""
    parts, k, size = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for pos, entry, members in zip(*(batch.column(i).to_pylist() for i in range(3))):
                members = np.frombuffer(members, books.kind).reshape(-1, size)
                own = np.append(members.sum(0, dtype=np.int64), len(members))
                total[pos, entry] = total.get((pos, entry), 0) + own
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([x[0] for x in keys], size).astype(np.int32)),
             pa.array(np.repeat([x[1] for x in keys], size).astype(np.int32)),
             pa.array(np.tile(np.arange(size, dtype=np.int32), len(keys))),
             pa.array(np.array([total[x][:-1] for x in keys], np.int64).reshape(-1)),
             pa.array(np.repeat(np.array([total[x][-1] for x in keys], np.int64), size))],
            ["pos", "entry", "at", "total", "n"])

    sums = (blocks.select("pos", "entry", "members")
            .mapInArrow(add, "pos int, entry int, at int, total long, n long")
            .groupBy("pos", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    entries = books.entries.copy()
    for r in sums.collect():
        entries[r.pos, r.entry, r.at] = r.total // r.n
    return Codebooks(entries, books.kind)


def final_codes(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """``uid, pos, entry, far`` of every part, assigned once more."""
    size = books.entries.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for pos, uids, members in zip(*(batch.column(i).to_pylist() for i in range(3))):
                now, far = nearest(np.frombuffer(members, books.kind).reshape(-1, size).astype(np.int64),
                                   books.entries[pos])
                made.append((np.frombuffer(uids, np.int64), np.full(len(now), pos, np.int32), now.astype(np.int32), far))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)],
                                                 ["uid", "pos", "entry", "far"])

    return blocks.select("pos", "uids", "members").mapInArrow(assign, "uid long, pos int, entry int, far long")


def _hex(parts: int):
    """Entries by position as two hex digits each, from sums that combine
    before the shuffle: eight positions make one long."""
    at, words = F.col("pos"), []
    for w in range(-(-parts // 8)):
        n = min(8, parts - 8 * w)
        here = F.when((at >= 8 * w) & (at < 8 * w + n), F.expr(f"shiftleft(cast(entry as bigint), 8 * ({8 * w + n - 1} - pos))"))
        words.append(F.lower(F.lpad(F.hex(F.coalesce(F.sum(here), F.lit(0))), 2 * n, "0")))
    return F.concat(*words)


def compress_vectors(table: DataFrame, *, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
                     parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
                     block_rows: int = 1 << 14) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of every kept row (written), and the
    codebooks that decode them. ``code`` has two hex digits per position, so
    ``entries`` is at most 256."""
    if entries > 256:
        raise ValueError("more entries than a code can tell apart")
    ship("tally.llm.vectors", __name__)
    rows = stage_as_is(integer_vectors(table, vector, scale, vec_id=F.col(f"`{vec_id}`"), label=F.col(f"`{label}`")),
                       "vectors")
    most = F.coalesce(F.array_max(F.transform("v", lambda x: F.greatest(x, -x - 1))), F.lit(0))
    n, width, reach = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(most)).first()
    size = max(1, -(-(width or 0) // parts))
    kind = next(k for k in ("<i2", "<i4", "<i8") if (reach or 0) <= np.iinfo(k).max)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v", "uid").select("v").limit(entries).collect()
    seeds = np.array([list(r.v) + [0] * (parts * size - len(r.v)) for r in seeds], np.int64).reshape(-1, parts, size)
    books = Codebooks(np.ascontiguousarray(seeds.transpose(1, 0, 2)), kind)
    if not n:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    packs = first_packs(rows, books, max(1, n // block_rows), block_rows)
    blocks = stage_as_is(joined(packs, size, kind, block_rows), "members")
    for i in range(rounds):
        books = updated(blocks, books)
        if i < rounds - 1:
            found = stage_as_is(migrate(blocks, books), "residents")
            came = stage_as_is(joined(found.filter("moved"), size, kind, block_rows), "migrants")
            blocks = found.filter("NOT moved").unionByName(came)
    codes = final_codes(blocks, books).groupBy("uid").agg(_hex(parts).alias("code"), F.sum("far").alias("error"))
    return stage_as_is(rows.select("uid", "vec_id", "label").join(codes, "uid")
                       .select("vec_id", "label", "code", "error"), "codes"), books


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the error summed over equal labels, nulls
    together. The sums are broadcast when there are at most a million labels."""
    sums = stage(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(small(sums, 1 << 20), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
