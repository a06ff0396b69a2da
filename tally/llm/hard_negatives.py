"""Hard-negative mining: cover trees searched for windows of inner products.

1. All rows are range-partitioned by label and cut into blocks of at most
   ``BLOCK_ROWS``; every block becomes one cover tree (``cover_tree``).
2. The anchors, in blocks of ``QUERY_ROWS``, meet every tree once for their
   positives (best rows of the same label) and, with the windows that those
   set, a second time for the negatives (best rows of other labels in each
   window). A task keeps an anchor's best rows from tree to tree, so what one
   tree found prunes the next.
3. What the tasks found is ranked per anchor, and per anchor and positive.

Scale: trees never leave their group of tasks; a query block is sent to every
group once, with the trees of a group searched one after another. A task holds
one tree, one query block and a few rows per window; it emits at most the
requested rows per window, so the ranking shuffles little and no label, however
hot, is a key of a shuffle with whole rows. The tables between the steps are
written, so a lost executor repeats one step only.

Defined cases: rows with a null label, a null vector or a null or non-finite
component take no part; shorter vectors end in zeros; an anchor without
positives, or whose windows are empty, gives no row. Ties of score go to the
smaller id (null last), then to the row read first; repeated ids are rows of
their own, also as anchors. A negative positive score gives an empty window. An
empty table gives an empty result. Scores must fit a long. Other columns,
whatever their names, are ignored; labels are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tally.llm.common import ship, stage, stage_as_is
from tally.llm.cover_tree import LEAST, MOST, NO_ID, Best, CoverTree
from tally.llm.vectors import integer_vectors, matrix

BLOCK_ROWS = 2048
QUERY_ROWS = 512
_TREE = ["points", "uids", "ids", "labels", "start", "end", "centre", "radius", "child", "children", "low", "high"]
_QUERIES = ["queries", "q_uids", "q_labels", "q_low", "q_high"]
_FOUND = "anchor long, window int, score long, id long, uid long"


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A partition in tables of at most ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def cover_trees(rows: DataFrame, width: int, n: int) -> DataFrame:
    """One row per block of ``rows``: the arrays of its cover tree."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BLOCK_ROWS):
            uids, ids, labels = (_column(block, c).to_numpy(zero_copy_only=False) for c in ("uid", "id", "label"))
            tree = CoverTree.build(matrix(_column(block, "v"), width), uids, ids, labels)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in tree.to_binary()], _TREE)

    parts = rows.repartitionByRange(max(1, -(-n // BLOCK_ROWS)), "label", "uid")
    return parts.select("uid", "id", "label", "v").mapInArrow(build, ", ".join(f"{c} binary" for c in _TREE))


def query_blocks(anchors: DataFrame, width: int) -> DataFrame:
    """``queries, q_uids, q_labels, q_low, q_high``: anchors (``uid, label, v,
    low, high``; as many windows each) packed in blocks."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, QUERY_ROWS):
            low, high = _column(block, "low"), _column(block, "high")
            arrays = [matrix(_column(block, "v"), width), _column(block, "uid").to_numpy(),
                      _column(block, "label").to_numpy(), low.flatten().to_numpy(), high.flatten().to_numpy()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(a, np.int64).tobytes()], pa.binary()) for a in arrays], _QUERIES)

    return anchors.select("uid", "label", "v", "low", "high").mapInArrow(
        build, ", ".join(f"{c} binary" for c in _QUERIES))


def searched(trees: DataFrame, blocks: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """``anchor, window, score, id, uid``: rows that may be among the best ``k``
    of a window, at most ``k`` per window and group of trees."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked = None, None

        def emit() -> Iterator[pa.RecordBatch]:
            if asked is not None:
                ask, window, *rest = asked[3].found()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[2][ask]), pa.array(window.astype(np.int32)), *map(pa.array, rest)],
                    ["anchor", "window", "score", "id", "uid"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if block != (row["q_uids"], row["q_low"]):
                    yield from emit()
                    block = row["q_uids"], row["q_low"]
                    q, uids, labels, low, high = (np.frombuffer(row[c], np.int64) for c in
                                                  ("queries", "q_uids", "q_labels", "q_low", "q_high"))
                    low, high = low.reshape(len(uids), -1), high.reshape(len(uids), -1)
                    asked = q.reshape(-1, width), labels, uids, Best(low, high, k)
                q, labels, uids, best = asked
                CoverTree.from_binary(width, [row[c] for c in _TREE]).search(q, best, labels, same, uids)
        yield from emit()

    groups = max(1, 4 * trees.sparkSession.sparkContext.defaultParallelism)
    trees = trees.withColumn("group", F.pmod(F.xxhash64("uids"), F.lit(groups)))
    used = [r["group"] for r in trees.select("group").distinct().collect()]  # at most ``groups``
    blocks = blocks.withColumn("group", F.explode(F.lit(used or [0]).cast("array<long>")))
    return blocks.join(trees, "group").drop("group").mapInArrow(search, _FOUND)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` rows of every key, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(table: DataFrame, anchors: Column, *, vector: str = "embedding", vec_id: str = "vec_id",
                        label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                        scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for every row that ``anchors`` (a condition on ``table``)
    holds for, and each of its ``positives`` best rows of the same label, the
    ``negatives`` best rows of other labels whose score lies between ``low`` and
    ``high`` percent of the positive's."""
    ship("tally.llm.vectors", "tally.llm.cover_tree", __name__)
    known = table.filter(F.col(f"`{label}`").isNotNull())
    rows = stage_as_is(integer_vectors(
        known, vector, scale, id=F.coalesce(F.col(f"`{vec_id}`").cast("long"), F.lit(int(NO_ID))),
        label=F.col(f"`{label}`").cast("long"), anchor=F.coalesce(anchors, F.lit(False))), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    trees = stage_as_is(cover_trees(rows, width, n), "cover-trees")
    asked = rows.filter("anchor").select("uid", "id", "label", "v")

    every = [F.array(F.lit(x).cast("long")) for x in (int(LEAST), int(MOST))]
    blocks = query_blocks(asked.withColumns({"low": every[0], "high": every[1]}), width)
    near = _ranked(searched(trees, blocks, width, positives, True), ["anchor"], positives)
    near = stage(near.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("near")),
        "positives")

    # Whole numbers: low * p <= 100 * score <= high * p. Anchors with fewer
    # positives get empty windows for the rest.
    p = F.col("near.positive_score")

    def padded(c, empty):
        return F.slice(F.concat(c, F.array_repeat(F.lit(int(empty)).cast("long"), positives)), 1, positives)

    windows = asked.join(near, F.col("uid") == F.col("anchor")).select(
        "uid", "label", "v",
        padded(F.transform(p, lambda s: F.ceil(s.cast("decimal(20,0)") * low / 100).cast("long")), MOST).alias("low"),
        padded(F.transform(p, lambda s: F.floor(s.cast("decimal(20,0)") * high / 100).cast("long")), LEAST).alias("high"))
    found = _ranked(searched(trees, query_blocks(windows, width), width, negatives, False), ["anchor", "window"],
                    negatives)
    told = near.join(asked.select(F.col("uid").alias("_uid"), F.col("id").alias("anchor_id")),
                     F.col("anchor") == F.col("_uid")).select("anchor", "anchor_id", "near")
    out = found.join(told, "anchor").withColumn("near", F.col("near")[F.col("window")])

    def named(c):
        return F.when(c != int(NO_ID), c)

    return out.select(named(F.col("anchor_id")).alias("anchor_id"), named(F.col("near.positive_id")).alias("positive_id"),
                      "rank", named(F.col("id")).alias("negative_id"),
                      F.col("near.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
