"""Classes of near-equal items from candidate groups.

Members of a group (items that share a key) are first compared with one
centre, the smallest id, so a group of n gives n - 1 comparisons and a large
family of copies is joined at once. In groups whose other members are not all
in one class by then, every member is compared with every member of another
class: no link of a group is lost, whatever its size.

Four things keep that small, and none of them rules out a link between classes
that nothing else joins. Members that the triangle inequality holds apart are
not compared: all know their distance to the first centre, and two whose
distances differ by more than the bound cannot be that near. ``possible`` rules
out pairs by short signs of the items. ``finer`` cuts a group of over ``BLOCK``
members into smaller ones by further keys, of which near members share one. And
with ``linked`` pairs are verified where they meet, those of the member with
most possible partners first; a pair that found links have joined by then is
not looked at, and only links that join two classes of a cell become rows, fewer
than it has members. What is left of a large group is compared in cells of two
salted blocks of about ``BLOCK`` members, so a hot group is spread over tasks;
without ``finer`` the cells of a group grow with the square of its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tally.llm.common import ship, stage

BLOCK = 512
#: Bytes of the items in a block, on average.
BLOCK_BYTES = 8 << 20
_MANY = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` (smallest id of the connected component) of every id in
    ``edges`` (``a, b``), by alternating large and small stars. Every step is
    a partial aggregation and a join, written out to cut the lineage; the
    number of steps is logarithmic in the size of the largest component."""
    edges = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stage(edges.distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        ends = F.explode(F.array("a", "b"))
        small = large.join(low, "b").select(F.col("m"), ends.alias("b")).filter("m != b").select(
            F.col("m").alias("a"), "b").distinct()
        edges = stage(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def joining_links(ids: np.ndarray, root: np.ndarray, x: np.ndarray, y: np.ndarray,
                  test: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Of the pairs (``x``, ``y``: places in ``ids``) links that join classes
    (``root``), as ids; every link is within a class afterwards. Pairs of
    members with many pairs come first: one that is near to all joins all."""
    _, label = np.unique(root, return_inverse=True)
    up = list(range(len(label)))
    label = label.tolist()

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    degree = np.bincount(np.concatenate([x, y]), minlength=len(ids))
    swap = degree[y] > degree[x]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    order = np.lexsort((x, -degree[x]))
    out = []
    for i, j in zip(x[order].tolist(), y[order].tolist()):
        a, b = find(label[i]), find(label[j])
        if a != b and test(i, j):
            up[a] = b
            out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def _between_classes(group: DataFrame, bound: float,
                     possible: Callable[[np.ndarray, np.ndarray], np.ndarray] | None,
                     linked: Callable[[list], Callable[[int, int], bool]] | None) -> DataFrame:
    """``a, b`` (ids, ``a < b``) of the members of a group (``key, id, root,
    away, sign`` and, with ``linked``, ``item``) that are of different classes
    and may be within ``bound``; with ``linked``, of links that join the classes."""
    ship(__name__)
    blocks = F.count(F.lit(1)) / BLOCK
    if linked is not None:
        blocks = F.greatest(blocks, F.sum(F.length("item")) / BLOCK_BYTES)
    sizes = group.groupBy("key").agg(F.ceil(blocks).cast("int").alias("_blocks"))
    salted = group.join(sizes, "key").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    told = ["id", "root", "away", "_block", "sign"] + (["item"] if linked is not None else [])
    cells = (salted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .groupBy("key", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))
             .agg(F.collect_list(F.struct(*told)).alias("_m"))
             .filter(F.size("_m") > 1))

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        n = 0
        for batch in batches:
            ends = np.asarray(batch.column(2).offsets)
            ids, root, away, block, sign, *items = batch.column(2).flatten().flatten()
            ids, root, away, block = (np.asarray(x) for x in (ids, root, away, block))
            ends = ends - ends[0]
            sign = np.asarray(sign.flatten()).reshape(len(ids), -1)
            for k, (i, j) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                here = np.arange(ends[k], ends[k + 1])
                one, two = (here, here) if i == j else (here[block[here] == i], here[block[here] == j])
                pairs: list[np.ndarray] = []
                for at in range(0, len(one), 64):
                    some = one[at:at + 64]
                    ok = root[some][:, None] != root[two][None]
                    ok &= np.abs(away[some][:, None] - away[two][None]) <= bound + 1e-9
                    if i == j:
                        ok &= ids[some][:, None] < ids[two][None]
                    if possible is not None and ok.any():
                        ok &= possible(sign[some], sign[two])
                    x, y = np.nonzero(ok)
                    if len(x):
                        pairs.append(np.stack([some[x], two[y]]))
                if not pairs:
                    continue
                x, y = np.concatenate(pairs, axis=1)
                if linked is None:
                    x, y = ids[x], ids[y]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                else:
                    test = linked(items[0].slice(ends[k], len(here)).to_pylist())
                    links = joining_links(ids[here], root[here], x - ends[k], y - ends[k], test)
                    found.append(np.array(links, np.int64).reshape(-1, 2).T)
                n += found[-1].shape[1]
                if n > _MANY:
                    yield rows(found)
                    found, n = [], 0
        if n:
            yield rows(found)

    return cells.select("_i", "_j", "_m").mapInArrow(compare, "a long, b long")


def link_classes(members: DataFrame, measure: Callable[[DataFrame], DataFrame], bound: float, *,
                 signs: Callable[[], DataFrame] | None = None,
                 possible: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
                 finer: Callable[[Column], Column] | None = None,
                 linked: Callable[[list], Callable[[int, int], bool]] | None = None) -> DataFrame:
    """``id, root`` of the items in ``members`` (``key, id``, both long) that
    have a link. ``measure`` adds the distance ``d`` (a metric) to distinct
    pairs ``a, b``; pairs within ``bound`` are links, or those it marks ``link``
    if the bound differs among pairs (``bound`` is then the greatest). A distance beyond the bound
    may be given as any value from there to the true one. ``signs``, called
    after the first round, has one ``sign`` (array of numbers, all of one length)
    per ``id``; ``possible`` tells
    for two blocks of signs which pairs may be links, and ``finer`` makes an array
    of longs of a sign, one of which two linked items share at the same place.
    ``linked`` makes of a list of items (``item``, bytes or text, given by ``signs``
    too) a test of two of them by their places; without it, pairs of the second
    round become rows and are measured like those of the first."""
    groups = (members.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("_z")).filter("a < _z")
              .select("key", "a"))
    live = stage(members.join(groups, "key").select("key", "id", "a"), "group-members")
    first = live.filter("id != a").select("a", F.col("id").alias("b")).distinct()
    first = stage(measure(stage(first, "pairs")), "measured")
    within = F.col("link") if "link" in first.columns else F.col("d") <= bound + 1e-9
    links = first.filter(within).select("a", "b")
    classes = stage(components(links), "classes")
    away = first.select("a", F.col("b").alias("id"), F.col("d").alias("_d"))
    # A centre is compared with all of its group by now.
    rooted = live.filter("id != a").join(away, ["a", "id"], "left").join(classes, "id", "left").select(
        "key", "id", F.coalesce("root", "id").alias("root"), F.coalesce("_d", F.lit(0.0)).alias("away"))
    several = F.col("_a") < F.col("_z")
    open_ = (rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).filter(several)
             .select("key"))
    rooted = stage(rooted.join(open_, "key").distinct(), "group-open")
    if rooted.isEmpty():
        return classes
    if signs is None:
        rooted = rooted.withColumn("sign", F.array(F.lit(0).cast("long")))
    else:
        item = ["item"] if linked is not None else []
        rooted = stage(rooted.join(signs(), "id").select("key", "id", "root", "away", "sign", *item), "group-signs")
    columns = rooted.columns
    wanted = rooted
    if finer is not None:
        size = rooted.groupBy("key").agg((F.count(F.lit(1)) > BLOCK).alias("_large"))
        sized = rooted.join(size, "key")
        cut = sized.filter("_large").select(*columns, F.posexplode(finer(F.col("sign"))).alias("_at", "_part"))
        cut = cut.select(F.xxhash64("key", "_at", "_part").alias("key"), *columns[1:])
        met = (cut.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).filter(several)
               .select("key"))
        wanted = stage(sized.filter("not _large").select(*columns)
                       .unionByName(cut.join(met, "key").select(*columns)), "group-finer")
    more = _between_classes(wanted, bound, possible, linked)
    if linked is not None:
        return components(links.unionByName(more))
    more = stage(more.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    more = stage(measure(more), "measured")
    return components(links.unionByName(more.filter(within).select("a", "b")))
