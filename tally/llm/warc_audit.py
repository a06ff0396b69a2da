"""Merkle fixity audit of WARC files.

Records are hashed; ordered offset ranges of a file are hashed over the
records that start in them; ``fanout`` ranges make a node, up to the root of
the file, and ``fanout`` files make a node of the collection, up to one root.
Two replicas are compared from the root down: only children of nodes that
differ are read, and at the bottom the records of ranges that differ.

Scale: a level is one aggregation whose groups have at most ``fanout`` members
(at the bottom, the records that start in ``range_bytes``), so no file or host
is gathered in one task; the descent joins a level with the mismatching nodes
above it, a join whose size follows the damage.

Defined cases: null columns are written as empty values; empty payloads are
records of their own; repeated rows are records of their own, one after the
other; a record that one side lacks is ``missing`` or ``extra``; a file that
one side lacks differs at its root and is descended like any other; two empty
tables agree and give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tally.llm.common import stage


def record_bytes(record_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record around a payload (binary)."""
    text = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.coalesce(F.octet_length(payload), F.lit(0)).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(text, "UTF-8"), F.coalesce(payload, F.lit(b"")), F.lit(b"\r\n\r\n"))


def write_order(pages: DataFrame, per_file: int = 256, replica: Column | None = None) -> DataFrame:
    """``file, offset, length, digest, page_id`` of the pages as WARC records.
    A file holds ``per_file`` ids; pages without an id are dealt to 4,096 files by
    their url. Inside a file records are ordered by id, then by content.
    ``replica`` (another html of a page) adds ``replica_length, replica_digest``
    of the record that a copy holds at the same place."""
    body = record_bytes(F.col("page_id"), F.col("url"), F.encode(F.col("html"), "UTF-8"))
    file = F.when(F.col("page_id").isNull(),
                  F.concat(F.lit("crawl-n"), F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 3))).otherwise(
        F.concat(F.lit("crawl-"), F.floor(F.col("page_id") / per_file).cast("string")))
    copy = [] if replica is None else [record_bytes(F.col("page_id"), F.col("url"),
                                                    F.encode(replica, "UTF-8")).alias("_copy")]
    found = [] if replica is None else [F.octet_length("_copy").cast("long").alias("replica_length"),
                                        F.sha2("_copy", 256).alias("replica_digest")]
    records = (pages.select("page_id", file.alias("file"), body.alias("_body"), *copy)
               .select("page_id", "file", F.octet_length("_body").cast("long").alias("length"),
                       F.sha2("_body", 256).alias("digest"), *found))
    ends = F.sum("length").over(Window.partitionBy("file").orderBy("page_id", "digest")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return records.select("file", (ends - F.col("length")).alias("offset"), "length", "digest", "page_id",
                          *([] if replica is None else ["replica_length", "replica_digest"]))


def _up(children: DataFrame, keys: list[Column], fanout: int) -> DataFrame:
    """Parents of ``(…, idx, digest)``: hashes over the ordered children."""
    ordered = F.sort_array(F.collect_list(F.struct("idx", "digest")))
    return (children.groupBy(*keys, F.floor(F.col("idx") / fanout).alias("parent")).agg(ordered.alias("_c"))
            .withColumn("digest", F.sha2(F.array_join(F.transform(
                "_c", lambda c: F.concat_ws(":", c["idx"].cast("string"), c["digest"])), "|"), 256))
            .drop("_c").withColumnRenamed("parent", "idx"))


def merkle_levels(records: DataFrame, *, levels: int, range_bytes: int, fanout: int) -> list[DataFrame]:
    """Node tables ``file, idx, digest`` from offset ranges (first) to file
    roots (last); ``records`` has ``file, offset, length, digest``."""
    leaf = records.select("file", F.col("offset").alias("idx"),
                          F.concat_ws(":", F.col("length").cast("string"), "digest").alias("digest"))
    nodes = [_up(leaf, [F.col("file")], range_bytes)]
    for _ in range(levels):
        nodes.append(_up(nodes[-1], [F.col("file")], fanout))
    return nodes


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    a = a.select(*keys, F.col("digest").alias("_a"))
    b = b.select(*keys, F.col("digest").alias("_b"))
    return a.join(b, keys, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def _below(level: DataFrame, bad: DataFrame, divide: int, at: str = "idx") -> DataFrame:
    """Nodes of ``level`` under the mismatching nodes of the level above."""
    up = bad.select(F.col("file").alias("_file"), F.col("idx").alias("_up"))
    return level.join(up, (F.col("file") == F.col("_file")) & (F.floor(F.col(at) / divide) == F.col("_up")),
                      "left_semi")


def collection_root(roots: DataFrame, fanout: int = 16) -> str | None:
    """Digest over the file roots (``file, digest``); files are dealt to nodes
    by a hash, so a level shrinks by ``fanout`` until at most ``fanout`` nodes
    are left, which the driver hashes. None without files."""
    files = roots.count()
    if not files:
        return None
    width = 1
    while width < files:
        width *= fanout
    nodes = roots.select("file", F.pmod(F.xxhash64("file"), F.lit(width)).alias("idx"), "digest").groupBy("idx").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "file", "digest"))), "|"), 256)
        .alias("digest"))
    while width > 1:
        nodes = _up(nodes, [], fanout)
        width //= fanout
    return nodes.first()["digest"]


def audit(primary: DataFrame, replica: DataFrame, *, range_bytes: int = 1 << 16, fanout: int = 16) -> DataFrame:
    """Records that differ between two replicas (``file, offset, length,
    digest``): ``file, offset, status, length, digest, found_length,
    found_digest`` with status ``corrupt``, ``missing`` or ``extra``.

    Offsets are those of the catalogue both replicas were written from. Equal
    collection roots end the audit after one comparison.
    """
    primary = stage(primary.select("file", "offset", "length", "digest"), "audit-primary")
    replica = stage(replica.select("file", "offset", "length", "digest"), "audit-replica")
    top = primary.unionByName(replica).agg(F.max("offset")).first()[0] or 0
    levels, reach = 0, range_bytes
    while reach <= top:
        reach *= fanout
        levels += 1
    a = merkle_levels(primary, levels=levels, range_bytes=range_bytes, fanout=fanout)
    b = merkle_levels(replica, levels=levels, range_bytes=range_bytes, fanout=fanout)
    a = [stage(x, "audit-a") for x in a]
    b = [stage(x, "audit-b") for x in b]
    if collection_root(a[-1]) == collection_root(b[-1]):
        bad = a[-1].limit(0).select("file", "idx")
    else:
        bad = _differ(a[-1], b[-1], ["file", "idx"])
        for low_a, low_b in zip(a[-2::-1], b[-2::-1]):
            bad = _differ(_below(low_a, bad, fanout), _below(low_b, bad, fanout), ["file", "idx"])
    bad = stage(bad, "audit-bad")
    mine = _below(primary, bad, range_bytes, "offset")
    found = _below(replica, bad, range_bytes, "offset").select(
        "file", "offset", F.col("length").alias("found_length"), F.col("digest").alias("found_digest"))
    status = (F.when(F.col("found_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra")
              .otherwise("corrupt"))
    return (mine.join(found, ["file", "offset"], "full_outer")
            .filter(~(F.col("digest").eqNullSafe(F.col("found_digest"))
                      & F.col("length").eqNullSafe(F.col("found_length"))))
            .select("file", "offset", status.alias("status"), "length", "digest", "found_length", "found_digest"))
