"""Ledgers and state tables derived from the driver's tables.

The driver data has no ledger CSVs, so the registered queries turn its tables
into ledgers. Every rule reads the whole table; the modulo rules below
*inject* faults and states. Rows are left out only where that is the case to
be shown: customers without an account (``orphan_accounts``), files without a
status or summary (L3), keys of only one snapshot (L4), files missing from a
manifest (L5).

* L1 ``orders_ledger``: a clean typed ledger, one file per customer.
* L2 ``events_raw_ledger``: a text ledger with malformed and unusual cells,
  one file per user, file order = ``event_id``.
* L3 ``file_states``: manifest, file status and summary tables.
* L4 ``summary_snapshots``: an old and a new ``file_summary`` snapshot.
* L5 ``write_csv_ledgers``: L2 written out as real ledger CSV files, one
  per (user, chunk of event ids), with several header layouts, quoted cells
  and short records, to be read back through the CSV source and the stream
  intake.
* ``account_registry``: accounts with e-mail addresses, from ``customer``.
"""

from __future__ import annotations

import datetime as dt
import itertools
import os
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordinals import with_blocks
from ..functions.predicates import (STATUS_DONE, STATUS_FAILED, STATUS_PROCESSING, STATUS_TO_REVIEW,
                                    as_timestamp)
from ..session import remove_path

# Parameters of the derived test ledgers.
L2_MAX_ROW_ERRORS = 3          # per-file threshold used on L2
L2_CHECKPOINT_INTERVAL = 20    # checkpoint cadence used on L2
L5_CHUNK_IDS = 1 << 20         # event ids per CSV file of a user
L3_NOW = dt.datetime(2024, 2, 1, 0, 0, 0)
L3_TIMEOUT_SECS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: ``account_id = file_key = o_custkey``, ``id = o_orderkey``,
    finished orders (F) are credits, the others debits."""
    o = table(spark, sf_dir, "orders")
    signed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return o.select(
        F.col("o_custkey").alias("account_id"), F.col("o_custkey").alias("file_key"),
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"),
        signed.cast("decimal(18,2)").alias("amount"))


def events_raw_ledger(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """L2: ``id``, ``date``, ``transaction`` as text, with injected cells, each
    at every so many events: an empty id (97), a control character before the
    id (103), an id in Unicode white space (107), day 32 (89), a non-number
    (83), and the amounts 1e20 (109), 1e-7 (113) and -1e-7 (127). The ordinal
    blocks are added by :func:`l2_blocks`."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    sign = F.when(F.col("event_type").isin("purchase", "error"), F.lit("-")).otherwise(F.lit("+"))
    text = eid.cast("string")
    return e.select(
        F.col("user_id").alias("account_id"), F.col("user_id").alias("file_key"), eid,
        F.when(eid % 97 == 0, F.lit("")).when(eid % 103 == 0, F.concat(F.lit("\x01"), text))
         .when(eid % 107 == 0, F.concat(F.lit("\u00a0"), text, F.lit("\u2003"))).otherwise(text).alias("id"),
        F.when(eid % 89 == 0, F.lit("32/01/2024")).otherwise(F.date_format("ts", "dd/MM/yyyy")).alias("date"),
        F.when(eid % 83 == 0, F.lit("not-a-number")).when(eid % 109 == 0, F.lit("1e20"))
         .when(eid % 113 == 0, F.lit("+1e-7")).when(eid % 127 == 0, F.lit("-1e-7"))
         .otherwise(F.concat(sign, F.col("value").cast("decimal(18,2)").cast("string"))).alias("transaction"),
        F.lit(False).alias("malformed"), *carry)


def l2_blocks(ledger: DataFrame) -> DataFrame:
    """L2 rows with their ordinal block."""
    return with_blocks(ledger, ["file_key"], "event_id")


def account_registry(spark: SparkSession, sf_dir: str, orphan_every: int | None = None) -> DataFrame:
    """Accounts from ``customer``; every 13th has an unusable address. With
    ``orphan_every``, customers divisible by it have no account."""
    c = table(spark, sf_dir, "customer")
    if orphan_every:
        c = c.filter(F.col("c_custkey") % orphan_every != 0)
    email = F.when(F.col("c_custkey") % 13 == 0, F.lit("not-an-email")).otherwise(
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")))
    return c.select(
        F.col("c_custkey").alias("account_id"), email.alias("email"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def flawed_tables(spark: SparkSession, sf_dir: str):
    """``(raw, status, summaries, accounts)`` as above with flaws against each
    rule: missing cells, an unknown status, NULLs and repeated keys."""
    raw = events_raw_ledger(spark, sf_dir)
    raw = raw.withColumn("date", F.when(F.col("event_id") % 101 == 3, F.lit(" ")).otherwise(F.col("date")))
    _, status, summaries = file_states(spark, sf_dir)
    accounts = account_registry(spark, sf_dir)

    def flawed(df, key, every, **nulls):
        out = df.withColumns({c: F.when(F.col(key) % n != r, F.col(c)) for c, (n, r) in nulls.items()})
        return out.unionByName(out.filter(F.col(key) % every == 5))

    status = flawed(status, "file_key", 17, heartbeat_at=(11, 2)).withColumn(
        "status", F.when(F.col("file_key") % 13 == 6, F.lit("lost")).otherwise(F.col("status")))
    return (raw, status, flawed(summaries, "file_key", 9, email_sent=(5, 1)),
            flawed(accounts, "account_id", 71, email=(53, 9)))


def file_states(spark: SparkSession, sf_dir: str):
    """L3: ``(manifest, status, summaries)``, one file per user."""
    e = table(spark, sf_dir, "events")
    manifest = e.select(F.col("user_id").alias("account_id")).distinct().select(
        F.col("account_id").alias("file_key"), "account_id")
    k = F.col("account_id") % 7
    status = manifest.filter(k != 0).select(
        "file_key", "account_id",
        F.when(k.isin(1, 2, 3), F.lit(STATUS_DONE)).when(k == 4, F.lit(STATUS_PROCESSING))
         .when(k == 5, F.lit(STATUS_FAILED)).otherwise(F.lit(STATUS_TO_REVIEW)).alias("status"),
        (as_timestamp(L3_NOW) - F.make_dt_interval(secs=(F.col("account_id") % 41).cast("int"))).alias("heartbeat_at"))
    summaries = manifest.filter(k.isin(1, 2) | ((k == 5) & (F.col("account_id") % 2 == 0))).select(
        "file_key", "account_id", (k == 1).alias("email_sent"))
    return manifest, status, summaries


def summary_snapshots(spark: SparkSession, sf_dir: str):
    """L4: ``(old, new)`` file summaries keyed by customer.

    old: orders before 1998 of customers not divisible by 3, delivered for
    even customers; new: all orders of customers not divisible by 5."""
    o = table(spark, sf_dir, "orders")
    amt = F.col("o_totalprice").cast("decimal(18,2)")

    def snap(df, sent):
        return df.groupBy(F.col("o_custkey").alias("file_key")).agg(F.sum(amt).alias("_t")).select(
            "file_key", F.col("file_key").alias("account_id"), F.col("_t").cast("double").alias("total_balance"),
            sent.alias("email_sent"))

    old = snap(o.filter((F.col("o_orderdate") < as_timestamp(dt.datetime(1998, 1, 1))) & (F.col("o_custkey") % 3 != 0)),
               F.col("file_key") % 2 == 0)
    new = snap(o.filter(F.col("o_custkey") % 5 != 0), F.lit(False))
    return old, new


def write_csv_ledgers(spark: SparkSession, sf_dir: str, out_dir: str, chunk_ids: int = L5_CHUNK_IDS) -> None:
    """Write L2 as ledger CSV files under ``out_dir``.

    One file per (user, ``event_id // chunk_ids``), laid out as
    ``account_id=<user>/chunk=<n>/part-*.txt``, header first, records in
    ``event_id`` order. Layouts: even users ``id,date,transaction``; odd users
    `` Transaction ,memo,ID,Date`` (permuted, extra column, case and spaces).
    Users at 7 modulo 50 have a fifth column whose name takes 70,000 bytes,
    users at 10 modulo 50 a header without ``date`` (rejected). Files of users
    at 3 modulo 4 begin with a blank line. Memos hold, in turn, doubled
    quotes with a comma, a backslash before the closing quote and a quoted new
    line. Every 101st event is written one field short.

    Each file is written by the one task that holds its (user, chunk), so a
    file is bounded by ``chunk_ids`` events, not by the user's size. On a
    shared folder of the local kind the tasks make the files themselves
    (``local_files``), on any other file system Spark's text writer does.
    """
    rows = events_raw_ledger(spark, sf_dir, carry=("event_type",))
    eid, user = F.col("event_id"), F.col("account_id")
    odd, long = user % 2 == 1, user % 50 == 7
    short = eid % 101 == 0
    memo = (F.when(eid % 7 == 1, F.lit('"say ""hi"", bye"')).when(eid % 7 == 2, F.lit('"C:\\dir\\"'))
            .when(eid % 7 == 3, F.lit('"one\ntwo"')).otherwise(F.col("event_type")))
    cells = F.when(odd, F.array(F.col("transaction"), memo, F.col("id"), F.col("date"))).otherwise(
        F.array("id", "date", "transaction"))
    cells = F.when(long, F.concat(cells, F.array(F.lit("x")))).otherwise(cells)
    line = F.array_join(F.when(short, F.slice(cells, 1, F.size(cells) - 1)).otherwise(cells), ",")
    chunk = F.floor(eid / chunk_ids).cast("bigint")
    body = rows.select("account_id", chunk.alias("chunk"), eid.alias("_ord"), line.alias("value"))
    header = (F.when(user % 50 == 10, F.lit("id,day,transaction"))
              .when(long, F.concat(F.lit(" Transaction ,memo,ID,Date,"), F.repeat(F.lit("n"), 70_000)))
              .when(odd, F.lit(" Transaction ,memo,ID,Date")).otherwise(F.lit("id,date,transaction")))
    header = F.when(user % 4 == 3, F.concat(F.lit("\n"), header)).otherwise(header)
    heads = body.select("account_id", "chunk").distinct().select(
        "account_id", "chunk", F.lit(-1).cast("bigint").alias("_ord"), header.alias("value"))
    # Making files takes the time, not their bytes: several tasks a core, however few bytes they get.
    lines = (heads.unionByName(body).repartition(4 * spark.sparkContext.defaultParallelism, "account_id", "chunk")
             .sortWithinPartitions("account_id", "chunk", "_ord").drop("_ord"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        remove_path(spark, out_dir)
        fs.mkdirs(path)
        local_files(lines, fs.makeQualified(path).toUri().getPath())
    else:
        lines.write.mode("overwrite").partitionBy("account_id", "chunk").text(out_dir)


def local_files(lines: DataFrame, folder: str) -> None:
    """``account_id, chunk, value``, each file's lines together and in order, as
    ``<folder>/account_id=<user>/chunk=<n>/part-0.txt``. Hadoop without its native
    library starts a process for every permission that it sets, several a local
    file. A file comes whole under its name, so a task may run again."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def name(value):
            return "__HIVE_DEFAULT_PARTITION__" if value is None else value

        files = 0
        for (account, chunk), group in itertools.groupby(rows(), key=lambda row: row[:2]):
            at = f"{folder}/account_id={name(account)}/chunk={name(chunk)}"
            os.makedirs(at, exist_ok=True)
            made = f"{at}/.{uuid.uuid4().hex}"
            with open(made, "wb") as file:
                file.writelines((value or b"") + b"\n" for _, _, value in group)
            os.replace(made, f"{at}/part-0.txt")
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    rows = lines.select("account_id", "chunk", F.col("value").cast("binary").alias("value"))
    rows.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()
