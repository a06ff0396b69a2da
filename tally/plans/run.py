"""One idempotent batch run over ledger files, with keyed state tables.

This is the main flow (account check, idempotency key, triage, compute,
persist the summary, hand the statement to delivery, mark it sent), re-aimed
at many files per run:

1. Every path gets its ``file_key``; a file whose account is missing or has an
   unusable address is left alone (``missing_account`` / ``invalid_email``);
   otherwise ``triage`` against the stored ``file_status`` and
   ``file_summary`` decides per file: skip, send_only, process,
   error_already_processed, locked or resume. No file is opened for that.
2. Only files to *process* or *resume* are read, ``batch_files`` at a time: a
   batch bounds the path list on the driver and the layout table that its
   records look up. A resumed file is recomputed whole from its source; that
   is idempotent, so no partial state is carried over.
3. Validation, per-file outcome and month summaries for those files. A file
   with an unusable header is listed in ``rejected`` and leaves no state: it
   is looked at again by the next run.
4. The files to read are claimed first (``claim_files``): they are
   ``processing`` under a lease that the run renews while it works, so another
   run finds them ``locked``, or takes them over when the lease is stale.
5. The rows that changed are appended as a version of the state (``statestore``):
   what a run reads and writes follows its own files, not the history. A
   delivered summary is never replaced.
6. ``statements`` lists the due statements of the run's files (finished file,
   stored summary, not delivered, usable address), built from the stored JSON
   summaries. ``acknowledge`` marks delivered keys in a new version.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import count, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import file_key
from ..functions.predicates import (DEFAULT_HEARTBEAT_TIMEOUT_SECS, DEFAULT_MAX_ROW_ERRORS, STATUS_DONE, STATUS_FAILED,
                                    as_timestamp, valid_email)
from ..operators import report, state, summary, validate
from ..operators.state import ACTION_PROCESS, ACTION_RESUME
from ..session import many_files, release_scratch, remove_path, scratch_mark, stage
from ..sources.csv_ledger import account_from_path, list_ledgers, qualified, read_ledger_files
from .statestore import (CLAIM_SCHEMA, STATUS_SCHEMA, SUMMARY_SCHEMA, TABLES, Heartbeat, committed_version,
                         committed_versions, compact, next_version, read_state, running_clock, snapshot, take_version,
                         vacuum, write_state)

# --- fixed values -----------------------------------------------------------
# Account errors, checked before the file triage.
ACTION_MISSING_ACCOUNT = "missing_account"
ACTION_INVALID_EMAIL = "invalid_email"
# ---------------------------------------------------------------------------

REJECTED_SCHEMA = "file_path string, reject_reason string"
CLAIM_COLS = ["file_key", "account_id", "file_path"]

__all__ = ["Claim", "RunResult", "acknowledge", "claim_files", "committed_version", "committed_versions", "compact",
           "process_claim", "read_state", "run_batch", "statements", "vacuum"]


@dataclass
class RunResult:
    version: int
    triage: DataFrame       # file_key, account_id, file_path, status, action
    file_status: DataFrame  # the table as of this version
    file_summary: DataFrame  # the table as of this version
    statements: DataFrame   # due statements: file_key, account_id, to, subject, payload_json, html
    rejected: DataFrame     # file_path, reject_reason: files whose header is unusable


def in_batches(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while batch := list(islice(rows, size)):
        yield batch


def process_files(spark: SparkSession, paths: list[str], ts, max_errors: int, multi_line: bool):
    """``(status rows, summary rows, rejected)`` of one batch of files."""
    with many_files(spark):
        lf = read_ledger_files(spark, paths, multi_line=multi_line)
        # parse the CSV once; every later scan reads the staged parquet
        rows = validate.stage_classified(validate.classify(lf.raw), "run-rows")
    _, outcome = validate.error_report(rows, "blk", ["blk", "mid"], max_errors, carry=["file_path"], files=lf.files,
                                        blank_lines=lf.blank_lines)
    status = outcome.select(
        "file_key", "account_id", "file_path", "status", "checkpoint_row", "valid_rows", "invalid_rows",
        F.to_json("row_errors").alias("row_errors_json"), ts.alias("heartbeat_at"))
    done = outcome.filter(F.col("status") == STATUS_DONE).select("account_id", "file_key", "invalid_rows")
    docs = report.summary_documents(summary.accepted_monthly_summary(rows, max_errors), done)
    summaries = docs.select("file_key", "account_id", F.lit(False).alias("email_sent"), "summary_json",
                            ts.alias("created_at"), ts.alias("updated_at"))
    return status, summaries, lf.rejected


@dataclass
class Claim:
    """Files that a run holds: nobody else processes them while its heartbeat is
    fresh, and rows of its version never replace those of a later one."""
    version: int
    triage: DataFrame      # file_key, account_id, file_path, status, action
    files: DataFrame       # the claimed ones: file_key, account_id, file_path
    state_dir: str
    accounts: DataFrame
    now: dt.datetime
    clock: Callable[[], dt.datetime]
    timeout_secs: int


def claim_files(spark: SparkSession, paths: str | list[str], state_dir: str, accounts: DataFrame, now: dt.datetime,
                timeout_secs: int = DEFAULT_HEARTBEAT_TIMEOUT_SECS, suffix: str = "") -> Claim:
    """Triage ``paths`` and take the files to process or resume. When another
    run takes the version meanwhile, the state has changed and the triage is
    made again; of any number of runs one gets each file."""
    clock, run = running_clock(now), uuid.uuid4().hex[:12]
    files = list_ledgers(spark, paths, suffix) if isinstance(paths, str) else spark.createDataFrame(
        [(p,) for p in paths], "file_path string").select(qualified(spark, F.col("file_path")).alias("file_path"))
    manifest = files.distinct().withColumn("account_id", account_from_path(F.col("file_path"))).withColumn(
        "file_key", file_key(F.col("account_id"), F.col("file_path")))
    mark = scratch_mark()
    manifest = stage(manifest, "manifest")
    triages = scratch_mark()
    # J1 + P10 come first: a file whose account is missing or has an unusable
    # address is not touched at all.
    acc = accounts.select("account_id", valid_email("email").alias("_ok"))
    for attempt in count(1):
        seen = snapshot(spark, state_dir)
        status, summaries = (read_state(spark, state_dir, t, manifest, seen) for t in TABLES)
        tri = state.triage(manifest, status.select("file_key", "status", "heartbeat_at"),
                           summaries.select("file_key", "email_sent"), as_timestamp(clock()), timeout_secs)
        tri = tri.join(acc, "account_id", "left").withColumn(
            "action", F.when(F.col("_ok").isNull(), F.lit(ACTION_MISSING_ACCOUNT))
            .when(~F.col("_ok"), F.lit(ACTION_INVALID_EMAIL)).otherwise(F.col("action"))).drop("_ok")
        tri = stage(tri, "triage")  # one row per file, reused below and returned
        mine = tri.filter(F.col("action").isin(ACTION_PROCESS, ACTION_RESUME)).select(*CLAIM_COLS)
        folder = f"{run}-{attempt}"
        mine.write.parquet(f"{state_dir}/claims/{folder}")
        version = take_version(spark, state_dir, seen, run, clock(), folder)
        if version is not None:
            release_scratch(spark, mark, keep=1)
            held = spark.read.schema(CLAIM_SCHEMA).parquet(f"{state_dir}/claims/{folder}")
            return Claim(version, tri, held, state_dir, accounts, now, clock, timeout_secs)
        remove_path(spark, f"{state_dir}/claims/{folder}")
        release_scratch(spark, triages)


def process_claim(spark: SparkSession, claim: Claim, max_errors: int = DEFAULT_MAX_ROW_ERRORS,
                  multi_line: bool = False, batch_files: int = 50_000) -> RunResult:
    """Read the claimed files, a bounded batch at a time, and commit what they
    gave. The lease is renewed meanwhile. A run that fails leaves its files
    ``failed``, to be resumed by the next one."""
    state_dir, version = claim.state_dir, claim.version
    ts = as_timestamp(claim.now)
    mark = scratch_mark()
    kept: list[list[DataFrame]] = []
    with Heartbeat(spark, state_dir, version, claim.timeout_secs, claim.clock):
        try:
            todo = claim.files.select("file_path").toLocalIterator()
            for batch in in_batches((r["file_path"] for r in todo), batch_files):
                inner = scratch_mark()
                found = process_files(spark, batch, ts, max_errors, multi_line)
                kept.append([stage(df, "run-result") for df in found])
                release_scratch(spark, inner, keep=3)
            empty = [spark.createDataFrame([], s) for s in (STATUS_SCHEMA, SUMMARY_SCHEMA, REJECTED_SCHEMA)]
            new = [empty[i].drop("version") if i < 2 else empty[i] for i in range(3)]
            for part in kept:
                new = [a.unionByName(b) for a, b in zip(new, part)]
            state.write_snapshot(new[2], f"{state_dir}/rejected", version)
            old = read_state(spark, state_dir, "file_summary", new[1]).join(new[1].select("file_key"), "file_key",
                                                                           "left_semi").drop("version")
            write_state(spark, state_dir, version, new[0], state.upsert_summaries(old, new[1]).drop("source"))
        except Exception:
            failed = claim.files.select(
                "*", F.lit(STATUS_FAILED).alias("status"), *[F.lit(0).cast("bigint").alias(c) for c in (
                    "checkpoint_row", "valid_rows", "invalid_rows")], F.lit("[]").alias("row_errors_json"),
                ts.alias("heartbeat_at"))
            write_state(spark, state_dir, version, failed, spark.createDataFrame([], SUMMARY_SCHEMA))
            raise
        finally:
            release_scratch(spark, mark)

    # due statements of the run's files from the stored documents
    seen, keys = snapshot(spark, state_dir), claim.triage.select("file_key")
    due = [read_state(spark, state_dir, t, keys, seen).join(keys, "file_key", "left_semi") for t in TABLES]
    rejected = spark.read.schema(REJECTED_SCHEMA).parquet(f"{state_dir}/rejected/v={version}")
    whole = [read_state(spark, state_dir, t, seen=seen) for t in TABLES]
    return RunResult(version, claim.triage, *whole, statements(*due, claim.accounts), rejected)


def run_batch(spark: SparkSession, paths: str | list[str], state_dir: str, accounts: DataFrame,
              now: dt.datetime, max_errors: int = DEFAULT_MAX_ROW_ERRORS,
              timeout_secs: int = DEFAULT_HEARTBEAT_TIMEOUT_SECS, multi_line: bool = False, suffix: str = "",
              batch_files: int = 50_000) -> RunResult:
    """Run once over ``paths``: a folder, or a list of files, under
    ``account_id=<id>/`` folders. Runs over the same files may go on at the same
    time: each file is processed by one of them.

    ``accounts`` has ``account_id, email``, one row per account (the command
    line keeps it that way with a last-write-wins upsert). ``now`` is the time
    at the start: it decides about stale leases and stamps the rows, so a run is
    reproducible; with what has passed since it renews the run's own lease.
    ``multi_line`` reads quoted new lines.
    """
    claim = claim_files(spark, paths, state_dir, accounts, now, timeout_secs, suffix)
    return process_claim(spark, claim, max_errors, multi_line, batch_files)


def statements(status: DataFrame, summaries: DataFrame, accounts: DataFrame) -> DataFrame:
    due = report.outbox(status, summaries, accounts).select("file_key", "account_id", "email", "summary_json")
    docs = report.payload_from_documents(report.parse_documents(due))
    return docs.select(
        "file_key", "account_id", F.col("email").alias("to"),
        F.concat(F.lit("Account statement "), F.col("account_id")).alias("subject"),
        "payload_json", report.html_from_payload("payload").alias("html"))


def acknowledge(spark: SparkSession, state_dir: str, delivered: DataFrame, now: dt.datetime) -> DataFrame:
    """Mark ``delivered`` keys (``file_key``) as sent in a new version,
    which holds only their rows. Returns the table."""
    keys = delivered.select("file_key").distinct()
    version = next_version(spark, state_dir, now)
    mine = read_state(spark, state_dir, "file_summary", keys).join(keys, "file_key", "left_semi")
    marked = state.mark_delivered(mine, keys, now=as_timestamp(now))
    write_state(spark, state_dir, version, spark.createDataFrame([], STATUS_SCHEMA), marked)
    return read_state(spark, state_dir, "file_summary")
