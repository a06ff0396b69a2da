"""The registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver's tables whole (through ``ledgers``) and is a
composition of library operators. Output columns are aliased to the names
used by the matching oracle SQL in ``oracle``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import file_key
from ..functions.money import total
from ..functions.predicates import STATUS_DONE, STATUS_FAILED, STATUS_TO_REVIEW, as_timestamp
from ..operators import quality, report, state, summary, validate
from ..operators.state import KNOWN_STATUSES
from ..session import many_files, scratch_path, stage
from ..sources.csv_ledger import list_ledgers, read_ledger_files
from ..streaming.intake import LedgerIntake
from ..streaming.running import RunningMonths
from . import ledgers as L
from .statestore import (Heartbeat, compact, read_state, snapshot, take_version, write_state)

Query = Callable[[SparkSession, str], DataFrame]

MONTHLY_COLS = ["account_id", "file_key", "year", "month_num", "month", "txn_count", "credit_count",
                "debit_count", "credit_sum", "debit_sum", "avg_credit", "avg_debit"]


# --- L1: clean typed ledger from orders -------------------------------------

def monthly_summary(spark, sf_dir):
    return summary.monthly_summary(L.orders_ledger(spark, sf_dir)).select(*MONTHLY_COLS)


def account_totals(spark, sf_dir):
    return summary.totals(L.orders_ledger(spark, sf_dir))


def yearly_counts(spark, sf_dir):
    return summary.yearly_counts(L.orders_ledger(spark, sf_dir))


def credit_debit_totals(spark, sf_dir):
    return summary.credit_debit_totals(L.orders_ledger(spark, sf_dir))


def ledger_with_account(spark, sf_dir):
    # Aggregate first, then look the account up: the join moves one row per
    # file instead of one row per transaction.
    t = summary.totals(L.orders_ledger(spark, sf_dir))
    acc = L.account_registry(spark, sf_dir).select("account_id", "name", "segment")
    return state.with_parent(t, acc, "account_id")


def orphan_accounts(spark, sf_dir):
    per_account = L.orders_ledger(spark, sf_dir).groupBy("account_id").agg(F.count(F.lit(1)).alias("txn_count"))
    return state.orphans(per_account, L.account_registry(spark, sf_dir, orphan_every=10), "account_id")


def merge_partial_summaries(spark, sf_dir):
    # Two partial month states (split by order-key parity) from one scan: the
    # split is an extra grouping key; merging sums the partials per month.
    ledger = L.orders_ledger(spark, sf_dir).withColumn("part", F.col("id") % 2)
    partials = summary.monthly_state(ledger, keys=("account_id", "file_key", "part"))
    return summary.finish_monthly(summary.merge_states(partials.drop("part"))).select(*MONTHLY_COLS)


def statement_rows(spark, sf_dir):
    return report.statement_rows(summary.monthly_summary(L.orders_ledger(spark, sf_dir)))


def summary_json(spark, sf_dir):
    docs = report.summary_documents(summary.monthly_summary(L.orders_ledger(spark, sf_dir)))
    return docs.select("account_id", "file_key", "summary_json")


def summary_roundtrip(spark, sf_dir):
    """A12/F14 -> F15 -> R1: nest, serialise, parse back and flatten."""
    docs = report.summary_documents(summary.monthly_summary(L.orders_ledger(spark, sf_dir)))
    back = report.parse_documents(docs.select("account_id", "file_key", "summary_json"))
    return report.flatten_documents(back, doc_fields={"total_balance": "TotalBalance",
                                                      "invalid_rows": "InvalidRows"})


def statement_html(spark, sf_dir):
    return report.statement_html(summary.monthly_summary(L.orders_ledger(spark, sf_dir)))


# --- L2: raw text ledger with faults from events ----------------------------

def _l2_classified(spark, sf_dir, blocks: bool = False):
    """L2 classified, with its ordinal blocks for queries along the file
    order. The source is a columnar table: queries that scan it twice parse it
    twice, which is cheaper than writing a parsed copy."""
    raw = L.events_raw_ledger(spark, sf_dir)
    return validate.classify(L.l2_blocks(raw) if blocks else raw)


def _l2_errors(classified):
    return validate.row_error_details(classified, "blk", ["event_id"], L.L2_MAX_ROW_ERRORS)


def ledger_valid_rows(spark, sf_dir):
    v = validate.valid_rows(_l2_classified(spark, sf_dir))
    return v.select("account_id", "file_key", "id", F.col("date").cast("string").alias("txn_date"),
                    F.col("amount").cast("double").alias("amount"))


def row_error_details(spark, sf_dir):
    return _l2_errors(_l2_classified(spark, sf_dir, blocks=True))


def file_status(spark, sf_dir):
    c = _l2_classified(spark, sf_dir, blocks=True)
    _, out = validate.error_report(c, "blk", ["event_id"], L.L2_MAX_ROW_ERRORS)
    return out.select("account_id", "file_key", "status", "checkpoint_row", "valid_rows", "invalid_rows",
                      F.to_json("row_errors").alias("row_errors_json"))


def monthly_summary_accepted(spark, sf_dir):
    c = _l2_classified(spark, sf_dir)
    return summary.accepted_monthly_summary(c, L.L2_MAX_ROW_ERRORS).select(*MONTHLY_COLS)


def checkpoint_snapshots(spark, sf_dir):
    return summary.checkpoint_snapshots(_l2_classified(spark, sf_dir, blocks=True), "blk", ["event_id"],
                                        L.L2_CHECKPOINT_INTERVAL, L.L2_MAX_ROW_ERRORS)


def resume_from_checkpoint(spark, sf_dir):
    c = _l2_classified(spark, sf_dir, blocks=True)
    manifest, _, _ = L.file_states(spark, sf_dir)
    checkpoints = manifest.select("file_key", (F.col("file_key") % 30).alias("checkpoint_row"))
    rest = summary.resume_delta(c, checkpoints, "blk", ["event_id"])
    return rest.groupBy("account_id", "file_key").agg(
        F.count(F.lit(1)).alias("txn_count"), total("amount").alias("balance"))


def ledger_rollup(spark, sf_dir):
    return summary.ledger_rollup(validate.valid_rows(_l2_classified(spark, sf_dir)))


# --- L5: ledger CSV files (source and stream) -------------------------------

FILE_STATUS_COLS = ["account_id", "chunk", "status", "checkpoint_row", "valid_rows", "invalid_rows",
                    "row_errors_json", "reason"]


def _chunk_of(path_col):
    return F.regexp_extract(path_col, r"chunk=([0-9]+)", 1).cast("bigint")


def _account_of(path_col):
    return F.regexp_extract(path_col, r"account_id=([0-9]+)", 1).cast("bigint")


def _rejected_rows(rejected):
    return rejected.select(
        _account_of("file_path").alias("account_id"), _chunk_of("file_path").alias("chunk"),
        F.lit("rejected").alias("status"), F.lit(0).cast("bigint").alias("checkpoint_row"),
        F.lit(0).cast("bigint").alias("valid_rows"), F.lit(0).cast("bigint").alias("invalid_rows"),
        F.lit("[]").alias("row_errors_json"), F.col("reject_reason").alias("reason"))


def _status_rows(outcome):
    return outcome.select(
        F.col("account_id").cast("bigint").alias("account_id"), _chunk_of("file_path").alias("chunk"),
        "status", "checkpoint_row", "valid_rows", "invalid_rows",
        F.to_json("row_errors").alias("row_errors_json"), F.lit(None).cast("string").alias("reason"))


def _l5_folder(spark, sf_dir):
    base = scratch_path(spark, "ledger-csv")
    L.write_csv_ledgers(spark, sf_dir, base)
    return base


def csv_file_status(spark, sf_dir):
    """S1/S2/S4/P4 + A9-A11: ledger CSV files read back and judged per file."""
    base = _l5_folder(spark, sf_dir)
    with many_files(spark):
        lf = read_ledger_files(spark, base, multi_line=True, suffix=".txt")
        c = validate.stage_classified(validate.classify(lf.raw), "csv-rows")
    _, outcome = validate.error_report(c, "blk", ["blk", "mid"], L.L2_MAX_ROW_ERRORS, carry=["file_path"],
                                       files=lf.files, blank_lines=lf.blank_lines)
    return _status_rows(outcome).unionByName(_rejected_rows(lf.rejected)).select(*FILE_STATUS_COLS)


def manifest_files(spark, sf_dir):
    """The same files with their accounts from a manifest that lacks the
    files of some users and lists those of others twice."""
    base = _l5_folder(spark, sf_dir)
    with many_files(spark):
        listed = stage(list_ledgers(spark, base, ".txt"), "listed").withColumn("_user", _account_of("file_path"))
    listed = listed.filter(F.col("_user") % 11 != 3)
    again = listed.filter(F.col("_user") % 13 == 5)
    manifest = listed.unionByName(again).select(
        "file_path", F.concat(F.lit("ACC-"), F.col("_user").cast("string")).alias("account_id"))
    with many_files(spark):
        lf = read_ledger_files(spark, base, manifest=manifest, multi_line=True, suffix=".txt")
        counts = stage(lf.raw.groupBy("file_path").agg(F.count(F.lit(1)).alias("records")), "counts")
    good = lf.files.join(counts, "file_path", "left").select(
        "file_path", "account_id", F.coalesce("records", F.lit(0)).alias("records"),
        F.lit(None).cast("string").alias("reason"))
    bad = lf.rejected.select("file_path", F.lit(None).cast("string").alias("account_id"),
                             F.lit(0).cast("bigint").alias("records"), F.col("reject_reason").alias("reason"))
    return good.unionByName(bad).select(_account_of("file_path").alias("user_id"), _chunk_of("file_path").alias("chunk"),
                                        "account_id", "records", "reason")


#: Files of a micro-batch at most: the driver holds their paths.
BATCH_FILES = 10_000


def _intake(spark, sf_dir):
    """The L5 files through the Structured Streaming intake (``availableNow``,
    two micro-batches or, of ``BATCH_FILES`` files at most, more, whose tables
    are merged on read)."""
    base = _l5_folder(spark, sf_dir)
    with many_files(spark):
        n = list_ledgers(spark, base, ".txt").count()
    intake = LedgerIntake(spark, base, scratch_path(spark, "intake-out"), max_errors=L.L2_MAX_ROW_ERRORS,
                          max_files_per_trigger=min(BATCH_FILES, max(1, (n + 1) // 2)), suffix=".txt", multi_line=True)
    intake.run_available()
    return intake


def stream_file_status(spark, sf_dir):
    """Every file's outcome, read back from the stream's tables."""
    intake = _intake(spark, sf_dir)
    return (_status_rows(intake.file_status()).unionByName(_rejected_rows(intake.table("rejected_files")))
            .select(*FILE_STATUS_COLS))


def stream_account_monthly(spark, sf_dir):
    """Per (account, month) over all accepted files, after the first
    batch was delivered a second time."""
    intake = _intake(spark, sf_dir)
    first = (intake.table("file_status").filter("batch_id = 0").select(F.col("file_path").alias("path"))
             .unionByName(intake.table("rejected_files").filter("batch_id = 0").select(F.col("file_path").alias("path"))))
    intake.process_batch(stage(first, "replayed"), 0)
    return intake.account_monthly_summary().select(
        F.col("account_id").cast("bigint").alias("account_id"), "year", "month_num", "txn_count", "credit_count",
        "debit_count", "credit_sum", "debit_sum")


def stream_running_months(spark, sf_dir):
    """T3 without a threshold: all orders through the stateful stream in some
    micro-batches. The query dies after the second one was written and before it
    was committed, and goes on from its checkpoint."""
    folder, out, checkpoint = (scratch_path(spark, n) for n in ("ledger", "running", "running-checkpoint"))
    ledger = L.orders_ledger(spark, sf_dir).select("account_id", "date", "amount")
    ledger.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    def killed(batch_id):
        if batch_id == 1:
            raise RuntimeError("killed after the write of batch 1")

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        RunningMonths(spark, stream, out, checkpoint, partitions, after_write=killed).run_available()
    except StreamingQueryException:
        pass
    months = RunningMonths(spark, stream, out, checkpoint, partitions, fold_every=2)
    months.run_available()
    return months.account_monthly_summary().select("account_id", "year", "month_num", "month", "txn_count", "credit_count",
                                                   "debit_count", "credit_sum", "debit_sum", "avg_credit", "avg_debit")


# --- L3 / L4: state tables --------------------------------------------------

def file_triage(spark, sf_dir):
    manifest, status, summaries = L.file_states(spark, sf_dir)
    t = state.triage(manifest, status, summaries, L.L3_NOW, L.L3_TIMEOUT_SECS)
    return t.select("file_key", "account_id", "status", "action")


def _status_of(files, status):
    return files.select("file_key", "account_id", "file_path", F.lit(status).alias("status"),
                        *[F.lit(0).cast("bigint").alias(c) for c in ("checkpoint_row", "valid_rows", "invalid_rows")],
                        F.lit("[]").alias("row_errors_json"), as_timestamp(L.L3_NOW).alias("heartbeat_at"))


def _summary_of(files, sent=None):
    now = as_timestamp(L.L3_NOW)
    return files.select("file_key", "account_id", (F.lit(False) if sent is None else sent).alias("email_sent"),
                        F.lit("{}").alias("summary_json"), now.alias("created_at"), now.alias("updated_at"))


def claimed_files(spark, sf_dir):
    """Triage of every user's file while runs overlap. One run is
    done; one died with a stale lease, another took half of its files over and
    finished, and then the first one committed after all; one failed; one works
    with a fresh lease; one died."""
    folder = scratch_path(spark, "state")
    manifest = stage(L.table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("k"), F.col("user_id")).alias("file_key"), F.col("user_id").cast("string").alias("account_id"),
        F.concat(F.lit("ledgers/"), F.col("user_id")).alias("file_path"), "user_id"), "manifest")
    k, even = F.col("user_id") % 7, F.col("user_id") % 2 == 0
    none = manifest.limit(0)

    def claim(run, files, seconds_ago):
        files.select("file_key", "account_id", "file_path").write.parquet(f"{folder}/claims/{run}")
        beat = L.L3_NOW - dt.timedelta(seconds=seconds_ago)
        version = take_version(spark, folder, snapshot(spark, folder), run, beat, run)
        Heartbeat(spark, folder, version, L.L3_TIMEOUT_SECS, lambda: beat).beat()
        return version

    first = claim("first", manifest.filter(k.isin(1, 2, 3)), 90)
    dead = claim("dead", manifest.filter(k == 4), 60)
    failed = claim("failed", manifest.filter(k == 6), 50)
    claim("working", manifest.filter(k == 5), 5)
    again = claim("again", manifest.filter((k == 4) & even), 30)
    claim("died", manifest.filter((k == 0) & (F.col("user_id") % 3 == 0)), L.L3_TIMEOUT_SECS)
    write_state(spark, folder, first, _status_of(manifest.filter(k.isin(1, 2, 3)), STATUS_DONE),
                _summary_of(manifest.filter(k.isin(1, 2)), k == 1))
    write_state(spark, folder, failed, _status_of(manifest.filter(k == 6), STATUS_FAILED), _summary_of(none))
    mine = manifest.filter((k == 4) & even)
    write_state(spark, folder, again, _status_of(mine, STATUS_DONE), _summary_of(mine))
    write_state(spark, folder, dead, _status_of(manifest.filter(k == 4), STATUS_TO_REVIEW), _summary_of(none))
    seen = snapshot(spark, folder)
    status, summaries = (read_state(spark, folder, t, manifest, seen) for t in ("file_status", "file_summary"))
    out = state.triage(manifest, status, summaries, as_timestamp(L.L3_NOW), L.L3_TIMEOUT_SECS)
    return out.select("user_id", "status", F.col("heartbeat_at").cast("string").alias("heartbeat"), "action")


def state_after_compaction(spark, sf_dir):
    """K1-K4: three versions of every customer's row (years of orders), with a
    compaction after the first and the second; the buckets of changed keys are
    written again, more of them as rows come."""
    folder = scratch_path(spark, "state")
    o = L.table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    for low, high in ((0, 1993), (1994, 1994), (1995, 9999)):
        per = o.filter(F.col("y").between(low, high)).groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n"), F.max("y").alias("y"))
        files = per.select(F.concat(F.lit("k"), F.col("o_custkey")).alias("file_key"),
                           F.col("o_custkey").cast("string").alias("account_id"),
                           F.concat(F.lit("y"), F.col("y")).alias("file_path"), "n")
        version = take_version(spark, folder, snapshot(spark, folder), "change", L.L3_NOW)
        rows = _status_of(files, STATUS_DONE).join(files.select("file_key", "n"), "file_key").withColumn(
            "valid_rows", F.col("n")).drop("n")
        write_state(spark, folder, version, rows, _summary_of(files.limit(0)))
        if high < 9999:
            compact(spark, folder, L.L3_NOW, rows_per_bucket=200 * low + 200)
    keys = L.table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_custkey")).alias("file_key"))
    return read_state(spark, folder, "file_status", keys).select(
        F.col("account_id").cast("bigint").alias("customer"), F.col("file_path").alias("last_year"),
        F.col("valid_rows").alias("orders"))


def unprocessed_files(spark, sf_dir):
    manifest, status, _ = L.file_states(spark, sf_dir)
    return state.unprocessed(manifest, status)


def pending_statements(spark, sf_dir):
    _, status, summaries = L.file_states(spark, sf_dir)
    return report.outbox(status, summaries, L.account_registry(spark, sf_dir)).select(
        "file_key", "account_id", "email")


def statement_payloads(spark, sf_dir):
    """R4 + K6: due statements (L3 files, accounts with a usable address)
    with their payload from the accepted L2 ledger summaries: one scan of the
    ledger, the number of skipped rows comes with the month rows."""
    _, status, summaries = L.file_states(spark, sf_dir)
    due = report.outbox(status, summaries, L.account_registry(spark, sf_dir)).select(
        "file_key", "account_id", "email")
    monthly = summary.accepted_monthly_summary(_l2_classified(spark, sf_dir), L.L2_MAX_ROW_ERRORS)
    rows = report.statements(due, report.statement_payloads(monthly))
    return rows.select("file_key", "account_id", "to", "subject",
                       F.col("payload.TotalBalance").alias("total_balance"),
                       F.size("payload.ByYear").alias("months"),
                       F.col("payload.ByYear")[0]["TxnCount"].alias("first_month_txns"),
                       F.col("payload.InvalidRows").alias("invalid_rows"))


def statement_payload_json(spark, sf_dir):
    """K6: the payload text of every L1 file."""
    payloads = report.statement_payloads(summary.monthly_summary(L.orders_ledger(spark, sf_dir)))
    return payloads.select("account_id", "file_key", "payload_json")


def statement_notes(spark, sf_dir):
    """statements of the accepted L2 files; those with skipped rows carry
    a note."""
    monthly = summary.accepted_monthly_summary(_l2_classified(spark, sf_dir), L.L2_MAX_ROW_ERRORS)
    html = report.statement_html(monthly)
    note = F.regexp_extract("html", '<p class="note">([0-9]+) row', 1)
    return html.select("account_id", "file_key", F.contains("html", F.lit('class="note"')).alias("has_note"),
                       F.when(note == "", F.lit(0)).otherwise(note.try_cast("bigint")).cast("bigint").alias("skipped"),
                       F.regexp_count("html", F.lit("<tr><td>")).cast("bigint").alias("months"))


def merge_stored_summaries(spark, sf_dir):
    """A stored month state (orders before 1997) merged with the state of
    the orders since."""
    ledger = L.orders_ledger(spark, sf_dir)
    cut = F.lit("1997-01-01").cast("date")
    stored = stage(summary.monthly_state(ledger.filter(F.col("date") < cut)), "month-state")
    delta = summary.monthly_state(ledger.filter(F.col("date") >= cut))
    return summary.finish_monthly(summary.merge_states(stored, delta)).select(*MONTHLY_COLS)


K5_BUCKETS = 16
K5_ACCOUNT = 7


def account_summaries(spark, sf_dir):
    """K5: all month summaries written by account bucket, one account read."""
    monthly = summary.monthly_summary(L.orders_ledger(spark, sf_dir)).select(*MONTHLY_COLS)
    path = state.write_by_account(monthly, scratch_path(spark, "summaries"), K5_BUCKETS)
    return state.read_account(spark, path, K5_ACCOUNT, K5_BUCKETS)


def outbox_after_delivery(spark, sf_dir):
    """Due statements after those of even files were acknowledged."""
    _, status, summaries = L.file_states(spark, sf_dir)
    accounts = L.account_registry(spark, sf_dir)
    due = report.outbox(status, summaries, accounts)
    marked = state.mark_delivered(summaries, due.filter(F.col("file_key") % 2 == 0).select("file_key"))
    return report.outbox(status, marked, accounts).select("file_key", "account_id", "email")


def summary_upsert(spark, sf_dir):
    old, new = L.summary_snapshots(spark, sf_dir)
    return state.upsert_summaries(old, new)


def latest_per_key(spark, sf_dir):
    e = L.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    current, changes = e.filter(F.col("ts") < cut), e.filter(F.col("ts") >= cut)
    latest = state.upsert(current, changes, ["user_id"], ["ts", "event_id"])
    return latest.select("user_id", "event_id", "event_type", "value")


def file_keys(spark, sf_dir):
    c = L.table(spark, sf_dir, "customer")
    path = F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit(".csv"))
    return c.select("c_custkey", file_key(F.col("c_custkey").cast("string"), path).alias("file_key"))


def constraint_report(spark, sf_dir):
    raw, status, summaries, acc = L.flawed_tables(spark, sf_dir)
    return quality.constraint_report([
        (raw, {"ledger_id_missing": F.col("id").isNull() | (F.trim(F.col("id")) == ""),
               "ledger_date_missing": F.col("date").isNull() | (F.trim(F.col("date")) == "")},
         "ledger_file_date_repeats", ["file_key", "date"]),
        (status, {"status_not_in_enum": ~F.col("status").isin(*KNOWN_STATUSES) | F.col("status").isNull(),
                  "heartbeat_null": F.col("heartbeat_at").isNull()},
         "status_key_duplicates", ["file_key"]),
        (summaries, {"email_sent_null": F.col("email_sent").isNull()}, "summary_key_duplicates", ["file_key"]),
        (acc, {"email_null": F.col("email").isNull()}, "account_key_duplicates", ["account_id"]),
    ])


QUERIES: dict[str, Query] = {
    "monthly_summary": monthly_summary,
    "account_totals": account_totals,
    "yearly_counts": yearly_counts,
    "credit_debit_totals": credit_debit_totals,
    "ledger_rollup": ledger_rollup,
    "ledger_with_account": ledger_with_account,
    "orphan_accounts": orphan_accounts,
    "ledger_valid_rows": ledger_valid_rows,
    "row_error_details": row_error_details,
    "file_status": file_status,
    "monthly_summary_accepted": monthly_summary_accepted,
    "checkpoint_snapshots": checkpoint_snapshots,
    "resume_from_checkpoint": resume_from_checkpoint,
    "merge_partial_summaries": merge_partial_summaries,
    "latest_per_key": latest_per_key,
    "summary_upsert": summary_upsert,
    "statement_payloads": statement_payloads,
    "file_keys": file_keys,
    "file_triage": file_triage,
    "claimed_files": claimed_files,
    "state_after_compaction": state_after_compaction,
    "unprocessed_files": unprocessed_files,
    "pending_statements": pending_statements,
    "constraint_report": constraint_report,
    "statement_rows": statement_rows,
    "summary_json": summary_json,
    "summary_roundtrip": summary_roundtrip,
    "statement_html": statement_html,
    "statement_payload_json": statement_payload_json,
    "statement_notes": statement_notes,
    "merge_stored_summaries": merge_stored_summaries,
    "account_summaries": account_summaries,
    "outbox_after_delivery": outbox_after_delivery,
    "csv_file_status": csv_file_status,
    "manifest_files": manifest_files,
    "stream_file_status": stream_file_status,
    "stream_account_monthly": stream_account_monthly,
    "stream_running_months": stream_running_months,
}

