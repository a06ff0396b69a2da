"""Command line: one batch run over a folder of ledger files.

    python -m tally --ledgers s3a://b/ledgers --state s3a://b/state \\
        --accounts s3a://b/accounts.csv --outbox s3a://b/outbox [--max-row-errors 10]

(or the ``tally`` console script once the package is installed).

``--accounts`` is a CSV with ``account_id,email``; its rows are upserted
(last write wins per account) into ``<state>/accounts``. Ledger files live
under ``account_id=<id>/`` folders. Due statements are written to
``<outbox>/v=<run version>``. Ledgers, state and outbox may lie in any file
system that Spark reaches.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.predicates import DEFAULT_HEARTBEAT_TIMEOUT_SECS, DEFAULT_MAX_ROW_ERRORS
from .operators import state
from .plans.run import run_batch
from .session import apply_defaults, ensure_checkpoint_dir, release_scratch


def upsert_accounts(spark: SparkSession, state_dir: str, accounts_csv: str, version_stamp: int):
    """K1: merge the account list into ``<state>/accounts`` (last write wins)."""
    base = f"{state_dir}/accounts"
    # version: the run stamp, then the record order (a later line of the same
    # file wins), assigned on the scan; an account keeps its first stamp as
    # ``created_at``
    incoming = (spark.read.option("header", True).csv(accounts_csv)
                .select(F.trim("account_id").alias("account_id"), F.trim("email").alias("email"),
                        F.lit(version_stamp).cast("bigint").alias("v"),
                        F.monotonically_increasing_id().alias("seq"),
                        F.timestamp_micros(F.lit(version_stamp)).cast("timestamp_ntz").alias("created_at")))
    current = state.latest_snapshot_path(spark, base)
    merged = state.latest_per_key(incoming, ["account_id"], ["v", "seq"]) if current is None else \
        state.upsert_created(spark.read.parquet(current), incoming, ["account_id"], ["v", "seq"])
    versions = state.snapshot_versions(spark, base)
    path = state.write_snapshot(merged, base, (versions[-1] if versions else 0) + 1)
    return spark.read.parquet(path)


def main(argv: list[str] | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="tally")
    ap.add_argument("--ledgers", required=True, help="folder of ledger files under account_id=<id>/ folders")
    ap.add_argument("--state", required=True, help="folder of the versioned state tables")
    ap.add_argument("--accounts", required=True, help="CSV with account_id,email (upserted, last line wins)")
    ap.add_argument("--outbox", required=True, help="folder for the due statements of this run")
    ap.add_argument("--suffix", default=".csv", help="ledger file name suffix (default .csv)")
    ap.add_argument("--multi-line", action="store_true", help="read quoted new lines (a file is then one task)")
    ap.add_argument("--max-row-errors", type=int, default=DEFAULT_MAX_ROW_ERRORS,
                    help="bad rows tolerated per file; more sends the file to review")
    ap.add_argument("--heartbeat-timeout", type=int, default=DEFAULT_HEARTBEAT_TIMEOUT_SECS,
                    help="seconds after which a processing lease is stale")
    ap.add_argument("--now", default=None, help="ISO timestamp; defaults to the current UTC time")
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName("tally").getOrCreate()
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    now = dt.datetime.fromisoformat(a.now) if a.now else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

    accounts = upsert_accounts(spark, a.state, a.accounts, int(now.timestamp() * 1e6))
    r = run_batch(spark, a.ledgers, a.state, accounts.select("account_id", "email"), now,
                  a.max_row_errors, a.heartbeat_timeout, multi_line=a.multi_line, suffix=a.suffix)
    out = f"{a.outbox.rstrip('/')}/v={r.version}"
    r.statements.write.mode("overwrite").parquet(out)
    counts = {row["action"]: row["n"] for row in r.triage.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    report = {"version": r.version, "files": sum(counts.values()), "actions": counts,
              "rejected": r.rejected.count(), "outbox": out}
    release_scratch(spark)
    print(json.dumps(report))
    return report


def cli() -> int:
    """Console entry point (exit status 0 on success)."""
    main()
    return 0


if __name__ == "__main__":
    cli()
