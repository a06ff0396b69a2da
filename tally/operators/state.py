"""Keyed state tables: upserts, lookups and file triage.

Tables are ordinary DataFrames. An "upsert" produces the next snapshot of a
table; the caller writes it to a new location (never over a path that is
being read). Everything is a join or an aggregate on the key, so the work is
spread by key across the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import (STATUS_DONE, STATUS_FAILED, STATUS_PROCESSING, STATUS_TO_REVIEW,
                                    lease_is_fresh)

# --- fixed values -----------------------------------------------------------
# Triage actions for a file, decided top to bottom.
ACTION_SKIP = "skip"                                # statement already delivered
ACTION_SEND_ONLY = "send_only"                      # finished, summary stored, not delivered
ACTION_PROCESS = "process"                          # never seen
ACTION_ALREADY_PROCESSED = "error_already_processed"  # done but no summary stored
ACTION_LOCKED = "locked"                            # another worker holds a fresh lease
ACTION_RESUME = "resume"                            # stale lease, failed or to_review
# ---------------------------------------------------------------------------


def latest_per_key(df: DataFrame, key_cols: Sequence[str], version_cols: Sequence[str]) -> DataFrame:
    """The row with the greatest version of every key (last write wins).

    ``max`` over a struct led by the version columns is a partial aggregate:
    each task keeps one candidate per key before the shuffle, so a key that
    holds a third of all rows costs no more than any other key.
    """
    payload = [c for c in df.columns if c not in key_cols and c not in version_cols]
    best = F.max(F.struct(*[F.col(c) for c in version_cols], *[F.col(c) for c in payload])).alias("_best")
    return df.groupBy(*key_cols).agg(best).select(
        *key_cols, *[F.col(f"_best.{c}").alias(c) for c in [*version_cols, *payload]])


def upsert(current: DataFrame, changes: DataFrame, key_cols: Sequence[str],
           version_cols: Sequence[str]) -> DataFrame:
    """Insert-or-replace; ``changes`` win on equal versions only if later."""
    return latest_per_key(current.unionByName(changes), key_cols, version_cols)


def upsert_created(current: DataFrame, changes: DataFrame, key_cols: Sequence[str],
                   version_cols: Sequence[str]) -> DataFrame:
    """K1: :func:`upsert` that keeps the earliest ``created_at`` of a key."""
    rows = current.unionByName(changes)
    payload = [c for c in rows.columns if c not in (*key_cols, *version_cols, "created_at")]
    best = F.max(F.struct(*version_cols, *payload)).alias("_best")
    return rows.groupBy(*key_cols).agg(best, F.min("created_at").alias("created_at")).select(
        *key_cols, *[F.col(f"_best.{c}").alias(c) for c in [*version_cols, *payload]], "created_at")


def upsert_summaries(old: DataFrame, new: DataFrame, key: str = "file_key") -> DataFrame:
    """K3: next ``file_summary`` snapshot.

    A delivered summary (``email_sent``) is left alone; otherwise the new
    summary replaces the old one, and a key without a new summary keeps the
    old row. ``created_at`` (when present) is kept from the old row.
    Both inputs have one row per key, so the full outer join has no hot key.
    """
    value_cols = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    keep_old = F.coalesce(F.col("o.email_sent"), F.lit(False)) | F.col(f"n.{key}").isNull()
    cols = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)]
    for c in value_cols:
        if c == "created_at":
            cols.append(F.coalesce(F.col("o.created_at"), F.col("n.created_at")).alias(c))
        else:
            cols.append(F.when(keep_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    cols.append(F.when(keep_old, F.lit("old")).otherwise(F.lit("new")).alias("source"))
    return joined.select(*cols)


def mark_delivered(summaries: DataFrame, acknowledged: DataFrame, now=None, key: str = "file_key") -> DataFrame:
    """Set ``email_sent`` for the keys whose delivery was acknowledged."""
    ack = acknowledged.select(key).distinct().withColumn("_ack", F.lit(True))
    out = summaries.join(ack, key, "left").withColumn(
        "email_sent", F.coalesce(F.col("email_sent"), F.lit(False)) | F.coalesce(F.col("_ack"), F.lit(False)))
    if now is not None and "updated_at" in out.columns:
        out = out.withColumn("updated_at", F.when(F.col("_ack"), F.lit(now)).otherwise(F.col("updated_at")))
    return out.drop("_ack")


def triage(manifest: DataFrame, status: DataFrame, summaries: DataFrame, now, timeout_secs: int,
           key: str = "file_key") -> DataFrame:
    """Decide what to do with every file of the manifest.

    ``status`` has ``file_key, status, heartbeat_at``; ``summaries`` has
    ``file_key, email_sent``. One row per key on each side.
    """
    st = status.select(key, "status", "heartbeat_at")
    sm = summaries.select(key, F.col("email_sent"), F.lit(True).alias("_has_summary"))
    j = manifest.join(st, key, "left").join(sm, key, "left")
    has_summary = F.coalesce(F.col("_has_summary"), F.lit(False))
    action = (
        F.when(F.coalesce(F.col("email_sent"), F.lit(False)), F.lit(ACTION_SKIP))
        .when(has_summary & (F.col("status") == STATUS_DONE), F.lit(ACTION_SEND_ONLY))
        .when(F.col("status").isNull(), F.lit(ACTION_PROCESS))
        .when(F.col("status") == STATUS_DONE, F.lit(ACTION_ALREADY_PROCESSED))
        .when(lease_is_fresh("status", "heartbeat_at", now, timeout_secs), F.lit(ACTION_LOCKED))
        .otherwise(F.lit(ACTION_RESUME))
    )
    return j.withColumn("action", action).drop("_has_summary")


def keep_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys`` (a semi join).

    Written as an inner join with the distinct keys: Catalyst pushes a
    ``left_semi``/``left_anti`` join below an aggregate on the same key,
    which would move the aggregate's input rows (ledger rows) through the
    join instead of its map-side combined output, and a hot key would reach
    one reducer whole.
    """
    cols = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*cols).distinct(), cols, "inner")


def drop_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys`` (an anti join), written as
    a left outer join and a NULL test for the reason given in
    :func:`keep_keys`."""
    cols = [on] if isinstance(on, str) else list(on)
    marked = keys.select(*cols).distinct().withColumn("_present", F.lit(True))
    return df.join(marked, cols, "left").filter(F.col("_present").isNull()).drop("_present")


def unprocessed(manifest: DataFrame, status: DataFrame, key: str = "file_key") -> DataFrame:
    """Files of the manifest that are not finished."""
    return drop_keys(manifest, status.filter(F.col("status") == STATUS_DONE), key)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent row (see :func:`drop_keys`)."""
    return drop_keys(child, parent, key)


def with_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Inner lookup; children without a parent drop out (see ``orphans``).

    AQE turns this into a broadcast join at run time only when the parent
    side is measured under the broadcast threshold; otherwise it stays a
    shuffle join, and skewed child keys are split by the skew-join rule.
    """
    return child.join(parent, key, "inner")


def account_bucket(account_col, buckets: int):
    """K5 layout: a stable hash bucket of the account, to ``partitionBy`` a
    summary table so that reading one account's summaries lists and scans a
    single bucket folder (partition pruning), without one folder per account."""
    c = F.col(account_col) if isinstance(account_col, str) else account_col
    return F.pmod(F.xxhash64(c.cast("string")), F.lit(buckets)).cast("int")


def write_by_account(df: DataFrame, path: str, buckets: int) -> str:
    """K5: a summary table laid out by account bucket (folder ``bucket=<n>``)."""
    df.withColumn("bucket", account_bucket("account_id", buckets)).write.mode("overwrite").partitionBy(
        "bucket").parquet(path)
    return path


def read_account(spark, path: str, account_id, buckets: int) -> DataFrame:
    """K5: the summaries of one account. The bucket is a constant, so one
    folder is listed and scanned."""
    account = F.lit(account_id)
    return (spark.read.parquet(path)
            .filter((F.col("bucket") == account_bucket(account, buckets)) & (F.col("account_id") == account))
            .drop("bucket"))


def write_snapshot(df: DataFrame, base: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Write the next version of a keyed table to ``<base>/v=<version>``.

    A new snapshot never overwrites the folder it was computed from;
    re-writing the same version (a retried job) replaces it whole.
    """
    path = f"{base.rstrip('/')}/v={int(version)}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def snapshot_versions(spark, base: str, committed_only: bool = True, keep=lambda version: True) -> list[int]:
    """Versions ``v=<n>`` under ``base`` that ``keep`` takes (a listing, no
    scan). With ``committed_only`` a version counts only when its write finished
    (the ``_SUCCESS`` marker of the job commit), so a folder left by a failed or
    killed job is never read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit() and keep(int(name[2:])):
            if not committed_only or fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def latest_snapshot_path(spark, base: str) -> str | None:
    """Folder of the highest committed ``v=<n>`` version under ``base``."""
    versions = snapshot_versions(spark, base)
    return f"{base.rstrip('/')}/v={versions[-1]}" if versions else None


KNOWN_STATUSES = (STATUS_PROCESSING, STATUS_DONE, STATUS_FAILED, STATUS_TO_REVIEW)
