"""Continuously updated account months (T3 without the per-file threshold).

A stream of typed ledger rows is aggregated with state: one row of counts and
exact sums per (account, year, month) lives in Spark's state store (RocksDB, so
it may exceed the executors' memory) and is checkpointed with the stream. Update
mode emits the rows that a micro-batch changed; they are written as version
``batch_id`` of a keyed table. Amounts are decimals, so the state is the same in
whatever order and batches the rows arrive.

A query that was killed goes on from its checkpoint. A batch that was written but
not committed is computed again from the same state and replaces its version.
Every ``fold_every`` batches the latest row of every key is written as one
table, and what it replaces is removed one fold later: a reader opens the last
fold and the versions since, however long the stream has run.

Rows of files that turn out to be unusable are counted too: use
``LedgerIntake`` where a threshold per file applies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state, summary
from ..session import remove_path, scratch_path

KEYS = ("account_id",)
MONTH_KEYS = [*KEYS, "year", "month_num"]
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class RunningMonths:
    """``ledger`` is a streaming DataFrame with ``account_id, date, amount``
    (DECIMAL). ``out_dir`` holds the table, ``checkpoint_dir`` offsets and state.
    ``state_partitions`` is fixed by the first start of a checkpoint: choose it
    for the number of (account, month) pairs, a million or so to each."""

    def __init__(self, spark: SparkSession, ledger: DataFrame, out_dir: str, checkpoint_dir: str | None = None,
                 state_partitions: int | None = None, fold_every: int = 50,
                 after_write: Callable[[int], None] | None = None):
        self.spark, self.ledger = spark, ledger
        self.out_dir = out_dir.rstrip("/")
        self.checkpoint_dir = checkpoint_dir or scratch_path(spark, "running-checkpoint")
        self.state_partitions, self.fold_every, self.after_write = state_partitions, fold_every, after_write

    def _settings(self) -> dict[str, str]:
        more = {"spark.sql.shuffle.partitions": str(self.state_partitions)} if self.state_partitions else {}
        return {**ROCKSDB, **more}

    def start(self, **trigger):
        """Start the query (by default: what is available now, then stop)."""
        months = summary.monthly_state(self.ledger, keys=KEYS)
        old = {k: self.spark.conf.get(k, None) for k in self._settings()}
        try:
            for k, v in self._settings().items():  # a query keeps the settings of its start
                self.spark.conf.set(k, v)
            return (months.writeStream.outputMode("update").foreachBatch(self._write)
                    .option("checkpointLocation", self.checkpoint_dir)
                    .trigger(**(trigger or {"availableNow": True})).start())
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def run_available(self) -> None:
        self.start().awaitTermination()

    def _write(self, changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        state.write_snapshot(changed.withColumn("batch_id", F.lit(batch_id).cast("bigint")), f"{self.out_dir}/changes",
                             batch_id)
        if batch_id % self.fold_every == self.fold_every - 1:
            self._fold(spark, batch_id)
        if self.after_write:
            self.after_write(batch_id)

    def _fold(self, spark: SparkSession, batch_id: int) -> None:
        folds = [v for v in state.snapshot_versions(spark, f"{self.out_dir}/folded") if v < batch_id]
        state.write_snapshot(self._latest(spark, batch_id), f"{self.out_dir}/folded", batch_id)
        # Readers of the fold before may still be at work: one fold is kept.
        for table, end in (("changes", max(folds, default=-1)), ("folded", max(folds, default=-1) - 1)):
            for v in state.snapshot_versions(spark, f"{self.out_dir}/{table}", committed_only=False):
                if v <= end:
                    remove_path(spark, f"{self.out_dir}/{table}/v={v}")

    def _latest(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        inside = lambda v: upto is None or v <= upto
        folds = state.snapshot_versions(spark, f"{self.out_dir}/folded", keep=lambda v: upto is None or v < upto)
        last = max(folds, default=-1)
        paths = [f"{self.out_dir}/folded/v={last}"] if folds else []
        paths += [f"{self.out_dir}/changes/v={v}" for v in
                  state.snapshot_versions(spark, f"{self.out_dir}/changes", keep=lambda v: v > last and inside(v))]
        return state.latest_per_key(spark.read.parquet(*paths), MONTH_KEYS, ["batch_id"])

    # -- readers ------------------------------------------------------------
    def month_state(self) -> DataFrame:
        """The latest state row of every (account, year, month)."""
        return self._latest(self.spark).drop("batch_id")

    def account_monthly_summary(self) -> DataFrame:
        return summary.finish_monthly(self.month_state(), keys=KEYS)
