"""The stateful stream of account months: recovery, replay, folding."""
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tally.operators import summary
from tally.streaming.running import KEYS, RunningMonths

SCHEMA = "account_id string, date date, amount decimal(18,2)"


def _part(spark, k, n=40):
    """File ``k``: accounts and months of all files overlap; account 0 is hot."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "0").otherwise((F.col("id") % 5).cast("string")).alias("account_id"),
        F.make_date(F.lit(2024), (F.col("id") % 12 + 1).cast("int"), F.lit(k + 1)).alias("date"),
        ((F.col("id") * 7 + k - 20) * F.lit(1.01)).cast("decimal(18,2)").alias("amount"))


def _add(spark, folder, k):
    _part(spark, k).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def _rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def _crash(at):
    def fail(batch_id):
        if batch_id == at:
            raise RuntimeError("killed")
    return fail


@pytest.mark.parametrize("fold_every", [2, 50])
def test_killed_and_restarted_between_batches_equals_the_batch_result(spark, tmp_path, fold_every):
    folder, where = str(tmp_path / "in"), dict(out_dir=str(tmp_path / "out"), checkpoint_dir=str(tmp_path / "ckpt"),
                                               state_partitions=2, fold_every=fold_every)
    for k in range(5):
        _add(spark, folder, k)
    for at in (1, 3):  # killed after the batch was written, before it was committed
        with pytest.raises(StreamingQueryException):
            RunningMonths(spark, _stream(spark, folder), **where, after_write=_crash(at)).run_available()
    months = RunningMonths(spark, _stream(spark, folder), **where)
    months.run_available()
    want = summary.monthly_summary(spark.read.parquet(folder), keys=KEYS)
    assert _rows(months.account_monthly_summary()) == _rows(want)
    assert len(_rows(want)) > 12
    # the state goes on, and only changed months are written
    _add(spark, folder, 5)
    months.run_available()
    assert _rows(months.account_monthly_summary()) == _rows(summary.monthly_summary(spark.read.parquet(folder), keys=KEYS))
    months.run_available()  # nothing new
    assert _rows(months.account_monthly_summary()) == _rows(summary.monthly_summary(spark.read.parquet(folder), keys=KEYS))
    providers = [d for d, _, f in os.walk(tmp_path / "ckpt" / "state") if any(x.endswith((".changelog", ".zip")) for x in f)]
    assert providers  # RocksDB's changelogs, not the in-memory store's deltas


def test_a_reader_opens_a_bounded_number_of_versions(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(10):
        _add(spark, folder, k)
    months = RunningMonths(spark, _stream(spark, folder), out, str(tmp_path / "ckpt"), state_partitions=1, fold_every=3)
    months.run_available()
    assert len(os.listdir(f"{out}/changes")) <= 2 * 3 and len(os.listdir(f"{out}/folded")) <= 2
    assert _rows(months.account_monthly_summary()) == _rows(summary.monthly_summary(spark.read.parquet(folder), keys=KEYS))
