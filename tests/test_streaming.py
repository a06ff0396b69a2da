"""Structured Streaming intake."""

from tally.operators import summary, validate
from tally.sources.csv_ledger import read_ledger_csv
from tally.streaming.intake import LedgerIntake

HEADER = "id,date,transaction\n"


def _rows(out):
    return sorted(tuple(r) for r in out.collect())


def test_stream_once_per_file_replay_and_batch_equality(spark, write_csv, tmp_path):
    files = {("A", "1.csv"): HEADER + "1,01/01/2025,+10\n2,05/01/2025,-4\n3,bad,+1\n",
             ("B", "1.csv"): HEADER + "1,01/02/2025,+7\n2,x,+1\n3,y,+1\n",  # 2 errors > max 1 -> to_review
             ("C", "1.csv"): "Transaction,ID,Date\n+2,1,03/03/2025\n"}
    base, paths = write_csv(files)
    out = str(tmp_path / "out")
    intake = LedgerIntake(spark, base, out, checkpoint_dir=str(tmp_path / "ckpt"), max_errors=1)
    q = intake.run_available()
    assert q.lastProgress is not None
    st = {r["account_id"]: (r["status"], r["invalid_rows"]) for r in intake.file_status().collect()}
    assert st == {"A": ("done", 1), "B": ("to_review", 2), "C": ("done", 0)}

    # The stream's accepted monthly summary equals the batch computation
    raw, _ = read_ledger_csv(spark, paths)
    c = validate.classify(raw)
    outcome = validate.file_outcome(c, validate.row_error_details(c, "blk", ["blk", "mid"], 1), 1)
    want = validate.accepted(summary.monthly_summary(validate.valid_rows(c)), outcome)
    got = intake.monthly_summary()
    cols = sorted(want.columns)
    assert _rows(got.select(*cols)) == _rows(want.select(*cols))

    # A second run without new files emits no batch; a new file is processed alone
    before = len(list((tmp_path / "out" / "file_status").glob("batch_id=*")))
    intake.run_available()
    assert len(list((tmp_path / "out" / "file_status").glob("batch_id=*"))) == before
    write_csv({("A", "2.csv"): HEADER + "9,01/01/2026,+1\n"})
    intake.run_available()
    assert len(list((tmp_path / "out" / "file_status").glob("batch_id=*"))) == before + 1
    assert intake.file_status().count() == 4

    # Replaying a batch replaces its output, totals unchanged
    acc_before = _rows(intake.account_monthly_summary())
    batch = spark.createDataFrame([("file:" + p,) for p in paths], "path string")
    intake.process_batch(batch, 0)
    intake.process_batch(batch, 0)
    assert _rows(intake.account_monthly_summary()) == acc_before
    acc = {(r["account_id"], r["year"], r["month_num"]): r["txn_count"] for r in intake.account_monthly_summary().collect()}
    assert acc == {("A", 2025, 1): 2, ("A", 2026, 1): 1, ("C", 2025, 3): 1}


def test_file_totals_from_month_states(spark, write_csv, tmp_path):
    base, _ = write_csv({("A", "1.csv"): HEADER + "1,01/01/2025,+10\n2,05/02/2025,-4\n"})
    intake = LedgerIntake(spark, base, str(tmp_path / "o"), checkpoint_dir=str(tmp_path / "c"), max_errors=1)
    intake.run_available()
    t = intake.file_totals().first()
    assert (t["total_balance"], t["txn_count"]) == (6.0, 2)


def test_processed_files_can_be_archived(spark, write_csv, tmp_path):
    base, paths = write_csv({("A", "1.csv"): HEADER + "1,01/01/2025,+10\n"})
    archive = tmp_path / "archive"
    intake = LedgerIntake(spark, base, str(tmp_path / "o"), checkpoint_dir=str(tmp_path / "c"),
                          archive_dir=str(archive))
    intake.run_available()
    assert intake.file_status().count() == 1
    # files of a batch are archived once the batch is committed to the
    # source, i.e. when a later batch runs; the move itself is asynchronous
    write_csv({("A", "2.csv"): HEADER + "2,01/02/2025,+5\n"})
    intake.run_available()
    import time
    for _ in range(150):  # the move is asynchronous; allow up to 30 s on a busy machine
        if list(archive.rglob("*.csv")):
            break
        time.sleep(0.2)
    assert list(archive.rglob("1.csv"))
    assert intake.file_status().count() == 2


def test_micro_batches_of_the_queries_are_bounded(spark, tmp_path, monkeypatch):
    """Two micro-batches while they are small, then more, with the same rows."""
    import datetime as dt
    from tally.plans import catalog
    rows = [(i, dt.datetime(2024, 3, 5), i % 8, "view", 2.5, None) for i in range(1, 25)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    for most in (catalog.BATCH_FILES, 3):
        monkeypatch.setattr(catalog, "BATCH_FILES", most)
        intake = catalog._intake(spark, str(tmp_path))
        sizes = sorted(r["count"] for r in intake.table("file_status").groupBy("batch_id").count().collect())
        seen.append((sizes, _rows(intake.account_monthly_summary())))
    assert [sizes for sizes, _ in seen] == [[4, 4], [2, 3, 3]]
    assert seen[0][1] == seen[1][1] and sum(r[4] for r in seen[0][1]) == 24
