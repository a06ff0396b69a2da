"""End-to-end runs with state snapshots: triage, recompute, statements, delivery."""
import datetime as dt
import json


from tally.plans.run import acknowledge, compact, committed_version, read_state, run_batch

HEADER = "id,date,transaction\n"


def test_two_runs_are_idempotent(spark, write_csv, tmp_path):
    base, paths = write_csv({
        ("A", "1.csv"): HEADER + "41,12/10/2022,+88.5\n42,30/10/2022,-13.25\n",
        ("A", "2.csv"): HEADER + "1,x,+1\n2,y,+1\n3,z,+1\n4,w,+1\n",
        ("B", "1.csv"): HEADER + "1,01/01/2025,+3\n",
        ("C", "1.csv"): "id,when,transaction\n1,01/01/2025,+3\n",
        ("MISSING", "1.csv"): HEADER + "1,01/01/2025,+3\n",
    })
    accounts = spark.createDataFrame([("A", "dock@harbor.example"), ("B", "not-an-email"), ("C", "c@example.com")],
                                     "account_id string, email string")
    state_dir = str(tmp_path / "state")
    now = dt.datetime(2026, 8, 1)

    r1 = run_batch(spark, paths, state_dir, accounts, now, max_errors=3)
    assert r1.version == 1
    assert sorted(r["action"] for r in r1.triage.collect()) == \
        ["invalid_email", "missing_account", "process", "process", "process"]
    st = {r["file_path"].rsplit("/", 2)[1] + "/" + r["file_path"].rsplit("/", 1)[1]: r["status"]
          for r in r1.file_status.collect()}
    assert st == {"account_id=A/1.csv": "done", "account_id=A/2.csv": "to_review",
                  }  # B's account has no usable address: not touched; C's header: no state
    assert [(r["file_path"].rsplit("/", 2)[1], r["reject_reason"]) for r in r1.rejected.collect()] == [
        ("account_id=C", 'parser: missing required column "date"')]
    stm = r1.statements.collect()
    assert [(r["account_id"], r["to"]) for r in stm] == [("A", "dock@harbor.example")]
    payload = json.loads(stm[0]["payload_json"])
    assert payload["TotalBalance"] == 75.25 and payload["InvalidRows"] == 0
    assert [(m["Month"], m["Year"], m["TxnCount"]) for m in payload["ByYear"]] == [("October", 2022, 2)]
    assert "October 2022" in stm[0]["html"] and "+$88.50" in stm[0]["html"]
    assert "could not be read" not in stm[0]["html"]  # no skipped-rows note when nothing was skipped

    acknowledge(spark, state_dir, r1.statements.select("file_key"), now)

    r2 = run_batch(spark, paths, state_dir, accounts, now + dt.timedelta(hours=1), max_errors=3)
    assert r2.version == 3
    actions = {r["file_path"].rsplit("/", 2)[1] + "/" + r["file_path"].rsplit("/", 1)[1]: r["action"]
               for r in r2.triage.collect()}
    assert actions == {"account_id=A/1.csv": "skip", "account_id=A/2.csv": "resume",
                       "account_id=B/1.csv": "invalid_email", "account_id=C/1.csv": "process",
                       "account_id=MISSING/1.csv": "missing_account"}
    assert r2.statements.count() == 0  # A/1 delivered
    sent = {r["account_id"]: r["email_sent"] for r in r2.file_summary.collect()}
    assert sent == {"A": True}
    assert r2.file_status.count() == 2 and r2.file_summary.count() == 1

    # versions hold what changed; a compaction gives the same tables
    sizes = [spark.read.parquet(f"{state_dir}/file_status/v={v}").count() for v in (1, 2, 3)]
    assert sizes == [2, 0, 1]
    before = sorted(map(str, read_state(spark, state_dir, "file_summary").drop("version").collect()))
    assert compact(spark, state_dir) == 4
    assert sorted(map(str, read_state(spark, state_dir, "file_summary").drop("version").collect())) == before
    assert read_state(spark, state_dir, "file_status").count() == 2


def test_bounded_batches_give_the_same_and_leave_no_folder(spark, write_csv, tmp_path):
    from tally.session import _scratch
    base, paths = write_csv({(a, f"{n}.csv"): HEADER + f"{n},01/0{n + 1}/2021,+{n}.5\n" + ("x,y,z\n" if n == 2 else "")
                             for a in "AB" for n in range(4)})
    accounts = spark.createDataFrame([("A", "a@x.io"), ("B", "Ana <b@x.io>")], "account_id string, email string")
    outs = []
    for k, size in enumerate((100, 3, 1)):
        before = len(_scratch)
        r = run_batch(spark, base, str(tmp_path / f"s{k}"), accounts, dt.datetime(2026, 8, 1), batch_files=size)
        assert len(_scratch) == before + 1  # the triage table only, which the result refers to
        outs.append([sorted(map(str, df.collect())) for df in (r.triage, r.file_status, r.file_summary, r.statements)])
    assert outs[0] == outs[1] == outs[2] and len(outs[0][3]) == 8


def test_uncommitted_versions_are_ignored(spark, write_csv, tmp_path):
    import os
    base, paths = write_csv({("A", "1.csv"): HEADER + "41,12/10/2022,+88.5\n"})
    accounts = spark.createDataFrame([("A", "dock@harbor.example")], "account_id string, email string")
    state_dir = str(tmp_path / "state")
    r1 = run_batch(spark, paths, state_dir, accounts, dt.datetime(2026, 8, 1))
    assert committed_version(spark, state_dir) == 1
    # a run that died after writing only file_status v=2 (and a stray partial folder)
    r1.file_status.limit(0).write.parquet(os.path.join(state_dir, "file_status", "v=2"))
    os.makedirs(os.path.join(state_dir, "file_summary", "v=7"))
    assert committed_version(spark, state_dir) == 1
    r2 = run_batch(spark, paths, state_dir, accounts, dt.datetime(2026, 8, 2))
    assert r2.version == 2
    assert {r["action"] for r in r2.triage.collect()} == {"send_only"}
    assert r2.statements.count() == 1  # still due: stored summary, not delivered


def test_command_line_run(spark, write_csv, tmp_path):
    from tally.__main__ import main
    base, _ = write_csv({("A", "1.csv"): HEADER + "41,12/10/2022,+88.5\n", ("B", "1.csv"): HEADER + "1,x,+1\n"})
    acc = tmp_path / "accounts.csv"
    acc.write_text("account_id,email\nA,old@example.com\nB,b@example.com\nA,a@example.com\n")
    args = ["--ledgers", base, "--state", str(tmp_path / "st"), "--accounts", str(acc),
            "--outbox", str(tmp_path / "out"), "--now", "2026-08-01T00:00:00"]
    rep = main(args)
    assert rep["files"] == 2 and rep["actions"] == {"process": 2} and rep["rejected"] == 0
    out = spark.read.parquet(rep["outbox"]).collect()
    assert sorted(r["to"] for r in out) == ["a@example.com", "b@example.com"]
    html = {r["account_id"]: r["html"] for r in out}
    assert "1 row(s)" in html["B"] and "row(s)" not in html["A"]
    assert json.loads([r for r in out if r["account_id"] == "B"][0]["payload_json"]) == \
        {"TotalBalance": 0.0, "ByYear": [], "InvalidRows": 1}
    rep2 = main(args[:-1] + ["2026-08-01T01:00:00"])
    assert rep2["actions"] == {"send_only": 2}


def test_run_with_only_rejected_files(spark, write_csv, tmp_path):
    base, paths = write_csv({("A", "bad.csv"): "id,when,transaction\n1,01/01/2025,+3\n"})
    accounts = spark.createDataFrame([("A", "a@example.com")], "account_id string, email string")
    r = run_batch(spark, paths, str(tmp_path / "s"), accounts, dt.datetime(2026, 8, 1))
    assert r.file_status.count() == 0 and r.rejected.count() == 1
    assert r.statements.count() == 0
