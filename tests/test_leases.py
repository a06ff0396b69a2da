"""Runs that overlap: claims, leases, take-over, fencing, compaction beside them."""
import datetime as dt
import os
import threading

import pytest

from tally.plans import run as run_module
from tally.plans.run import acknowledge, claim_files, compact, process_claim, read_state, run_batch, vacuum
from tally.plans.statestore import (Heartbeat, compaction, create_once, running_clock, snapshot, take_version,
                                    write_state)

HEADER = "id,date,transaction\n"
NOW = dt.datetime(2026, 8, 1)


def later(seconds):
    return NOW + dt.timedelta(seconds=seconds)


def _files(write_csv, n, accounts="AB"):
    return write_csv({(a, f"{i}.csv"): HEADER + f"{i},01/0{i % 9 + 1}/2021,+{i}.5\n" for a in accounts for i in range(n)})


@pytest.fixture()
def accounts(spark):
    return spark.createDataFrame([("A", "a@x.io"), ("B", "b@x.io")], "account_id string, email string")


def _actions(triage):
    return sorted(r["action"] for r in triage.collect())


def _keys(df):
    return sorted(r["file_key"] for r in df.collect())


def test_one_of_many_creates_a_file(spark, tmp_path):
    name, won = str(tmp_path / "log" / "1"), []
    threads = [threading.Thread(target=lambda k=k: won.append((create_once(spark, name, f"run {k}"), k))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [k for ok, k in won if ok]
    assert len(won) == 8 and len(winners) == 1
    assert (tmp_path / "log" / "1").read_text() == f"run {winners[0]}"
    assert sorted(x for x in os.listdir(tmp_path / "log") if not x.endswith(".crc")) == ["1"]


def test_interleaved_runs_process_each_file_once(spark, write_csv, accounts, tmp_path):
    base, paths = _files(write_csv, 3)
    state = str(tmp_path / "state")
    a = claim_files(spark, paths[:4], state, accounts, NOW)
    b = claim_files(spark, base, state, accounts, later(5))
    assert (a.version, b.version) == (1, 2)
    assert _actions(b.triage) == ["locked"] * 4 + ["process"] * 2
    assert not set(_keys(a.files)) & set(_keys(b.files)) and a.files.count() + b.files.count() == 6
    assert {r["status"] for r in read_state(spark, state, "file_status").collect()} == {"processing"}
    rb = process_claim(spark, b)
    assert sorted(r["status"] for r in rb.file_status.collect()) == ["done"] * 2 + ["processing"] * 4
    ra = process_claim(spark, a)
    rows = ra.file_status.collect()
    assert len(rows) == 6 and {r["status"] for r in rows} == {"done"}
    assert {r["file_key"]: r["version"] for r in rows} == {**{k: 1 for k in _keys(a.files)}, **{k: 2 for k in _keys(b.files)}}
    assert ra.file_summary.count() == 6
    assert _actions(run_batch(spark, base, state, accounts, later(9)).triage) == ["send_only"] * 6


def test_runs_that_claim_at_the_same_time_share_the_files(spark, write_csv, accounts, tmp_path, monkeypatch):
    """All runs have made their triage when the first of them takes a version."""
    base, paths = _files(write_csv, 4)
    state, n = str(tmp_path / "state"), 3
    barrier, first = threading.Barrier(n), threading.local()

    def together(*args, **kwargs):
        if not getattr(first, "met", False):
            first.met = True
            barrier.wait(timeout=120)
        return take_version(*args, **kwargs)

    monkeypatch.setattr(run_module, "take_version", together)
    claims, results, faults = [], [], []

    def one(k):
        try:
            claim = claim_files(spark, base if k else paths[:5], state, accounts, later(k / 10), timeout_secs=600)
            claims.append(claim)
            results.append(process_claim(spark, claim))
        except Exception as e:  # noqa: BLE001
            faults.append(e)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not faults
    assert sorted(c.version for c in claims) == [1, 2, 3]
    taken = [k for c in claims for k in _keys(c.files)]
    assert len(taken) == len(set(taken)) == 8
    assert read_state(spark, state, "file_status").filter("status = 'done'").count() == 8


def test_files_of_a_killed_run_are_resumed_when_its_lease_is_stale(spark, write_csv, accounts, tmp_path):
    base, _ = _files(write_csv, 2)
    state = str(tmp_path / "state")
    dead = claim_files(spark, base, state, accounts, NOW)  # killed before it commits anything
    assert _actions(claim_files(spark, base, state, accounts, later(19)).triage) == ["locked"] * 4
    r = run_batch(spark, base, state, accounts, later(21))
    assert _actions(r.triage) == ["resume"] * 4 and {x["status"] for x in r.file_status.collect()} == {"done"}
    # the run was only slow: it commits now, and loses to the later version
    acknowledge(spark, state, r.statements.select("file_key"), later(22))
    late = process_claim(spark, dead)
    assert {x["version"] for x in late.file_status.collect()} == {r.version}
    assert all(x["email_sent"] for x in late.file_summary.collect()) and late.statements.count() == 0


def test_a_working_run_keeps_its_lease(spark, write_csv, accounts, tmp_path):
    base, _ = _files(write_csv, 1)
    state = str(tmp_path / "state")
    a = claim_files(spark, base, state, accounts, NOW)
    ticks = iter(range(15, 1000, 15))
    beating = Heartbeat(spark, state, a.version, 0.3, lambda: later(next(ticks)))
    with beating:
        while snapshot(spark, state).open[1][1] < later(60):
            pass
        assert _actions(claim_files(spark, base, state, accounts, later(70)).triage) == ["locked"] * 2
    assert not beating._thread.is_alive()
    clock = running_clock(NOW)
    assert NOW <= clock() <= clock()


def test_a_failing_run_leaves_its_files_failed(spark, write_csv, accounts, tmp_path, monkeypatch):
    base, _ = _files(write_csv, 1)
    state = str(tmp_path / "state")

    def broken(*_):
        raise OSError("no space left")

    with monkeypatch.context() as m:
        m.setattr(run_module, "process_files", broken)
        with pytest.raises(OSError):
            run_batch(spark, base, state, accounts, NOW)
    assert {r["status"] for r in read_state(spark, state, "file_status").collect()} == {"failed"}
    r = run_batch(spark, base, state, accounts, later(1))  # no lease to wait for
    assert _actions(r.triage) == ["resume"] * 2 and r.file_summary.count() == 2


def _rows(spark, lo, hi, status="done"):
    return spark.range(lo, hi).selectExpr(
        "sha2(cast(id as string), 256) as file_key", "cast(id as string) as account_id", "'p' as file_path",
        f"'{status}' as status", "0L as checkpoint_row", "id as valid_rows", "0L as invalid_rows",
        "'[]' as row_errors_json", "timestamp_ntz'2026-08-01 00:00:00' as heartbeat_at")


def _summaries(spark, lo, hi):
    return spark.range(lo, hi).selectExpr(
        "sha2(cast(id as string), 256) as file_key", "cast(id as string) as account_id", "false as email_sent",
        "repeat(sha2(cast(id as string), 512), 8) as summary_json", "timestamp_ntz'2026-08-01 00:00:00' as created_at",
        "timestamp_ntz'2026-08-01 00:00:00' as updated_at")


def _store(spark, state, parts, rows_per_bucket):
    for lo, hi in parts:
        version = take_version(spark, state, snapshot(spark, state), "change", NOW)
        write_state(spark, state, version, _rows(spark, lo, hi), _summaries(spark, lo, hi))
    return compact(spark, state, NOW, rows_per_bucket=rows_per_bucket)


def _bytes(df):
    return sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())


def test_bytes_read_for_one_file_do_not_grow_with_stored_files(spark, tmp_path):
    read = []
    for k, n in enumerate((400, 1600, 6400)):
        state = str(tmp_path / f"s{k}")
        _store(spark, state, [(0, n // 2), (n // 2, n)], 100)
        assert compaction(spark, state).buckets >= n // 100
        key = _rows(spark, 7, 8).select("file_key")
        found = read_state(spark, state, "file_summary", key)
        assert [r["account_id"] for r in found.collect()] == ["7"]
        read.append(_bytes(found))
        assert read_state(spark, state, "file_status").count() == n
    assert max(read) < 2.5 * min(read) and _bytes(read_state(spark, state, "file_summary")) > 20 * max(read)


def test_compaction_writes_touched_buckets_only(spark, tmp_path):
    state = str(tmp_path / "state")
    first = _store(spark, state, [(0, 900)], 100)
    before = compaction(spark, state)
    second = _store(spark, state, [(3, 5)], 100)  # two keys change
    after = compaction(spark, state)
    assert (first, second) == (2, 4) and after.buckets == before.buckets > 4
    for t in ("file_status", "file_summary"):
        assert len(after.folders[t]) == len(before.folders[t])
        new = [b for b, (v, _) in after.folders[t].items() if v == second]
        assert 1 <= len(new) <= 2 and sum(n for _, n in after.folders[t].values()) == 900
    whole = sorted(map(str, read_state(spark, state, "file_status").collect()))
    gone = vacuum(spark, state)
    assert any(g.endswith("file_status/v=1") for g in gone) and not any("base=2" in g for g in gone)
    assert sorted(map(str, read_state(spark, state, "file_status").collect())) == whole and len(whole) == 900
    assert _store(spark, state, [(890, 950)], 100) == 6  # numbers go on, also after a vacuum


def test_compaction_beside_open_runs(spark, write_csv, accounts, tmp_path):
    base, paths = _files(write_csv, 2)
    state = str(tmp_path / "state")
    dead = claim_files(spark, paths[:1], state, accounts, NOW)
    slow = claim_files(spark, paths[1:2], state, accounts, later(95))
    run_batch(spark, paths[2:], state, accounts, later(96))
    ack = take_version(spark, state, snapshot(spark, state), "change", later(99))  # taken, not written yet
    assert compact(spark, state, later(100)) == 5
    assert compaction(spark, state).pending == [slow.version, ack]
    assert sorted(r["status"] for r in read_state(spark, state, "file_status").collect()) == \
        ["done", "done", "processing", "processing"]
    process_claim(spark, slow)  # commits a version below the compaction's
    write_state(spark, state, ack, _rows(spark, 0, 0), _summaries(spark, 0, 1))
    assert sorted(r["status"] for r in read_state(spark, state, "file_status").collect()) == \
        ["done", "done", "done", "processing"]
    assert read_state(spark, state, "file_summary").filter("account_id = '0'").count() == 1
    process_claim(spark, dead)  # lost its files at the compaction
    r = run_batch(spark, base, state, accounts, later(101))
    assert _actions(r.triage) == ["resume"] + ["send_only"] * 3
    vacuum(spark, state)
    assert {x["status"] for x in read_state(spark, state, "file_status").collect()} == {"done"}
