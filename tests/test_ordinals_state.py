"""Two-level ordinals equal a one-level window; state operators."""
import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tally.operators import ordinals, state, summary, validate


def _random_raw(spark, n_files=5, n_rows=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n_rows):
        f = rnd.choice([0, 0, 0, 1, 2, 3, 4])  # file 0 is hot
        bad = rnd.random() < 0.08
        rows.append((f, f, i, str(i) if rnd.random() > 0.03 else "",
                     "01/0%d/2025" % rnd.randint(1, 9) if not bad else "xx",
                     ("+" if rnd.random() < 0.5 else "-") + "%d.%02d" % (rnd.randint(0, 99), rnd.randint(0, 99))))
    df = spark.createDataFrame(rows, "account_id long, file_key long, event_id long, id string, date string, "
                                     "transaction string")
    return df


def test_two_level_matches_one_level(spark):
    raw = _random_raw(spark)
    for block in (1, 7, 64, 10_000):
        c = validate.classify(raw.withColumn("blk", F.floor(F.col("event_id") / block)))
        meas = {"v": F.when(validate.is_valid(), 1).otherwise(0), "bal": F.coalesce(F.col("amount").cast("decimal(18,2)"), F.lit(0))}
        blocks = ordinals.block_totals(c, ["file_key"], "blk", meas)
        two = ordinals.running_totals(c, blocks, ["file_key"], "blk", ["event_id"], meas)
        w = Window.partitionBy("file_key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
        one = c.withColumns({n: F.sum(expr).over(w) for n, expr in meas.items()})
        a = sorted((r["event_id"], r["v"], r["bal"]) for r in two.select("event_id", "v", "bal").collect())
        b = sorted((r["event_id"], r["v"], r["bal"]) for r in one.select("event_id", "v", "bal").collect())
        assert a == b and len(a) == 400


def test_error_details_and_snapshots_independent_of_blocks(spark):
    raw = _random_raw(spark, seed=11)
    results = []
    for block in (3, 50, 10_000):
        c = validate.classify(raw.withColumn("blk", F.floor(F.col("event_id") / block)))
        errs = validate.row_error_details(c, "blk", ["event_id"], max_errors=4)
        snaps = summary.checkpoint_snapshots(c, "blk", ["event_id"], interval=10, max_errors=4)
        cps = spark.createDataFrame([(0, 25), (2, 3)], "file_key long, checkpoint_row long")
        rest = summary.resume_delta(c, cps, "blk", ["event_id"])
        results.append((sorted(map(tuple, errs.collect())), sorted(map(tuple, snaps.collect())),
                        sorted(r["id"] for r in rest.collect())))
    assert results[0] == results[1] == results[2]
    assert len(results[0][0]) > 0 and len(results[0][1]) > 0


def test_checkpoint_every_two_rows(spark):
    raw = spark.createDataFrame(
        [(1, 1, i, str(i), "%02d/07/2026" % (15 + i), "+%d" % (10 * (i + 1)), 0) for i in range(4)],
        "account_id long, file_key long, event_id long, id string, date string, transaction string, blk long")
    snaps = summary.checkpoint_snapshots(validate.classify(raw), "blk", ["event_id"], interval=2, max_errors=10)
    assert [(r["checkpoint_row"], r["balance"]) for r in snaps.orderBy("checkpoint_row").collect()] == \
        [(2, 30.0), (4, 100.0)]


def test_latest_per_key_and_upsert(spark):
    cur = spark.createDataFrame([("A", 1, "x"), ("B", 1, "y")], "k string, v long, email string")
    chg = spark.createDataFrame([("A", 2, "x2"), ("C", 1, "z")], "k string, v long, email string")
    got = {r["k"]: r["email"] for r in state.upsert(cur, chg, ["k"], ["v"]).collect()}
    assert got == {"A": "x2", "B": "y", "C": "z"}


def test_summary_upsert_keeps_delivered(spark):
    old = spark.createDataFrame([("k1", "a", 1.0, True), ("k2", "a", 2.0, False), ("k3", "b", 3.0, False)],
                                "file_key string, account_id string, total_balance double, email_sent boolean")
    new = spark.createDataFrame([("k1", "a", 10.0, False), ("k2", "a", 20.0, False), ("k4", "c", 4.0, False)],
                                "file_key string, account_id string, total_balance double, email_sent boolean")
    got = {r["file_key"]: (r["total_balance"], r["email_sent"], r["source"])
           for r in state.upsert_summaries(old, new).collect()}
    assert got == {"k1": (1.0, True, "old"), "k2": (20.0, False, "new"), "k3": (3.0, False, "old"),
                   "k4": (4.0, False, "new")}
    ack = spark.createDataFrame([("k2",)], "file_key string")
    sent = {r["file_key"]: r["email_sent"] for r in state.mark_delivered(state.upsert_summaries(old, new), ack).collect()}
    assert sent == {"k1": True, "k2": True, "k3": False, "k4": False}


def test_triage_actions(spark):
    now = dt.datetime(2024, 2, 1)
    manifest = spark.createDataFrame([(f"f{i}",) for i in range(8)], "file_key string")
    st = spark.createDataFrame([
        ("f0", "done", "2024-01-31 00:00:00"), ("f1", "done", "2024-01-31 00:00:00"),
        ("f3", "done", "2024-01-31 00:00:00"), ("f4", "processing", "2024-01-31 23:59:50"),
        ("f5", "processing", "2024-01-31 23:59:00"), ("f6", "failed", "2024-01-31 23:59:59"),
        ("f7", "to_review", "2024-01-31 23:59:59")], "file_key string, status string, heartbeat_at string"
    ).withColumn("heartbeat_at", F.col("heartbeat_at").cast("timestamp_ntz"))
    sm = spark.createDataFrame([("f0", True), ("f1", False)], "file_key string, email_sent boolean")
    got = {r["file_key"]: r["action"] for r in state.triage(manifest, st, sm, now, 20).collect()}
    assert got == {"f0": "skip", "f1": "send_only", "f2": "process", "f3": "error_already_processed",
                   "f4": "locked", "f5": "resume", "f6": "resume", "f7": "resume"}
    left = {r["file_key"] for r in state.unprocessed(manifest, st).collect()}
    assert left == {"f2", "f4", "f5", "f6", "f7"}


def test_merge_partials_equals_whole(spark):
    raw = _random_raw(spark, seed=3).withColumn("blk", F.lit(0))
    ledger = validate.valid_rows(validate.classify(raw))
    whole = summary.monthly_summary(ledger)
    parts = [summary.monthly_state(ledger.filter(F.col("id") % 3 == r)) for r in range(3)]
    merged = summary.finish_monthly(summary.merge_states(*parts))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.select(*whole.columns).collect()))
    # invariant: month counts add up to the ledger, sums add up to the balance
    tot = summary.totals(ledger.withColumn("account_id", F.lit(0)).withColumn("file_key", F.lit(0))).first()
    agg = whole.agg(F.sum("txn_count").alias("n"), F.sum(F.col("credit_sum") + F.col("debit_sum")).alias("s")).first()
    assert agg["n"] == tot["txn_count"] and abs(agg["s"] - tot["total_balance"]) < 1e-6


def test_snapshots_versioned(spark, tmp_path):
    base = str(tmp_path / "accounts")
    assert state.latest_snapshot_path(spark, base) is None
    v1 = spark.createDataFrame([("A", 1, "a@x.io")], "account_id string, v long, email string")
    state.write_snapshot(v1, base, 1)
    chg = spark.createDataFrame([("A", 2, "b@x.io"), ("B", 1, "c@x.io")], "account_id string, v long, email string")
    cur = spark.read.parquet(state.latest_snapshot_path(spark, base))
    state.write_snapshot(state.upsert(cur, chg, ["account_id"], ["v"]), base, 2)
    state.write_snapshot(state.upsert(cur, chg, ["account_id"], ["v"]), base, 2)  # retried job: same result
    latest = spark.read.parquet(state.latest_snapshot_path(spark, base))
    assert sorted((r["account_id"], r["email"]) for r in latest.collect()) == [("A", "b@x.io"), ("B", "c@x.io")]


def test_statement_payload(spark):
    from tally.operators import report
    monthly = spark.createDataFrame(
        [("harbor", "k", 2024, 5, "May", 1, 0.0, -8.5), ("harbor", "k", 2023, 2, "February", 2, 125.75, -40.25)],
        "account_id string, file_key string, year int, month_num int, month string, txn_count long, "
        "avg_credit double, avg_debit double")
    monthly = monthly.withColumn("month_balance", F.when(F.col("month_num") == 2, F.lit(85.5))
                                 .otherwise(F.lit(-8.5)).cast("decimal(24,6)")).withColumn("month_rest", F.lit(0.0))
    totals = spark.createDataFrame([("harbor", "k", 0)], "account_id string, file_key string, invalid_rows long")
    due = spark.createDataFrame([("k", "harbor", "dock@harbor.example")], "file_key string, account_id string, email string")
    out = report.statements(due, report.statement_payloads(monthly, totals)).first()
    assert out["to"] == "dock@harbor.example"
    months = out["payload"]["ByYear"]
    assert [(m["Month"], m["Year"], m["TxnCount"]) for m in months] == [("February", 2023, 2), ("May", 2024, 1)]
    assert out["payload_json"].startswith('{"TotalBalance":77.0,"ByYear":[{"Year":2023,"MonthNum":2')


def test_account_bucket_layout_prunes(spark, tmp_path):
    df = spark.createDataFrame([(f"A{i}", float(i)) for i in range(50)], "account_id string, total double")
    base = str(tmp_path / "summaries")
    one = state.read_account(spark, state.write_by_account(df, base, 8), "A7", 8)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert [r["total"] for r in one.collect()] == [7.0]


def test_results_independent_of_partitioning(spark):
    """Aggregates and ordinals do not change when the ledger is spread differently."""
    from sf_paths import SF_SMALL
    from tally.plans import ledgers as L
    base = L.events_raw_ledger(spark, SF_SMALL).withColumn("blk", F.floor(F.col("event_id") / 64))
    outs = []
    for parts in (1, 7, 23):
        c = validate.classify(base.repartition(parts))
        errs, outcome = validate.error_report(c, "blk", ["event_id"], 3)
        monthly = summary.accepted_monthly_summary(c, 3)
        outs.append((sorted(map(tuple, errs.collect())),
                     sorted((r["file_key"], r["status"], r["valid_rows"]) for r in outcome.collect()),
                     sorted(map(tuple, monthly.collect()))))
    assert outs[0] == outs[1] == outs[2]


def test_table_checks_one_scan_and_empty_table(spark):
    from tally.operators import quality
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "y")], "k string, v string")
    got = {r["rule"]: r["violations"] for r in quality.constraint_report(
        [(df, {"v_null": F.col("v").isNull()}, "k_dup", ["k"])]).collect()}
    assert got == {"v_null": 1, "k_dup": 1}
    empty = df.limit(0)
    got = {r["rule"]: r["violations"] for r in quality.constraint_report(
        [(empty, {"v_null": F.col("v").isNull()}, "k_dup", ["k"])]).collect()}
    assert got == {"v_null": 0, "k_dup": 0}


def test_blocks_follow_the_rows_of_a_file(spark):
    from sf_paths import SF_CHECK
    from tally.plans import ledgers as L
    rows = [("hot", i * 3 - 500) for i in range(1000)] + [(f"f{i % 50}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "f string, k long")
    for broadcast_rows in (10, 0):
        got = ordinals.with_blocks(df, ["f"], "k", block_rows=100, broadcast_rows=broadcast_rows)
        sizes = {(r["f"], r["blk"]): r["count"] for r in got.groupBy("f", "blk").count().collect()}
        assert sum(sizes.values()) == 1400 and len(sizes) <= 51 + 1400 // 100
        assert max(sizes.values()) <= 101 and len({b for f, b in sizes if f == "hot"}) == 10
    order = got.filter("f = 'hot'").groupBy("blk").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("blk").collect()
    assert all(x["b"] < y["a"] for x, y in zip(order, order[1:]))
    ledger = L.l2_blocks(L.events_raw_ledger(spark, SF_CHECK))
    files, total = ledger.select("file_key").distinct().count(), ledger.count()
    assert ledger.select("file_key", "blk").distinct().count() <= files + total / 100_000


def test_cluster_conf():
    from tally.session import cluster_conf
    conf = cluster_conf(total_cores=8000, input_bytes=100 * 2 ** 40)
    assert int(conf["spark.sql.shuffle.partitions"]) == 819_200  # 128 MB each; above 3 waves (24,000)
    assert conf["spark.sql.adaptive.enabled"] == "true" and conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(conf["spark.sql.sources.parallelPartitionDiscovery.parallelism"]) == 32000


def test_mark_delivered_stamps_only_acknowledged(spark):
    import datetime as dt
    sm = spark.createDataFrame([("k1", False, dt.datetime(2026, 1, 1)), ("k2", False, dt.datetime(2026, 1, 1))],
                               "file_key string, email_sent boolean, updated_at timestamp_ntz")
    ack = spark.createDataFrame([("k1",), ("k1",)], "file_key string")
    now = F.lit("2026-02-01 00:00:00").cast("timestamp_ntz")
    got = {r["file_key"]: (r["email_sent"], r["updated_at"]) for r in state.mark_delivered(sm, ack, now=now).collect()}
    assert got == {"k1": (True, dt.datetime(2026, 2, 1)), "k2": (False, dt.datetime(2026, 1, 1))}


def test_documents_for_files_without_months(spark):
    import json
    from tally.operators import report
    ledger = spark.createDataFrame([("A", "k1", 1, None, None)],
                                   "account_id string, file_key string, id long, date date, amount decimal(24,6)")
    monthly = summary.monthly_summary(ledger.filter(F.col("id") < 0))  # no valid rows at all
    files = spark.createDataFrame([("A", "k1", 2)], "account_id string, file_key string, invalid_rows long")
    doc = json.loads(report.summary_documents(monthly, files).first()["summary_json"])
    assert doc == {"AccountID": "A", "TotalBalance": 0.0, "ByYear": {}, "InvalidRows": 2}
    html = report.statement_html(monthly, files).first()["html"]
    assert "Balance: $0.00" in html and "2 row(s)" in html
    pay = json.loads(report.statement_payloads(monthly, files).first()["payload_json"])
    assert pay == {"TotalBalance": 0.0, "ByYear": [], "InvalidRows": 2}
