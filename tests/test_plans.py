"""Physical plan shapes that matter at scale (read after execution, AQE final plan)."""
import re

import pytest

from sf_paths import SF_SMALL
from tally.plans import catalog


def _plan(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _first_line(plan, pattern):
    for i, line in enumerate(plan.split("\n")):
        if re.search(pattern, line):
            return i
    return None


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(spark, "monthly_summary")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == \
        ["o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"]
    assert "partial_count" in plan  # map-side combine before the shuffle


def test_date_filter_reaches_the_scan(spark):
    plan = _plan(spark, "summary_upsert")
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", plan)


@pytest.mark.parametrize("name", ["ledger_with_account", "orphan_accounts"])
def test_aggregate_before_account_join(spark, name):
    plan = _plan(spark, name)
    join = _first_line(plan, r"(HashJoin|SortMergeJoin)")
    agg = _first_line(plan, r"HashAggregate")
    assert join is not None and agg is not None and join < agg  # aggregate is below (a child of) the join


def test_rollup_expands_month_rows_only(spark):
    plan = _plan(spark, "ledger_rollup")
    lines = plan.split("\n")
    expand = _first_line(plan, r"Expand")
    assert expand is not None
    assert any("HashAggregate" in ln for ln in lines[expand + 1:])  # pre-aggregation under the Expand


def test_latest_per_key_has_no_window(spark):
    assert "Window" not in _plan(spark, "latest_per_key")


@pytest.mark.parametrize("name", ["row_error_details", "checkpoint_snapshots"])
def test_ledger_windows_are_per_block(spark, name, monkeypatch):
    from tally.operators.ordinals import with_blocks
    monkeypatch.setattr(catalog.L, "l2_blocks", lambda df: with_blocks(df, ["file_key"], "event_id", block_rows=5))
    plan = _plan(spark, name)
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan)
    row_windows = [s for s in specs if "event_id" in s]
    assert row_windows and all("blk" in s for s in row_windows)


def test_queries_stay_in_the_jvm(spark):
    """No Python operator in any job of any registered query, the header and
    layout jobs included."""
    python_ops = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "PythonMapIn",
                  "FlatMapGroupsInPandas", "PythonUDF")
    offenders = {}
    for name in catalog.QUERIES:
        plan = _plan(spark, name)
        hits = [op for op in python_ops if op in plan]
        if hits:
            offenders[name] = hits
    assert offenders == {}
    import tally.sources.csv_ledger as C
    for module in (C, catalog):
        text = open(module.__file__).read()
        assert not any(w in text for w in ("mapIn", "pandas_udf", "applyIn", ".rdd", "F.udf"))


@pytest.mark.parametrize("name,scans,shuffles", [("statement_payloads", 1, None), ("summary_json", None, 2)])
def test_scans_and_shuffles(spark, name, scans, shuffles):
    plan = _plan(spark, name)
    final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    if scans is not None:
        assert len(re.findall(r"FileScan parquet [^\n]*value", final)) == scans  # the ledger cells
    if shuffles is not None:
        assert len(re.findall(r"Exchange hashpartitioning", final)) <= shuffles
