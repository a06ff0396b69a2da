"""Every registered query equals its DuckDB oracle at sf0.01 (the driver's gate)."""
import os

import pytest

from sf_paths import SF_CHECK, SF_SMALL
from tally.plans.catalog import QUERIES


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "avg_credit" in df.columns


NAMES = list(QUERIES)


def test_queries_have_oracles():
    from __spark_entry__ import oracle_sql, queries
    assert set(NAMES) <= set(queries()) and set(NAMES) <= set(oracle_sql())


@pytest.mark.skipif(not os.path.exists(SF_CHECK), reason="driver data not present")
def test_all_queries_match_duckdb(spark):
    from oracle_check import compare
    from tally.session import _scratch, release_scratch
    res = compare(spark, SF_CHECK, NAMES, verbose=False)
    left = list(_scratch)
    release_scratch(spark)
    assert left and not any(os.path.exists(p.removeprefix("file:")) for p in left)
    bad = {k: v for k, v in res.items() if v[0] == "MISMATCH"}
    assert not bad
    assert all(v[1] > 0 for v in res.values())


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver data not present")
def test_all_queries_match_duckdb_small(spark):
    from oracle_check import compare
    res = compare(spark, SF_SMALL, NAMES, verbose=False)
    assert not {k: v for k, v in res.items() if v[0] == "MISMATCH"}


@pytest.mark.skipif(not os.path.exists(SF_CHECK), reason="driver data not present")
def test_results_independent_of_ansi_mode_and_time_zone(spark):
    """Parsing, timestamp literals and formatting do not depend on the
    session's ANSI mode or time zone."""
    from oracle_check import compare
    names = ["ledger_valid_rows", "row_error_details", "file_triage", "summary_upsert", "latest_per_key",
             "statement_html"]
    old = {k: spark.conf.get(k) for k in ("spark.sql.ansi.enabled", "spark.sql.session.timeZone")}
    spark.conf.set("spark.sql.ansi.enabled", "false")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        res = compare(spark, SF_CHECK, names, verbose=False)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {k: v[0] for k, v in res.items()} == {k: "ok" for k in names}
