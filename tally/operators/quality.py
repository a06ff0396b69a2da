"""Data-quality report over table constraints.

Each table is scanned once: rows are grouped by the table's key (partially
aggregated), its NOT NULL / CHECK style rules are ``count_if`` aggregates, and
keys seen more than once break the uniqueness rule. The results are unpivoted
into ``(rule, violations)`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_checks(df: DataFrame, rules: Mapping[str, Column], unique_name: str,
                 key_cols: Sequence[str]) -> DataFrame:
    """Row rules and one key-uniqueness rule of a table in a single scan.

    Rows are grouped by the key (partial aggregation); each group counts its
    rows and its violations of every rule; a second, tiny aggregate sums the
    violations and counts the keys seen more than once.
    """
    per_key = df.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.coalesce(pred, F.lit(False))).alias(name) for name, pred in rules.items()])
    totals = per_key.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in rules],
                         F.count_if(F.col("_n") > 1).alias(unique_name))
    return totals.unpivot([], [*rules, unique_name], "rule", "violations")


def constraint_report(tables: Sequence[tuple[DataFrame, Mapping[str, Column], str, Sequence[str]]]) -> DataFrame:
    """``(rule, violations)`` rows. ``tables`` entries (table, rules,
    uniqueness rule name, key columns) are checked in one scan each."""
    parts = [table_checks(df, rules, name, keys) for df, rules, name, keys in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule", F.col("violations").cast("bigint").alias("violations"))
