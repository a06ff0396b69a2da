"""Ledger aggregates (A1-A8, A12 inputs, W3, P8).

Input is a typed ledger: ``account_id, file_key, id, date, amount`` (amount
an exact decimal). All aggregates are plain ``groupBy``/``rollup`` with
partial aggregation, so a hot account or month is combined map-side before
anything is shuffled. Means are derived from exact (sum, count) pairs, which
makes every aggregate mergeable (A8) and independent of row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_num, year_of
from ..functions.money import EXACT_TYPE, exact_part, exact_sum, rest_part, rest_sum, sums_exactly, total
from ..functions.predicates import DEFAULT_CHECKPOINT_INTERVAL, DEFAULT_MAX_ROW_ERRORS, is_credit, is_debit
from ..session import ensure_checkpoint_dir
from .ordinals import block_totals, running_totals
from .validate import is_valid

KEYS = ("account_id", "file_key")
STATE_COLS = ("txn_count", "credit_count", "debit_count", "credit_sum", "debit_sum", "credit_rest", "debit_rest")


def _sums(credit, debit, exact: bool) -> list:
    """Exact decimal sums and the sums of amounts that no decimal holds."""
    return [exact_sum(credit, exact).alias("credit_sum"), exact_sum(debit, exact).alias("debit_sum"),
            rest_sum(credit, exact).alias("credit_rest"), rest_sum(debit, exact).alias("debit_rest")]


def monthly_state(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A2/A6 + sums: mergeable per-month state (counts and exact sums)."""
    amt = F.col("amount")
    return ledger.groupBy(*keys, year_of("date").alias("year"), month_num("date").alias("month_num")).agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.count_if(is_credit(amt)).alias("credit_count"),
        F.count_if(is_debit(amt)).alias("debit_count"),
        *_sums(F.when(is_credit(amt), amt), F.when(is_debit(amt), amt), sums_exactly(ledger)),
    )


def merge_states(*states: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Merge partial month states (old checkpoint + delta, or splits)."""
    union = states[0]
    for s in states[1:]:
        union = union.unionByName(s)
    return union.groupBy(*keys, "year", "month_num").agg(
        *[F.sum(c).alias(c) for c in STATE_COLS])


def mean_or_zero(whole, count):
    """A4/A5: mean of a conditional set, 0 when the set is empty."""
    return F.coalesce(F.try_divide(whole, F.col(count)), F.lit(0.0))


def balance():
    """Balance of a group of month rows as a double (an aggregate)."""
    return F.sum("month_balance").cast("double") + F.sum("month_rest")


def finish_monthly(state: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Month rows with name, means and sums as DOUBLE, plus the exact
    ``month_balance`` (DECIMAL) and ``month_rest`` (DOUBLE, amounts that no
    decimal holds) from which file totals are summed (:func:`balance`).
    ``invalid_rows`` is kept where present."""
    credit = F.col("credit_sum").cast("double") + F.col("credit_rest")
    debit = F.col("debit_sum").cast("double") + F.col("debit_rest")
    extra = ["invalid_rows"] if "invalid_rows" in state.columns else []
    return state.select(
        *keys, "year", "month_num",
        F.date_format(F.make_date("year", "month_num", F.lit(1)), "MMMM").alias("month"),
        "txn_count", "credit_count", "debit_count",
        credit.alias("credit_sum"), debit.alias("debit_sum"),
        mean_or_zero(credit, "credit_count").alias("avg_credit"),
        mean_or_zero(debit, "debit_count").alias("avg_debit"),
        (F.col("credit_sum") + F.col("debit_sum")).cast(EXACT_TYPE).alias("month_balance"),
        (F.col("credit_rest") + F.col("debit_rest")).alias("month_rest"), *extra,
    )


def accepted_monthly_summary(classified: DataFrame, max_errors: int = DEFAULT_MAX_ROW_ERRORS,
                             keys: Sequence[str] = KEYS) -> DataFrame:
    """A11 + A2-A6 in one ledger scan: month rows of files that stay ``done``.

    Invalid rows are counted in a per-file bucket with NULL year/month inside
    the same aggregate; a window over the (few) aggregated rows of each file
    then adds up the file's invalid rows, and the file is dropped when they
    exceed ``max_errors``. The file's number is kept as ``invalid_rows``.
    """
    amt = F.col("amount")
    ok = is_valid()
    per_month = classified.groupBy(
        *keys, F.when(ok, year_of("pdate")).alias("year"), F.when(ok, month_num("pdate")).alias("month_num")
    ).agg(
        F.count_if(ok).alias("txn_count"),
        F.count_if(ok & is_credit(amt)).alias("credit_count"),
        F.count_if(ok & is_debit(amt)).alias("debit_count"),
        *_sums(F.when(ok & is_credit(amt), amt), F.when(ok & is_debit(amt), amt), sums_exactly(classified)),
        F.count_if(~ok).alias("_invalid"),
    )
    file_invalid = F.sum("_invalid").over(Window.partitionBy(*keys))
    kept = per_month.withColumn("invalid_rows", file_invalid.cast("bigint")).filter(
        (F.col("invalid_rows") <= max_errors) & F.col("year").isNotNull())
    return finish_monthly(kept, keys)


def monthly_summary(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per (account, file, year, month) counts and means."""
    return finish_monthly(monthly_state(ledger, keys), keys)


def totals(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A1: total balance and transaction count per (account, file)."""
    return ledger.groupBy(*keys).agg(
        total("amount", sums_exactly(ledger)).alias("total_balance"),
        F.count(F.lit(1)).alias("txn_count"),
    )


def yearly_counts(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A3: transactions per calendar year."""
    return ledger.groupBy(*keys, year_of("date").alias("year")).agg(F.count(F.lit(1)).alias("txn_count"))


def credit_debit_totals(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Credit and debit counts and totals per (account, file)."""
    amt, exact = F.col("amount"), sums_exactly(ledger)
    return ledger.groupBy(*keys).agg(
        F.count_if(is_credit(amt)).alias("credit_count"),
        F.count_if(is_debit(amt)).alias("debit_count"),
        total(F.when(is_credit(amt), amt), exact).alias("credit_total"),
        total(F.when(is_debit(amt), amt), exact).alias("debit_total"),
    )


def ledger_rollup(ledger: DataFrame, keys: Sequence[str] = ("account_id",)) -> DataFrame:
    """Month -> year -> account -> grand total in one result.

    The ledger is first reduced to one row per month (partial aggregation),
    and only those rows go through the rollup's Expand, so the 4x row
    expansion applies to month rows, not to ledger rows.
    """
    month_rows = ledger.groupBy(*keys, year_of("date").alias("year"), month_num("date").alias("month_num")).agg(
        F.count(F.lit(1)).alias("n"), exact_sum("amount", sums_exactly(ledger)).alias("s"),
        rest_sum("amount", sums_exactly(ledger)).alias("r"))
    return month_rows.rollup(*keys, "year", "month_num").agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("txn_count"),
        (F.sum("s").cast("double") + F.sum("r")).alias("balance"),
    )


def checkpoint_snapshots(classified: DataFrame, block_col: str, order_cols: Sequence[str],
                         interval: int = DEFAULT_CHECKPOINT_INTERVAL,
                         max_errors: int = DEFAULT_MAX_ROW_ERRORS,
                         file_cols: Sequence[str] = ("file_key",)) -> DataFrame:
    """Running balance and counts after every ``interval`` valid rows.

    Mirrors a reader that stops at error ``max+1``: a valid row after that
    error is never reached, so it makes no checkpoint. Only blocks that hold
    a multiple of ``interval`` before the cut-off are sorted.
    """
    meas = {
        "row_no": F.when(is_valid(), 1).otherwise(0),
        "err_no": F.when(is_valid(), 0).otherwise(1),
        "balance": F.coalesce(F.when(is_valid(), exact_part("amount")), F.lit(0).cast(EXACT_TYPE)),
        "rest": F.coalesce(F.when(is_valid(), rest_part("amount")), F.lit(0.0)),
        "credit_count": F.when(is_valid() & is_credit(F.col("amount")), 1).otherwise(0),
    }
    blocks = block_totals(classified, file_cols, block_col, meas)
    start, end = F.col("row_no_before"), F.col("row_no_before") + F.col("row_no_in_block")
    crosses = F.floor(end / interval) > F.floor(start / interval)
    wanted = blocks.filter(crosses & (F.col("err_no_before") <= max_errors))
    ran = running_totals(classified, wanted, file_cols, block_col, order_cols, meas)
    snaps = ran.filter(is_valid() & (F.col("row_no") % interval == 0) & (F.col("err_no") <= max_errors))
    return snaps.select(
        "account_id", *file_cols, F.col("row_no").alias("checkpoint_row"),
        (F.col("balance").cast("double") + F.col("rest")).alias("balance"),
        "credit_count", (F.col("row_no") - F.col("credit_count")).alias("debit_count"),
    )


def resume_delta(classified: DataFrame, checkpoints: DataFrame, block_col: str, order_cols: Sequence[str],
                 file_cols: Sequence[str] = ("file_key",)) -> DataFrame:
    """The valid rows after each file's ``checkpoint_row``.

    ``checkpoints`` has ``file_key, checkpoint_row`` (files without a row
    start at 0). It is joined into the small per-block table, never into the
    ledger. Each block is marked once: wholly after the checkpoint (rows pass
    without sorting), straddling it (only this block per file gets a window)
    or wholly before it (dropped by the join).
    """
    meas = {"row_no": F.when(is_valid(), 1).otherwise(0)}
    blocks = block_totals(classified, file_cols, block_col, meas).join(
        checkpoints.select(*file_cols, "checkpoint_row"), list(file_cols), "left"
    ).withColumn("checkpoint_row", F.coalesce(F.col("checkpoint_row"), F.lit(0)))
    start, end = F.col("row_no_before"), F.col("row_no_before") + F.col("row_no_in_block")
    mode = (F.when(start >= F.col("checkpoint_row"), F.lit("whole"))
            .when(end > F.col("checkpoint_row"), F.lit("part")))
    marked = blocks.withColumn("_mode", mode).filter(F.col("_mode").isNotNull()).select(
        *file_cols, block_col, "_mode", "checkpoint_row", "row_no_before")
    # The marked block table (one row per block) feeds two branches; a
    # reliable checkpoint in the session's shared checkpoint folder computes
    # it once and cuts its lineage.
    ensure_checkpoint_dir(marked.sparkSession)
    marked = marked.checkpoint(eager=True)
    valid = classified.filter(is_valid())
    cols = valid.columns
    # One join with the marked blocks (broadcast by AQE when small); rows of
    # "whole" blocks leave without a window, only "part" rows are sorted.
    joined = valid.join(marked, [*file_cols, block_col], "inner")
    whole = joined.filter(F.col("_mode") == "whole").select(*cols)
    part = joined.filter(F.col("_mode") == "part")
    w = (Window.partitionBy(*file_cols, block_col).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = part.withColumn("_row_no", F.col("row_no_before") + F.count(F.lit(1)).over(w))
    return whole.unionByName(part.filter(F.col("_row_no") > F.col("checkpoint_row")).select(*cols))
