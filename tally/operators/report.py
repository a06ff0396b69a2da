"""Statements: nested summaries, statement rows and HTML, the outbox
(A12, F14, F15, R1-R4, O1, K6, F11-F13, F18).

Everything is a column expression over month rows. A file has at most one
row per calendar month, so the per-file arrays built here are bounded by the
calendar span of the file, never by its number of transactions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import balance_cell, credit_cell, debit_cell, month_label, when_positive
from ..functions.predicates import STATUS_DONE, not_delivered, valid_email
from .state import keep_keys
from .summary import balance

KEYS = ("account_id", "file_key")

# --- fixed values -----------------------------------------------------------
# Field names of a stored summary document.
DOC_ACCOUNT = "AccountID"
DOC_BALANCE = "TotalBalance"
DOC_BY_YEAR = "ByYear"
DOC_INVALID = "InvalidRows"
DOC_TXN_COUNT = "TxnCount"
DOC_BY_MONTH = "ByMonth"
DOC_MONTH = "Month"
DOC_MONTH_NUM = "MonthNum"
DOC_AVG_CREDIT = "AvgCredit"
DOC_AVG_DEBIT = "AvgDebit"
DOC_CREDIT_COUNT = "CreditCount"
DOC_DEBIT_COUNT = "DebitCount"
# Field names of a statement payload (months as an ordered list).
PAY_BALANCE = "TotalBalance"
PAY_MONTHS = "ByYear"
PAY_INVALID = "InvalidRows"
PAY_YEAR = "Year"
PAY_MONTH_NUM = "MonthNum"
PAY_MONTH = "Month"
PAY_TXN_COUNT = "TxnCount"
PAY_AVG_CREDIT = "AvgCredit"
PAY_AVG_DEBIT = "AvgDebit"
# ---------------------------------------------------------------------------

MONTH_DOC_TYPE = T.StructType([
    T.StructField(DOC_MONTH, T.StringType()),
    T.StructField(DOC_MONTH_NUM, T.IntegerType()),
    T.StructField(DOC_TXN_COUNT, T.LongType()),
    T.StructField(DOC_AVG_CREDIT, T.DoubleType()),
    T.StructField(DOC_AVG_DEBIT, T.DoubleType()),
    T.StructField(DOC_CREDIT_COUNT, T.LongType()),
    T.StructField(DOC_DEBIT_COUNT, T.LongType()),
])
YEAR_DOC_TYPE = T.StructType([
    T.StructField(DOC_TXN_COUNT, T.LongType()),
    T.StructField(DOC_BY_MONTH, T.MapType(T.StringType(), MONTH_DOC_TYPE)),
])
SUMMARY_DOC_TYPE = T.StructType([
    T.StructField(DOC_ACCOUNT, T.StringType()),
    T.StructField(DOC_BALANCE, T.DoubleType()),
    T.StructField(DOC_BY_YEAR, T.MapType(T.StringType(), YEAR_DOC_TYPE)),
    T.StructField(DOC_INVALID, T.LongType()),
])


def _by_key(entries):
    """Sort map entries by key (documents list keys in sorted order)."""
    return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1)
                        .when(a["key"] > b["key"], 1).otherwise(0))


def _with_files(per_file: DataFrame, files: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Attach per-file columns (``invalid_rows``); with ``files`` every listed
    file is kept, including files without a single valid month; without it,
    ``invalid_rows`` carried by the month rows are used if there are any."""
    if files is None:
        return per_file if "invalid_rows" in per_file.columns else per_file.withColumn(
            "invalid_rows", F.lit(0).cast("bigint"))
    per_file = per_file.drop("invalid_rows")
    f = files.select(*keys, F.coalesce(F.col("invalid_rows"), F.lit(0)).cast("bigint").alias("invalid_rows"))
    return f.join(per_file, list(keys), "left")


def summary_documents(monthly: DataFrame, files: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """One nested summary per file, as a struct and as JSON text.

    ``monthly`` is :func:`summary.monthly_summary` output. The file balance
    is the sum of the month balances, taken in the one aggregation that
    gathers a file's months (at most one per calendar month); the years are
    nested on each row, without another shuffle. ``files`` (keys +
    ``invalid_rows``) is optional.
    """
    month_doc = F.struct(
        F.col("month").alias(DOC_MONTH), F.col("month_num").alias(DOC_MONTH_NUM),
        F.col("txn_count").alias(DOC_TXN_COUNT), F.col("avg_credit").alias(DOC_AVG_CREDIT),
        F.col("avg_debit").alias(DOC_AVG_DEBIT), F.col("credit_count").alias(DOC_CREDIT_COUNT),
        F.col("debit_count").alias(DOC_DEBIT_COUNT))
    per_file = monthly.groupBy(*keys).agg(
        balance().alias("total_balance"),
        F.collect_list(F.struct(F.format_string("%04d", F.col("year")).alias("key"), F.col("month").alias("name"),
                                month_doc.alias("value"))).alias("_months"))

    def year_entry(year):
        mine = F.filter("_months", lambda m: m["key"] == year)
        by_month = F.map_from_entries(_by_key(F.transform(
            mine, lambda m: F.struct(m["name"].alias("key"), m["value"].alias("value")))))
        count = F.aggregate(mine, F.lit(0).cast("bigint"), lambda n, m: n + m["value"][DOC_TXN_COUNT])
        return F.struct(year.alias("key"),
                        F.struct(count.alias(DOC_TXN_COUNT), by_month.alias(DOC_BY_MONTH)).alias("value"))

    years = F.array_sort(F.array_distinct(F.transform("_months", lambda m: m["key"])))
    per_file = per_file.select(*keys, "total_balance",
                               F.map_from_entries(F.transform(years, year_entry)).alias("_by_year"))
    docs = _with_files(per_file, files, keys)
    doc = F.struct(
        F.col("account_id").cast("string").alias(DOC_ACCOUNT),
        F.coalesce(F.col("total_balance").cast("double"), F.lit(0.0)).alias(DOC_BALANCE),
        F.coalesce(F.col("_by_year"), F.create_map().cast(T.MapType(T.StringType(), YEAR_DOC_TYPE)))
         .alias(DOC_BY_YEAR),
        F.col("invalid_rows").alias(DOC_INVALID))
    return docs.select(*keys, doc.alias("summary"), F.to_json(doc).alias("summary_json"))


def parse_documents(df: DataFrame, col: str = "summary_json") -> DataFrame:
    """JSON text back to the nested summary struct."""
    return df.withColumn("summary", F.from_json(F.col(col), SUMMARY_DOC_TYPE))


def flatten_documents(df: DataFrame, keys: Sequence[str] = KEYS, col: str = "summary",
                      doc_fields: dict[str, str] | None = None) -> DataFrame:
    """Nested summary -> one row per month, in calendar order (O1).

    ``doc_fields`` maps output names to document-level fields (e.g.
    ``{"total_balance": "TotalBalance"}``) carried onto every month row, so
    no join back to the documents is needed.
    """
    carried = [F.col(f"{col}.{f}").alias(name) for name, f in (doc_fields or {}).items()]
    names = list(doc_fields or {})
    years = df.select(*keys, *carried, F.explode(F.col(f"{col}.{DOC_BY_YEAR}")).alias("_year", "_ydoc"))
    months = years.select(*keys, *names, F.col("_year").cast("int").alias("year"),
                          F.explode(F.col(f"_ydoc.{DOC_BY_MONTH}")).alias("_mname", "_m"))
    return months.select(
        *keys, *names, "year", F.col(f"_m.{DOC_MONTH_NUM}").alias("month_num"), F.col(f"_m.{DOC_MONTH}").alias("month"),
        F.col(f"_m.{DOC_TXN_COUNT}").alias("txn_count"), F.col(f"_m.{DOC_AVG_CREDIT}").alias("avg_credit"),
        F.col(f"_m.{DOC_AVG_DEBIT}").alias("avg_debit"))


def statement_rows(monthly: DataFrame, files: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """One statement line per (file, month), in calendar order.

    ``seq`` numbers the months of a file chronologically and the file balance
    is a window sum of the exact month balances: both windows run over month
    rows (at most one row per calendar month per file), no second scan.
    """
    by_file = Window.partitionBy(*keys)
    rows = monthly.withColumn("total_balance", F.sum("month_balance").over(by_file).cast("double")
                              + F.sum("month_rest").over(by_file))
    if files is not None:
        rows = rows.join(files.select(*keys, F.col("invalid_rows").cast("bigint")), list(keys), "inner")
    else:
        rows = rows.withColumn("invalid_rows", F.lit(0).cast("bigint"))
    w = by_file.orderBy("year", "month_num")
    return rows.select(
        *keys, F.row_number().over(w).alias("seq"), "year", "month_num",
        month_label("month", "year").alias("month_label"),
        "txn_count", "avg_credit", "avg_debit",
        F.abs(F.col("avg_debit")).alias("avg_debit_abs"),
        "total_balance", "invalid_rows",
        credit_cell("avg_credit").alias("credit_cell"), debit_cell("avg_debit").alias("debit_cell"),
        balance_cell("total_balance").alias("balance_cell"))


def _row_html(m):
    return F.concat(
        F.lit("<tr><td>"), m["month"], F.lit(" "), m["year"].cast("string"), F.lit("</td><td>"),
        m["txn_count"].cast("string"), F.lit("</td><td>"), credit_cell(m["avg_credit"]),
        F.lit("</td><td>"), debit_cell(m["avg_debit"]), F.lit("</td></tr>"))


def statement_html(monthly: DataFrame, files: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """One HTML statement per file, from its payload."""
    payloads = statement_payloads(monthly, files, keys)
    return payloads.select(*keys, html_from_payload("payload").alias("html"))


def outbox(status: DataFrame, summaries: DataFrame, accounts: DataFrame, key: str = "file_key") -> DataFrame:
    """Statements due: finished files with a stored, undelivered summary
    whose account has a usable address."""
    done = status.filter(F.col("status") == STATUS_DONE)
    due = keep_keys(summaries.filter(not_delivered("email_sent")), done, key)
    acc = accounts.filter(valid_email("email")).select("account_id", "email")
    return due.join(acc, "account_id", "inner")


def statement_payloads(monthly: DataFrame, files: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """K6 payload per file: balance, months in calendar order (O1), invalid rows.

    ``payload`` is a struct, ``payload_json`` its JSON text. The month list is
    ``sort_array`` of structs led by (year, month): at most one element per
    calendar month of the file; the balance is summed in the same aggregation.
    """
    carried = [F.max("invalid_rows").alias("invalid_rows")] if "invalid_rows" in monthly.columns else []
    months = monthly.groupBy(*keys).agg(
        balance().alias("total_balance"), *carried,
        F.sort_array(F.collect_list(F.struct(
        F.col("year").alias(PAY_YEAR), F.col("month_num").alias(PAY_MONTH_NUM), F.col("month").alias(PAY_MONTH),
        F.col("txn_count").alias(PAY_TXN_COUNT), F.col("avg_credit").alias(PAY_AVG_CREDIT),
        F.col("avg_debit").alias(PAY_AVG_DEBIT)))).alias("_months"))
    j = _with_files(months, files, keys)
    payload = F.struct(
        F.coalesce(F.col("total_balance"), F.lit(0.0)).alias(PAY_BALANCE),
        F.coalesce(F.col("_months"), F.array()).alias(PAY_MONTHS),
        F.coalesce(F.col("invalid_rows"), F.lit(0)).cast("bigint").alias(PAY_INVALID))
    return j.select(*keys, payload.alias("payload"), F.to_json(payload).alias("payload_json"))


def statements(due: DataFrame, payloads: DataFrame, html: DataFrame | None = None, key: str = "file_key") -> DataFrame:
    """K6: the statement sink's rows: recipient, subject, payload (and HTML).

    ``due`` is :func:`outbox` output (``file_key, account_id, email``). The
    result is written with any ``DataFrameWriter``; transport is not part of
    this library. Rows are keyed by ``file_key`` so a re-sent batch replaces,
    never duplicates.
    """
    out = due.join(payloads.drop("account_id"), key, "inner")
    if html is not None:
        out = out.join(html.select(key, "html"), key, "left")
    return out.withColumn("to", F.col("email")).withColumn(
        "subject", F.concat(F.lit("Account statement "), F.col("account_id").cast("string")))


def payload_from_documents(docs: DataFrame, col: str = "summary") -> DataFrame:
    """R1 + K6 from stored documents: the statement payload of each parsed
    summary (:func:`parse_documents`), months flattened from the nested maps
    and sorted by (year, month) with higher-order functions on each row (no
    explode, no shuffle)."""
    by_year = F.map_entries(F.col(f"{col}.{DOC_BY_YEAR}"))
    months = F.flatten(F.transform(by_year, lambda y: F.transform(
        F.map_values(y["value"][DOC_BY_MONTH]), lambda m: F.struct(
            y["key"].cast("int").alias(PAY_YEAR), m[DOC_MONTH_NUM].alias(PAY_MONTH_NUM),
            m[DOC_MONTH].alias(PAY_MONTH), m[DOC_TXN_COUNT].alias(PAY_TXN_COUNT),
            m[DOC_AVG_CREDIT].alias(PAY_AVG_CREDIT), m[DOC_AVG_DEBIT].alias(PAY_AVG_DEBIT)))))
    payload = F.struct(
        F.col(f"{col}.{DOC_BALANCE}").alias(PAY_BALANCE),
        F.sort_array(F.coalesce(months, F.array())).alias(PAY_MONTHS),
        F.col(f"{col}.{DOC_INVALID}").alias(PAY_INVALID))
    return docs.withColumn("payload", payload).withColumn("payload_json", F.to_json("payload"))


def html_from_payload(payload_col: str = "payload"):
    """The HTML statement of a payload struct (our own neutral
    markup): the months are in calendar order already, and the note on
    skipped rows appears only when there are some. No UDF."""
    p = F.col(payload_col)
    rows = F.transform(p[PAY_MONTHS], lambda m: _row_html({
        "month": m[PAY_MONTH], "year": m[PAY_YEAR], "txn_count": m[PAY_TXN_COUNT],
        "avg_credit": m[PAY_AVG_CREDIT], "avg_debit": m[PAY_AVG_DEBIT]}))
    invalid = p[PAY_INVALID]
    note = when_positive(invalid, F.concat(
        F.lit("<p class=\"note\">"), invalid.cast("string"),
        F.lit(" row(s) of the file could not be read and are not part of this summary.</p>")))
    return F.concat(
        F.lit("<html><body><h1>Account statement</h1><p>Balance: "), balance_cell(p[PAY_BALANCE]),
        F.lit("</p><table><tr><th>Month</th><th>Transactions</th><th>Average credit</th>"
              "<th>Average debit</th></tr>"),
        F.array_join(rows, ""), F.lit("</table>"), note, F.lit("</body></html>"))
