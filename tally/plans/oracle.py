"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Tables ``orders events customer ...`` are views over the driver's parquet.
Written independently of the Spark plans: plain SQL windows over whole
files, direct ROLLUP, FULL OUTER JOIN, etc. Counts are cast to BIGINT,
decimal results to DOUBLE, calendar parts to INT, so that types line up.
"""

from __future__ import annotations

# L1: typed ledger from orders.
L1 = """
l1 AS (
  SELECT o_custkey AS account_id, o_custkey AS file_key, o_orderkey AS id,
         CAST(o_orderdate AS DATE) AS date,
         CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount
  FROM orders)"""

# L2: raw text ledger from events, parsed and classified.
L2 = r"""
raw AS (
  SELECT user_id AS account_id, user_id AS file_key, event_id,
         CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 103 = 0 THEN chr(1) || CAST(event_id AS VARCHAR)
              WHEN event_id % 107 = 0 THEN chr(160) || CAST(event_id AS VARCHAR) || chr(8195)
              ELSE CAST(event_id AS VARCHAR) END AS id,
         CASE WHEN event_id % 89 = 0 THEN '32/01/2024' ELSE strftime(ts, '%d/%m/%Y') END AS date,
         CASE WHEN event_id % 83 = 0 THEN 'not-a-number' WHEN event_id % 109 = 0 THEN '1e20'
              WHEN event_id % 113 = 0 THEN '+1e-7' WHEN event_id % 127 = 0 THEN '-1e-7'
              ELSE (CASE WHEN event_type IN ('purchase', 'error') THEN '-' ELSE '+' END)
                   || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS "transaction"
  FROM events),
trimmed AS (
  SELECT *, trim(id, ' ' || chr(160) || chr(8195)) AS tid, trim(date) AS tdate, trim("transaction") AS tamt,
         CASE WHEN starts_with(trim("transaction"), '+') THEN substr(trim("transaction"), 2)
              ELSE trim("transaction") END AS samt
  FROM raw),
parsed AS (
  SELECT *,
    CASE WHEN regexp_full_match(tid, '[+-]?[0-9]+') THEN TRY_CAST(tid AS BIGINT) END AS pid,
    CASE WHEN regexp_full_match(tdate, '[0-9]{2}/[0-9]{2}/[0-9]{4}')
         THEN CAST(try_strptime(tdate, '%d/%m/%Y') AS DATE) END AS pdate,
    CASE WHEN regexp_full_match(samt, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
         THEN TRY_CAST(samt AS DOUBLE) END AS amount
  FROM trimmed),
classified AS (
  SELECT *,
    CASE WHEN pid IS NULL THEN 'ID' WHEN pdate IS NULL THEN 'Date' WHEN amount IS NULL THEN 'Amount' END AS error_field,
    CASE WHEN pid IS NULL THEN 'parser: field ID: expected int, got "' || replace(replace(coalesce(id, ''), '\', '\\'), '"', '\"') || '"'
         WHEN pdate IS NULL THEN 'parser: field Date: expected dd/mm/yyyy, got "' || replace(replace(coalesce(date, ''), '\', '\\'), '"', '\"') || '"'
         WHEN amount IS NULL THEN 'parser: field Amount: expected float, got "' || replace(replace(coalesce(tamt, ''), '\', '\\'), '"', '\"') || '"'
    END AS error
  FROM parsed),
ordered AS (
  SELECT *,
    CAST(sum(CASE WHEN error_field IS NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS row_no,
    CAST(sum(CASE WHEN error_field IS NULL THEN 0 ELSE 1 END) OVER w AS BIGINT) AS err_no,
    sum(CASE WHEN error_field IS NULL AND abs(amount) < 1e16 THEN CAST(amount AS DECIMAL(38,12)) ELSE 0 END) OVER w AS run_exact,
    sum(CASE WHEN error_field IS NULL AND abs(amount) >= 1e16 THEN amount ELSE 0 END) OVER w AS run_rest,
    CAST(sum(CASE WHEN error_field IS NULL AND amount > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS run_credits
  FROM classified
  WINDOW w AS (PARTITION BY file_key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
valid AS (
  SELECT account_id, file_key, event_id, pid AS id, pdate AS date, amount FROM classified WHERE error_field IS NULL),
errors AS (
  SELECT account_id, file_key, err_no, row_no AS "row", error_field AS field, error
  FROM ordered WHERE error_field IS NOT NULL AND err_no <= 4),
outcome AS (
  SELECT account_id, file_key,
    CAST(count(*) FILTER (WHERE error_field IS NULL) AS BIGINT) AS valid_rows,
    CAST(count(*) FILTER (WHERE error_field IS NOT NULL) AS BIGINT) AS invalid_rows
  FROM classified GROUP BY account_id, file_key)"""

# L3: file states from events.
L3 = """
manifest AS (SELECT DISTINCT user_id AS file_key, user_id AS account_id FROM events),
fstatus AS (
  SELECT file_key, account_id,
    CASE WHEN account_id % 7 IN (1, 2, 3) THEN 'done' WHEN account_id % 7 = 4 THEN 'processing'
         WHEN account_id % 7 = 5 THEN 'failed' ELSE 'to_review' END AS status,
    TIMESTAMP '2024-02-01 00:00:00' - to_seconds(account_id % 41) AS heartbeat_at
  FROM manifest WHERE account_id % 7 <> 0),
fsummary AS (
  SELECT file_key, account_id, (account_id % 7 = 1) AS email_sent
  FROM manifest WHERE account_id % 7 IN (1, 2) OR (account_id % 7 = 5 AND account_id % 2 = 0))"""

ACCOUNTS = """
accounts AS (
  SELECT c_custkey AS account_id,
    CASE WHEN c_custkey % 13 = 0 THEN 'not-an-email'
         ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
    c_name AS name, c_mktsegment AS segment
  FROM customer)"""


def _sum(x: str, where: str = "true") -> str:
    """Sum as a double: exact decimals, plus what no decimal holds."""
    return (f"(CAST(coalesce(sum(CAST({x} AS DECIMAL(38,12))) FILTER (WHERE ({where}) AND abs({x}) < 1e16), 0) AS DOUBLE)"
            f" + coalesce(sum(CAST({x} AS DOUBLE)) FILTER (WHERE ({where}) AND abs({x}) >= 1e16), 0))")


def _fmt2(x: str) -> str:
    """``%.2f`` of the exact binary value, as in C."""
    return f"printf('%.2f', CAST({x} AS DOUBLE))"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def _monthly(src: str) -> str:
    return f"""
SELECT account_id, file_key, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month_num,
  monthname(min(date)) AS month,
  CAST(count(*) AS BIGINT) AS txn_count,
  CAST(count(*) FILTER (WHERE amount > 0) AS BIGINT) AS credit_count,
  CAST(count(*) FILTER (WHERE amount <= 0) AS BIGINT) AS debit_count,
  {_sum("amount", "amount > 0")} AS credit_sum, {_sum("amount", "amount <= 0")} AS debit_sum,
  coalesce({_sum("amount", "amount > 0")} / nullif(count(*) FILTER (WHERE amount > 0), 0), 0.0) AS avg_credit,
  coalesce({_sum("amount", "amount <= 0")} / nullif(count(*) FILTER (WHERE amount <= 0), 0), 0.0) AS avg_debit
FROM {src}
GROUP BY account_id, file_key, year(date), month(date)"""


L1_TOTALS = """
l1_totals AS (
  SELECT account_id, file_key, CAST(sum(amount) AS DOUBLE) AS total_balance, CAST(count(*) AS BIGINT) AS txn_count
  FROM l1 GROUP BY account_id, file_key)"""


L5 = r"""
ev AS (
  SELECT user_id AS account_id, CAST(floor(event_id / 1048576) AS BIGINT) AS chunk, event_id,
         CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 103 = 0 THEN chr(1) || CAST(event_id AS VARCHAR)
              WHEN event_id % 107 = 0 THEN chr(160) || CAST(event_id AS VARCHAR) || chr(8195)
              ELSE CAST(event_id AS VARCHAR) END AS id,
         CASE WHEN event_id % 89 = 0 THEN '32/01/2024' ELSE strftime(ts, '%d/%m/%Y') END AS date,
         CASE WHEN event_id % 83 = 0 THEN 'not-a-number' WHEN event_id % 109 = 0 THEN '1e20'
              WHEN event_id % 113 = 0 THEN '+1e-7' WHEN event_id % 127 = 0 THEN '-1e-7'
              ELSE (CASE WHEN event_type IN ('purchase', 'error') THEN '-' ELSE '+' END)
                   || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS "transaction",
         (event_id % 101 = 0) AS malformed,
         CASE WHEN user_id % 2 = 1 AND event_id % 7 = 3 THEN 2 ELSE 1 END AS n_lines,
         CASE WHEN user_id % 4 = 3 THEN 2 ELSE 1 END AS head_lines
  FROM events),
parsed AS (
  SELECT *,
    CASE WHEN regexp_full_match(trim(id, ' ' || chr(160) || chr(8195)), '[+-]?[0-9]+') THEN TRY_CAST(trim(id, ' ' || chr(160) || chr(8195)) AS BIGINT) END AS pid,
    CASE WHEN regexp_full_match(trim(date), '[0-9]{2}/[0-9]{2}/[0-9]{4}')
         THEN CAST(try_strptime(trim(date), '%d/%m/%Y') AS DATE) END AS pdate,
    CASE WHEN regexp_full_match(CASE WHEN starts_with(trim("transaction"), '+') THEN substr(trim("transaction"), 2)
                                     ELSE trim("transaction") END,
                                '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
         THEN TRY_CAST(CASE WHEN starts_with(trim("transaction"), '+') THEN substr(trim("transaction"), 2)
                            ELSE trim("transaction") END AS DOUBLE) END AS amount
  FROM ev WHERE account_id % 50 <> 10),
classified AS (
  SELECT *,
    CASE WHEN malformed THEN 'Record' WHEN pid IS NULL THEN 'ID' WHEN pdate IS NULL THEN 'Date'
         WHEN amount IS NULL THEN 'Amount' END AS error_field
  FROM parsed),
ordered AS (
  SELECT *,
    CAST(sum(CASE WHEN error_field IS NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS row_no,
    CAST(sum(CASE WHEN error_field IS NULL THEN 0 ELSE 1 END) OVER w AS BIGINT) AS err_no,
    CAST(head_lines + sum(n_lines) OVER w - n_lines + 1 AS BIGINT) AS line_no
  FROM classified
  WINDOW w AS (PARTITION BY account_id, chunk ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
errors AS (
  SELECT account_id, chunk, err_no, row_no AS "row",
    CASE WHEN error_field = 'Record' THEN 'record on line ' || CAST(line_no AS VARCHAR) || ': wrong number of fields'
         WHEN error_field = 'ID' THEN 'parser: field ID: expected int, got "' || coalesce(id, '') || '"'
         WHEN error_field = 'Date' THEN 'parser: field Date: expected dd/mm/yyyy, got "' || coalesce(date, '') || '"'
         ELSE 'parser: field Amount: expected float, got "' || coalesce(trim("transaction"), '') || '"' END AS error
  FROM ordered WHERE error_field IS NOT NULL AND err_no <= 4),
outcome AS (
  SELECT account_id, chunk,
    CAST(count(*) FILTER (WHERE error_field IS NULL) AS BIGINT) AS valid_rows,
    CAST(count(*) FILTER (WHERE error_field IS NOT NULL) AS BIGINT) AS invalid_rows
  FROM classified GROUP BY account_id, chunk),
lists AS (
  SELECT account_id, chunk, CAST(to_json(list({'row': "row", 'error': error} ORDER BY err_no)) AS VARCHAR) AS j
  FROM errors GROUP BY account_id, chunk)"""

L5_STATUS = _with(L5) + r"""
SELECT o.account_id, o.chunk,
  CASE WHEN o.invalid_rows > 3 THEN 'to_review' ELSE 'done' END AS status,
  CAST(CASE WHEN o.invalid_rows > 3 THEN 0 ELSE o.valid_rows END AS BIGINT) AS checkpoint_row,
  o.valid_rows, o.invalid_rows, coalesce(l.j, '[]') AS row_errors_json, CAST(NULL AS VARCHAR) AS reason
FROM outcome o LEFT JOIN lists l ON o.account_id = l.account_id AND o.chunk = l.chunk
UNION ALL
SELECT DISTINCT account_id, chunk, 'rejected', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '[]',
  'parser: missing required column "date"'
FROM ev WHERE account_id % 50 = 10"""


ORACLE_SQL: dict[str, str] = {
    "monthly_summary": _with(L1) + _monthly("l1"),

    "account_totals": _with(L1) + """
SELECT account_id, file_key, CAST(sum(amount) AS DOUBLE) AS total_balance, CAST(count(*) AS BIGINT) AS txn_count
FROM l1 GROUP BY account_id, file_key""",

    "yearly_counts": _with(L1) + """
SELECT account_id, file_key, CAST(year(date) AS INT) AS year, CAST(count(*) AS BIGINT) AS txn_count
FROM l1 GROUP BY account_id, file_key, year(date)""",

    "credit_debit_totals": _with(L1) + """
SELECT account_id, file_key,
  CAST(count(*) FILTER (WHERE amount > 0) AS BIGINT) AS credit_count,
  CAST(count(*) FILTER (WHERE amount <= 0) AS BIGINT) AS debit_count,
  CAST(coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS DOUBLE) AS credit_total,
  CAST(coalesce(sum(amount) FILTER (WHERE amount <= 0), 0) AS DOUBLE) AS debit_total
FROM l1 GROUP BY account_id, file_key""",

    "ledger_rollup": _with(L2) + """
SELECT account_id, year, month_num, CAST(GROUPING(account_id, year, month_num) AS INT) AS level,
  CAST(count(*) AS BIGINT) AS txn_count, """ + _sum("amount") + """ AS balance
FROM (SELECT account_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month_num, amount FROM valid) v
GROUP BY ROLLUP (account_id, year, month_num)""",

    "ledger_with_account": _with(L1, L1_TOTALS, ACCOUNTS) + """
SELECT t.account_id, t.file_key, t.total_balance, t.txn_count, a.name, a.segment
FROM l1_totals t JOIN accounts a ON t.account_id = a.account_id""",

    "orphan_accounts": _with(L1, ACCOUNTS) + """
SELECT account_id, CAST(count(*) AS BIGINT) AS txn_count FROM l1
WHERE account_id NOT IN (SELECT account_id FROM accounts WHERE account_id % 10 <> 0)
GROUP BY account_id""",

    "ledger_valid_rows": _with(L2) + """
SELECT account_id, file_key, id, CAST(date AS VARCHAR) AS txn_date, CAST(amount AS DOUBLE) AS amount FROM valid""",

    "row_error_details": _with(L2) + """
SELECT account_id, file_key, err_no, "row", field, error FROM errors""",

    "file_status": _with(L2) + """
SELECT o.account_id, o.file_key,
  CASE WHEN o.invalid_rows > 3 THEN 'to_review' ELSE 'done' END AS status,
  CAST(CASE WHEN o.invalid_rows > 3 THEN 0 ELSE o.valid_rows END AS BIGINT) AS checkpoint_row,
  o.valid_rows, o.invalid_rows,
  coalesce(e.row_errors_json, '[]') AS row_errors_json
FROM outcome o LEFT JOIN (
  SELECT file_key, CAST(to_json(list({'row': "row", 'error': error} ORDER BY err_no)) AS VARCHAR) AS row_errors_json
  FROM errors GROUP BY file_key) e ON o.file_key = e.file_key""",

    "monthly_summary_accepted": _with(L2) + """
SELECT * FROM (""" + _monthly("valid") + """) m
WHERE file_key IN (SELECT file_key FROM outcome WHERE invalid_rows <= 3)""",

    "checkpoint_snapshots": _with(L2) + """
SELECT account_id, file_key, row_no AS checkpoint_row, CAST(run_exact AS DOUBLE) + run_rest AS balance,
  run_credits AS credit_count, row_no - run_credits AS debit_count
FROM ordered
WHERE error_field IS NULL AND row_no % 20 = 0 AND err_no <= 3""",

    "resume_from_checkpoint": _with(L2) + """
SELECT account_id, file_key, CAST(count(*) AS BIGINT) AS txn_count, """ + _sum("amount") + """ AS balance
FROM ordered
WHERE error_field IS NULL AND row_no > file_key % 30
GROUP BY account_id, file_key""",

    "merge_partial_summaries": _with(L1) + _monthly("l1"),

    "latest_per_key": """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",

    "summary_upsert": """
WITH old AS (
  SELECT o_custkey AS file_key, o_custkey AS account_id,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_balance, (o_custkey % 2 = 0) AS email_sent
  FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND o_custkey % 3 <> 0 GROUP BY o_custkey),
new AS (
  SELECT o_custkey AS file_key, o_custkey AS account_id,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_balance, false AS email_sent
  FROM orders WHERE o_custkey % 5 <> 0 GROUP BY o_custkey)
SELECT coalesce(o.file_key, n.file_key) AS file_key,
  CASE WHEN coalesce(o.email_sent, false) OR n.file_key IS NULL THEN o.account_id ELSE n.account_id END AS account_id,
  CASE WHEN coalesce(o.email_sent, false) OR n.file_key IS NULL THEN o.total_balance ELSE n.total_balance END AS total_balance,
  CASE WHEN coalesce(o.email_sent, false) OR n.file_key IS NULL THEN o.email_sent ELSE n.email_sent END AS email_sent,
  CASE WHEN coalesce(o.email_sent, false) OR n.file_key IS NULL THEN 'old' ELSE 'new' END AS source
FROM old o FULL OUTER JOIN new n ON o.file_key = n.file_key""",

    "file_keys": """
SELECT c_custkey,
  substr(sha256(CAST(c_custkey AS VARCHAR) || '_' || c_mktsegment || '/' || c_name || '.csv'), 1, 32) AS file_key
FROM customer""",

    "file_triage": _with(L3) + """
SELECT m.file_key, m.account_id, s.status,
  CASE WHEN coalesce(f.email_sent, false) THEN 'skip'
       WHEN f.file_key IS NOT NULL AND s.status = 'done' THEN 'send_only'
       WHEN s.status IS NULL THEN 'process'
       WHEN s.status = 'done' THEN 'error_already_processed'
       WHEN s.status = 'processing' AND s.heartbeat_at > TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 SECOND THEN 'locked'
       ELSE 'resume' END AS action
FROM manifest m LEFT JOIN fstatus s ON m.file_key = s.file_key LEFT JOIN fsummary f ON m.file_key = f.file_key""",

    "claimed_files": """
WITH users AS (SELECT DISTINCT user_id, user_id % 7 AS k FROM events)
SELECT user_id,
       CASE WHEN k IN (1, 2, 3) OR (k = 4 AND user_id % 2 = 0) THEN 'done' WHEN k = 4 THEN 'to_review'
            WHEN k = 5 THEN 'processing' WHEN k = 6 THEN 'failed' WHEN user_id % 3 = 0 THEN 'processing' END AS status,
       CASE WHEN k = 5 THEN '2024-01-31 23:59:55' WHEN k <> 0 THEN '2024-02-01 00:00:00'
            WHEN user_id % 3 = 0 THEN '2024-01-31 23:59:40' END AS heartbeat,
       CASE WHEN k = 1 THEN 'skip' WHEN k = 2 OR (k = 4 AND user_id % 2 = 0) THEN 'send_only'
            WHEN k = 3 THEN 'error_already_processed' WHEN k = 5 THEN 'locked'
            WHEN k IN (4, 6) OR user_id % 3 = 0 THEN 'resume' ELSE 'process' END AS action
FROM users""",

    "state_after_compaction": """
SELECT o_custkey AS customer, 'y' || max(year(o_orderdate)) AS last_year, CAST(count(*) AS BIGINT) AS orders
FROM (SELECT *, CASE WHEN year(o_orderdate) <= 1993 THEN 1 WHEN year(o_orderdate) = 1994 THEN 2 ELSE 3 END AS part
      FROM orders)
GROUP BY o_custkey, part
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY part DESC) = 1""",

    "unprocessed_files": _with(L3) + """
SELECT file_key, account_id FROM manifest
WHERE file_key NOT IN (SELECT file_key FROM fstatus WHERE status = 'done')""",

    "pending_statements": _with(L3, ACCOUNTS) + r"""
SELECT f.file_key, f.account_id, a.email
FROM fsummary f
JOIN accounts a ON f.account_id = a.account_id
WHERE NOT coalesce(f.email_sent, false)
  AND f.file_key IN (SELECT file_key FROM fstatus WHERE status = 'done')
  AND regexp_full_match(trim(a.email), '[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*@[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*')""",

    "constraint_report": _with(L2, L3, ACCOUNTS) + """
, raw2 AS (SELECT file_key, id, CASE WHEN event_id % 101 = 3 THEN ' ' ELSE date END AS date FROM raw),
status1 AS (
  SELECT file_key, CASE WHEN file_key % 13 = 6 THEN 'lost' ELSE status END AS status,
         CASE WHEN file_key % 11 <> 2 THEN heartbeat_at END AS heartbeat_at FROM fstatus),
status2 AS (SELECT * FROM status1 UNION ALL SELECT * FROM status1 WHERE file_key % 17 = 5),
summary1 AS (SELECT file_key, CASE WHEN file_key % 5 <> 1 THEN email_sent END AS email_sent FROM fsummary),
summary2 AS (SELECT * FROM summary1 UNION ALL SELECT * FROM summary1 WHERE file_key % 9 = 5),
account1 AS (SELECT account_id, CASE WHEN account_id % 53 <> 9 THEN email END AS email FROM accounts),
account2 AS (SELECT * FROM account1 UNION ALL SELECT * FROM account1 WHERE account_id % 71 = 5)
SELECT 'ledger_id_missing' AS rule, CAST(count(*) FILTER (WHERE id IS NULL OR trim(id) = '') AS BIGINT) AS violations FROM raw2
UNION ALL SELECT 'ledger_date_missing', CAST(count(*) FILTER (WHERE date IS NULL OR trim(date) = '') AS BIGINT) FROM raw2
UNION ALL SELECT 'status_not_in_enum', CAST(count(*) FILTER (WHERE status IS NULL OR status NOT IN ('processing', 'done', 'failed', 'to_review')) AS BIGINT) FROM status2
UNION ALL SELECT 'heartbeat_null', CAST(count(*) FILTER (WHERE heartbeat_at IS NULL) AS BIGINT) FROM status2
UNION ALL SELECT 'email_sent_null', CAST(count(*) FILTER (WHERE email_sent IS NULL) AS BIGINT) FROM summary2
UNION ALL SELECT 'email_null', CAST(count(*) FILTER (WHERE email IS NULL) AS BIGINT) FROM account2
UNION ALL SELECT 'ledger_file_date_repeats', CAST(count(*) AS BIGINT) FROM (SELECT file_key, date FROM raw2 GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'status_key_duplicates', CAST(count(*) AS BIGINT) FROM (SELECT file_key FROM status2 GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'summary_key_duplicates', CAST(count(*) AS BIGINT) FROM (SELECT file_key FROM summary2 GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'account_key_duplicates', CAST(count(*) AS BIGINT) FROM (SELECT account_id FROM account2 GROUP BY ALL HAVING count(*) > 1)""",

    "statement_rows": _with(L1, L1_TOTALS) + """
SELECT m.account_id, m.file_key,
  CAST(row_number() OVER (PARTITION BY m.account_id, m.file_key ORDER BY m.year, m.month_num) AS INT) AS seq,
  m.year, m.month_num, m.month || ' ' || CAST(m.year AS VARCHAR) AS month_label, m.txn_count,
  m.avg_credit, m.avg_debit, abs(m.avg_debit) AS avg_debit_abs, t.total_balance, CAST(0 AS BIGINT) AS invalid_rows,
  '+$' || """ + _fmt2("m.avg_credit") + """ AS credit_cell,
  '-$' || """ + _fmt2("abs(m.avg_debit)") + """ AS debit_cell,
  '$' || """ + _fmt2("t.total_balance") + """ AS balance_cell
FROM (""" + _monthly("l1") + """) m JOIN l1_totals t ON m.account_id = t.account_id AND m.file_key = t.file_key""",

    "summary_roundtrip": _with(L1, L1_TOTALS) + """
SELECT m.account_id, m.file_key, m.year, m.month_num, m.month, m.txn_count, m.avg_credit, m.avg_debit,
  t.total_balance, CAST(0 AS BIGINT) AS invalid_rows
FROM (""" + _monthly("l1") + """) m JOIN l1_totals t ON m.account_id = t.account_id AND m.file_key = t.file_key""",

    "statement_payloads": _with(L2, L3, ACCOUNTS) + r"""
, due AS (
  SELECT f.file_key, f.account_id, a.email
  FROM fsummary f JOIN accounts a ON f.account_id = a.account_id
  WHERE NOT coalesce(f.email_sent, false)
    AND f.file_key IN (SELECT file_key FROM fstatus WHERE status = 'done')
    AND regexp_full_match(trim(a.email), '[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*@[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*')),
months AS (
  SELECT file_key, year(date) AS y, month(date) AS m, count(*) AS n FROM valid GROUP BY ALL),
first_month AS (
  SELECT file_key, CAST(arg_min(n, y * 12 + m) AS BIGINT) AS first_month_txns, CAST(count(*) AS INT) AS months
  FROM months GROUP BY file_key),
totals AS (
  SELECT file_key, """ + _sum("amount") + r""" AS total_balance FROM valid GROUP BY file_key)
SELECT d.file_key, d.account_id, d.email AS "to", 'Account statement ' || CAST(d.account_id AS VARCHAR) AS subject,
  t.total_balance, fm.months, fm.first_month_txns, o.invalid_rows
FROM due d
JOIN outcome o ON o.file_key = d.file_key AND o.invalid_rows <= 3
JOIN totals t ON t.file_key = d.file_key
JOIN first_month fm ON fm.file_key = d.file_key""",
    "csv_file_status": L5_STATUS,
    "stream_file_status": L5_STATUS,
    "summary_json": _with(L1) + """
, m AS (""" + _monthly("l1") + """),
yrs AS (
  SELECT account_id, file_key, year, sum(txn_count) AS ycount,
    map_from_entries(list({'key': month, 'value': {'Month': month, 'MonthNum': month_num, 'TxnCount': txn_count,
        'AvgCredit': avg_credit, 'AvgDebit': avg_debit, 'CreditCount': credit_count, 'DebitCount': debit_count}}
        ORDER BY month)) AS by_month
  FROM m GROUP BY ALL),
files AS (
  SELECT account_id, file_key,
    map_from_entries(list({'key': lpad(CAST(year AS VARCHAR), 4, '0'),
                           'value': {'TxnCount': CAST(ycount AS BIGINT), 'ByMonth': by_month}} ORDER BY year)) AS by_year
  FROM yrs GROUP BY ALL),
tot AS (SELECT account_id, file_key, CAST(sum(amount) AS DOUBLE) AS total FROM l1 GROUP BY ALL)
SELECT t.account_id, t.file_key,
  CAST(to_json({'AccountID': CAST(t.account_id AS VARCHAR), 'TotalBalance': t.total, 'ByYear': f.by_year,
                'InvalidRows': CAST(0 AS BIGINT)}) AS VARCHAR) AS summary_json
FROM tot t JOIN files f ON t.account_id = f.account_id AND t.file_key = f.file_key""",
    "statement_html": _with(L1) + """
, m AS (""" + _monthly("l1") + """),
rows AS (
  SELECT account_id, file_key,
    string_agg('<tr><td>' || month || ' ' || CAST(year AS VARCHAR) || '</td><td>' || CAST(txn_count AS VARCHAR)
               || '</td><td>+$' || """ + _fmt2("avg_credit") + """
               || '</td><td>-$' || """ + _fmt2("abs(avg_debit)") + """ || '</td></tr>', '' ORDER BY year, month_num) AS body
  FROM m GROUP BY ALL),
tot AS (SELECT account_id, file_key, CAST(sum(amount) AS DOUBLE) AS total FROM l1 GROUP BY ALL)
SELECT t.account_id, t.file_key,
  '<html><body><h1>Account statement</h1><p>Balance: $' || """ + _fmt2("t.total") + """
  || '</p><table><tr><th>Month</th><th>Transactions</th><th>Average credit</th><th>Average debit</th></tr>'
  || r.body || '</table></body></html>' AS html
FROM tot t JOIN rows r ON t.account_id = r.account_id AND t.file_key = r.file_key""",
    "merge_stored_summaries": _with(L1) + _monthly("l1"),

    "account_summaries": _with(L1) + """
SELECT * FROM (""" + _monthly("l1") + """) m WHERE account_id = 7""",

    "outbox_after_delivery": _with(L3, ACCOUNTS) + r"""
SELECT f.file_key, f.account_id, a.email
FROM fsummary f
JOIN accounts a ON f.account_id = a.account_id
WHERE NOT coalesce(f.email_sent, false) AND f.file_key % 2 <> 0
  AND f.file_key IN (SELECT file_key FROM fstatus WHERE status = 'done')
  AND regexp_full_match(trim(a.email), '[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*@[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*')""",

    "statement_notes": _with(L2) + """
SELECT o.account_id, o.file_key, o.invalid_rows > 0 AS has_note, o.invalid_rows AS skipped, m.months
FROM outcome o
JOIN (SELECT file_key, CAST(count(DISTINCT year(date) * 12 + month(date)) AS BIGINT) AS months
      FROM valid GROUP BY file_key) m ON m.file_key = o.file_key
WHERE o.invalid_rows <= 3""",

    "statement_payload_json": _with(L1) + """
, m AS (""" + _monthly("l1") + """),
files AS (
  SELECT account_id, file_key,
    list({'Year': year, 'MonthNum': month_num, 'Month': month, 'TxnCount': txn_count, 'AvgCredit': avg_credit,
          'AvgDebit': avg_debit} ORDER BY year, month_num) AS months
  FROM m GROUP BY ALL),
tot AS (SELECT account_id, file_key, CAST(sum(amount) AS DOUBLE) AS total FROM l1 GROUP BY ALL)
SELECT t.account_id, t.file_key,
  CAST(to_json({'TotalBalance': t.total, 'ByYear': f.months, 'InvalidRows': CAST(0 AS BIGINT)}) AS VARCHAR)
    AS payload_json
FROM tot t JOIN files f ON t.account_id = f.account_id AND t.file_key = f.file_key""",

    "manifest_files": """
SELECT user_id, CAST(floor(event_id / 1048576) AS BIGINT) AS chunk,
  CASE WHEN user_id % 11 <> 3 AND user_id % 13 <> 5 AND user_id % 50 <> 10
       THEN 'ACC-' || CAST(user_id AS VARCHAR) END AS account_id,
  CAST(CASE WHEN user_id % 11 <> 3 AND user_id % 13 <> 5 AND user_id % 50 <> 10 THEN count(*) ELSE 0 END AS BIGINT)
    AS records,
  CASE WHEN user_id % 11 = 3 THEN 'manifest: file not listed'
       WHEN user_id % 13 = 5 THEN 'manifest: file listed more than once'
       WHEN user_id % 50 = 10 THEN 'parser: missing required column "date"' END AS reason
FROM events GROUP BY user_id, floor(event_id / 1048576)""",

    "stream_running_months": _with(L1) + """
SELECT * EXCLUDE (file_key) FROM (""" + _monthly("l1") + """) m""",

    "stream_account_monthly": _with(L5) + """
SELECT account_id, CAST(year(pdate) AS INT) AS year, CAST(month(pdate) AS INT) AS month_num,
  CAST(count(*) AS BIGINT) AS txn_count,
  CAST(count(*) FILTER (WHERE amount > 0) AS BIGINT) AS credit_count,
  CAST(count(*) FILTER (WHERE amount <= 0) AS BIGINT) AS debit_count,
  """ + _sum("amount", "amount > 0") + """ AS credit_sum, """ + _sum("amount", "amount <= 0") + """ AS debit_sum
FROM classified c JOIN outcome o USING (account_id, chunk)
WHERE c.error_field IS NULL AND o.invalid_rows <= 3
GROUP BY account_id, year(pdate), month(pdate)""",
}
