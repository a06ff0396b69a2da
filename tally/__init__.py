"""tally: validate, aggregate, track and report on account ledgers with Spark.

Sub-packages:
  functions  - column expressions (parsing, calendar, keys, formatting, predicates)
  sources    - ledger readers (CSV files, any table with the ledger columns)
  operators  - validation, running ordinals, summaries, state tables, reports
  plans      - derived test ledgers, the registered queries and their oracle SQL
  streaming  - incremental intake of arriving ledger files
"""

__version__ = "0.1.0"
