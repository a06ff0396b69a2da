"""Scalar parsing and formatting functions."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tally.functions import calendar, keys, money, parse, predicates, text


def _one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_parse_id(spark):
    cases = {" 007 ": 7, "+7": 7, "-7": -7, "1.0": None, "1e2": None, "": None, None: None,
             "9223372036854775807": 9223372036854775807, "9223372036854775808": None, "7 7": None,
             " 7　": 7, "\x017": None, "8\x02": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["p"] for r in df.select("v", parse.parse_id("v").alias("p")).collect()}
    assert got == cases


def test_parse_date(spark):
    cases = {"15/07/2026": dt.date(2026, 7, 15), " 02/08/2026 ": dt.date(2026, 8, 2), "5/1/2025": None,
             "05/01/25": None, "05/01/20255": None, "32/01/2025": None, "31/04/2025": None,
             "29/02/2023": None, "29/02/2024": dt.date(2024, 2, 29), "01/13/2025": None,
             "15/07/2026x": None, "not-a-date": None, "": None, None: None, "2026-07-15": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["p"] for r in df.select("v", parse.parse_date("v").alias("p")).collect()}
    assert got == cases


def test_parse_amount(spark):
    cases = {"+88.5": 88.5, "-13.25": -13.25, "+0.00": 0.0, "++5": 5.0, "+-5": -5.0, " 1e2 ": 100.0, ".5": 0.5,
             "5.": 5.0, "1e20": 1e20, "1e-7": 1e-7, "-1e-7": -1e-7, "1e300": 1e300, "1e-400": 0.0, "\x015": None,
             "1.5f": None, "1.5d": None, "NaN": None, "Infinity": None, "inf": None, "0x1p-2": None,
             "1e400": None, "not-a-number": None, "": None, None: None, "+++5": None, "1,5": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["p"] for r in df.select("v", parse.parse_amount("v").alias("p")).collect()}
    assert got == cases


def test_totals_are_exact_and_drop_nothing(spark):
    amounts = [0.1] * 10 + [1e20, -1e20, 1e-7, -2.5e-13, 1e15 + 0.5, None]
    df = spark.createDataFrame([(a,) for a in amounts], "a double")
    parts = df.select(money.exact_part("a").alias("e"), money.rest_part("a").alias("r")).collect()
    assert sum(r["e"] is not None for r in parts) == 12 and sum(r["r"] is not None for r in parts) == 3
    small = df.filter("abs(a) < 1")
    assert small.filter("a > 0.01").agg(money.total("a").alias("t")).first()["t"] == 1.0
    assert df.limit(0).agg(money.total("a").alias("t")).first()["t"] == 0.0


def test_trim_and_plus(spark):
    assert _one(spark, text.trim_space("v"), "\t  a b  \n") == "a b"
    assert _one(spark, text.strip_one_plus("v"), "++5") == "+5"
    assert _one(spark, text.quote_text("v"), 'a"b\\c') == '"a\\"b\\\\c"'
    assert _one(spark, text.quote_text("v"), None) == '""'


def test_calendar(spark):
    d = F.col("v").cast("date")
    assert _one(spark, calendar.month_name(d), "2026-07-15") == "July"
    assert _one(spark, calendar.month_num(d), "2026-07-15") == 7


def test_file_key(spark):
    # the first 16 bytes of the SHA-256 of "<account>_<path>", in hex
    import hashlib
    want = hashlib.sha256(b"harbor_2022/q4.csv").hexdigest()[:32]
    df = spark.createDataFrame([("harbor", "2022/q4.csv")], "a string, p string")
    assert df.select(keys.file_key("a", "p").alias("k")).first()["k"] == want


def test_money_cells(spark):
    assert _one(spark, money.balance_cell("v"), -31.5, "v double") == "$-31.50"
    assert _one(spark, money.credit_cell("v"), 88.5, "v double") == "+$88.50"
    assert _one(spark, money.debit_cell("v"), -13.25, "v double") == "-$13.25"
    assert _one(spark, money.month_label(F.lit("October"), F.col("v")), 2022, "v int") == "October 2022"


def test_predicates(spark):
    want = {"dock@harbor.example": True, "no address": False, "a.b+c@d.e": True, "a..b@c": False, "@x": False,
            "a@b": True, "Ana <a@x.io>": True, '"Last, First" <l.f@x.io>': True, '"two words"@x.io': True,
            "<a@x.io>": True, "Ana a@x.io": False, "Ana <a@x.io": False, '"open@x.io': False, "jörg@straße.de": True,
            "a@b@c": False, "a b@c": False, "a@b,": False, None: False}
    df = spark.createDataFrame([(x,) for x in want], "v string")
    got = {r["v"]: r["ok"] for r in df.select("v", predicates.valid_email("v").alias("ok")).collect()}
    assert got == want
    amts = spark.createDataFrame([(Decimal("1"),), (Decimal("0"),), (Decimal("-1"),)], "a decimal(24,6)")
    flags = [r["c"] for r in amts.select(predicates.is_credit("a").alias("c")).collect()]
    assert flags == [True, False, False]


def test_lease(spark):
    now = dt.datetime(2024, 2, 1)
    rows = [("processing", "2024-01-31 23:59:45"), ("processing", "2024-01-31 23:59:40"),
            ("processing", "2024-01-31 23:59:39"), ("failed", "2024-01-31 23:59:59")]
    df = spark.createDataFrame(rows, "s string, h string").withColumn("h", F.col("h").cast("timestamp_ntz"))
    got = [r["f"] for r in df.select(predicates.lease_is_fresh("s", "h", now, 20).alias("f")).collect()]
    assert got == [True, False, False, False]


def test_parse_id_against_python(spark):
    vals = ["7", "+7", "-7", "007", "1.0", "1.", ".1", "1e2", "0x10", "", " ", "+", "-", "--1", "+-1",
            "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809",
            "١٢", "７", "1_000", "1 000", "12a", "\t7", "7 ", "0", "-0", "+0", "00000000000000000000001"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    import re

    def want(v):
        t = v.strip()
        return int(t) if re.fullmatch("[+-]?[0-9]+", t) and -2**63 <= int(t) < 2**63 else None

    got = {r["v"]: r["p"] for r in df.select("v", parse.parse_id("v").alias("p")).collect()}
    assert got == {v: want(v) for v in vals}


def test_two_decimals_round_the_exact_value(spark):
    """As C's ``%.2f`` (and Python's): from the exact binary value, ties to even."""
    import math
    import random

    from tally.functions.money import two_decimals
    rng = random.Random(5)
    values = [0.125, 1.005, 12345678.9, 0.375, 0.005, 0.015, 2.675, -0.001, -0.0, 0.0, 1e-320, 99.995, 0.994999999, 0.995,
              9007199254740991.0, 9007199254740992.0, 4503599627370495.5, 1e15 + 0.125, 1e20, 1e22, 1e23, -1e23, 2.0 ** 100 * 3,
              4.2e37, 123456789012.345, -45.0, 1e16, 2.0 ** 63, 2.0 ** 64 - 2048]
    values += [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-4, 36) for _ in range(400)]
    values += [k / 8 for k in range(-40, 40)] + [math.nextafter(k / 200, s * 9e9) for k in range(300) for s in (-1, 1)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["t"] for r in df.select("i", two_decimals("v").alias("t")).collect()}
    assert {i: (v, got[i]) for i, v in enumerate(values) if got[i] != "%.2f" % v} == {}
    assert spark.range(1).select(two_decimals(F.lit(None).cast("double")).alias("t")).first()["t"] is None
