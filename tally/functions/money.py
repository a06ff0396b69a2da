"""Statement cell formatting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


#: Amounts of up to 16 digits before and 12 after the point are summed exactly.
EXACT_TYPE = "decimal(38,12)"
EXACT_BELOW = 1e16


def exact_part(amount) -> Column:
    """The amount as a decimal where that is the same number, else NULL."""
    a = _c(amount)
    d = a.try_cast(EXACT_TYPE)
    return F.when((F.abs(a) < EXACT_BELOW) & (d.cast("double") == a.cast("double")), d)


def rest_part(amount) -> Column:
    """The amount as a double where it has no exact part, else NULL."""
    a = _c(amount)
    return F.when(exact_part(a).isNull(), a.cast("double"))


def sums_exactly(df: DataFrame, column: str = "amount") -> bool:
    """Whether the column is a decimal whose sums ``EXACT_TYPE`` holds: no amount
    needs a look of its own then."""
    kind = df.schema[column].dataType
    return isinstance(kind, DecimalType) and kind.scale <= 12 and kind.precision - kind.scale <= 16


def exact_sum(amount, exact: bool = False) -> Column:
    """Sum of the exact parts; ``exact``: of the amounts as they are (see
    :func:`sums_exactly`)."""
    whole = F.sum(_c(amount)).cast(EXACT_TYPE) if exact else F.sum(exact_part(amount))
    return F.coalesce(whole, F.lit(0).cast(EXACT_TYPE))


def rest_sum(amount, exact: bool = False) -> Column:
    return F.lit(0.0) if exact else F.coalesce(F.sum(rest_part(amount)), F.lit(0.0))


def total(amount, exact: bool = False) -> Column:
    """Sum of amounts as a double: exact, and hence independent of the order
    of the rows, but for amounts that no decimal holds."""
    return exact_sum(amount, exact).cast("double") + rest_sum(amount, exact)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a projection would repeat it
    wherever it is used)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def two_decimals(x) -> Column:
    """``%.2f`` of a number, from the exact binary value of the double, ties
    to even: 0.125 gives 0.12 and 1.005 (which is a little less) 1.00.

    Spark rounds the shortest decimal text of a double. That differs only where
    this text ends in a 5 at the third place, and where doubles lie so far apart
    (from ``FAR`` on) that the text has fewer digits than it needs; there the
    value's bits decide.
    """
    x = _c(x).cast("double")
    a = F.abs(x)
    text = F.when(_ends_in_five(a) | ((a >= FAR) & (a < 2.0 ** 53)), _let(a, _rounded)).when(
        (a >= 2.0 ** 53) & (a < 2.0 ** 125), _let(a, _integer_text))
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(text.isNotNull(), F.concat(sign, text)).when(x.isNotNull(), F.format_string("%.2f", x))


FAR = 1e11


def _ends_in_five(a: Column) -> Column:
    thousandths = F.round(F.when(a < FAR, a) * 1000)
    return F.coalesce((thousandths % 10 == 5) & (thousandths / 1000 == a), F.lit(False))


def _rounded(a: Column) -> Column:
    """Text of a double below 2**53 rounded to hundredths. Its whole and
    fractional part are exact, and 61 bits hold every fraction from 2**-8 on, so
    a hundred times these bits, over 2**61, are the exact hundredths."""
    scaled = F.floor((a - F.floor(a)) * 2.0 ** 61).cast("decimal(19,0)") * 100
    unit, half = F.lit(Decimal(1 << 61)), F.lit(Decimal(1 << 60))

    def nearest(s: Column) -> Column:
        return _let(F.call_function("div", s, unit), lambda q: _let(
            s - q.cast("decimal(3,0)") * unit,
            lambda rest: q + F.when((rest > half) | ((rest == half) & (q % 2 == 1)), 1).otherwise(0)))

    total = F.floor(a).cast("decimal(16,0)") + _let(scaled, nearest).cast("decimal(3,0)") / F.lit(Decimal(100))
    return total.cast("decimal(20,2)").cast("string")


def _integer_text(a: Column) -> Column:
    """Text of a double from 2**53 to 2**125: mantissa times a power of two, both
    exact as decimals."""
    def text(power: Column) -> Column:
        def product(p: Column) -> Column:
            first = F.least(p, F.lit(36))
            mantissa = (a / F.pow(F.lit(2.0), p)).cast("bigint").cast("decimal(16,0)")
            return mantissa * _power_of_two(first) * _power_of_two(p - first)
        mantissa = a / F.pow(F.lit(2.0), power)  # the logarithm may be one off
        right = F.when(mantissa >= 2.0 ** 53, power + 1).when(mantissa < 2.0 ** 52, power - 1).otherwise(power)
        return _let(right, product)

    whole = _let(F.floor(F.log2(a)).cast("int") - 52, text)
    return F.concat(whole.cast("decimal(38,0)").cast("string"), F.lit(".00"))


def _power_of_two(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n).cast("decimal(12,0)")


def balance_cell(x) -> Column:
    """Balance as ``$1234.50`` (a negative one prints ``$-45.00``)."""
    return F.concat(F.lit("$"), two_decimals(x))


def credit_cell(x) -> Column:
    """Mean credit as ``+$60.50``."""
    return F.concat(F.lit("+$"), two_decimals(x))


def debit_cell(x) -> Column:
    """Mean debit as ``-$10.30`` (F11: absolute value after the sign)."""
    return F.concat(F.lit("-$"), two_decimals(F.abs(_c(x))))


def month_label(month, year) -> Column:
    """``July 2026``."""
    return F.concat_ws(" ", _c(month), _c(year).cast("string"))


def when_positive(n, text: Column) -> Column:
    """a section shown only when ``n > 0``; empty text otherwise."""
    return F.when(_c(n) > 0, text).otherwise(F.lit(""))
