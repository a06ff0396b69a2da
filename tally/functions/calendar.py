"""Calendar parts of a transaction date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def year_of(d) -> Column:
    """calendar year as INT."""
    return F.year(_c(d))


def month_num(d) -> Column:
    """month number 1-12 as INT."""
    return F.month(_c(d))


def month_name(d) -> Column:
    """F8: English month name (``July``)."""
    return F.date_format(_c(d), "MMMM")

