"""Small column expressions shared by the queries."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(value: dt.datetime | dt.date | str) -> Column:
    """A zone-free timestamp literal; dates mean midnight."""
    if isinstance(value, dt.datetime):
        text = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = value.isoformat() + " 00:00:00"
    else:
        text = value
    return F.lit(text).cast("timestamp_ntz")


def day(value: dt.datetime | dt.date | str) -> Column:
    """The calendar day of ``value`` as a date literal."""
    return stamp(value).cast("date")


def percent_half_up(numerator: Column, denominator: Column) -> Column:
    """``100 * numerator / denominator`` to two decimals, half away from zero.

    Both sides are whole numbers (counts, quantities, cents), so the rounding is done in
    integer arithmetic and is exact.  NULL when the denominator is 0 or NULL.
    """
    n, d = numerator.cast("decimal(38,0)"), denominator.cast("decimal(38,0)")
    scaled = (F.abs(n) * 20000 + F.abs(d)).cast("decimal(38,0)")
    divisor = F.when(d != 0, F.abs(d) * 2).cast("decimal(38,0)")
    hundredths = F.call_function("div", scaled, divisor)
    sign = F.signum(n.cast("double")) * F.signum(d.cast("double"))
    return (sign * hundredths.cast("double") / 100.0).cast("double")


def not_false(condition: Column) -> Column:
    """SQL CHECK semantics: only FALSE fails, NULL passes."""
    return F.coalesce(condition, F.lit(True))


_MONTH = re.compile(r"[0-9]{4}-[0-9]{2}")


def month_bounds(month: str) -> tuple[dt.date, dt.date]:
    """First and last day of a ``YYYY-MM`` month; ``ValueError`` for anything else."""
    if not isinstance(month, str) or not _MONTH.fullmatch(month):
        raise ValueError("Invalid month format. Please use YYYY-MM")
    year, number = int(month[:4]), int(month[5:])
    if not 1 <= number <= 12 or year < 1:
        raise ValueError("Invalid date format")
    first = dt.date(year, number, 1)
    next_first = dt.date(year + number // 12, number % 12 + 1, 1) if (year, number) != (9999, 12) else None
    last = next_first - dt.timedelta(days=1) if next_first else dt.date(9999, 12, 31)
    return first, last
