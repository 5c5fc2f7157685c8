"""Month keys (yyyymm), month lists and closed-form weekday counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_first(day: dt.date) -> dt.date:
    return day.replace(day=1)


def shift_month(day: dt.date, months: int) -> dt.date:
    """First day of the month `months` away from the month of `day`."""
    index = day.year * 12 + day.month - 1 + months
    return dt.date(index // 12, index % 12 + 1, 1)


def month_last(day: dt.date) -> dt.date:
    return shift_month(day, 1) - dt.timedelta(days=1)


def month_key(day: dt.date) -> int:
    return day.year * 100 + day.month


def key_month(key: int) -> dt.date:
    """First day of a yyyymm key."""
    return dt.date(key // 100, key % 100, 1)


def billing_span(sd: dt.date, ed: dt.date) -> tuple[dt.date, dt.date]:
    """First and last billing month.

    A month after the first is billed only if it begins strictly before `ed`,
    so an `ed` on the 1st does not bring in its own month.
    """
    first = month_first(sd)
    last = month_first(ed - dt.timedelta(days=1))
    return first, max(first, last)


def yrmo(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


def first_of(key: Column) -> Column:
    """First day of a yyyymm column."""
    return F.make_date(F.call_function("div", key, F.lit(100)).cast("int"), (key % 100).cast("int"), F.lit(1))


def month_gap(start: Column, end: Column) -> Column:
    """Month boundaries crossed from start to end (day of month is ignored)."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def iso_weekday(day: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(day) + 1


def weekday_hits(weekday: Column, start: Column, end: Column) -> Column:
    """How often an ISO weekday falls in [start, end]; 0 for an empty range."""
    ahead = F.pmod(weekday - 1 - F.weekday(start), F.lit(7))
    weeks = F.call_function("div", F.datediff(end, start) - ahead + 7, F.lit(7))
    return F.greatest(F.lit(0), weeks).cast("int")


def months_between_first(start: Column, end: Column, low: Column, high: Column) -> Column:
    """First days of the months that [start, end] touches, clipped to [low, high].

    Filter rows with an empty range out before use: sequence() would run backwards.
    """
    return F.sequence(
        F.greatest(F.trunc(start, "month"), low),
        F.least(F.coalesce(F.trunc(end, "month"), high), high),
        F.expr("interval 1 month"),
    )
