"""Date and decay functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TAU_DAYS = 30.0


def bounds(start: Column, end: Column, date: Column) -> tuple[Column, Column]:
    """Start and end of an event: one side stands for both, the end is never before the start, a bare date for neither."""
    s, e = F.coalesce(start, end, date), F.coalesce(end, start, date)
    return s, F.greatest(s, e)


def intersects(start: Column, end: Column, low: Column, high: Column) -> Column:
    """An unknown event passes; an absent side of the window is open."""
    return start.isNull() | ((low.isNull() | (end >= low)) & (high.isNull() | (start <= high)))


def strictly_intersects(start: Column, end: Column, low: Column, high: Column) -> Column:
    """An unknown event fails, and so does a window without sides."""
    return F.coalesce(start.isNotNull() & (low.isNotNull() | high.isNotNull()) & intersects(start, end, low, high), F.lit(False))


def decay(start: Column, end: Column, low: Column, high: Column, tau_days: float = TAU_DAYS) -> Column:
    """1 inside the window or where unknown, else the exponential of the gap over tau."""
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    gap = F.when(end < low, us(low) - us(end)).when(start > high, us(start) - us(high))
    return F.coalesce(F.exp(-(gap / 1e6 / (tau_days * 86400.0))), F.lit(1.0))


def event_date(text: Column) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy; null otherwise."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
    return F.to_date(F.try_to_timestamp(full, F.lit("yyyy-MM-dd")))


def add_months_overflow(date: Column, months: Column | int) -> Column:
    """Calendar months added with days past the month's end carried over: 31 January and one month is 2 or 3 March."""
    first = F.add_months(F.trunc(date, "month"), months)
    return F.date_add(first, F.dayofmonth(date) - 1)


def at_granularity(date: Column, granularity: Column) -> Column:
    return F.when(granularity == "year", F.date_format(date, "yyyy")).when(granularity == "month", F.date_format(date, "MMMM yyyy")).otherwise(F.date_format(date, "d MMMM yyyy"))


def keep_score(hits: Column, last_used: Column, created: Column, durability: Column, now: Column) -> Column:
    """Usage, recency and age terms of retention; 0.3 is taken from volatile entries' weight of age."""
    days = lambda x: (F.unix_micros(now) - F.unix_micros(x)) / 86400e6
    usage = hits / (hits + 1.0)
    recent = F.coalesce(1.0 / (1.0 + F.greatest(days(last_used), F.lit(0.0))), F.lit(0.0))
    evergreen = durability == "evergreen"
    age = F.least(F.greatest(days(created), F.lit(0.0)) / F.when(evergreen, 365.0).otherwise(90.0), F.lit(1.0))
    return usage + recent - age - F.when(evergreen, 0.0).otherwise(0.3)
