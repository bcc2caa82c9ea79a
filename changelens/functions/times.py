"""Time expressions.  All of them assume a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month")
FIRST_YEAR = 1990


def utc_time(epoch_seconds: Column) -> Column:
    """Epoch seconds as a timestamp.

    An author's zone offset only changes how the instant is printed, so it
    takes no part here.
    """
    return F.timestamp_seconds(epoch_seconds)


def issue_time(text: Column) -> Column:
    """Wall-clock fields to the second; zone and fraction are ignored, ``None`` and blank are null."""
    return F.try_to_timestamp(F.left(F.when(~text.isin("", "None"), text), F.lit(19)))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def micros(ts: Column) -> Column:
    """Instant in microseconds, of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    """Instant in whole seconds, of a timestamp with or without zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def commit_day(ts: Column) -> Column:
    return F.to_date(ts)


def period_index(day: Column, unit: str) -> Column:
    """Number of the week or month since 1990; weeks start on Sunday, 52 to a year.

    Any other unit gives null.
    """
    years = F.year(day) - FIRST_YEAR
    if unit == "week":
        return years * 52 + F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7).cast("int")
    if unit == "month":
        return years * 12 + F.month(day)
    return F.lit(None).cast("int")


def activity_period(ts: Column, period: str) -> Column:
    """Grouping value for a report: the date itself or a period index."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, not {period!r}")
    return commit_day(ts) if period == "day" else period_index(commit_day(ts), period)
