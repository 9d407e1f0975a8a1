"""Calendar keys, reporting windows and labels.

Windows are computed from an explicit ``as_of`` day and become literals, so Catalyst
pushes them into the Parquet scan. Keys stay zone-less: a session time zone never moves
a booking to another day.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Step of each reporting grain.
STEPS = {
    "day": "interval 1 day",
    "week": "interval 7 days",
    "month": "interval 1 month",
    "quarter": "interval 3 months",
    "year": "interval 1 year",
}


@dataclass(frozen=True)
class Span:
    """A closed time range and the one it is compared with."""

    start: datetime
    end: datetime
    prev_start: datetime
    prev_end: datetime


def stamp(value: date | datetime) -> datetime:
    """A bare date means its first instant."""
    return value if isinstance(value, datetime) else datetime.combine(value, time.min)


def ts(value: date | datetime) -> Column:
    """Zone-less timestamp literal."""
    return F.lit(stamp(value).isoformat(sep=" ")).cast("timestamp_ntz")


def day(value: date | datetime) -> Column:
    return F.lit(stamp(value).date())


def within(column: str, start: date | datetime, end: date | datetime) -> Column:
    """Both ends inclusive; a bare end date stops at its midnight."""
    return F.col(column).between(ts(start), ts(end))


def within_days(column: str, start: date | None, end: date | None) -> Column:
    """Whole days, both inclusive, an absent bound is open. Written as a range on the
    timestamp itself so that it is pushed to the scan."""
    test = F.lit(True)
    if start is not None:
        test = test & (F.col(column) >= ts(start))
    if end is not None:
        test = test & (F.col(column) < ts(stamp(end) + timedelta(days=1)))
    return test


# Folder column of a published bookings table.
MONTH = "booked_month"


def _months(df: DataFrame, first: date | datetime | None, last: date | datetime | None) -> Column:
    """The months that a range of ``booked_at`` touches, which prunes folders; nothing where the table has no folders."""
    tests = []
    if MONTH in df.columns:
        if first is not None:
            tests.append(F.col(MONTH) >= F.lit(floor_day(first, "month")))
        if last is not None:
            tests.append(F.col(MONTH) <= F.lit(floor_day(last, "month")))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def booked_any(spans: list[tuple[date | datetime, date | datetime]]) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: bookings of any of some ranges, both ends inclusive."""

    def run(df: DataFrame) -> DataFrame:
        tests = [within("booked_at", *span) for span in spans]
        # A window and the one before it touch, so one range of months is as good as two, and the scan can use it.
        first, last = min(stamp(a) for a, _ in spans), max(stamp(b) for _, b in spans)
        return df.filter(reduce(lambda a, b: a | b, tests)).filter(_months(df, first, last))

    return run


def booked_within(start: date | datetime, end: date | datetime) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: bookings of a range, both ends inclusive."""
    return booked_any([(start, end)])


def booked_days(start: date | None, end: date | None) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: bookings of whole days, an absent bound is open."""
    return lambda df: df.filter(within_days("booked_at", start, end) & _months(df, start, end))


def booked_buckets(start: date | datetime, end: date | datetime, grain: str) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: bookings of every bucket that a range touches."""
    first, after = floor_day(start, grain), ceil_day(end, grain)
    return booked_days(first, after - timedelta(days=1))


def booked_since(start: date | datetime, until: date | datetime | None) -> Callable[[DataFrame], DataFrame]:
    """For ``DataFrame.transform``: bookings from a time up to another, or to the end of a day, or without an end."""
    if until is not None and not isinstance(until, datetime):
        until = stamp(until) + timedelta(days=1) - timedelta(microseconds=1)

    def run(df: DataFrame) -> DataFrame:
        test = F.col("booked_at") >= ts(start)
        if until is not None:
            test = test & (F.col("booked_at") <= ts(until))
        return df.filter(test & _months(df, start, until))

    return run


def shift_months(value: date, months: int) -> date:
    """First day of the month that lies ``months`` away."""
    index = value.year * 12 + value.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def months_before(value: date, months: int) -> date:
    """The same day ``months`` earlier, clipped to the month's last day."""
    first = shift_months(value, -months)
    last = shift_months(first, 1) - timedelta(days=1)
    return first.replace(day=min(value.day, last.day))


def last_days(now: date | datetime, days: int = 30) -> tuple[datetime, datetime]:
    """The range of an export that names none."""
    return stamp(now) - timedelta(days=days), stamp(now)


def _end_of(next_start: date) -> datetime:
    return stamp(next_start) - timedelta(microseconds=1)


def period_window(period: str, as_of: date) -> Span:
    """Calendar unit holding ``as_of`` and the one before. Weeks start on Sunday. ``month``
    is the trailing 12 calendar months against the 12 before them."""
    if period == "day":
        first, after = as_of, as_of + timedelta(days=1)
        before = as_of - timedelta(days=1)
    elif period == "week":
        first = as_of - timedelta(days=as_of.isoweekday() % 7)
        after, before = first + timedelta(days=7), first - timedelta(days=7)
    elif period == "quarter":
        first = date(as_of.year, (as_of.month - 1) // 3 * 3 + 1, 1)
        after, before = shift_months(first, 3), shift_months(first, -3)
    elif period == "year":
        first = date(as_of.year, 1, 1)
        after, before = date(as_of.year + 1, 1, 1), date(as_of.year - 1, 1, 1)
    else:
        first, after = shift_months(as_of, -11), shift_months(as_of, 1)
        before = shift_months(as_of, -23)
    return Span(stamp(first), _end_of(after), stamp(before), _end_of(first))


def trailing_months(as_of: date, back: int = 12) -> tuple[datetime, datetime]:
    """From the month ``back`` months ago to the end of this one (back + 1 calendar months)."""
    return stamp(shift_months(as_of, -back)), _end_of(shift_months(as_of, 1))


def bucket(column: str, grain: str) -> Column:
    """First day of the grain; ISO weeks, as the database truncates them."""
    as_day = F.to_date(column)
    return as_day if grain == "day" else F.trunc(as_day, grain)


def hour_of(column: str) -> Column:
    """Start of the hour, without passing through a zoned timestamp."""
    return F.expr(f"cast(to_date({column}) as timestamp_ntz) + hour({column}) * interval '1' hour")


def second_text(column: str) -> Column:
    """yyyy-MM-dd HH:mm:ss. The plain cast of a zone-less time does not touch the session zone."""
    return F.substring(F.col(column).cast("string"), 1, 19)


def as_instant(column: str) -> Column:
    """The zone-less time read as UTC, whatever the session zone is."""
    return F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())


def as_clock(instant: str | Column) -> Column:
    """The reverse of ``as_instant``."""
    zoned = F.col(instant) if isinstance(instant, str) else instant
    return F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz")


def sunday_of(column: str) -> Column:
    as_day = F.to_date(column)
    return F.date_sub(as_day, F.dayofweek(as_day) - 1)


def floor_day(value: date | datetime, grain: str) -> date:
    d = stamp(value).date()
    if grain == "day":
        return d
    if grain == "week":
        return d - timedelta(days=d.weekday())
    if grain == "quarter":
        return date(d.year, (d.month - 1) // 3 * 3 + 1, 1)
    return d.replace(day=1) if grain == "month" else date(d.year, 1, 1)


def ceil_day(value: date | datetime, grain: str) -> date:
    """First day after the grain that holds the value."""
    first = floor_day(value, grain)
    if grain in ("day", "week"):
        return first + timedelta(days=1 if grain == "day" else 7)
    return shift_months(first, {"month": 1, "quarter": 3, "year": 12}[grain])


def calendar(
    spark: SparkSession, start: date | datetime, end: date | datetime, grain: str, name: str
) -> DataFrame:
    """One row per grain from the one holding ``start`` to the one holding ``end``."""
    days = F.sequence(day(floor_day(start, grain)), day(floor_day(end, grain)), F.expr(STEPS[grain]))
    return spark.range(1).select(F.explode(days).alias(name))


def week_of_year(column: Column) -> Column:
    """Week number that starts on January 1st, two digits."""
    week = F.floor((F.dayofyear(column) - 1) / 7) + 1
    return F.lpad(week.cast("string"), 2, "0")


def month_difference(later: Column, earlier: Column) -> Column:
    """Whole months between two month starts."""
    return (
        (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    ).cast("int")


def period_label(column: str, period: str) -> Column:
    """Chart label of a day."""
    d = F.to_date(column)
    if period == "day":
        return F.date_format(d, "d EEE")
    if period == "week":
        return F.concat(F.lit("Week "), F.ceil(F.dayofmonth(d) / 7).cast("string"))
    if period == "quarter":
        return F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit(" "), F.date_format(d, "yy"))
    if period == "year":
        return F.date_format(d, "yyyy")
    return F.date_format(d, "MMM yy")
