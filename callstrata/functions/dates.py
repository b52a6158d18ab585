"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a call timestamp, tried in order.
CALL_FORMATS = ("dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd-MM-yyyy")


def naive(ts: Column) -> Column:
    """Wall-clock timestamp without a zone."""
    return ts.cast("timestamp_ntz")


def parse_call_time(text: Column, formats=CALL_FORMATS) -> Column:
    """Day-first parse with fallbacks; text that fits no format becomes null."""
    tries = [naive(F.try_to_timestamp(text, F.lit(f))) for f in formats]
    return F.coalesce(*tries, naive(F.try_to_timestamp(text)))


def hour_of_text(text: Column) -> Column:
    """Hour of a clock text (HH:mm:ss) or of a full timestamp text."""
    clock = F.try_to_timestamp(text, F.lit("HH:mm:ss"))
    return F.hour(F.coalesce(clock, F.try_to_timestamp(text)))


def epoch_second(ts: Column) -> Column:
    """Whole wall-clock seconds since 1970-01-01, independent of the session zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def dow0(d: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(d)


def is_business(d: Column) -> Column:
    return F.weekday(d) < 5


def week_label(d: Column) -> Column:
    """ISO year and week, e.g. 2025-S01 for 2024-12-30."""
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-S"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")
    )


def month_start_flag(d: Column) -> Column:
    return (F.dayofmonth(d) <= 5).cast("int")


def month_week(d: Column) -> Column:
    return (F.floor((F.dayofmonth(d) - 1) / 7) + 1).cast("int")


def wave(fn, x: Column, period: int) -> Column:
    """sin or cos of a cyclic calendar part."""
    return fn(2 * F.pi() * x / F.lit(period))


def next_sunday(d: Column) -> Column:
    """First Sunday strictly after a date."""
    return F.next_day(d, "SUN")
