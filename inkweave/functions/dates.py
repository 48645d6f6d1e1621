"""ISO week dates and 12-hour clock text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day names by ISO week day 1..7.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DAY_ABBREVIATIONS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
UNKNOWN_DAY = "???"


def _pick(names: list[str], number: Column) -> Column:
    # element_at of a constant array answers a null index with its last element.
    return F.when(number.isNotNull(), F.element_at(F.array(*map(F.lit, names)), number))


def _iso_year(ts: Column) -> Column:
    return F.date_part(F.lit("YEAROFWEEK"), ts).cast("string")


def _iso_week(ts: Column) -> Column:
    return F.lpad(F.weekofyear(ts).cast("string"), 2, "0")


def iso_day(ts: Column) -> Column:
    return F.weekday(ts) + 1


def iso_week_date(ts: Column) -> Column:
    """``2025-W48-1``."""
    return F.concat(_iso_year(ts), F.lit("-W"), _iso_week(ts), F.lit("-"), iso_day(ts).cast("string"))


def week_key(ts: Column) -> Column:
    """``2025-w48``, the name of a weekly journal note."""
    return F.concat(_iso_year(ts), F.lit("-w"), _iso_week(ts))


def day_name(ts: Column) -> Column:
    return _pick(DAY_NAMES, iso_day(ts))


def minute_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")


def day_abbrev(iso_date: Column) -> Column:
    """Day abbreviation of ISO week date text, ``???`` where it names no day."""
    parts = F.split(iso_date, "-")
    day = F.when(F.size(parts) == 3, F.element_at(parts, 3))
    number = F.when(day.rlike(r"^\+?0*[1-7]$"), F.regexp_extract(day, "([1-7])$", 1).cast("int"))
    return F.coalesce(_pick(DAY_ABBREVIATIONS, number), F.lit(UNKNOWN_DAY))


def valid_iso_week(c: Column) -> Column:
    """``YYYY-Www-D`` with week 1..53 and day 1..7."""
    return c.rlike(r"^(\d{4}|\+\d{3})-W(0[1-9]|[1-4]\d|5[0-3]|\+[1-9])-\+?0*[1-7]$")


def format_12h(ts: Column) -> Column:
    return F.date_format(ts, "h:mm a")


def parse_12h(c: Column, strict: bool) -> Column:
    """Minute of the day of ``h:mm AM`` text, null when it does not parse.

    ``strict`` is the rule for bulk input (hour 1-12, minute at most 59, any case);
    without it the rule for stored entries holds (no range check, upper case only).
    """
    pattern = r"(?U)^\s*\+?(\d+):\+?(\d+)\s+(AM|PM)\s*$"
    source = F.upper(c) if strict else c
    matched = source.rlike(pattern)
    hour = F.regexp_extract(source, pattern, 1)
    minute = F.regexp_extract(source, pattern, 2)
    h = F.when(matched, hour.try_cast("long"))
    m = F.when(matched, minute.try_cast("long"))
    half = F.regexp_extract(source, pattern, 3)
    # Without the range check a number still has to fit 32 bits.
    in_range = h.between(1, 12) & (m <= 59) if strict else (h < 2**32) & (m < 2**32)
    hour24 = (
        F.when((half == "AM") & (h == 12), 0)
        .when(half == "AM", h)
        .when(h == 12, 12)
        .otherwise(h + 12)
    )
    return F.when(matched & in_range, hour24 * 60 + m)
