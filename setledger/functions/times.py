"""Zone-free date and time columns (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STAMP = "yyyy-MM-dd HH:mm:ss"
ISO = "yyyy-MM-dd'T'HH:mm:ss"
# Formats that a plain cast reads; the pattern pins the one that is meant.
_CAST_FORMATS = {STAMP: r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", ISO: r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"}


def parse_timestamp(c: Column, fmt: str = STAMP) -> Column:
    """One pinned format; text in any other format is missing. The two common formats never pass
    through a zoned value, so a local clock change cannot move them."""
    if fmt in _CAST_FORMATS:
        text = F.trim(c)
        return F.when(text.rlike(_CAST_FORMATS[fmt]), text.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def truncate_seconds(c: Column) -> Column:
    micros = ((F.extract(F.lit("SECOND"), c) % 1) * 1000000).cast("int")
    return F.timestamp_add("MICROSECOND", -micros, c)


def iso_seconds(c: Column) -> Column:
    return F.replace(F.substring(c.cast("timestamp_ntz").cast("string"), 1, 19), F.lit(" "), F.lit("T"))


def start_of_day(c: Column) -> Column:
    return F.to_date(c).cast("timestamp_ntz")


def start_of_week(c: Column) -> Column:
    day = F.to_date(c)
    return F.date_sub(day, F.weekday(day)).cast("timestamp_ntz")


def epoch_seconds(c: Column) -> Column:
    """Whole seconds since 1970, missing as 0; never shifts by a session zone."""
    day = F.unix_date(F.to_date(c)).cast("bigint") * 86400
    return F.coalesce(day + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c), F.lit(0).cast("bigint"))


def format_date(c: Column, raw: Column | None = None) -> Column:
    """Day as text; unreadable input is shown as it came, missing as ``unknown date``."""
    shown = F.date_format(c, "yyyy-MM-dd")
    if raw is not None:
        shown = F.coalesce(shown, F.nullif(raw, F.lit("")))
    return F.coalesce(shown, F.lit("unknown date"))


def pretty_date(c: Column) -> Column:
    """January 1st, 2024"""
    day = F.dayofmonth(c)
    ending = (F.when(day.between(11, 13), "th").when(day % 10 == 1, "st")
              .when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th"))
    return F.concat(F.date_format(c, "MMMM"), F.lit(" "), day.cast("string"), ending, F.lit(", "),
                    F.year(c).cast("string"))


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def next_midnight(c: Column) -> Column:
    return F.date_add(F.to_date(c), 1).cast("timestamp_ntz")
