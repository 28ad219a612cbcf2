"""Number columns: lenient parsing and half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Plain decimal notation; keeps out suffixes such as 5d that a JVM cast accepts.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(c: Column) -> Column:
    """Text to double; anything that is not a finite decimal number is missing."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def coerce_number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(parse_number(c), F.lit(default))


def known(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def optional_effort(c: Column) -> Column:
    """Blank or unreadable effort is missing."""
    return parse_number(c)


def positive_or_missing(c: Column) -> Column:
    return F.when(c > 0, c)


def at_least(c: Column, floor) -> Column:
    return F.greatest(c, F.lit(floor))


def format_number(c: Column) -> Column:
    """Whole numbers without a point, others with one decimal, missing as ``unknown``."""
    # as a decimal: a double's text switches to powers of ten from 1e7 on
    plain = F.coalesce(F.bround(c, 1).try_cast("decimal(38,1)").cast("string"), F.bround(c, 1).cast("string"))
    one_place = F.regexp_replace(plain, r"\.0$", "")
    whole = c.cast("bigint").cast("string")
    return F.when(c.isNull() | F.isnan(c), "unknown").when(c == F.floor(c), whole).otherwise(one_place)
