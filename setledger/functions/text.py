"""Text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Unicode white space as text tools outside the JVM see it; Java's \s alone covers ASCII only.
SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# Characters that end a line, besides the pair CR LF.
BREAK_CHARS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def coerce_text(c: Column) -> Column:
    """Null becomes empty; surrounding white space goes."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def normalize_name(c: Column) -> Column:
    return F.lower(strip(c))


def normalize_text(c: Column) -> Column:
    """Lower case, every run of other characters one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)")))


def words(c: Column) -> Column:
    """Words between white space. Mapping every space character to a blank and splitting on it is
    several times faster than splitting on a character class."""
    return F.array_remove(F.split(F.translate(c, SPACE_CHARS, " " * len(SPACE_CHARS)), " "), "")


def unify_breaks(c: Column) -> Column:
    """Every line end as one newline."""
    return F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), BREAK_CHARS, "\n" * len(BREAK_CHARS))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.array_join(words(c), " ")


def excerpt(c: Column, chars: int) -> Column:
    return F.substring(squeeze(c), 1, chars)


def join_authors(c: Column) -> Column:
    """Trimmed, non-blank names in one line."""
    names = F.filter(F.transform(c, strip), lambda x: x != "")
    return F.array_join(names, ", ")


def drop_bad_bytes(c: Column) -> Column:
    """Remove byte sequences that are not UTF-8."""
    return F.when(F.is_valid_utf8(c), c).otherwise(
        F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit("")))
