"""Tolerant conversions of raw text columns. Bad input gives a default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that no decimal number has (they spell NaN, Infinity, 0x1 or 1d),
# and texts that mean "no value".
FOREIGN_LETTERS = "[A-DF-Za-df-z]"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
EMPTY_TEXTS = ["none", "nan", "null", ""]


def _decimal(value: Column) -> Column:
    """Text as double, null for garbage; a number too large for a double is infinite."""
    text = value.cast("string")
    return F.when(~text.rlike(FOREIGN_LETTERS), F.trim(text).try_cast("double"))


def number_or_null(value: Column) -> Column:
    """Text as double; null for anything that is not a finite decimal number."""
    return F.nullif(F.nullif(_decimal(value), F.lit(float("inf"))), F.lit(float("-inf")))


def safe_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(number_or_null(value), F.lit(float(default)))


def safe_int(value: Column, default: int = 0) -> Column:
    """Truncating conversion: ``10.7`` is 10, ``1e2`` is 100, garbage is the default."""
    return F.coalesce(_decimal(value).try_cast("bigint"), F.lit(default).cast("bigint"))


def positive_int_or_null(value: Column) -> Column:
    """Like :func:`safe_int`, but null for bad input and for values that truncate to 0 or less."""
    return F.nullif(F.greatest(_decimal(value).try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def clean_text(value: Column) -> Column:
    """Trimmed text, or null when it only spells a missing value."""
    text = F.trim(value.cast("string"))
    return F.when(~F.lower(text).isin(EMPTY_TEXTS), text)


def parse_day(value: Column) -> Column:
    """Calendar day written in the text (ISO with or without time and zone, US, or long month).

    A zoned timestamp keeps the day that is written, it is not shifted to UTC.
    """
    text = F.trim(value.cast("string"))
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")),
        F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")),
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"),
               F.try_to_date(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/\d{4})", 1), "M/d/yyyy")),
        F.when(text.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), F.try_to_date(F.initcap(text), "MMM d, yyyy")),
    )


def clock_to_seconds(value: Column) -> Column:
    """``M:SS``, ``H:MM:SS`` or decimal minutes to whole seconds; anything else is 0."""
    text = value.cast("string")
    parts = F.split(text, ":")
    clock = F.aggregate(
        parts, F.lit(0).cast("bigint"),
        lambda total, part: F.try_add(F.try_multiply(total, F.lit(60).cast("bigint")), F.trim(part).try_cast("bigint")))
    seconds = F.when(F.size(parts) == 1, (_decimal(text) * 60).try_cast("bigint")).when(F.size(parts) <= 3, clock)
    return F.coalesce(seconds, F.lit(0).cast("bigint"))


def seconds_to_clock(seconds: Column) -> Column:
    """Whole seconds as ``M:SS``; hours are not split off, missing is ``0:00``."""
    s = F.coalesce(seconds.cast("bigint"), F.lit(0))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
