"""Biographic columns: height, weight, origin, draft, name matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from formline.functions.casts import INTEGER_PATTERN

# Countries counted as European, draft places counted as lottery.
EUROPEAN_COUNTRIES = [
    "Albania", "Andorra", "Armenia", "Austria", "Azerbaijan", "Belarus", "Belgium",
    "Bosnia and Herzegovina", "Bulgaria", "Croatia", "Cyprus", "Czech Republic", "Denmark",
    "Estonia", "Finland", "France", "Georgia", "Germany", "Greece", "Hungary", "Iceland",
    "Ireland", "Italy", "Kazakhstan", "Latvia", "Liechtenstein", "Lithuania", "Luxembourg",
    "Malta", "Moldova", "Monaco", "Montenegro", "Netherlands", "North Macedonia", "Norway",
    "Poland", "Portugal", "Romania", "Russia", "San Marino", "Serbia", "Slovakia", "Slovenia",
    "Spain", "Sweden", "Switzerland", "Ukraine", "United Kingdom", "Vatican City",
    "USSR", "Yugoslavia", "Serbia and Montenegro", "Macedonia", "Scotland", "Czechia",
]
LOTTERY_PICKS = 14


def height_inches(height: Column, default: int = 0) -> Column:
    """``6-9`` to 81; the default where feet or inches cannot be read."""
    parts = F.split(height, "-")

    def number(i: int) -> Column:
        text = F.try_element_at(parts, F.lit(i))
        return F.when(text.rlike(INTEGER_PATTERN), F.trim(text).try_cast("int"))

    return F.coalesce(number(1) * 12 + number(2), F.lit(default))


def height_cm(height: Column) -> Column:
    parts = F.split(height, "-")
    readable = F.try_element_at(parts, F.lit(1)).rlike(INTEGER_PATTERN) & F.try_element_at(parts, F.lit(2)).rlike(INTEGER_PATTERN)
    return F.when(readable, F.bround(height_inches(height) * F.lit(2.54)).cast("int"))


def pounds_to_kg(pounds: Column) -> Column:
    return F.when(pounds > 0, F.bround(pounds * F.lit(0.453592)).cast("int"))


def is_european(country: Column) -> Column:
    return F.coalesce(country.isin(EUROPEAN_COUNTRIES), F.lit(False))


def is_lottery_pick(draft_number: Column) -> Column:
    return F.coalesce(draft_number <= LOTTERY_PICKS, F.lit(False))


def has_word_starting(name: Column, letter: str) -> Column:
    """True if the name, or any later word of it, starts with ``letter``."""
    return F.lower(name).rlike("(^| )" + re.escape(letter.lower()))


def matches_whole_words(name: Column, wanted: Column) -> Column:
    """True if ``wanted`` equals a run of complete words of ``name``."""
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    return padded.contains(F.concat(F.lit(" "), F.lower(F.trim(wanted)), F.lit(" ")))


def looks_abbreviated(name: Column) -> Column:
    """Name of the form ``X. Surname``."""
    return F.coalesce(name.rlike(r"^.\. "), F.lit(False))
