"""Season labels (``2023-24``), the season calendar and coded game ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes, cup knock-out suffixes, first month of a season, first season.
GAME_TYPES = {
    "001": "PRESEASON", "002": "RS", "003": "ALLSTAR",
    "004": "PO", "005": "PI", "006": "IST",
}
CUP_SUFFIXES = ["01201", "01202", "01203", "01204", "01229", "01230"]
SEASON_START_MONTH = 10
FIRST_SEASON_YEAR = 1983


def season_label(year: Column) -> Column:
    y = year.cast("int")
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def season_year(season: Column) -> Column:
    return F.split_part(season, F.lit("-"), F.lit(1)).try_cast("int")


def season_of(day: Column) -> Column:
    """Season of a calendar day; October opens a new one."""
    started = F.when(F.month(day) >= SEASON_START_MONTH, F.year(day)).otherwise(F.year(day) - 1)
    return season_label(started)


def previous_season(season: Column) -> Column:
    return season_label(season_year(season) - 1)


def normalise_season(value: Column) -> Column:
    """``2023``, ``202324`` and ``2023 - 24`` all become ``2023-24``; other texts lose blanks and dashes."""
    digits = F.regexp_replace(value.cast("string"), "[ -]", "")
    return (
        F.when(F.length(digits) == 6, F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2)))
        .when((F.length(digits) == 4) & digits.rlike(r"^\d{4}$"), season_label(digits.try_cast("int")))
        .otherwise(digits)
    )


def seasons_until(day: Column, first_year: int = FIRST_SEASON_YEAR) -> Column:
    """Array of all season labels from ``first_year`` to the season of ``day``."""
    return F.transform(F.sequence(F.lit(first_year), season_year(season_of(day))), season_label)


def season_bounds(season: Column) -> Column:
    """Calendar shown for a season: 1 August to 31 July."""
    y = season_year(season)
    return F.struct(
        F.make_date(y, F.lit(8), F.lit(1)).alias("first_day"),
        F.make_date(y + 1, F.lit(7), F.lit(31)).alias("last_day"),
    )


def game_type(code: Column) -> Column:
    """Competition named by the three leading digits, else ``unknown``."""
    prefix = F.substring(code, 1, 3)
    out = F.when(F.length(code) < 3, F.lit("unknown"))
    for key, name in GAME_TYPES.items():
        out = out.when(prefix == key, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def game_code_date(code: Column) -> Column:
    """Date written in a long code (digits 4 to 11), null for short codes and impossible dates."""
    return F.when(
        (F.length(code) >= 11) & F.substring(code, 4, 8).rlike(r"^\d{8}$"),
        F.try_to_date(F.substring(code, 4, 8), "yyyyMMdd"),
    )


def game_code_season(code: Column) -> Column:
    """Season of a ten-digit code: digits 4 and 5 are the year, below 50 in this century."""
    yy = F.substring(code, 4, 2).try_cast("int")
    return F.when((F.length(code) == 10) & yy.isNotNull(),
                  season_label(yy + F.when(yy < 50, 2000).otherwise(1900)))


def deduce_season(code: Column, field: Column, fallback: Column, day: Column) -> Column:
    """First season that can be told: code, delivered field, caller's fallback, date."""
    return F.coalesce(
        game_code_season(code),
        F.when(field != "", field),
        F.when(fallback != "", fallback),
        F.when(day.isNotNull(), season_of(day)),
    )


def is_cup_code(code: Column, season: Column) -> Column:
    """Predicted cup game: final prefix, knock-out suffix, or group number 1..60 since 2024."""
    prefix, suffix = F.substring(code, 1, 3), F.substring(code, 6, 100)
    number = F.when(suffix.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(suffix).try_cast("int"))
    group_stage = (season_year(season) >= 2024) & number.between(1, 60)
    return F.coalesce(
        (prefix == "006") | ((prefix == "002") & (suffix.isin(CUP_SUFFIXES) | group_stage)), F.lit(False)
    )
