"""Attributes computed from one stat line or one game row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE_CATEGORIES = ["pts", "reb", "ast", "stl", "blk"]


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def repaired_shots(fgm: Column, fga: Column, fg3m: Column, fg3a: Column, ftm: Column, fta: Column) -> dict[str, Column]:
    """Made and attempted counts made consistent.

    Attempts are raised to makes first, then threes are bounded by all field
    goals; a three-point attempt count is bounded by the raised total.
    """
    total = F.greatest(fga, fgm)
    return {
        "fgm": fgm,
        "fga": total,
        "fg3m": F.least(fg3m, fgm),
        "fg3a": F.least(F.greatest(fg3a, fg3m), total),
        "ftm": ftm,
        "fta": F.greatest(fta, ftm),
    }


def tens(prefix: str = "") -> Column:
    """Number of categories with ten or more."""
    flags = [F.coalesce((F.col(prefix + c) >= 10).cast("int"), F.lit(0)) for c in DOUBLE_CATEGORIES]
    return sum(flags[1:], flags[0])


def is_double_double(prefix: str = "") -> Column:
    return tens(prefix) >= 2


def is_triple_double(prefix: str = "") -> Column:
    return tens(prefix) >= 3


def winner(home_id: Column, away_id: Column, home_score: Column, away_score: Column) -> Column:
    """Side with more points, null for a tie or a missing score."""
    return F.when(home_score > away_score, home_id).when(away_score > home_score, away_id)


def opponent(team_id: Column, home_id: Column, away_id: Column) -> Column:
    return F.when(team_id == home_id, away_id).otherwise(home_id)


def period_scores(home: Column, away: Column) -> Column:
    """Array of (label, home, away): Q1..Q4 then OT1.., the shorter side filled with 0."""
    return F.transform(
        F.arrays_zip(home.alias("home"), away.alias("away")),
        lambda p, i: F.struct(
            F.when(i < 4, F.concat(F.lit("Q"), (i + 1).cast("string")))
            .otherwise(F.concat(F.lit("OT"), (i - 3).cast("string"))).alias("label"),
            F.coalesce(p["home"], F.lit(0)).alias("home"),
            F.coalesce(p["away"], F.lit(0)).alias("away"),
        ),
    )


def progress_percent(length: Column, record: Column) -> Column:
    """Whole percent of a record reached, at most 100; 0 without a positive record."""
    share = F.floor(F.try_divide(length.cast("bigint") * 100, record.cast("bigint")))
    return F.when(record > 0, F.least(F.lit(100).cast("bigint"), share)).otherwise(F.lit(0).cast("bigint"))
