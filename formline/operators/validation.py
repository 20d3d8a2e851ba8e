"""Row constraints, unique keys and references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_COUNTS = ["pts", "reb", "ast", "stl", "blk", "tov", "pf", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta"]
SHOT_PAIRS = [("fgm", "fga"), ("fg3m", "fg3a"), ("fg3m", "fgm"), ("fg3a", "fga"), ("ftm", "fta")]


def line_rules(prefix: str = "", shares: Sequence[str] = ("fg_pct", "fg3_pct", "ft_pct")) -> dict[str, Column]:
    """Rules of a stat line; ``prefix='total_'`` gives those of a side's totals."""
    rules = {f"check_{c}": F.col(prefix + c) >= 0 for c in LINE_COUNTS}
    rules |= {f"check_{c}": F.col(c).between(0, 1) for c in shares}
    rules |= {f"check_{a}_lte_{b}": F.col(prefix + a) <= F.col(prefix + b) for a, b in SHOT_PAIRS}
    return rules


def game_rules() -> dict[str, Column]:
    return {"check_home_score": F.col("home_score") >= 0, "check_away_score": F.col("away_score") >= 0}


def player_rules() -> dict[str, Column]:
    return {"check_weight_positive": F.col("weight") > 0, "check_exp_positive": F.col("season_exp") >= 0}


def league_outlier_rules() -> dict[str, Column]:
    return {
        "check_error": F.col("reconstruction_error") >= 0,
        "check_percentile": F.col("percentile").between(0, 100),
    }


def player_outlier_rules() -> dict[str, Column]:
    return {"check_outlier_type": F.col("outlier_type").isin("explosion", "crisis")}


def trend_rules() -> dict[str, Column]:
    return player_outlier_rules() | {"check_window_type": F.col("window_type").isin("week", "month")}


def streak_rules() -> dict[str, Column]:
    return {
        "check_length": F.col("length") > 0,
        "check_competition_type": F.col("competition_type").isin("regular", "playoffs", "nba_cup"),
    }


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules. As in SQL, an unknown result passes."""
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("violations", broken).filter(F.size("violations") > 0)


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule; one conditional count per rule in a single pass."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])
    return counts.select(F.inline(cells))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is set but missing in the parent."""
    known = parent.select(F.col(parent_key).alias(column))
    return df.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def active_streak_conflicts(streaks: DataFrame, entity: str = "player_id") -> DataFrame:
    """More than one open streak for the same (entity, type, competition)."""
    return duplicate_keys(streaks.filter("is_active"), [entity, "streak_type", "competition_type"])
