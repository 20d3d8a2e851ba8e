"""Personal bests, milestone counts and recent form."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.boxline import is_double_double, is_triple_double, opponent, ratio

# Columns with a personal best, and milestone counts.
BEST_COLUMNS = ["pts", "reb", "ast", "stl", "blk", "fg3m", "fgm", "ftm", "min_seconds", "plus_minus"]


def _milestones() -> dict[str, Column]:
    return {
        "games_60_pts": F.col("pts") >= 60,
        "games_50_pts": (F.col("pts") >= 50) & (F.col("pts") < 60),
        "games_40_pts": (F.col("pts") >= 40) & (F.col("pts") < 50),
        "games_20_reb": F.col("reb") >= 20,
        "games_20_ast": F.col("ast") >= 20,
        "games_5_stl": F.col("stl") >= 5,
        "games_5_blk": F.col("blk") >= 5,
        "games_10_3pm": F.col("fg3m") >= 10,
        "triple_doubles": is_triple_double(),
        "double_doubles": is_double_double(),
    }


def career_highs(lines: DataFrame) -> DataFrame:
    """Maxima and milestone counts per player in one aggregation."""
    return lines.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("total_games"),
        *[F.max(c).alias(f"max_{c}") for c in BEST_COLUMNS],
        *[F.count_if(rule).alias(name) for name, rule in _milestones().items()],
    )


def high_details(lines: DataFrame, columns: list[str] = BEST_COLUMNS) -> DataFrame:
    """The game of each personal best: (player, stat, value, game, day, season, opponent); latest game on ties.

    ``lines`` carries home_team_id and away_team_id of the game.
    """
    vs = opponent(F.col("team_id"), F.col("home_team_id"), F.col("away_team_id"))
    rows = lines.withColumn("__vs", vs)
    best = rows.groupBy("player_id").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(
            F.col(c).cast("double").alias("value"), F.col("date"), F.col("game_id"), F.col("season"), F.col("__vs").alias("vs_team_id"),
        ))).alias(c)
        for c in columns
    ])
    cells = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("best")) for c in columns])
    return best.select("player_id", F.inline(cells)).filter("best is not null").select("player_id", "stat", "best.*")


def recent_form(lines: DataFrame, today: date | str, windows: dict[str, int] | None = None, newest_rows: int | None = None) -> DataFrame:
    """Means over the last 7 and 30 days (both ends included), of each player's ``newest_rows`` rows only if that is given.

    The reference day is ``today`` or the player's newest game, whichever is later.
    Rows without playing time count as games; they are left out of the divisor unless there are no others.
    """
    windows = windows or {"last_7_days": 7, "last_month": 30}
    rows = lines
    if newest_rows is not None:
        newest = Window.partitionBy("player_id").orderBy(F.desc("date"), F.desc("game_id"), *_tie(lines))
        rows = rows.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= newest_rows)
    top = rows.groupBy("player_id").agg(F.max("date").alias("__top"))
    rows = rows.join(top, "player_id").withColumn("__ref", F.greatest(F.col("__top"), F.lit(str(today)).cast("date")))
    spans = F.array_compact(F.array(*[
        F.when(F.col("date") >= F.date_sub(F.col("__ref"), days), F.lit(name)) for name, days in windows.items()
    ]))
    sums = ["pts", "reb", "ast", "stl", "blk", "tov", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta"]
    grouped = rows.withColumn("span", F.explode(spans)).groupBy("player_id", "span").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("min_seconds") > 0).alias("games_played"),
        *[F.sum(F.col(c).cast("bigint")).alias(f"s_{c}") for c in sums],
        F.sum("min_seconds").alias("s_min"), F.sum(F.coalesce("plus_minus", F.lit(0.0))).alias("s_pm"),
    )
    d = F.when(F.col("games_played") > 0, F.col("games_played")).otherwise(F.col("games")).cast("double")
    per = {"ppg": "pts", "rpg": "reb", "apg": "ast", "spg": "stl", "bpg": "blk", "topg": "tov"}
    return grouped.select(
        "player_id", "span", "games", "games_played",
        (F.coalesce(F.col("s_min"), F.lit(0)).cast("double") / 60.0 / d).alias("mpg"),
        *[(F.col(f"s_{c}").cast("double") / d).alias(name) for name, c in per.items()],
        ratio(F.col("s_fgm"), F.col("s_fga")).alias("fg_pct"),
        ratio(F.col("s_fg3m"), F.col("s_fg3a")).alias("fg3_pct"),
        ratio(F.col("s_ftm"), F.col("s_fta")).alias("ft_pct"),
        (F.col("s_pm") / d).alias("plus_minus"),
    )


def _tie(lines: DataFrame) -> list[Column]:
    """Further sort keys, so that equal (date, game) rows are ordered the same way in every run."""
    return [F.desc(c) for c in ("pts", "min_seconds", "fga", "fta", "reb", "ast", "tov", "pf", "stl", "blk", "fg3a", "plus_minus") if c in lines.columns]
