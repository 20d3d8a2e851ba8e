"""Win/loss records and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.boxline import ratio


def _results(games: DataFrame, season: str | None) -> DataFrame:
    """One row per side of each finished regular game with a winner: (season, team, win, loss).

    The loser is the home side unless the home side won.
    """
    rows = games.filter((F.col("status") == 3) & F.col("rs") & F.col("winner_team_id").isNotNull())
    if season:
        rows = rows.filter(F.col("season") == season)
    loser = F.when(F.col("winner_team_id") == F.col("home_team_id"), F.col("away_team_id")).otherwise(F.col("home_team_id"))
    sides = F.array(
        F.struct(F.col("winner_team_id").alias("team_id"), F.lit(1).alias("win")),
        F.struct(loser.alias("team_id"), F.lit(0).alias("win")),
    )
    return rows.select("season", F.inline(sides))


def _ranked(table: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("pct"), "team_id")
    return table.withColumn("conf_rank", F.row_number().over(order))


def team_records(games: DataFrame, teams: DataFrame, season: str | None = None) -> DataFrame:
    """Record of every team over all games given (or one season), with the place in its conference.

    Teams without games take part with a share of 0.
    """
    counts = _results(games, season).groupBy("team_id").agg(
        F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"))
    zero = F.lit(0).cast("bigint")
    table = (
        teams.select(F.col("id").alias("team_id"), "full_name", "conference").join(counts, "team_id", "left")
        .select("team_id", "full_name", "conference", F.coalesce("wins", zero).alias("wins"), F.coalesce("losses", zero).alias("losses"))
        .withColumn("total", F.col("wins") + F.col("losses"))
        .withColumn("pct", ratio(F.col("wins"), F.col("total")))
    )
    return _ranked(table, ["conference"])


def season_standings(games: DataFrame, teams: DataFrame, season: str | None = None) -> DataFrame:
    """Tables of every season (or one): teams with games, ranked inside their conference."""
    counts = _results(games, season).groupBy("season", "team_id").agg(
        F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"))
    info = teams.select(F.col("id").alias("team_id"), "abbreviation", "full_name", "conference", "division")
    table = counts.join(info, "team_id").withColumn("pct", ratio(F.col("wins"), F.col("wins") + F.col("losses")))
    return _ranked(table, ["season", "conference"])


def score_standings(games: DataFrame, teams: DataFrame, season: str | None = None) -> DataFrame:
    """Tables from scores alone: any status, ties count for nobody."""
    rows = games.filter(F.col("rs") & (F.col("home_score") != F.col("away_score")))
    if season:
        rows = rows.filter(F.col("season") == season)
    home_won = F.col("home_score") > F.col("away_score")
    sides = F.array(
        F.struct(F.col("home_team_id").alias("team_id"), home_won.cast("int").alias("win"), F.lit(1).alias("at_home")),
        F.struct(F.col("away_team_id").alias("team_id"), (~home_won).cast("int").alias("win"), F.lit(0).alias("at_home")),
    )
    counts = rows.select("season", F.inline(sides)).groupBy("season", "team_id").agg(
        F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"),
        F.count_if((F.col("win") == 1) & (F.col("at_home") == 1)).alias("home_wins"),
        F.count_if((F.col("win") == 1) & (F.col("at_home") == 0)).alias("away_wins"),
    )
    info = teams.select(F.col("id").alias("team_id"), "full_name", "conference", "division")
    table = counts.join(info, "team_id").withColumn("pct", ratio(F.col("wins"), F.col("wins") + F.col("losses")))
    return _ranked(table, ["season", "conference"])
