"""Game details: header, player lines and side lines, with names or fallback texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions.casts import seconds_to_clock


def game_headers(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Games with both sides named: the team table is joined once per role, unknown sides get a text."""
    def side(role: str) -> DataFrame:
        return teams.select(F.col("id").alias(f"{role}_team_id"), F.col("full_name").alias(f"__{role}"), F.col("abbreviation").alias(f"__{role}_abbr"))

    joined = games.join(side("home"), "home_team_id", "left").join(side("away"), "away_team_id", "left")
    zero = F.lit(0)
    return joined.select(
        "id", "date", "season", "home_team_id", "away_team_id",
        F.coalesce("__home", F.concat(F.lit("Team "), F.col("home_team_id").cast("string"))).alias("home_team"),
        F.coalesce("__away", F.concat(F.lit("Team "), F.col("away_team_id").cast("string"))).alias("away_team"),
        F.coalesce("__home_abbr", F.lit("T1")).alias("home_team_abbr"),
        F.coalesce("__away_abbr", F.lit("T2")).alias("away_team_abbr"),
        F.coalesce("home_score", zero).alias("home_score"), F.coalesce("away_score", zero).alias("away_score"),
        *[F.coalesce(flag, F.lit(False)).alias(flag) for flag in ("rs", "po", "pi", "ist")],
    )


def player_lines(lines: DataFrame, players: DataFrame, teams: DataFrame, game_id: object | None = None) -> DataFrame:
    """Stat lines of one game (or all) with names; sort by minutes, then points, for display."""
    rows = lines if game_id is None else lines.filter(F.col("game_id") == game_id)
    people = players.select(F.col("id").alias("player_id"), F.col("full_name").alias("__player"))
    sides = teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("__team"))
    out = rows.join(people, "player_id", "left").join(sides, "team_id", "left").select(
        "game_id", "player_id", F.coalesce("__player", F.concat(F.lit("Player "), F.col("player_id").cast("string"))).alias("player"),
        F.coalesce("__team", F.concat(F.lit("ID "), F.col("team_id").cast("string"))).alias("team"), "team_id",
        "min_seconds", seconds_to_clock(F.col("min_seconds")).alias("min"),
        "pts", "reb", "ast", "stl", "blk", "tov", "pf", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "plus_minus",
    )
    return out if game_id is None else out.orderBy(F.desc("min_seconds"), F.desc("pts"), "player_id")


def side_lines(sides: DataFrame, teams: DataFrame, game_id: object | None = None) -> DataFrame:
    rows = sides if game_id is None else sides.filter(F.col("game_id") == game_id)
    names = teams.select(F.col("id").alias("team_id"), F.col("abbreviation").alias("__team"))
    return rows.join(names, "team_id", "left").withColumn(
        "team", F.coalesce("__team", F.concat(F.lit("ID "), F.col("team_id").cast("string")))).drop("__team")


def home_and_away(lines: DataFrame, games: DataFrame) -> DataFrame:
    """Mark each line with its side: home, away, or neither."""
    sides = games.select(F.col("id").alias("game_id"), "home_team_id", "away_team_id")
    return lines.join(sides, "game_id").withColumn(
        "side", F.when(F.col("team_id") == F.col("home_team_id"), "home").when(F.col("team_id") == F.col("away_team_id"), "away"))


def game_details(
    game_id: object, games: DataFrame, lines: DataFrame, sides: DataFrame, players: DataFrame, teams: DataFrame
) -> dict[str, DataFrame]:
    """The three parts of one game's page."""
    return {
        "game": game_headers(games.filter(F.col("id") == game_id), teams),
        "player_stats": player_lines(lines, players, teams, game_id),
        "team_stats": side_lines(sides, teams, game_id),
    }
