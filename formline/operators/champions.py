"""Titles derived from results and handed to every player of the roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.operators.series import CUP_FINAL_PREFIX

# Class and name of the two titles.
LEAGUE_TITLE = ("Champion", "NBA Champion")
CUP_TITLE = ("NBA Cup", "NBA Cup Champion")


def _last_winners(games: DataFrame, code: str) -> DataFrame:
    last = F.max(F.struct(F.col("date"), F.col(code), F.col("winner_team_id"))).alias("last")
    return games.groupBy("season").agg(last).select("season", F.col("last.winner_team_id").alias("team_id")).filter("team_id is not null")


def title_winners(games: DataFrame, code: str = "id") -> DataFrame:
    """(season, team, award_type, award_name): winner of the latest playoff game and of the latest cup final.

    The latest game decides even while a season is still being played.
    """
    def titled(rows: DataFrame, title: tuple[str, str]) -> DataFrame:
        return _last_winners(rows, code).withColumns({"award_type": F.lit(title[0]), "award_name": F.lit(title[1])})

    return titled(games.filter("po"), LEAGUE_TITLE).unionByName(
        titled(games.filter(F.col(code).startswith(CUP_FINAL_PREFIX)), CUP_TITLE))


def new_titles(games: DataFrame, season_rows: DataFrame, awards: DataFrame, code: str = "id") -> DataFrame:
    """Titles of roster players that are not on record yet."""
    roster = season_rows.select("season", "team_id", "player_id").distinct()
    earned = title_winners(games, code).join(roster, ["season", "team_id"])
    known = awards.select("player_id", "season", "award_type")
    return earned.join(known, ["player_id", "season", "award_type"], "left_anti").select(
        "player_id", "season", "award_type", "award_name", F.lit(None).cast("string").alias("description")).distinct()


def with_titles(games: DataFrame, season_rows: DataFrame, awards: DataFrame, code: str = "id") -> DataFrame:
    """Award table with the new titles added."""
    columns = ["player_id", "season", "award_type", "award_name", "description"]
    return awards.select(*columns).unionByName(new_titles(games, season_rows, awards, code))
