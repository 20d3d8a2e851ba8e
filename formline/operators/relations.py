"""Companions, rosters and category membership from (player, team, season, type) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.awards import INDIVIDUAL_AWARDS
from formline.functions.people import has_word_starting, is_european, is_lottery_pick
from formline.operators import categories
from formline.operators.search import first_per_name

REGULAR = "Regular Season"


def latest_rows(season_rows: DataFrame) -> DataFrame:
    """Each player's newest row: season, then end day (an open end is newest), then team and type."""
    order = F.struct(
        F.col("season"), F.col("end_date").isNull().alias("open"), F.col("end_date"), F.col("team_id"), F.col("type"),
    )
    return season_rows.groupBy("player_id").agg(F.max(order).alias("r")).select(
        "player_id", "r.season", "r.end_date", "r.team_id", "r.type")


def current_companions(season_rows: DataFrame, players: DataFrame, focus: DataFrame) -> DataFrame:
    """Players in the same team, season and type as the newest row of each player in ``focus``.

    ``focus`` holds the players a page asks for; the result grows with their teams, not with all pairs.
    """
    wanted = focus.select("player_id").distinct()
    mine = latest_rows(season_rows.join(wanted, "player_id", "left_semi")).select(
        F.col("player_id").alias("focus_id"), "team_id", "season", "type")
    mates = season_rows.select("player_id", "team_id", "season", "type").join(mine, ["team_id", "season", "type"])
    return _named(mates.filter(F.col("player_id") != F.col("focus_id")).select("focus_id", "player_id").distinct(), players)


def companion_history(season_rows: DataFrame, players: DataFrame, teams: DataFrame, focus: DataFrame) -> DataFrame:
    """All players that shared a team and season with each focus player, with seasons and teams shared."""
    wanted = focus.select("player_id").distinct()
    mine = (
        season_rows.join(wanted, "player_id", "left_semi")
        .select(F.col("player_id").alias("focus_id"), "team_id", "season").distinct()
    )
    mates = (
        season_rows.select("player_id", "team_id", "season").join(mine, ["team_id", "season"])
        .filter(F.col("player_id") != F.col("focus_id"))
    )
    sides = teams.select(F.col("id").alias("team_id"), F.col("full_name").alias("name"), "abbreviation")
    shared = (
        mates.join(sides, "team_id", "left").groupBy("focus_id", "player_id").agg(
            F.sort_array(F.collect_set("season"), asc=False).alias("seasons_together"),
            F.sort_array(F.collect_set(F.struct("team_id", "name", "abbreviation"))).alias("teams_together"),
        )
    )
    return _named(shared.withColumn("total_seasons", F.size("seasons_together")), players)


def _named(df: DataFrame, players: DataFrame) -> DataFrame:
    return df.join(players.select(F.col("id").alias("player_id"), "full_name", "position"), "player_id")


def _preferred(*columns: str) -> Column:
    """Regular season first, then most games; the type name settles equal rows."""
    order = F.struct(
        (F.col("type") == REGULAR).alias("regular"), F.coalesce("games_played", F.lit(0)).alias("games"), F.col("type").alias("name"),
    )
    return F.max_by(F.struct(*columns), order)


def roster(season_rows: DataFrame, players: DataFrame, team_id: int | None = None, season: str | None = None) -> DataFrame:
    """One row per player of each (team, season), preferring the regular season. The newest season of a team by default."""
    rows = season_rows if team_id is None else season_rows.filter(F.col("team_id") == team_id)
    if season:
        rows = rows.filter(F.col("season") == season)
    else:
        newest = rows.groupBy("team_id").agg(F.max("season").alias("season"))
        rows = rows.join(newest, ["team_id", "season"], "left_semi")
    kept = rows.groupBy("team_id", "season", "player_id").agg(
        _preferred("type", "games_played", "pts", "reb", "ast", "min_seconds").alias("r")
    ).select("team_id", "season", "player_id", "r.*")
    n = F.coalesce(F.nullif("games_played", F.lit(0)), F.lit(1)).cast("double")
    return _named(kept, players).select(
        "team_id", "season", "player_id", "full_name", "position", "type",
        F.coalesce("games_played", F.lit(0)).alias("games_played"),
        *[(F.coalesce(F.col(c), F.lit(0)).cast("double") / n).alias(name) for name, c in (("ppg", "pts"), ("rpg", "reb"), ("apg", "ast"))],
        (F.coalesce("min_seconds", F.lit(0)).cast("double") / 60.0 / n).alias("mpg"),
    )


def career_path(season_rows: DataFrame) -> DataFrame:
    """One row per (player, season, team), preferring the regular season."""
    return season_rows.groupBy("player_id", "season", "team_id").agg(
        _preferred("type", "games_played", "start_date", "end_date").alias("r")
    ).select("player_id", "season", "team_id", "r.*")


# ---- categories -----------------------------------------------------------------------------


def award_winners(awards: DataFrame, *types: str) -> DataFrame:
    return awards.filter(F.col("award_type").isin(*types)).select("player_id").distinct()


def lottery_picks(players: DataFrame) -> DataFrame:
    return players.filter(is_lottery_pick(F.col("draft_number"))).select(F.col("id").alias("player_id"))


def europeans(players: DataFrame) -> DataFrame:
    return players.filter(is_european(F.col("country"))).select(F.col("id").alias("player_id"))


def in_both_conferences(season_rows: DataFrame, teams: DataFrame, first: str = "East", second: str = "West") -> DataFrame:
    sides = teams.select(F.col("id").alias("team_id"), "conference")
    seen = season_rows.select("player_id", "team_id").join(sides, "team_id").groupBy("player_id").agg(
        F.bool_or(F.col("conference") == first).alias("a"), F.bool_or(F.col("conference") == second).alias("b"))
    return seen.filter("a and b").select("player_id")


def companions_of(season_rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Players that shared a team and season with any *other* player listed in ``chosen``.

    Each (team, season) is reduced to the lowest and highest chosen id. A player
    qualifies if one of the two is somebody else, so no pairs are formed.
    """
    marks = season_rows.join(chosen.select("player_id").distinct(), "player_id", "left_semi")
    spans = marks.groupBy("team_id", "season").agg(F.min("player_id").alias("low"), F.max("player_id").alias("high"))
    stays = season_rows.select("player_id", "team_id", "season").join(spans, ["team_id", "season"])
    other = (F.col("low") != F.col("player_id")) | (F.col("high") != F.col("player_id"))
    return stays.filter(other).select("player_id").distinct()


def companions_of_country(season_rows: DataFrame, players: DataFrame, country: str = "Spain") -> DataFrame:
    chosen = players.filter(F.col("country") == country).select(F.col("id").alias("player_id"))
    return companions_of(season_rows, chosen)


def companions_of_player(season_rows: DataFrame, player_id: int) -> DataFrame:
    chosen = season_rows.filter(F.col("player_id") == player_id).select("player_id")
    return companions_of(season_rows, chosen).filter(F.col("player_id") != player_id)


CATEGORIES = ["champion", "all_star", "lottery", "conferences", "non_mvp", "spanish_mate", "european", "lebron_mate"]


def category_bitmaps(
    players: DataFrame, teams: DataFrame, season_rows: DataFrame, awards: DataFrame, star_id: int, country: str = "Spain"
) -> DataFrame:
    """(category, bucket, bits) for every category: one pass each over players, awards and stays, whose repeats do not matter."""
    kind = F.col("award_type")
    won = categories.marks(awards, {"champion": kind == "Champion", "all_star": kind == "All-Star", "non_mvp": kind.isin(*INDIVIDUAL_AWARDS)})
    born = categories.marks(players, {"lottery": is_lottery_pick(F.col("draft_number")), "european": is_european(F.col("country"))}, "id")
    chosen = {"spanish_mate": F.col("country") == country, "lebron_mate": F.col("id") == star_id}
    return categories.united([
        categories.bitmaps(won.unionByName(born)), categories.roster_bitmaps(season_rows, teams, players, chosen, "conferences"),
    ])


def category_members(
    players: DataFrame, teams: DataFrame, season_rows: DataFrame, awards: DataFrame, star_id: int, country: str = "Spain"
) -> DataFrame:
    """(category, player_id) for every category."""
    return categories.members(category_bitmaps(players, teams, season_rows, awards, star_id, country))


def hints(players: DataFrame, season_rows: DataFrame, members: DataFrame, letter: str, limit: int = 10) -> DataFrame:
    """Members with a word starting with the letter, most games first, each name once."""
    totals = season_rows.groupBy("player_id").agg(F.coalesce(F.sum("games_played"), F.lit(0)).alias("total_games"))
    fits = (
        players.filter(has_word_starting(F.col("full_name"), letter))
        .select(F.col("id").alias("player_id"), "full_name")
        .join(members.select("player_id"), "player_id", "left_semi")
        .join(totals, "player_id", "left")
    )
    return first_per_name(fits, [F.desc_nulls_last("total_games"), F.asc("player_id")], limit)
