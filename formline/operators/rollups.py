"""Derived aggregates: season rows per player and team, side totals, score repair, averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions.boxline import ratio, winner

# Season row types by game flag, summed columns.
SEASON_TYPES = {"Regular Season": "rs", "Playoffs": "po", "Play-In": "pi", "NBA Cup": "ist"}
SUM_COLUMNS = ["pts", "reb", "ast", "stl", "blk", "tov", "pf", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta"]
AVERAGED = ["pts", "reb", "ast", "stl", "blk", "tov"]
RATIOS = {"fg_pct": ("fgm", "fga"), "fg3_pct": ("fg3m", "fg3a"), "ft_pct": ("ftm", "fta")}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables in one result of one row per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def season_rollup(lines: DataFrame) -> DataFrame:
    """Rows per (player, team, season, competition type). A game with two flags counts in both types."""
    types = F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(name)) for name, flag in SEASON_TYPES.items()
    ]))
    return (
        lines.withColumn("type", F.explode(types))
        .groupBy("player_id", "team_id", "season", "type")
        .agg(
            F.min("date").alias("start_date"), F.max("date").alias("end_date"),
            F.count(F.lit(1)).alias("games_played"),
            *[F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0).cast("bigint")).alias(c) for c in SUM_COLUMNS],
            F.coalesce(F.sum("plus_minus"), F.lit(0.0)).alias("plus_minus"),
            F.sum("min_seconds").alias("min_seconds"),
        )
        .withColumn("is_detailed", F.lit(True))
    )


def side_rollup(lines: DataFrame) -> DataFrame:
    """Totals per (game, team). A mean plus-minus of 0 is stored as missing, like an absent one."""
    totals = lines.groupBy("game_id", "team_id").agg(
        *[F.sum(F.col(c).cast("bigint")).alias(f"total_{c}") for c in SUM_COLUMNS],
        F.avg("plus_minus").alias("mean_pm"),
    )
    return totals.withColumns({
        "avg_plus_minus": F.when(F.col("mean_pm") != 0, F.col("mean_pm")),
        **{name: ratio(F.col(f"total_{made}"), F.col(f"total_{att}")) for name, (made, att) in RATIOS.items()},
    }).drop("mean_pm")


def repaired_scores(games: DataFrame, sides: DataFrame) -> DataFrame:
    """Games with a missing or zero score filled from side totals, if both sides have totals.

    All games are returned; ``score_repaired`` marks the changed ones. The winner of a
    repaired game is recomputed, a tie has none.
    """
    suspicious = F.coalesce(F.col("home_score"), F.lit(0)).eqNullSafe(0) | F.coalesce(F.col("away_score"), F.lit(0)).eqNullSafe(0)
    broken = games.filter(suspicious)
    # Only broken games need totals: pivot them to one row per game.
    pivot = (
        sides.select(F.col("game_id").alias("id"), "team_id", "total_pts")
        .join(broken.select("id", "home_team_id", "away_team_id"), "id")
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("__sides"),
            F.max(F.when(F.col("team_id") == F.col("home_team_id"), F.col("total_pts"))).alias("__home"),
            F.max(F.when((F.col("team_id") == F.col("away_team_id")) & (F.col("team_id") != F.col("home_team_id")),
                         F.col("total_pts"))).alias("__away"),
        )
        .filter("__sides >= 2")
    )
    joined = games.join(pivot, "id", "left")
    home = F.when(F.col("__sides").isNotNull(), F.coalesce("__home", "home_score")).otherwise(F.col("home_score")).cast("bigint")
    away = F.when(F.col("__sides").isNotNull(), F.coalesce("__away", "away_score")).otherwise(F.col("away_score")).cast("bigint")
    done = F.col("__sides").isNotNull() & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    return (
        joined.withColumns({"home_score": home, "away_score": away})
        .withColumn("score_repaired", done)
        .withColumn("winner_team_id", F.when(
            F.col("score_repaired"),
            winner(F.col("home_team_id"), F.col("away_team_id"), F.col("home_score"), F.col("away_score")),
        ).otherwise(F.col("winner_team_id")))
        .drop("__sides", "__home", "__away")
    )


def _per_game(divisor, seconds: str = "min_seconds", names: Sequence[str] = AVERAGED) -> dict:
    d = divisor.cast("double")
    out = {c: F.try_divide(F.col(c).cast("double"), d) for c in names}
    out["mpg"] = F.try_divide(F.coalesce(F.col(seconds), F.lit(0)).cast("double") / 60.0, d)
    out |= {name: ratio(F.col(m), F.col(a)) for name, (m, a) in RATIOS.items()}
    out["plus_minus"] = F.try_divide(F.coalesce(F.col("plus_minus"), F.lit(0.0)), d)
    return out


def season_averages(lines: DataFrame, season_rows: DataFrame) -> DataFrame:
    """Regular-season means per (player, season).

    A stored season row with games wins. Otherwise the stat lines are used: the
    divisor is then the number of lines with playing time, or all lines if none
    has any, while ``games`` counts all lines.
    """
    stored = (
        season_rows.filter((F.col("type") == "Regular Season") & (F.col("games_played") > 0))
        .groupBy("player_id", "season")
        .agg(F.min_by(F.struct("games_played", *SUM_COLUMNS, "plus_minus", "min_seconds"), F.col("team_id")).alias("r"))
        .select("player_id", "season", "r.*")
    )
    stored = stored.select("player_id", "season", F.col("games_played").alias("games"),
                           *[c.alias(n) for n, c in _per_game(F.col("games_played")).items()])
    counted = lines.filter("rs").groupBy("player_id", "season").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("min_seconds") > 0).alias("__played"),
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in SUM_COLUMNS],
        F.sum("plus_minus").alias("plus_minus"), F.sum("min_seconds").alias("min_seconds"),
    )
    divisor = F.when(F.col("__played") > 0, F.col("__played")).otherwise(F.col("games"))
    computed = counted.select("player_id", "season", "games", *[c.alias(n) for n, c in _per_game(divisor).items()])
    missing = computed.join(stored, ["player_id", "season"], "left_anti")
    return stored.withColumn("source", F.lit("season row")).unionByName(missing.withColumn("source", F.lit("stat lines")))


def season_summaries(season_rows: DataFrame) -> DataFrame:
    """Each season row as per-game values; a row without games divides by 1."""
    games = F.coalesce(F.nullif(F.col("games_played"), F.lit(0)), F.lit(1))
    return season_rows.select(
        "player_id", "team_id", "season", "type", F.col("games_played").alias("games"),
        *[c.alias(n) for n, c in _per_game(games).items()],
    )


def career_totals(season_rows: DataFrame) -> DataFrame:
    """Weighted career means per (player, type); players without games are left out."""
    grouped = season_rows.groupBy("player_id", "type").agg(
        F.sum("games_played").alias("games"),
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in SUM_COLUMNS],
        F.sum("plus_minus").alias("plus_minus"), F.sum("min_seconds").alias("min_seconds"),
    )
    return grouped.filter("games > 0").select(
        "player_id", "type", "games", *[c.alias(n) for n, c in _per_game(F.col("games")).items()],
    )


def experience(players: DataFrame, season_rows: DataFrame) -> DataFrame:
    """Distinct seasons on record, else the stored experience, else 0."""
    seen = season_rows.select("player_id", "season").distinct().groupBy("player_id").agg(F.count(F.lit(1)).alias("__n"))
    return (
        players.join(seen.withColumnRenamed("player_id", "id"), "id", "left")
        .select("id", F.coalesce("__n", "season_exp", F.lit(0)).cast("bigint").alias("experience"))
    )


def seasons_listed(games: DataFrame) -> DataFrame:
    return games.select("season").distinct().orderBy(F.desc("season"))


def team_seasons(season_rows: DataFrame, games: DataFrame) -> DataFrame:
    """Seasons per team from the season rows; teams without any take those of their games."""
    rows = season_rows.select("team_id", "season").distinct()
    sides = games.select("season", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).filter("team_id is not null").distinct()
    return rows.unionByName(sides.join(rows, "team_id", "left_anti"))
