"""Series between pairs of sides, and brackets of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cup knock-out codes with (round, position), suffixes of knock-out games,
# display names of the rounds.
CUP_PLACES = {
    "1201": (2, 0), "1202": (2, 1), "1203": (2, 2), "1204": (2, 3),
    "1229": (3, 0), "1230": (3, 1),
}
CUP_FINAL_PREFIX = "006"
PLAYOFF_PREFIX = "004"
PLAYOFF_ROUNDS = {1: "Primera Ronda", 2: "Semis de Conferencia", 3: "Finales de Conferencia", 4: "Finales NBA"}
CUP_ROUNDS = {2: "Cuartos de Final", 3: "Semifinales", 4: "Final (NBA Cup)"}
NO_POSITION = 99


def playoff_place(code: Column) -> Column:
    """(round, position) from digits 8 and 9 of a ten-character playoff code, else null."""
    usable = (F.length(code) == 10) & code.startswith(PLAYOFF_PREFIX)
    rnd, pos = F.substring(code, 8, 1).try_cast("int"), F.substring(code, 9, 1).try_cast("int")
    return F.when(usable & rnd.isNotNull(), F.struct(rnd.alias("round"), pos.alias("position")))


def cup_place(code: Column) -> Column:
    """(round, position) of a cup knock-out code, else null."""
    def place(r: int, p: int) -> Column:
        return F.struct(F.lit(r).alias("round"), F.lit(p).alias("position"))

    out = F.when(code.startswith(CUP_FINAL_PREFIX), place(4, 0))
    for ending, (rnd, pos) in CUP_PLACES.items():
        out = out.when(code.endswith(ending), place(rnd, pos))
    return F.when(F.length(code) == 10, out)


def pair_series(games: DataFrame, cup: bool = False, code: str = "id", by: tuple[str, ...] = ("season",)) -> DataFrame:
    """One row per unordered pair of sides: wins, first and last day, cup score, round and position.

    The smaller id is team 1. In a cup the score is that of the last decided game.
    """
    rows = games.filter(F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull())
    home_first = F.col("home_team_id") <= F.col("away_team_id")
    rows = rows.select(
        *by, "date", F.col(code).alias("__code"), "winner_team_id",
        F.least("home_team_id", "away_team_id").alias("team1_id"),
        F.greatest("home_team_id", "away_team_id").alias("team2_id"),
        F.when(home_first, F.col("home_score")).otherwise(F.col("away_score")).alias("__s1"),
        F.when(home_first, F.col("away_score")).otherwise(F.col("home_score")).alias("__s2"),
    )
    decided = F.col("winner_team_id").isin(F.col("team1_id"), F.col("team2_id"))
    latest = F.struct("date", "__code", "__s1", "__s2")
    place = cup_place(F.col("__code")) if cup else playoff_place(F.col("__code"))
    aggs = [
        F.count_if(F.col("winner_team_id") == F.col("team1_id")).alias("t1_wins"),
        F.count_if((F.col("winner_team_id") == F.col("team2_id")) & (F.col("team1_id") != F.col("team2_id"))).alias("t2_wins"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.max(F.when(place.isNotNull(), F.struct(F.col("date"), F.col("__code"), place.alias("place")))).alias("__placed"),
        F.max(F.when(decided, latest)).alias("__last"),
    ]
    zero = F.lit(0)
    t1, t2 = (F.coalesce("__last.__s1", zero), F.coalesce("__last.__s2", zero)) if cup else (zero, zero)
    return rows.groupBy(*by, "team1_id", "team2_id").agg(*aggs).select(
        *by, "team1_id", "team2_id", "t1_wins", "t2_wins", t1.cast("bigint").alias("t1_score"), t2.cast("bigint").alias("t2_score"),
        "first_date", "last_date",
        F.col("__placed.place.round").alias("round"),
        F.coalesce("__placed.place.position", F.lit(NO_POSITION)).alias("position"),
    )


def playoff_games(games: DataFrame, finished_only: bool = True) -> DataFrame:
    rows = games.filter("po")
    return rows.filter(F.col("status") == 3) if finished_only else rows


def cup_games(games: DataFrame, code: str = "id") -> DataFrame:
    """Finished cup games of the knock-out stage: not regular-season games, or a knock-out suffix."""
    knock_out = ~F.col("rs")
    for ending in CUP_PLACES:
        knock_out = knock_out | F.col(code).endswith("0" + ending)
    return games.filter(F.col("ist") & (F.col("status") == 3) & knock_out)


def _rounds(series: DataFrame, names: dict[int, str]) -> DataFrame:
    """Series with a round of 1 to 4, named."""
    label = F.lit(None).cast("string")
    for number, name in names.items():
        label = F.when(F.col("round") == number, F.lit(name)).otherwise(label)
    return series.filter(F.col("round").between(1, 4)).withColumn(
        "round_name", F.coalesce(label, F.concat(F.lit("Ronda "), F.col("round").cast("string"))))


def playoff_bracket(games: DataFrame, code: str = "id", finished_only: bool = True) -> DataFrame:
    return _rounds(pair_series(playoff_games(games, finished_only), code=code), PLAYOFF_ROUNDS)


def cup_bracket(games: DataFrame, code: str = "id") -> DataFrame:
    return _rounds(pair_series(cup_games(games, code), cup=True, code=code), CUP_ROUNDS)


def nested_rounds(bracket: DataFrame, teams: DataFrame) -> DataFrame:
    """One row per (season, round) with the named series in position order.

    A round has at most one series per pair of teams, so the list is bounded by the team table.
    """
    def named(side: str) -> DataFrame:
        return teams.select(F.col("id").alias(f"{side}_id"), F.col("full_name").alias(f"{side}_name"), F.col("abbreviation").alias(f"{side}_abbr"))

    full = bracket.join(named("team1"), "team1_id").join(named("team2"), "team2_id")
    item = F.struct("position", "team1_id", "team1_name", "team1_abbr", "team2_id", "team2_name", "team2_abbr",
                    "t1_wins", "t2_wins", "t1_score", "t2_score", "first_date", "last_date")
    return full.groupBy("season", "round", "round_name").agg(F.sort_array(F.collect_list(item)).alias("series"))
