"""Cleaning of landed inputs: game lists, game summaries, box scores, dimensions, awards.

The delivered files are read with ``spark.read.json`` / ``parquet`` and passed in;
nothing here talks to a remote service.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions import seasons as S
from formline.functions.awards import award_class, award_name, is_skipped
from formline.functions.boxline import ratio, repaired_shots
from formline.functions.casts import clean_text, clock_to_seconds, parse_day, positive_int_or_null, safe_double, safe_int
from formline.functions.people import looks_abbreviated
from formline.operators.filters import with_valid_team

# Delivered column names of each statistic, newest naming first.
LINE_ALIASES = {
    "player_id": ["personId", "PLAYER_ID", "playerId"],
    "team_id": ["teamId", "TEAM_ID"],
    "minutes": ["minutes", "MIN", "min"],
    "pts": ["points", "PTS"],
    "reb": ["reboundsTotal", "REB"],
    "ast": ["assists", "AST"],
    "stl": ["steals", "STL"],
    "blk": ["blocks", "BLK"],
    "tov": ["turnovers", "TOV"],
    "pf": ["foulsPersonal", "PF"],
    "plus_minus": ["plusMinusPoints", "PLUS_MINUS"],
    "fgm": ["fieldGoalsMade", "FGM"],
    "fga": ["fieldGoalsAttempted", "FGA"],
    "fg3m": ["threePointersMade", "FG3M"],
    "fg3a": ["threePointersAttempted", "FG3A"],
    "ftm": ["freeThrowsMade", "FTM"],
    "fta": ["freeThrowsAttempted", "FTA"],
}
NAME_ALIASES = ["PLAYER_NAME", "playerName", "name", "nameI"]
COUNTS = ["pts", "reb", "ast", "stl", "blk", "tov", "pf"]
SHOTS = ["fgm", "fga", "fg3m", "fg3a", "ftm", "fta"]
FINAL_STATUS = 3

_SIDE = "struct<score:string,periods:array<struct<score:int,points:int>>>"
_GAME = (
    "struct<gameStatus:int,gameEt:string,gameTimeUTC:string,gameSubtype:string,seasonYear:string,"
    f"homeTeamId:bigint,awayTeamId:bigint,homeTeam:{_SIDE},awayTeam:{_SIDE}>"
)
SUMMARY_SCHEMA = f"game {_GAME}, boxScoreSummary {_GAME}"


def alias_column(df: DataFrame, names: list[str]) -> Column:
    """First delivered name that exists in this input; null if none does."""
    present = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


# ---- game list ------------------------------------------------------------------------------


def season_games(lists: dict[str, DataFrame], season: str | None = None) -> DataFrame:
    """One row per game from per-competition lists with two rows per game (one for each side).

    ``lists`` maps a flag (is_rs, is_po, is_pi) to its list (GAME_ID, GAME_DATE, WL,
    and ``season`` unless one is given). Flags are or-ed; the date and result are
    the first ones present, in text order, so that the outcome does not depend on
    the order of delivery. Results come newest first.
    """
    flags = ["is_rs", "is_po", "is_pi"]
    tagged = [df.withColumn(flag, F.lit(True)) for flag, df in lists.items()]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    for flag in flags:
        both = both.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) if flag in both.columns else F.lit(False))
    label = F.lit(season) if season else F.col("season")
    grouped = both.withColumn("season", label).groupBy(F.col("GAME_ID").alias("game_id")).agg(
        F.max("season").alias("season"), F.min("GAME_DATE").alias("GAME_DATE"), F.min("WL").alias("WL"),
        *[F.max(flag).alias(flag) for flag in flags],
    )
    return grouped.select(
        "game_id", "season", parse_day(F.col("GAME_DATE")).alias("game_date"), *flags,
        S.is_cup_code(F.col("game_id"), F.col("season")).alias("is_ist"),
        finished_from_result(F.col("WL")).alias("is_finished"),
    ).orderBy(F.desc("game_date"), F.desc("game_id"))


def finished_from_result(wl: Column) -> Column:
    return F.coalesce(F.upper(F.trim(wl)).isin("W", "L"), F.lit(False))


# ---- game summary ---------------------------------------------------------------------------


def games_from_summaries(
    raw: DataFrame, predicted: DataFrame | None = None, season_fallback: str | None = None
) -> DataFrame:
    """Finished games from (game_id, payload) rows with JSON text.

    Either envelope key is accepted. The local date wins over UTC, the delivered
    subtype over the predicted cup flag; a tie is booked to the away side.
    ``predicted`` carries the flags of :func:`season_games`.
    """
    # Expanding the parsed value as one row keeps the optimizer from parsing once per field.
    parsed = raw.select("game_id", F.inline(F.array(F.from_json("payload", SUMMARY_SCHEMA))))
    rows = parsed.select("game_id", F.coalesce("game", "boxScoreSummary").alias("g")).filter(
        F.col("g.gameStatus") == FINAL_STATUS)
    flags = ["is_rs", "is_po", "is_pi", "is_ist"]
    if predicted is not None:
        rows = rows.join(predicted.select("game_id", *flags), "game_id", "left")
    else:
        rows = rows.withColumns({f: F.lit(False) for f in flags})
    day = parse_day(F.coalesce(F.nullif(F.col("g.gameEt"), F.lit("")), F.col("g.gameTimeUTC")))
    subtype = F.coalesce("g.gameSubtype", F.lit(""))

    def score(side: str) -> Column:
        return safe_int(F.col(f"g.{side}.score"))

    def periods(side: str) -> Column:
        return F.transform(F.col(f"g.{side}.periods"), lambda p: F.coalesce(p["score"], p["points"]))

    both = F.col("g.homeTeam.periods").isNotNull() & F.col("g.awayTeam.periods").isNotNull()
    return rows.select(
        F.col("game_id").alias("id"), day.alias("date"),
        S.deduce_season(F.col("game_id"), F.col("g.seasonYear"), F.lit(season_fallback), day).alias("season"),
        *[F.coalesce(f"is_{c}", F.lit(False)).alias(c) for c in ("rs", "po", "pi")],
        F.when(subtype != "", subtype.startswith("in-season")).otherwise(F.coalesce("is_ist", F.lit(False))).alias("ist"),
        F.col("g.gameStatus").alias("status"),
        F.col("g.homeTeamId").alias("home_team_id"), F.col("g.awayTeamId").alias("away_team_id"),
        score("homeTeam").alias("home_score"), score("awayTeam").alias("away_score"),
        F.when(score("homeTeam") > score("awayTeam"), F.col("g.homeTeamId")).otherwise(F.col("g.awayTeamId")).alias("winner_team_id"),
        F.when(both, F.struct(periods("homeTeam").alias("home"), periods("awayTeam").alias("away"))).alias("quarter_scores"),
    ).filter("season is not null")


# ---- box score ------------------------------------------------------------------------------


def clean_statistics(df: DataFrame, kept: list[str]) -> DataFrame:
    """Delivered lines with typed statistics: tolerant casts, then shots repaired, then shares."""
    raw = {name: alias_column(df, names) for name, names in LINE_ALIASES.items()}
    typed = df.select(
        *kept, safe_int(raw["player_id"], -1).alias("player_id"), safe_int(raw["team_id"], -1).alias("team_id"),
        clock_to_seconds(raw["minutes"]).alias("min_seconds"), *[safe_int(raw[c]).alias(c) for c in COUNTS],
        safe_double(raw["plus_minus"]).alias("plus_minus"), *[safe_int(raw[c]).alias(c) for c in SHOTS],
    )
    fixed = typed.withColumns(repaired_shots(*[F.col(c) for c in SHOTS]))
    return fixed.withColumns({
        "fg_pct": ratio(F.col("fgm"), F.col("fga")),
        "fg3_pct": ratio(F.col("fg3m"), F.col("fg3a")),
        "ft_pct": ratio(F.col("ftm"), F.col("fta")),
    })


def box_score_lines(df: DataFrame, teams: DataFrame, name_fallback: DataFrame | None = None) -> DataFrame:
    """Stat lines from delivered rows of any naming.

    Rows without a usable player or team are left out, as are empty rows (no name,
    no time, no points). Names come from first and family name, a name column,
    ``name_fallback`` (player_id, name), or ``Player <id>``.
    """
    first, family = alias_column(df, ["firstName"]), alias_column(df, ["familyName"])
    given = F.when((first != "") & (family != ""), F.trim(F.concat_ws(" ", first, family))).otherwise(alias_column(df, NAME_ALIASES))
    named = df.withColumn("__name", F.nullif(F.trim(given), F.lit("")))
    cleaned = clean_statistics(named, ["game_id", "__name"]).filter((F.col("player_id") > 0) & (F.col("team_id") > 0))
    cleaned = with_valid_team(cleaned, teams).filter("valid_team").drop("valid_team")
    if name_fallback is not None:
        spare = name_fallback.groupBy("player_id").agg(F.min("name").alias("__spare"))
        cleaned = cleaned.join(spare, "player_id", "left")
    else:
        cleaned = cleaned.withColumn("__spare", F.lit(None).cast("string"))
    empty = F.col("__name").isNull() & (F.col("min_seconds") == 0) & F.col("__spare").isNull() & (F.col("pts") == 0)
    label = F.coalesce("__name", "__spare", F.concat(F.lit("Player "), F.col("player_id").cast("string")))
    return cleaned.filter(~empty).withColumn("player_name", label).drop("__name", "__spare")


# ---- dimensions -----------------------------------------------------------------------------


def team_dimension(landed: DataFrame, existing: DataFrame, conferences: DataFrame | None = None) -> DataFrame:
    """Teams with refreshed attributes; an abbreviation in use by another id becomes ``ABBR_id``.

    ``conferences`` (id, conference, division) updates the two columns.
    """
    taken = existing.select(F.col("abbreviation"), F.col("id").alias("__owner"))
    clash = (
        landed.select("id", "abbreviation").join(taken, "abbreviation").filter(F.col("id") != F.col("__owner"))
        .select("id").distinct().withColumn("__clash", F.lit(True))
    )
    first = Window.partitionBy("abbreviation").orderBy("id")
    fresh = (
        landed.join(clash, "id", "left").withColumn("__rank", F.row_number().over(first))
        .withColumn("abbreviation", F.when(
            F.col("__clash").isNotNull() | (F.col("__rank") > 1), F.concat_ws("_", "abbreviation", F.col("id").cast("string")),
        ).otherwise(F.col("abbreviation")))
        .drop("__clash", "__rank")
    )
    kept = existing.select("id", "conference", "division")
    merged = fresh.join(kept, "id", "left").unionByName(existing.join(landed, "id", "left_anti"), allowMissingColumns=True)
    if conferences is None:
        return merged
    news = conferences.select("id", F.col("conference").alias("__c"), F.col("division").alias("__d"))
    return merged.join(news, "id", "left").withColumns({
        "conference": F.coalesce("__c", "conference"), "division": F.coalesce("__d", "division")}).drop("__c", "__d")


def player_dimension(landed: DataFrame, existing: DataFrame, refresh_names: bool = False) -> DataFrame:
    """Players after a roster load: activity always follows the list, names only if abbreviated or asked for."""
    news = landed.select("id", F.col("full_name").alias("__name"), F.coalesce("is_active", F.lit(False)).alias("__active"))
    listed = F.col("__active").isNotNull()
    rename = F.col("full_name").isNull() | looks_abbreviated(F.col("full_name")) | F.lit(refresh_names)
    return (
        existing.join(news, "id", "full_outer")
        .withColumns({
            "full_name": F.when(listed & rename, F.col("__name")).otherwise(F.col("full_name")),
            "is_active": F.coalesce("__active", "is_active"),
        })
        .drop("__name", "__active")
    )


def biographies(raw: DataFrame) -> DataFrame:
    """Delivered biography columns as typed player columns, bad values as null."""
    text = {
        "full_name": "DISPLAY_FIRST_LAST", "height": "HEIGHT", "school": "SCHOOL", "country": "COUNTRY",
        "jersey": "JERSEY", "position": "POSITION",
    }
    numbers = {
        "weight": "WEIGHT", "draft_year": "DRAFT_YEAR", "draft_round": "DRAFT_ROUND", "draft_number": "DRAFT_NUMBER",
        "from_year": "FROM_YEAR", "to_year": "TO_YEAR", "season_exp": "SEASON_EXP",
    }
    return raw.select(
        F.col("PERSON_ID").cast("bigint").alias("id"), parse_day(F.col("BIRTHDATE")).alias("birthdate"),
        *[clean_text(F.col(c)).alias(n) for n, c in text.items()],
        *[positive_int_or_null(F.col(c)).cast("int").alias(n) for n, c in numbers.items()],
        F.lit(True).alias("bio_synced"),
    )


def with_biographies(players: DataFrame, raw: DataFrame) -> DataFrame:
    """Players with delivered biographies put in; the name stays if none is delivered."""
    news = biographies(raw)
    fields = [c for c in news.columns if c != "id"]
    renamed = news.select("id", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__hit"))
    joined = players.join(renamed, "id", "left")
    updates = {}
    for c in fields:
        new = F.coalesce("__full_name", "full_name") if c == "full_name" else F.col(f"__{c}")
        updates[c] = F.when(F.col("__hit"), new).otherwise(F.col(c)) if c in players.columns else new
    return joined.withColumns(updates).drop("__hit", *[f"__{c}" for c in fields])


# ---- awards ---------------------------------------------------------------------------------


def classified_awards(raw: DataFrame) -> DataFrame:
    """(player_id, season, award_type, award_name) from (player_id, season, description, team_number): filtered, repeats kept."""
    # One step per derived text, so that none is computed once per test.
    rows = raw.select("player_id", F.trim("season").alias("season"), F.trim("description").alias("text"), "team_number")
    rows = rows.filter(~is_skipped(F.col("text"))).withColumn("lowered", F.lower("text"))
    return rows.select(
        "player_id", "season", award_class(F.col("text"), F.col("lowered")).alias("award_type"),
        award_name(F.col("text"), F.col("team_number")).alias("award_name"),
    )


def award_rows(raw: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Awards from (player_id, season, description, team_number): filtered, named, classified.

    One row per (player, season, name); rows already in ``known`` are left out.
    """
    rows = classified_awards(raw)
    # The class follows from the description, so equal names have equal classes.
    unique = rows.groupBy("player_id", "season", "award_name").agg(F.min("award_type").alias("award_type"))
    if known is not None:
        unique = unique.join(known, ["player_id", "season", "award_name"], "left_anti")
    return unique.select("player_id", "season", "award_type", "award_name", F.lit(None).cast("string").alias("description"))
