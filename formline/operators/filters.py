"""Optional filters, ordered listings and data-quality selections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted spellings of the competitions, special event sides, id range of clubs,
# texts that mark an unreadable biography, months in which all active players are refreshed.
COMPETITION_ALIASES = {
    "rs": "rs", "regular": "rs", "regular season": "rs",
    "po": "po", "playoffs": "po",
    "pi": "pi", "playin": "pi",
    "ist": "ist", "cup": "ist", "nba cup": "ist",
}
SPECIAL_EVENT_TEAM_IDS = [1610616833, 1610616834]
CLUB_ID_RANGE = (1610612737, 1610612766)
CORRUPT_TEXTS = ["nan", "None", ""]
REPAIRED_FIELDS = ["height", "position", "country", "school", "jersey"]
AWARD_MONTHS = [4, 5, 6]


def teams(df: DataFrame, conference: str | None = None, division: str | None = None) -> DataFrame:
    if conference:
        df = df.filter(F.col("conference") == conference)
    if division:
        df = df.filter(F.col("division") == division)
    return df.orderBy("full_name", "id")


def players(
    df: DataFrame,
    name: str | None = None,
    position: str | None = None,
    active_only: bool = False,
    memberships: DataFrame | None = None,
    team_id: int | None = None,
    season: str | None = None,
) -> DataFrame:
    """Players by name and position; membership of a team or season is a semi-join, so no duplicates arise."""
    if name:
        df = df.filter(F.col("full_name").ilike(f"%{name}%"))
    if position:
        df = df.filter(F.col("position").ilike(f"%{position}%"))
    if active_only:
        df = df.filter("is_active")
    if team_id or season:
        stays = memberships
        if team_id:
            stays = stays.filter(F.col("team_id") == team_id)
        if season:
            stays = stays.filter(F.col("season") == season)
        df = df.join(stays.select(F.col("player_id").alias("id")), "id", "left_semi")
    return df.orderBy("full_name", "id")


def competition_flag(name: str) -> Column | None:
    """Flag column for a spelling of a competition, None for an unknown one (no filter)."""
    flag = COMPETITION_ALIASES.get(name.lower())
    return F.col(flag) if flag else None


def games(
    df: DataFrame,
    season: str | None = None,
    team_id: int | None = None,
    start: date | str | None = None,
    end: date | str | None = None,
    finished_only: bool = False,
    competition: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Games of a side, date range or competition, newest first."""
    if season:
        df = df.filter(F.col("season") == season)
    if team_id is not None:
        df = df.filter((F.col("home_team_id") == team_id) | (F.col("away_team_id") == team_id))
    if start:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    if finished_only:
        df = df.filter(F.col("status") == 3)
    flag = competition_flag(competition) if competition else None
    if flag is not None:
        df = df.filter(flag)
    df = df.orderBy(F.desc("date"), F.desc("id"))
    return df.limit(limit) if limit else df


def games_page(
    df: DataFrame,
    season: str | None = None,
    on: str | None = None,
    start: str | None = None,
    end: str | None = None,
    team_id: int | None = None,
) -> DataFrame:
    """Listing of a page: an exact day wins over a range; without any choice the latest season."""
    if on:
        return games(df, season, team_id, start=on, end=on)
    if start or end or season:
        return games(df, season, team_id, start=start, end=end)
    return games(df.filter(F.col("season") == df.agg(F.max("season")).scalar()), team_id=team_id)


def stat_lines(
    lines: DataFrame,
    player_id: int | None = None,
    game_id: object | None = None,
    team_id: int | None = None,
    season: str | None = None,
    min_points: int | None = None,
    limit: int | None = None,
    by_date: bool = True,
) -> DataFrame:
    """Stat lines, newest first or highest first."""
    for column, wanted in (("player_id", player_id), ("game_id", game_id), ("team_id", team_id), ("season", season)):
        if wanted is not None:
            lines = lines.filter(F.col(column) == wanted)
    if min_points:
        lines = lines.filter(F.col("pts") >= min_points)
    order = [F.desc("date"), F.desc("pts")] if by_date else [F.desc("pts"), F.desc("date")]
    lines = lines.orderBy(*order, F.desc("game_id"), "player_id")
    return lines.limit(limit) if limit else lines


def games_by_total(
    df: DataFrame,
    low: int | None = None,
    high: int | None = None,
    season: str | None = None,
    limit: int = 10,
) -> DataFrame:
    """Finished games with a total in [low, high], highest first; missing totals lead, as nulls sort high."""
    total = F.col("home_score") + F.col("away_score")
    df = df.filter(F.col("status") == 3).withColumn("total_points", total)
    if season:
        df = df.filter(F.col("season") == season)
    if low is not None:
        df = df.filter(F.col("total_points") >= low)
    if high is not None:
        df = df.filter(F.col("total_points") <= high)
    return df.orderBy(F.desc_nulls_first("total_points"), F.desc("date"), F.desc("id")).limit(limit)


def recent(
    df: DataFrame,
    window: str,
    season: str | None = None,
    when: str = "date",
    period: str = "season",
    week_days: int = 7,
    month_days: int = 30,
) -> DataFrame:
    """Rows relative to the newest day of the input: last_game, week, month, or the season given."""
    if window in ("last_game", "week", "month"):
        back = {"last_game": 0, "week": week_days, "month": month_days}[window]
        newest = df.agg(F.max(when)).scalar()
        return df.filter(F.col(when) >= F.date_sub(newest, back))
    return df.filter(F.col(period) == season) if season else df


def still_playing(df: DataFrame, year: int) -> DataFrame:
    """Players without a last year, or whose last year is at most one year ago."""
    return df.filter(F.col("to_year").isNull() | (F.col("to_year") >= year - 1))


def with_valid_team(df: DataFrame, known: DataFrame, allow_special: bool = False, team: str = "team_id") -> DataFrame:
    """Add ``valid_team``: a known side, the club id range, or (if allowed) a special event side."""
    listed = known.select(F.col("id").alias(team)).distinct().withColumn("__known", F.lit(True))
    valid = F.col("__known").isNotNull() | F.col(team).between(*CLUB_ID_RANGE)
    if allow_special:
        valid = valid | F.col(team).isin(SPECIAL_EVENT_TEAM_IDS)
    return df.join(listed, team, "left").withColumn("valid_team", F.coalesce(valid, F.lit(False))).drop("__known")


def needing_award_refresh(
    players_df: DataFrame,
    lines: DataFrame,
    today: date | str,
    force_all: bool = False,
    days: int = 15,
) -> DataFrame:
    """Active players never refreshed, or refreshed too long ago and playing since; in the award months, all active."""
    day = F.lit(str(today)).cast("date")
    active = players_df.filter("is_active")
    if force_all or int(str(today)[5:7]) in AWARD_MONTHS:
        return active
    cutoff = F.date_sub(day, days)
    playing = (
        lines.filter(F.col("date") >= cutoff).select(F.col("player_id").alias("id")).distinct().withColumn("__playing", F.lit(True))
    )
    stale = (F.col("last_award_sync") < cutoff) & F.col("__playing").isNotNull()
    return active.join(playing, "id", "left").filter(F.col("last_award_sync").isNull() | stale).drop("__playing")


def completed_games(games_df: DataFrame, lines: DataFrame) -> DataFrame:
    """Finished (or scored) games that have stat lines."""
    done = (F.col("status") == 3) | ((F.col("status") == 1) & (F.col("home_score") > 0))
    return games_df.filter(done).join(lines.select(F.col("game_id").alias("id")), "id", "left_semi")


def repaired_biographies(df: DataFrame) -> DataFrame:
    """Rows whose height spells a missing value get N/A in every corrupt text field."""
    broken = F.coalesce(F.col("height").isin(CORRUPT_TEXTS), F.lit(False))
    fields = [c for c in REPAIRED_FIELDS if c in df.columns]
    return df.withColumns({
        c: F.when(broken & F.col(c).isin(CORRUPT_TEXTS), F.lit("N/A")).otherwise(F.col(c)) for c in fields
    })


def conference_cells(df: DataFrame, cells: list[tuple[str, str]]) -> DataFrame:
    """Teams listed by (conference, division) for the known cells; others are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("conference"), F.lit(d).alias("division")) for c, d in cells])
    known = F.array_contains(pairs, F.struct(F.col("conference").alias("conference"), F.col("division").alias("division")))
    return df.filter(known).groupBy("conference", "division").agg(
        F.count(F.lit(1)).alias("n_teams"),
        F.sort_array(F.collect_list(F.struct("full_name", "id", "abbreviation"))).alias("teams"),
    )


def team_by_abbreviation(df: DataFrame, text: str) -> DataFrame:
    """First team (by id) whose abbreviation contains the text."""
    return df.filter(F.col("abbreviation").ilike(f"%{text}%")).orderBy("id").limit(1)
