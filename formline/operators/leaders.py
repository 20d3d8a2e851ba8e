"""Leader boards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.awards import AWARD_CLASSES, award_priority

# Made and attempted columns of the ratios with the least attempts, least games,
# boards of the overview.
RATIO_STATS = {"fg_pct": ("fgm", "fga", 300), "fg3_pct": ("fg3m", "fg3a", 82), "ft_pct": ("ftm", "fta", 125)}
MIN_GAMES = 5
BOARD_STATS = ["pts", "reb", "ast", "stl", "blk"]


def top_average(lines: DataFrame, stat: str, season: str | None = None, limit: int = 10) -> DataFrame:
    """Best means of a counting column; every row counts as a game."""
    rows = lines.filter(F.col("season") == season) if season else lines
    return (
        rows.groupBy("player_id")
        .agg(F.sum(F.col(stat).cast("bigint")).alias("total"), F.count(stat).alias("valued"), F.count(F.lit(1)).alias("games"))
        .filter(F.col("games") >= MIN_GAMES)
        .select("player_id", F.try_divide(F.col("total").cast("double"), F.col("valued").cast("double")).alias("value"), "games")
        .orderBy(F.desc_nulls_first("value"), "player_id").limit(limit)
    )


def top_ratio(
    lines: DataFrame, made: str, attempted: str, min_attempts: int, season: str | None = None, limit: int = 10
) -> DataFrame:
    """Best ratio of sums among players with enough games and attempts."""
    rows = lines.filter(F.col("season") == season) if season else lines
    return (
        rows.groupBy("player_id")
        .agg(
            F.sum(F.col(made).cast("bigint")).alias("total_made"),
            F.sum(F.col(attempted).cast("bigint")).alias("total_attempts"),
            F.count(F.lit(1)).alias("games"),
        )
        .filter((F.col("games") >= MIN_GAMES) & (F.col("total_attempts") >= min_attempts))
        .withColumn("value", F.try_divide(F.col("total_made").cast("double"), F.col("total_attempts").cast("double")))
        .orderBy(F.desc("value"), "player_id").limit(limit)
        .select("player_id", "value", "games", "total_made", "total_attempts")
    )


def top_players(lines: DataFrame, stat: str, season: str | None = None, limit: int = 10) -> DataFrame:
    """Leader board of any statistic, by mean or by ratio of sums."""
    if stat in RATIO_STATS:
        return top_ratio(lines, *RATIO_STATS[stat], season=season, limit=limit).select(
            "player_id", F.round("value", 4).alias("value"), "games")
    return top_average(lines, stat, season, limit)


def boards(lines: DataFrame, stats: Sequence[str] = BOARD_STATS, season: str | None = None, limit: int = 10) -> DataFrame:
    """Several leader boards from one aggregation; the newest season unless one is given."""
    chosen = F.lit(season) if season else lines.agg(F.max("season")).scalar()
    means = (
        lines.filter(F.col("season") == chosen).groupBy("player_id")
        .agg(F.count(F.lit(1)).alias("games"), *[F.sum(F.col(s).cast("bigint")).alias(s) for s in stats], *[F.count(s).alias(f"__n_{s}") for s in stats])
        .filter(F.col("games") >= MIN_GAMES)
    )
    cells = F.array(*[
        F.struct(F.lit(s).alias("metric"), F.try_divide(F.col(s).cast("double"), F.col(f"__n_{s}").cast("double")).alias("value")) for s in stats
    ])
    order = Window.partitionBy("metric").orderBy(F.desc_nulls_first("value"), "player_id")
    return (
        means.select("player_id", "games", F.inline(cells))
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    )


def normalised_award_type(text: str) -> str:
    """Accept any capitalisation of an award class."""
    known = {c.lower(): c for c in AWARD_CLASSES.values()}
    return known.get(text.strip().lower(), text)


def award_leaders(
    awards: DataFrame,
    players: DataFrame,
    award_type: str | None = None,
    active_only: bool = False,
    limit: int = 10,
) -> DataFrame:
    """Players with most awards, with their distinct seasons, newest first."""
    rows = awards.filter(F.col("award_type") == normalised_award_type(award_type)) if award_type else awards
    people = players.filter("is_active") if active_only else players
    counted = rows.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("award_count"), F.sort_array(F.collect_set("season"), asc=False).alias("seasons"))
    return (
        counted.join(people.select(F.col("id").alias("player_id"), "full_name", "is_active"), "player_id")
        .orderBy(F.desc("award_count"), "player_id").limit(limit)
    )


def grouped_awards(awards: DataFrame) -> DataFrame:
    """Awards of each player by name: class, count, seasons newest first, and the display position."""
    grouped = awards.groupBy("player_id", "award_name").agg(
        F.max("award_type").alias("award_type"),
        F.count(F.lit(1)).alias("award_count"),
        F.sort_array(F.collect_list("season"), asc=False).alias("seasons"),
    )
    order = Window.partitionBy("player_id").orderBy("priority", "award_name")
    return (
        grouped.withColumn("priority", award_priority(F.col("award_type")))
        .withColumn("place", F.row_number().over(order))
        .select(
            "player_id", "award_type", "award_name", "award_count", "seasons", "place",
            F.when(F.col("award_type") == "Champion", "NBA Champion").otherwise(F.col("award_name")).alias("display_name"),
        )
    )
