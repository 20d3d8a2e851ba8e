"""What is missing in the store compared with the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.operators.running import Running, running

STOP_AFTER = 3


def frontier(games: DataFrame) -> DataFrame:
    """One row: the newest season that has a finished game."""
    return games.filter(F.col("status") == 3).agg(F.max("season").alias("frontier"))


def empty_seasons(seasons: DataFrame, games: DataFrame) -> DataFrame:
    """Seasons newer than the frontier; all of them if nothing is finished. Older ones are not looked at."""
    newest = frontier(games).scalar()
    return seasons.filter(newest.isNull() | (F.col("season") > newest))


def gap_scan(
    source: DataFrame, stored: DataFrame, today: str, stop_after: int = STOP_AFTER, when: str = "date", key: str = "id"
) -> DataFrame:
    """Finished source games missing in the store, found walking from new to old in each season.

    The walk stops once ``stop_after`` games in a row are present; a gap starts
    the count again, a game unfinished on both sides does not change it. Each gap
    opens an island, so the walk ends inside the first island with enough present
    games, and the gaps kept are those up to that island.
    """
    done = stored.select(
        F.col(key),
        ((F.col("status") == 3) | ((F.col("status") == 1) & (F.coalesce("home_score", F.lit(0)) > 0)
                                   & (F.col(when) < F.lit(today).cast("date")))).alias("__done"),
    )
    classed = source.join(done, key, "left").withColumn("present", F.coalesce("__done", F.lit(False))).drop("__done")
    classed = classed.withColumn("gap", F.coalesce("is_finished", F.lit(False)) & ~F.col("present"))
    walked = running(
        classed, ["season"], [F.desc(when), F.desc(key)], {"island": Running(F.col("gap").cast("int").cast("bigint"))},
        block=-F.unix_date(F.col(when).cast("date")))
    ends = (
        walked.groupBy("season", "island").agg(F.count_if("present").alias("__run")).filter(F.col("__run") >= stop_after)
        .groupBy("season").agg(F.min("island").alias("__stop"))
    )
    return (
        walked.filter("gap").join(ends, "season", "left")
        .filter(F.col("__stop").isNull() | (F.col("island") <= F.col("__stop"))).drop("__stop", "present", "gap")
    )
