"""The detectors run over the events as a file stream; results equal those of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators import streaks as S
from formline.plans import league as L
from formline.plans import sequences as Q
from formline.plans.league import sql, table
from formline.plans.registry import query
from formline.session import shared_dir
from formline.streaming.rollups import RollupStream
from formline.streaming.streaks import StreakStream
from formline.streaming.zscore import ZScoreStream

PARTS = 5
FILES = 2  # of each part


def land(spark: SparkSession, sf_dir: str, folder: str, parts: range = range(PARTS)) -> None:
    """The events as they would arrive: parts in the order of time, of some rows a second delivery, some rows one part late."""
    events = table(spark, sf_dir, "events")
    seconds = F.col("ts").cast("timestamp").cast("double")
    first, last = events.agg(F.min(seconds), F.max(seconds)).first()
    place = F.least(F.lit(PARTS - 1), F.floor((seconds - F.lit(first)) / F.lit((last - first) or 1.0) * PARTS).cast("int"))
    following = F.least(F.lit(PARTS - 1), place + 1)
    where = F.when(F.col("event_id") % 89 == 0, F.array(following)).when(F.col("event_id") % 97 == 0, F.array(place, following)).otherwise(F.array(place))
    arriving = events.select("*", F.explode(where).alias("part"))
    for part in parts:
        arriving.filter(F.col("part") == part).drop("part").repartition(FILES).write.mode("append").parquet(folder)


def form_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Landed events as a stream of stat lines, one part per micro-batch."""
    schema = table(spark, sf_dir, "events").schema
    return L.form_lines_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(folder))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def arrived(spark: SparkSession, sf_dir: str, label: str, parts: range = range(PARTS)) -> tuple[str, DataFrame]:
    root = shared_dir(spark, label)
    land(spark, sf_dir, f"{root}/in", parts)
    return root, form_stream(spark, sf_dir, f"{root}/in")


def finish(job, source: DataFrame, root: str):
    job.start(source, f"{root}/checkpoint").awaitTermination()
    return job


@query("stream_zscore", sql(Q.OUTLIERS, "form_lines", extra=Q.CHAIN))
def stream_zscore(spark, sf):
    root, source = arrived(spark, sf, "stream-zscore")
    return Q.flat_outliers(finish(ZScoreStream(spark, root, ddl(source), with_trends=False), source, root).outliers())


@query("stream_bootstrap", sql(Q.OUTLIERS, "form_lines", extra=Q.CHAIN))
def stream_bootstrap(spark, sf):
    """History is loaded in one go, the rest arrives as a stream."""
    root, source = arrived(spark, sf, "stream-bootstrap", range(PARTS - 2, PARTS))
    land(spark, sf, f"{root}/history", range(PARTS - 2))
    job = ZScoreStream(spark, root, ddl(source), with_trends=False)
    job.bootstrap(L.form_lines_of(spark.read.parquet(f"{root}/history")))
    return Q.flat_outliers(finish(job, source, root).outliers())


@query("stream_trends", Q.TREND_OUTLIERS)
def stream_trends(spark, sf):
    root, source = arrived(spark, sf, "stream-trends")
    return Q.flat_trends(finish(ZScoreStream(spark, root, ddl(source)), source, root).trends())


@query("stream_streaks", Q.streaks_sql(f"SELECT {Q._DAYS} FROM streaks"))
def stream_streaks(spark, sf):
    root, source = arrived(spark, sf, "stream-streaks")
    return finish(StreakStream(spark, root, ddl(source)), source, root).streaks(L.active_people(spark, sf))


@query("stream_rollup", sql("""
    SELECT player_id, team_id, season, type, count(*) AS games_played, CAST(sum(pts) AS BIGINT) AS pts, CAST(min(game_date) AS VARCHAR) AS start_date
    FROM (SELECT *, 'Regular Season' AS type FROM form_lines WHERE rs UNION ALL SELECT *, 'Playoffs' FROM form_lines WHERE po
          UNION ALL SELECT *, 'NBA Cup' FROM form_lines WHERE ist) GROUP BY player_id, team_id, season, type""", "form_lines"))
def stream_rollup(spark, sf):
    root, source = arrived(spark, sf, "stream-rollup")
    source = source.withColumnRenamed("game_date", "date").selectExpr("*", "false pi")
    job = finish(RollupStream(spark, root, ddl(source)), source, root)
    return job.rollups().select("player_id", "team_id", "season", "type", "games_played", "pts", "start_date")


_LENGTHS = """
    SELECT *, count(*) OVER (PARTITION BY player_id, streak_type, competition_type, island ORDER BY game_date, game_id) AS length FROM numbered WHERE met"""
_SOFAR = """
    SELECT *, greatest(2, CAST(floor(0.7::DOUBLE * max(length) OVER (PARTITION BY streak_type, competition_type ORDER BY game_date, game_id, player_id)) AS BIGINT)) AS threshold
    FROM lengths"""


@query("running_badges", sql("""
    SELECT player_id, streak_type, competition_type, CAST(game_date AS VARCHAR) AS game_date, game_id, length, threshold FROM (
        SELECT *, row_number() OVER (PARTITION BY player_id, streak_type, competition_type, island ORDER BY game_date, game_id) AS n FROM sofar WHERE length >= threshold)
    WHERE n = 1""", "form_lines", extra={"marks": Q.STREAK_VIEWS["marks"], "numbered": Q.STREAK_VIEWS["numbered"], "lengths": _LENGTHS, "sofar": _SOFAR}))
def running_badges(spark, sf):
    return S.running_badges(S.streak_rows(L.form_lines(spark, sf)))
