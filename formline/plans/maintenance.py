"""Queries that write, change and read back: purging, the log, one game's page, history loaded into a streak detector."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from formline.operators import boxscore
from formline.plans import league as L
from formline.plans import sequences as Q
from formline.plans.league import sql
from formline.plans.registry import query
from formline.plans.streams import PARTS, arrived, ddl, finish, land
from formline.session import shared_dir
from formline.sources import sinks
from formline.streaming.streaks import StreakStream


@query("purged_results", sql("""
    SELECT * FROM (SELECT 'player_outliers' AS table_name, count(*) AS rows FROM form_lines WHERE pts >= 20) UNION ALL
    SELECT 'streak_records', 0 UNION ALL SELECT 'streaks', 0""", "form_lines"))
def purged_results(spark, sf):
    """Three result tables are filled, the streak group is purged, the rows are counted again."""
    root, lines = shared_dir(spark, "results"), L.form_lines(spark, sf).filter("pts >= 20")
    names = ["player_outliers", "streak_records", "streaks"]
    for name in names:
        lines.select("player_id", "season", "pts").write.parquet(f"{root}/{name}")
    sinks.purge_results(spark, root, "streaks")
    counts = [spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("log_append", """
    SELECT upper(event_type) AS level, user_id % 10 AS module, count(*) AS entries FROM events GROUP BY ALL
    UNION ALL SELECT 'SUMMARY', count(DISTINCT event_type), 1 FROM events""")
def log_append(spark, sf):
    """The events are stored as log entries, one more entry is appended, all are read back."""
    root, events = shared_dir(spark, "log"), L.table(spark, sf, "events")
    events.selectExpr(
        "cast(ts as timestamp) ts", "upper(event_type) level", "cast(user_id % 10 as string) module", "cast(event_id as string) message", "cast(null as string) traceback",
    ).write.parquet(f"{root}/log_entries")
    kinds = events.agg(F.count_distinct("event_type")).first()[0]
    sinks.append_log(spark, root, [(datetime(2030, 1, 1, tzinfo=timezone.utc), "SUMMARY", str(kinds), "event types", None)])
    return spark.read.parquet(f"{root}/log_entries").groupBy("level", F.col("module").cast("bigint").alias("module")).agg(F.count(F.lit(1)).alias("entries"))


@query("game_page", sql("""
    SELECT 'game' AS part, g.id AS id, coalesce(h.full_name, 'Team ' || home_team_id) || ' - ' || coalesce(a.full_name, 'Team ' || away_team_id) AS name, coalesce(home_score, 0) AS pts
    FROM games g LEFT JOIN teams h ON g.home_team_id = h.id LEFT JOIN teams a ON g.away_team_id = a.id WHERE g.id = (SELECT max(game_id) FROM box_lines)
    UNION ALL SELECT 'player', player_id, coalesce(p.full_name, 'Player ' || player_id), pts FROM box_lines b LEFT JOIN players p ON b.player_id = p.id
    WHERE game_id = (SELECT max(game_id) FROM box_lines)
    UNION ALL SELECT 'side', team_id, coalesce(any_value(t.abbreviation), 'ID ' || team_id), CAST(sum(pts) AS BIGINT) FROM box_lines b LEFT JOIN teams t ON b.team_id = t.id
    WHERE game_id = (SELECT max(game_id) FROM box_lines) GROUP BY team_id""", "box_lines", "players", "teams"))
def game_page(spark, sf):
    """Header, player lines and sides of the game with the highest id."""
    lines = L.box_lines(spark, sf)
    newest = lines.agg(F.max("game_id")).first()[0]
    sides = lines.groupBy("game_id", "team_id").agg(F.sum("pts").cast("bigint").alias("pts"))
    parts = boxscore.game_details(newest, L.games(spark, sf), lines, sides, L.players(spark, sf), L.teams(spark, sf))
    both = F.concat_ws(" - ", "home_team", "away_team")
    return (
        parts["game"].select(F.lit("game").alias("part"), "id", both.alias("name"), F.col("home_score").cast("bigint").alias("pts"))
        .unionByName(parts["player_stats"].select(F.lit("player").alias("part"), F.col("player_id").alias("id"), F.col("player").alias("name"), F.col("pts").cast("bigint").alias("pts")))
        .unionByName(parts["team_stats"].select(F.lit("side").alias("part"), F.col("team_id").alias("id"), F.col("team").alias("name"), "pts"))
    )


@query("stream_streak_bootstrap", Q.streaks_sql(f"SELECT {Q._DAYS} FROM streaks"))
def stream_streak_bootstrap(spark, sf):
    """History is loaded in one go, the rest arrives as a stream."""
    root, source = arrived(spark, sf, "streak-bootstrap", range(PARTS - 2, PARTS))
    land(spark, sf, f"{root}/history", range(PARTS - 2))
    job = StreakStream(spark, root, ddl(source))
    job.bootstrap(L.form_lines_of(spark.read.parquet(f"{root}/history")))
    return finish(job, source, root).streaks(L.active_people(spark, sf))
