"""Parts of pages: sides of a game, periods, narrowed companion lists, progress of streaks, rules of detector results."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.functions.boxline import period_scores, progress_percent
from formline.operators import boxscore, relations, search, validation
from formline.operators.paging import page
from formline.plans import league as L
from formline.plans import membership as M
from formline.plans import sequences as Q
from formline.plans.league import sql
from formline.plans.registry import query


@query("side_split", sql("""
    SELECT game_id, CASE WHEN b.team_id = home_team_id THEN 'home' WHEN b.team_id = away_team_id THEN 'away' END AS side, team_id,
           coalesce(t.abbreviation, 'ID ' || team_id) AS team, count(*) AS players, CAST(sum(pts) AS BIGINT) AS pts, CAST(sum(reb) AS BIGINT) AS reb
    FROM box_lines b LEFT JOIN teams t ON b.team_id = t.id GROUP BY ALL""", "box_lines", "teams"))
def side_split(spark, sf):
    """The two sides of every game: the lines marked home and away, added up and named."""
    lines = L.box_lines(spark, sf).drop("home_team_id", "away_team_id")
    marked = boxscore.home_and_away(lines, L.games(spark, sf))
    totals = marked.groupBy("game_id", "side", "team_id").agg(
        F.count(F.lit(1)).alias("players"), F.sum("pts").cast("bigint").alias("pts"), F.sum("reb").cast("bigint").alias("reb"))
    return boxscore.side_lines(totals, L.teams(spark, sf)).select("game_id", "side", "team_id", "team", "players", "pts", "reb")


_PERIODS = "[coalesce({0}, 0) // 4, coalesce({0}, 0) // 5, coalesce({0}, 0) // 6, coalesce({0}, 0) % 30]"


@query("period_labels", sql(f"""
    SELECT id, CASE WHEN n <= 4 THEN 'Q' || n ELSE 'OT' || (n - 4) END AS label, coalesce(h[n], 0) AS home, coalesce(a[n], 0) AS away FROM (
        SELECT *, unnest(range(1, greatest(len(h), len(a)) + 1)) AS n FROM (
            SELECT id, CAST({_PERIODS.format("home_score")} || CASE WHEN id % 10 = 0 THEN [7, 3] ELSE [] END AS BIGINT[]) AS h,
                   CAST({_PERIODS.format("away_score")} || CASE WHEN id % 15 = 0 THEN [5] ELSE [] END AS BIGINT[]) AS a FROM games))""", "games"))
def period_labels(spark, sf):
    """Scores by period of all games; some have overtime, for some of those one side's is missing."""
    part = "array(coalesce({0}, 0) div 4, coalesce({0}, 0) div 5, coalesce({0}, 0) div 6, cast(coalesce({0}, 0) % 30 as bigint))"
    games = L.games(spark, sf).select(
        "id", F.expr(f"concat({part.format('home_score')}, if(id % 10 = 0, array(7L, 3L), array()))").alias("h"),
        F.expr(f"concat({part.format('away_score')}, if(id % 15 = 0, array(5L), array()))").alias("a"))
    return games.select("id", F.inline(period_scores(F.col("h"), F.col("a"))))


@query("companions_narrowed", sql("""
    SELECT * FROM (SELECT DISTINCT r.player_id, p.full_name FROM latest l
        JOIN season_rows r ON r.team_id = l.team_id AND r.season = l.season AND r.type = l.type AND r.player_id <> l.player_id
        JOIN players p ON p.id = r.player_id WHERE l.player_id IN (SELECT player_id FROM focus) AND lower(p.full_name) LIKE '%ar%')
    ORDER BY full_name, player_id LIMIT 25 OFFSET 25""", "season_rows", "players", extra={"latest": M._LATEST, "focus": M._FOCUS}))
def companions_narrowed(spark, sf):
    """The second page of a companion list narrowed to names that contain a text."""
    rows = M.stored_seasons(spark, sf)
    found = relations.current_companions(rows, L.players(spark, sf), M.busiest(rows)).select("player_id", "full_name").distinct()
    return page(search.narrowed(found, "AR"), [F.asc("full_name"), F.asc("player_id")], 2, 25)


@query("streak_progress", Q.streaks_sql("""
    SELECT s.player_id, s.streak_type, s.competition_type, s.length, r.length AS record, least(100, s.length * 100 // r.length) AS progress
    FROM streaks s JOIN all_records r USING (streak_type, competition_type) WHERE s.is_active
    ORDER BY progress DESC, s.length DESC, s.player_id, s.streak_type, s.competition_type LIMIT 100"""))
def streak_progress(spark, sf):
    """Open streaks by the share of the record that they have reached."""
    found = Q.stored_streaks(spark, sf)
    limits = Q.completed_records(spark, sf, found).select("streak_type", "competition_type", F.col("length").alias("record"))
    shown = found.filter("is_active").join(F.broadcast(limits), ["streak_type", "competition_type"]).withColumn("progress", progress_percent(F.col("length"), F.col("record")))
    return shown.orderBy(F.desc("progress"), F.desc("length"), "player_id", "streak_type", "competition_type").limit(100).select(
        "player_id", "streak_type", "competition_type", "length", "record", "progress")


_FAULTY = """
    SELECT id, plus_minus AS reconstruction_error, pts * 3 AS percentile, CASE ast % 3 WHEN 0 THEN 'explosion' WHEN 1 THEN 'crisis' ELSE 'other' END AS outlier_type,
           CASE reb % 3 WHEN 0 THEN 'week' WHEN 1 THEN 'month' ELSE 'year' END AS window_type, stl AS length,
           CASE blk % 3 WHEN 0 THEN 'regular' WHEN 1 THEN 'nba_cup' ELSE 'summer' END AS competition_type FROM form_lines"""
_BROKEN = {
    "check_error": "reconstruction_error < 0", "check_percentile": "percentile NOT BETWEEN 0 AND 100", "check_outlier_type": "outlier_type NOT IN ('explosion', 'crisis')",
    "check_window_type": "window_type NOT IN ('week', 'month')", "check_length": "length <= 0", "check_competition_type": "competition_type NOT IN ('regular', 'playoffs', 'nba_cup')",
}


@query("result_violations", sql(" UNION ALL ".join(
    f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {bad}) AS rows FROM faulty" for rule, bad in _BROKEN.items()), "form_lines", extra={"faulty": _FAULTY}))
def result_violations(spark, sf):
    """The rules of detector results on results made faulty."""
    faulty = L.form_lines(spark, sf).selectExpr(
        "id", "plus_minus reconstruction_error", "pts * 3 percentile", "case ast % 3 when 0 then 'explosion' when 1 then 'crisis' else 'other' end outlier_type",
        "case reb % 3 when 0 then 'week' when 1 then 'month' else 'year' end window_type", "stl length",
        "case blk % 3 when 0 then 'regular' when 1 then 'nba_cup' else 'summer' end competition_type")
    return validation.violation_counts(faulty, validation.league_outlier_rules() | validation.trend_rules() | validation.streak_rules())


@query("streak_conflicts", Q.streaks_sql("""
    SELECT player_id, streak_type, competition_type, count(*) AS rows FROM (
        SELECT player_id, streak_type, competition_type FROM streaks WHERE is_active UNION ALL
        SELECT player_id, streak_type, competition_type FROM streaks WHERE is_active AND player_id % 2 = 0) GROUP BY ALL HAVING count(*) > 1"""))
def streak_conflicts(spark, sf):
    """One open streak per key, on stored streaks of which the open ones of every other player came twice."""
    found = Q.stored_streaks(spark, sf)
    return validation.active_streak_conflicts(found.unionByName(found.filter("is_active and player_id % 2 = 0")))
