"""Scores, dashboards, upserts, exports and the combined run."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.operators import anomalies, scoring, streaks, trends, zscore
from formline.operators.paging import top_entries
from formline.plans import league as L
from formline.plans import sequences as Q
from formline.plans.league import sql
from formline.plans.registry import query
from formline.session import shared_dir, write_and_reload
from formline.sources import sinks
from formline.sources.keyed_log import KeyedLog, id_slot

_COLUMNS = [f for f in scoring.MODEL_FEATURES if f != "min"]
_ROWS = """
    SELECT * REPLACE ({}), CAST(min_seconds AS DOUBLE) / 60.0::DOUBLE AS min FROM form_lines WHERE min_seconds >= 300""".format(
    ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _COLUMNS))


@query("standardise", sql(f"""
    SELECT id, {", ".join(f"round((r.{f} - m.m_{f}) / m.s_{f}, 6) AS {f}" for f in scoring.MODEL_FEATURES)} FROM rows_ r, (
        SELECT {", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS s_{f}" for f in scoring.MODEL_FEATURES)} FROM rows_) m""",
    "form_lines", extra={"rows_": _ROWS}))
def standardise(spark, sf):
    rows = scoring.feature_rows(L.form_lines(spark, sf))
    scaled = scoring.Scaler.fit(rows).transform(rows)
    return scaled.select("id", *[F.round(f, 6).alias(f) for f in scoring.MODEL_FEATURES])


@query("season_weights", sql("""
    SELECT id, season, round(raw * (SELECT count(*) FROM w) / (SELECT sum(raw) FROM w), 9) AS weight FROM w""", "form_lines", extra={
    "w": "SELECT id, season, exp(-0.1::DOUBLE * ((SELECT max(CAST(substring(season, 1, 4) AS INTEGER)) FROM form_lines) - CAST(substring(season, 1, 4) AS INTEGER))) AS raw FROM form_lines"}))
def season_weights(spark, sf):
    return scoring.season_weights(L.form_lines(spark, sf)).select("id", "season", F.round("weight", 9).alias("weight"))


@query("temporal_split", sql("""
    SELECT id, row_number() OVER (ORDER BY game_date, game_id) <= (SELECT CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) FROM form_lines) AS is_train FROM form_lines""", "form_lines"))
def temporal_split(spark, sf):
    return scoring.temporal_split(L.form_lines(spark, sf)).select("id", "is_train")


_ERRORS = "SELECT id, game_date, (pts - 17) * (pts - 17) + tov AS error FROM form_lines"


def errors(spark, sf):
    return L.form_lines(spark, sf).selectExpr("id", "game_date", "(pts - 17) * (pts - 17) + tov error")


@query("error_percentiles", sql("""
    SELECT id, error, CAST(coalesce(below, 0) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM e WHERE game_date < DATE '2023-10-01') * 100.0::DOUBLE AS percentile
    FROM e LEFT JOIN (SELECT a.error, sum(b.n) AS below FROM (SELECT DISTINCT error FROM e) a
                      JOIN (SELECT error, count(*) AS n FROM e WHERE game_date < DATE '2023-10-01' GROUP BY error) b ON b.error < a.error GROUP BY a.error) USING (error)""",
    "form_lines", extra={"e": _ERRORS}))
def error_percentiles(spark, sf):
    rows = errors(spark, sf)
    train = rows.filter("game_date < date'2023-10-01'")
    return scoring.error_percentiles(train, rows).select("id", "error", "percentile")


@query("error_quantile", sql("SELECT quantile_cont(CAST(error AS DOUBLE), 0.99) AS value FROM e", "form_lines", extra={"e": _ERRORS}))
def error_quantile(spark, sf):
    return scoring.quantile(errors(spark, sf).withColumn("error", F.col("error").cast("double")), 0.99)


@query("top_contributions", sql("""
    SELECT id, string_agg(feature, ',' ORDER BY value DESC, feature) AS features FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, feature) AS n FROM (
            SELECT id, 'pts' AS feature, pts AS value FROM form_lines UNION ALL SELECT id, 'ast', ast FROM form_lines UNION ALL
            SELECT id, 'reb', reb FROM form_lines UNION ALL SELECT id, 'stl', stl FROM form_lines UNION ALL SELECT id, 'tov', tov FROM form_lines))
    WHERE n <= 3 GROUP BY id""", "form_lines"))
def top_contributions(spark, sf):
    names = ["pts", "ast", "reb", "stl", "tov"]
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
    return L.form_lines(spark, sf).select("id", top_entries(values, 3)["feature"].alias("features"))


def league(spark, sf):
    return scoring.league_outliers(L.form_lines(spark, sf), L.active_people(spark, sf))


@query("error_scores")
def error_scores(spark, sf):
    """Scores depend on an eigen-decomposition, so there is no SQL; the tests compare with NumPy."""
    return league(spark, sf).select("stat_id", "player_id", "season", "reconstruction_error", "percentile", "is_outlier",
                                    top_entries(F.col("contributions"), 3)["feature"].alias("top_features"))


@query("league_leaders")
def league_leaders(spark, sf):
    top = anomalies.top_league_outliers(
        league(spark, sf), L.active_people(spark, sf), "month", limit=25, newest=L.form_lines(spark, sf))
    return top.select("stat_id", "player_id", "game_date", "percentile", "reconstruction_error", F.col("top_features.feature").alias("top_features"))


# ---- dashboards -----------------------------------------------------------------------------


@query("game_anomalies", sql(f"""
    SELECT o.stat_id, o.player_id, p.full_name, o.outlier_type, abs(o.headline_z) AS size, o.game_date FROM ({Q.OUTLIERS}) o
    JOIN people p ON o.player_id = p.player_id WHERE p.is_active AND o.game_date = (SELECT CAST(max(game_date) AS VARCHAR) FROM form_lines)
    ORDER BY round(abs(o.headline_z), 2) DESC, stat_id LIMIT 50""", "form_lines", "people", extra=Q.CHAIN))
def game_anomalies(spark, sf):
    lines = L.form_lines(spark, sf)
    found = write_and_reload(zscore.zscore_outliers(lines), "outliers")
    listed = anomalies.game_anomalies(found, L.people(spark, sf), newest=lines)
    sizes = found.select("stat_id", F.abs("headline_z").alias("size"))
    return listed.join(sizes, "stat_id").select("stat_id", "player_id", "full_name", "outlier_type", "size", "game_date")


_TREND_SIZES = ", ".join(f"CASE WHEN abs(z_{f.name}) > 2 THEN abs(z_{f.name}) END" for f in Q.FEATURES)


@query("trend_anomalies", sql(f"""
    SELECT t.player_id, p.full_name, reference_date, size FROM (
        SELECT *, max(reference_date) OVER () AS newest FROM (
            SELECT player_id, window_type, reference_date, greatest({_TREND_SIZES}) AS size
            FROM ({Q._trend_rows("week", 7, 2)} UNION ALL {Q._trend_rows("month", 30, 5)})) WHERE size IS NOT NULL) t
    JOIN people p ON t.player_id = p.player_id WHERE p.is_active AND window_type = 'month'
      AND CAST(reference_date AS DATE) >= CAST(newest AS DATE) - 7 ORDER BY size DESC, t.player_id LIMIT 50""", "form_lines", "people", extra=Q._TRENDS))
def trend_anomalies(spark, sf):
    found = trends.trend_outliers(L.form_lines(spark, sf))
    listed = anomalies.trend_anomalies(found, L.people(spark, sf), "month")
    return listed.select("player_id", "full_name", "reference_date", F.abs("max_z_score").alias("size"))


@query("anomaly_counts", sql(f"""
    SELECT (SELECT count(*) FROM form_lines WHERE game_date >= since AND player_id IN (SELECT player_id FROM act)) AS total_stats,
           (SELECT count(*) FROM form_lines WHERE pts >= 40 AND game_date >= since AND player_id IN (SELECT player_id FROM act)) AS league_outliers,
           e + c AS player_outliers, e AS explosions, c AS crises
    FROM (SELECT max(game_date) AS since FROM form_lines), (
        SELECT count(*) FILTER (WHERE outlier_type = 'explosion') AS e, count(*) FILTER (WHERE outlier_type = 'crisis') AS c
        FROM ({Q.OUTLIERS}) WHERE player_id IN (SELECT player_id FROM act) AND game_date = (SELECT CAST(max(game_date) AS VARCHAR) FROM form_lines))""",
    "form_lines", "people", extra=Q.CHAIN | {"act": "SELECT player_id FROM people WHERE is_active"}))
def anomaly_counts(spark, sf):
    """The league detector is stood in for by a plain rule, so that SQL can count it."""
    lines = L.form_lines(spark, sf)
    league_rows = lines.select("player_id", "season", "game_date", (F.col("pts") >= 40).alias("is_outlier"))
    return anomalies.anomaly_counts(
        lines, league_rows, zscore.zscore_outliers(lines), trends.trend_outliers(lines), L.active_people(spark, sf), "last_game")


_RELEVANT = """CASE WHEN b.streak_type IN ('fg_pct_60', 'fg3_pct_50', 'ft_pct_90') THEN b.length >= 3 ELSE b.length >= greatest(2, r.length * 0.05::DOUBLE) END"""


@query("streak_dashboard", Q.streaks_sql(f"""
    SELECT b.player_id, b.streak_type, b.length, CAST(b.started_at AS VARCHAR) AS started_at, r.length AS record_length,
           least(100, b.length * 100 // r.length) AS progress, b.length >= r.length OR b.is_historical AS is_historical
    FROM badged b JOIN all_records r USING (streak_type, competition_type) WHERE b.is_active AND b.competition_type = 'regular' AND {_RELEVANT}"""))
def streak_dashboard(spark, sf):
    found = Q.found_streaks(spark, sf)
    records = Q.completed_records(spark, sf, found)
    shown = anomalies.active_streaks(streaks.with_badges(found, records), records, L.active_people(spark, sf))
    return shown.select("player_id", "streak_type", "length", "started_at", "record_length", "progress", "is_historical")


def _streak_parts(spark, sf):
    found = Q.found_streaks(spark, sf)
    records = Q.completed_records(spark, sf, found)
    badged = streaks.with_badges(found, records)
    newest = L.form_lines(spark, sf).agg(F.max("game_date")).scalar()
    return (anomalies.active_streaks(badged, records, L.active_people(spark, sf)), anomalies.broken_streaks(badged, records, newest))


_SHOWN = f"""
    SELECT b.*, r.length AS record_length, CASE WHEN b.is_active THEN 0 ELSE 1 END AS part FROM badged b JOIN all_records r USING (streak_type, competition_type)
    WHERE b.competition_type = 'regular' AND {_RELEVANT} AND (b.is_active OR b.ended_at >= (SELECT max(game_date) FROM form_lines) - 7)"""


@query("streak_page", Q.streaks_sql(f"""
    SELECT player_id, streak_type, length, CAST(part AS BIGINT) AS part, CAST(started_at AS VARCHAR) AS started_at FROM ({_SHOWN})
    ORDER BY part, CASE WHEN part = 1 THEN ended_at END DESC, length DESC, player_id, streak_type, streak_page.started_at LIMIT 40 OFFSET 40"""
    .replace("streak_page.started_at", "5")))
def streak_page(spark, sf):
    return anomalies.streak_page(*_streak_parts(spark, sf), 2, 40).select("player_id", "streak_type", "length", "part", "started_at")


@query("streak_totals", Q.streaks_sql(f"""
    SELECT count(*) FILTER (WHERE part = 0) AS total_active, count(*) FILTER (WHERE part = 1) AS total_broken,
           count(*) FILTER (WHERE part = 0 AND (is_historical OR length >= record_length)) AS total_historical,
           CAST(ceil(count(*) / 40.0) AS BIGINT) AS total_pages FROM ({_SHOWN})"""))
def streak_totals(spark, sf):
    return anomalies.streak_totals(*_streak_parts(spark, sf), 40)


@query("longest_streaks", Q.streaks_sql("""
    SELECT player_id, streak_type, competition_type, length, strftime(started_at, '%d/%m/%Y') AS shown_day FROM badged
    ORDER BY length DESC, started_at, player_id, streak_type, competition_type LIMIT 20"""))
def longest_streaks(spark, sf):
    return anomalies.longest_streaks(Q.badged_streaks(spark, sf)).select(
        "player_id", "streak_type", "competition_type", "length", anomalies.display_day(F.col("started_at")).alias("shown_day"))


@query("detection_run", sql(f"""
    SELECT 'player' AS detector, n AS rows FROM z UNION ALL SELECT 'streaks', n FROM s UNION ALL SELECT 'league', NULL
    UNION ALL SELECT 'broken', NULL UNION ALL SELECT 'total', (SELECT n FROM z) + (SELECT n FROM s)""", "form_lines", "people",
    extra=Q.STREAK_VIEWS | Q.CHAIN | {"z": f"SELECT count(*) AS n FROM ({Q.OUTLIERS})", "s": "SELECT count(*) AS n FROM badged WHERE is_historical"}))
def detection_run(spark, sf):
    """League skipped, one detector failing on purpose: the others still deliver."""
    lines = L.form_lines(spark, sf)
    _, summary = anomalies.run_detectors(spark, {
        "league": lambda: league(spark, sf),
        "broken": lambda: lines.select("no_such_column"),
        "player": lambda: zscore.zscore_outliers(lines),
        "streaks": lambda: Q.badged_streaks(spark, sf).filter("is_historical"),
    }, skip=("league",))
    return summary.select("detector", "rows")


# ---- stores and exports ---------------------------------------------------------------------


UPSERTED = sql("""
    SELECT id, player_id, CASE WHEN ist THEN pts + 100 ELSE pts END AS pts FROM form_lines UNION ALL
    SELECT id + 1000000000, player_id, pts FROM form_lines WHERE po""", "form_lines")


def _target_and_updates(spark, sf):
    lines = L.form_lines(spark, sf)
    updates = lines.filter("ist").selectExpr("id", "player_id", "pts + 100 pts").unionByName(
        lines.filter("po").selectExpr("id + 1000000000 id", "player_id", "pts"))
    return lines.select("id", "player_id", "pts"), updates


@query("upsert_merge", UPSERTED)
def upsert_merge(spark, sf):
    return sinks.upsert(*_target_and_updates(spark, sf), ["id"])


@query("upsert_runs", UPSERTED)
def upsert_runs(spark, sf):
    """The same upsert into a keyed log: the update writes its own rows, the target stays as it is."""
    target, updates = _target_and_updates(spark, sf)
    log = KeyedLog(spark, shared_dir(spark, "upsert"), target.schema, ["id"], id_slot(target.schema, "id"))
    log.write(target, 0)
    log.write(updates, 1)
    return log.read()


@query("regenerate_period", sql("""
    SELECT player_id, season, CASE WHEN season = (SELECT max(season) FROM form_lines) THEN count(*) * 10 ELSE count(*) END AS games FROM form_lines
    GROUP BY player_id, season""", "form_lines"))
def regenerate_period(spark, sf):
    """Write all periods, replace the newest one, read the table back."""
    lines = L.form_lines(spark, sf)
    path = shared_dir(spark, "periods")
    table = lines.groupBy("player_id", "season").agg(F.count(F.lit(1)).alias("games"))
    sinks.replace_periods(table, path)
    newest = table.filter(F.col("season") == lines.agg(F.max("season")).scalar())
    sinks.replace_periods(newest.withColumn("games", F.col("games") * 10), path)
    return spark.read.schema("player_id bigint, games bigint, season string").parquet(path)


@query("get_or_create", sql("""
    SELECT id, CASE WHEN id % 3 = 0 THEN 'New ' || id WHEN conference = 'East' THEN full_name ELSE 'Team ' || id END AS full_name,
           CASE WHEN conference = 'East' THEN abbreviation ELSE 'TM_' || id END AS abbreviation
    FROM teams""", "teams"))
def get_or_create(spark, sf):
    """Sides named in games: half are stored, a third comes with a name, empty texts are ignored."""
    stored = L.teams(spark, sf).filter("conference = 'East'").select("id", "full_name", "abbreviation")
    wanted = L.games(spark, sf).selectExpr("home_team_id id", "if(home_team_id % 3 = 0, concat('New ', home_team_id), '') full_name")
    return sinks.get_or_create(stored, wanted, truthy=True, defaults=sinks.team_defaults())


@query("json_rows", sql("""
    SELECT '{"game_id":' || game_id || ',"player_id":' || player_id || ',"game_date":"' || CAST(game_date AS VARCHAR) || '","min":"' ||
           (min_seconds // 60) || ':' || lpad(CAST(min_seconds % 60 AS VARCHAR), 2, '0') || '","pts":' || pts || ',"fg_pct":' || round(fg_pct, 2) ||
           ',"shots":[' || round(fg_pct, 2) || ',' || round(ft_pct, 2) || ']}' AS json FROM form_lines""", "form_lines"))
def json_rows(spark, sf):
    rows = L.form_lines(spark, sf).select(
        "game_id", "player_id", "game_date", "min_seconds", "pts", "fg_pct", F.array("fg_pct", "ft_pct").alias("shots"), F.lit(1).alias("_internal"))
    return sinks.json_rows(rows)


@query("log_tail", """
    SELECT CAST(ts AS VARCHAR) AS ts, upper(event_type) AS level, user_id AS module FROM events WHERE event_type = 'error' ORDER BY events.ts DESC, event_id DESC LIMIT 50""")
def log_tail(spark, sf):
    log = L.table(spark, sf, "events").selectExpr(
        "ts", "upper(event_type) level", "cast(user_id as string) module", "cast(event_id as string) message")
    return sinks.log_tail(log, 50, "error").selectExpr("cast(ts as string) ts", "level", "cast(module as bigint) module")
