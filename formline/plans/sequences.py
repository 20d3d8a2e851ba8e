"""Z-scores, trends, streaks and scans over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.operators import gaps, streaks, trends, zscore
from formline.operators.asof import asof_join
from formline.operators.running import parts_of
from formline.plans import league as L
from formline.plans.league import sql
from formline.plans.registry import query
from formline.session import write_and_reload

FEATURES = zscore.DEFAULT_FEATURES


def _value(f) -> str:
    return f"CAST(round({f.name} * {f.scale}) AS BIGINT)"


def _use(f) -> str:
    return f"min_seconds > 0 AND {f.attempts} > 0" if f.attempts else "min_seconds > 0"


_FRAME = "PARTITION BY player_id, season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
STATE = f"""
    SELECT *, count(*) FILTER (WHERE min_seconds > 0) OVER w AS games_before,
           min(game_date) FILTER (WHERE min_seconds > 0) OVER w AS first_day,
           min(season) OVER (PARTITION BY player_id) AS first_season,
           {", ".join(f'''sum({_value(f)}) FILTER (WHERE {_use(f)}) OVER w AS {f.name}_s,
           sum({_value(f)} * {_value(f)}) FILTER (WHERE {_use(f)}) OVER w AS {f.name}_q,
           count(*) FILTER (WHERE {_use(f)}) OVER w AS {f.name}_n''' for f in FEATURES)}
    FROM form_lines WINDOW w AS ({_FRAME})"""


def _mean(f, p: str = "") -> str:
    return f"(CAST({p}{f.name}_s AS DOUBLE) / CAST({p}{f.name}_n * {f.scale} AS DOUBLE))"


def _sd(f) -> str:
    second = f"CAST({f.name}_q AS DOUBLE) / (CAST({f.name}_n AS DOUBLE) * {f.scale ** 2}::DOUBLE)"
    return f"sqrt(greatest({f.variance_floor}::DOUBLE, {second} - {_mean(f)} * {_mean(f)}))"


SCORED = f"""
    SELECT *, {", ".join(f"CASE WHEN {f.name}_n >= 5 THEN (CAST({f.name} AS DOUBLE) - {_mean(f)}) / {_sd(f)} END AS z_{f.name}" for f in FEATURES)}
    FROM state WHERE min_seconds >= 900 AND games_before >= 5
      AND ((game_date - first_day >= 30 AND games_before >= 20) OR first_season < season)"""


def _hit(f, threshold: float = 2.0) -> str:
    return f"(abs(z_{f.name}) > {threshold} AND {f.name} >= {f.minimum})"


OUTLIERS = f"""
    SELECT id AS stat_id, player_id, season, CAST(game_date AS VARCHAR) AS game_date, games_before AS games_in_sample, headline_z,
           CASE WHEN (headline_z > 0) = (headline = 'tov') THEN 'crisis' ELSE 'explosion' END AS outlier_type, features
    FROM (SELECT *, CASE {" ".join(f"WHEN headline = '{f.name}' THEN z_{f.name}" for f in FEATURES)} END AS headline_z
          FROM (SELECT *, CASE {" ".join(f"WHEN {_hit(f)} AND abs(z_{f.name}) = top THEN '{f.name}'" for f in FEATURES)} END AS headline
                FROM (SELECT *, greatest({", ".join(f"CASE WHEN {_hit(f)} THEN abs(z_{f.name}) END" for f in FEATURES)}) AS top,
                             concat_ws(',', {", ".join(f"CASE WHEN {_hit(f)} THEN '{f.name}' END" for f in FEATURES)}) AS features FROM scored)
                WHERE top IS NOT NULL))"""
CHAIN = {"state": STATE, "scored": SCORED}


def flat_outliers(found):
    return found.select(
        "stat_id", "player_id", "season", "game_date", "games_in_sample", "headline_z", "outlier_type",
        F.col("outlier_features.feature").alias("features"))


@query("expanding_state", sql(f"""
    SELECT id, games_before, CAST(first_day AS VARCHAR) AS first_day, {", ".join(
        f"CAST({f.name}_s AS BIGINT) AS {f.name}_s, CAST({f.name}_q AS BIGINT) AS {f.name}_q, {f.name}_n" for f in FEATURES)}
    FROM state""", "form_lines", extra={"state": STATE}))
def expanding_state(spark, sf):
    state = zscore.expanding_state(L.form_lines(spark, sf))
    zero = F.lit(0).cast("bigint")
    cols = []
    for f in FEATURES:
        cols += [f"{f.name}_s", F.col(f"{f.name}_q").cast("bigint").alias(f"{f.name}_q"), F.coalesce(f"{f.name}_n", zero).alias(f"{f.name}_n")]
    return state.select("id", F.coalesce("games_before", zero).alias("games_before"), "first_day", *cols)


@query("season_state", sql("""
    SELECT player_id, season, count(*) FILTER (WHERE min_seconds > 0) AS games_played,
           CAST(min(game_date) FILTER (WHERE min_seconds > 0) AS VARCHAR) AS first_game_date,
           CAST(max(game_date) FILTER (WHERE min_seconds > 0) AS VARCHAR) AS last_game_date,
           coalesce(CAST(sum(pts) FILTER (WHERE min_seconds > 0) AS DOUBLE), 0) AS pts,
           coalesce(CAST(sum(pts * pts) FILTER (WHERE min_seconds > 0) AS DOUBLE), 0) AS pts_sq,
           CAST(count(*) FILTER (WHERE min_seconds > 0 AND fga > 0) AS DOUBLE) AS fg_pct_count
    FROM form_lines GROUP BY player_id, season""", "form_lines"))
def season_state(spark, sf):
    acc = F.col("accumulated")
    return zscore.season_states(L.form_lines(spark, sf)).select(
        "player_id", "season", "games_played", "first_game_date", "last_game_date",
        *[acc[k].alias(k) for k in ("pts", "pts_sq", "fg_pct_count")])


@query("zscore_rows", sql(f"""
    SELECT id, player_id, season, CAST(game_date AS VARCHAR) AS game_date, games_before, {", ".join(f"z_{f.name}" for f in FEATURES)} FROM scored""",
    "form_lines", extra=CHAIN))
def zscore_rows(spark, sf):
    return zscore.zscore_rows(L.form_lines(spark, sf)).select(
        "id", "player_id", "season", "game_date", "games_before", *[f"z_{f.name}" for f in FEATURES])


@query("zscore_outliers", sql(OUTLIERS, "form_lines", extra=CHAIN))
def zscore_outliers(spark, sf):
    return flat_outliers(zscore.zscore_outliers(L.form_lines(spark, sf)))


@query("zscore_backfill", sql(f"""
    SELECT * FROM ({OUTLIERS}) WHERE season = (SELECT max(season) FROM form_lines)
      AND player_id IN (SELECT player_id FROM people WHERE is_active)""", "form_lines", "people", extra=CHAIN))
def zscore_backfill(spark, sf):
    return flat_outliers(zscore.zscore_backfill(L.form_lines(spark, sf), L.active_people(spark, sf)))


_REF = "SELECT player_id, max(game_date) AS ref, max(season) AS ref_season FROM form_lines GROUP BY player_id"
_BASE = f"""
    SELECT player_id, ref, count(*) FILTER (WHERE min_seconds > 0 AND in_base) AS games_in_baseline,
           {", ".join(f'''sum({_value(f)}) FILTER (WHERE in_base AND {_use(f)}) AS {f.name}_s,
           sum({_value(f)} * {_value(f)}) FILTER (WHERE in_base AND {_use(f)}) AS {f.name}_q,
           count(*) FILTER (WHERE in_base AND {_use(f)}) AS {f.name}_n''' for f in FEATURES)},
           {", ".join(f'''count(*) FILTER (WHERE min_seconds > 0 AND game_date > ref - {d}) AS w{d}_games, {", ".join(f"""
           sum({_value(f)}) FILTER (WHERE game_date > ref - {d} AND {_use(f)}) AS w{d}_{f.name}_s,
           count(*) FILTER (WHERE game_date > ref - {d} AND {_use(f)}) AS w{d}_{f.name}_n""" for f in FEATURES)}''' for d in (7, 30))}
    FROM (SELECT l.*, r.ref, l.season = r.ref_season AS in_base FROM form_lines l JOIN refs r ON l.player_id = r.player_id) GROUP BY player_id, ref"""


def _trend_rows(name: str, days: int, least: int) -> str:
    def z(f) -> str:
        cur = f"(CAST(w{days}_{f.name}_s AS DOUBLE) / CAST(w{days}_{f.name}_n * {f.scale} AS DOUBLE))"
        return (f"CASE WHEN {f.name}_n >= 5 AND w{days}_{f.name}_n > 0 THEN ({cur} - {_mean(f)}) / ({_sd(f)} / sqrt(CAST(w{days}_{f.name}_n AS DOUBLE))) END AS z_{f.name}, "
                f"CASE WHEN w{days}_{f.name}_n > 0 THEN {cur} END AS cur_{f.name}")

    return (f"SELECT player_id, CAST(ref AS VARCHAR) AS reference_date, '{name}' AS window_type, games_in_baseline, w{days}_games AS games_in_window, "
            + ", ".join(z(f) for f in FEATURES) + f" FROM base WHERE games_in_baseline >= 5 AND w{days}_games >= {least}")


_TRENDS = {"refs": _REF, "base": _BASE}


def _register_trend(name: str, window: trends.TrendWindow) -> None:
    @query(name, sql(_trend_rows(window.name, window.days, window.min_rows), "form_lines", extra=_TRENDS))
    def trend(spark, sf):
        scores = trends.trend_scores(L.form_lines(spark, sf), windows=[window])
        return scores.drop(*[f"base_{f.name}" for f in FEATURES])


_register_trend("trend_week", trends.WEEK)
_register_trend("trend_month", trends.MONTH)


_DAILY = f"""
    SELECT player_id, season, game_date, count(*) FILTER (WHERE min_seconds > 0) AS games, {", ".join(f'''coalesce(sum({_value(f)}) FILTER (WHERE {_use(f)}), 0) AS {f.name}_s,
           coalesce(sum({_value(f)} * {_value(f)}) FILTER (WHERE {_use(f)}), 0) AS {f.name}_q, count(*) FILTER (WHERE {_use(f)}) AS {f.name}_n''' for f in FEATURES)}
    FROM form_lines GROUP BY player_id, season, game_date"""
_SOFAR = f"""
    SELECT player_id, season, game_date, CAST(sum(games) OVER w AS BIGINT) AS games_in_baseline, {", ".join(f"sum({f.name}_{x}) OVER w AS {f.name}_{x}" for f in FEATURES for x in "sqn")}
    FROM daily WINDOW w AS (PARTITION BY player_id, season ORDER BY game_date)"""
_NEAR = "SELECT player_id, game_date, max(season) AS season, " + ", ".join(
    f"CAST(sum(sum(games)) OVER w{d} AS BIGINT) AS w{d}_games, " + ", ".join(f"sum(sum({f.name}_{x})) OVER w{d} AS w{d}_{f.name}_{x}" for f in FEATURES for x in "sn") for d in (7, 30)
) + " FROM daily GROUP BY player_id, game_date WINDOW " + ", ".join(
    f"w{d} AS (PARTITION BY player_id ORDER BY game_date RANGE BETWEEN INTERVAL {d - 1} DAYS PRECEDING AND CURRENT ROW)" for d in (7, 30))
_HISTORY = {"daily": _DAILY, "sofar": _SOFAR, "near": _NEAR, "base": "SELECT *, game_date AS ref FROM sofar JOIN near USING (player_id, season, game_date)"}


@query("trend_history", sql(f"{_trend_rows('week', 7, 2)} UNION ALL {_trend_rows('month', 30, 5)}", "form_lines", extra=_HISTORY))
def trend_history(spark, sf):
    return trends.trend_history(L.form_lines(spark, sf), parts=parts_of(L.table(spark, sf, "events"))).drop(*[f"base_{f.name}" for f in FEATURES])


@query("asof_form", sql("""
    SELECT id, l.player_id, CAST(l.game_date AS VARCHAR) AS game_date, r.best.game AS last_game, CAST(r.game_date AS VARCHAR) AS last_day, r.best.pts AS last_pts
    FROM (SELECT * FROM form_lines WHERE po) l ASOF LEFT JOIN
        (SELECT player_id, game_date, max(struct_pack(game := game_id, pts := pts)) AS best FROM form_lines WHERE rs GROUP BY player_id, game_date) r
        ON l.player_id = r.player_id AND l.game_date > r.game_date""", "form_lines"))
def asof_form(spark, sf):
    """Each playoff line with the player's last regular game before that day."""
    lines = L.form_lines(spark, sf)
    found = asof_join(
        lines.filter("po"), lines.filter("rs"), ["player_id"], "game_date", "game_date", {"last_game": "game_id", "last_day": "game_date", "last_pts": "pts"}, tie="game_id", strict=True)
    return found.select("id", "player_id", "game_date", "last_game", "last_day", "last_pts")


TREND_OUTLIERS = sql(f"""
    SELECT player_id, window_type, reference_date, games_in_window, games_in_baseline, top AS size, features FROM (
        SELECT *, greatest({", ".join(f"CASE WHEN abs(z_{f.name}) > 2 THEN abs(z_{f.name}) END" for f in FEATURES)}) AS top,
               concat_ws(',', {", ".join(f"CASE WHEN abs(z_{f.name}) > 2 THEN '{f.name}' END" for f in FEATURES)}) AS features
        FROM ({_trend_rows("week", 7, 2)} UNION ALL {_trend_rows("month", 30, 5)})) WHERE top IS NOT NULL""", "form_lines", extra=_TRENDS)


def flat_trends(found):
    return found.select(
        "player_id", "window_type", "reference_date", "games_in_window", "games_in_baseline",
        F.abs("max_z_score").alias("size"), F.map_keys("z_scores").alias("features"))


@query("trend_outliers", TREND_OUTLIERS)
def trend_outliers(spark, sf):
    return flat_trends(trends.trend_outliers(L.form_lines(spark, sf)))


# ---- streaks --------------------------------------------------------------------------------

_TENS = "(pts >= 10)::INT + (reb >= 10)::INT + (ast >= 10)::INT + (stl >= 10)::INT + (blk >= 10)::INT"
_RULES = {
    "pts_20": "pts >= 20", "pts_30": "pts >= 30", "pts_40": "pts >= 40", "triple_double": f"{_TENS} >= 3",
    "reb_10": "reb >= 10", "ast_10": "ast >= 10",
    "fg_pct_60": "CASE WHEN fga > 0 THEN fg_pct >= 0.6::DOUBLE END",
    "fg3_pct_50": "CASE WHEN fg3a > 0 THEN fg3_pct >= 0.5::DOUBLE END",
    "ft_pct_90": "CASE WHEN fta > 0 THEN ft_pct >= 0.9::DOUBLE END",
}
_MARKS = " UNION ALL ".join(
    f"SELECT player_id, game_date, game_id, '{t}' AS streak_type, '{c}' AS competition_type, {rule} AS met FROM form_lines WHERE min_seconds >= 60 AND {flag}"
    for t, rule in _RULES.items() for c, flag in streaks.COMPETITIONS.items())
STREAK_VIEWS = {
    "marks": f"SELECT * FROM ({_MARKS}) WHERE met IS NOT NULL",
    "numbered": """SELECT *, sum((NOT met)::INT) OVER (PARTITION BY player_id, streak_type, competition_type ORDER BY game_date, game_id) - (NOT met)::INT AS island FROM marks""",
    "runs": """SELECT player_id, streak_type, competition_type, island, count(*) FILTER (WHERE met) AS length,
                      min(game_date) FILTER (WHERE met) AS started_at, max(game_date) FILTER (WHERE met) AS last_day,
                      arg_min(game_id, (game_date, game_id)) FILTER (WHERE met) AS first_game_id,
                      arg_max(game_id, (game_date, game_id)) FILTER (WHERE met) AS last_game_id,
                      min(game_date) FILTER (WHERE NOT met) AS broken_on
               FROM numbered GROUP BY player_id, streak_type, competition_type, island HAVING count(*) FILTER (WHERE met) > 0""",
    "finals": " UNION ALL ".join(
        f"SELECT player_id, '{c}' AS competition_type, arg_max(game_id, (game_date, game_id)) AS final_id FROM form_lines WHERE {flag} GROUP BY player_id"
        for c, flag in streaks.COMPETITIONS.items()),
    "streaks": """SELECT player_id, streak_type, competition_type, length, is_active, started_at,
                         CASE WHEN broken_on IS NOT NULL THEN broken_on WHEN NOT is_active THEN last_day END AS ended_at, first_game_id, last_game_id
                  FROM (SELECT r.*, broken_on IS NULL AND coalesce(p.is_active, FALSE) AND last_game_id = final_id AS is_active
                        FROM runs r JOIN finals USING (player_id, competition_type) LEFT JOIN people p ON r.player_id = p.player_id)""",
    "records": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY streak_type, competition_type ORDER BY length DESC, started_at, player_id) AS rn
                                 FROM streaks) WHERE rn = 1""",
    "grid": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t in _RULES for c in streaks.COMPETITIONS) + ") g(streak_type, competition_type)",
    "all_records": """SELECT streak_type, competition_type, coalesce(r.player_id, (SELECT min(player_id) FROM people)) AS player_id, coalesce(length, 1) AS length,
                             coalesce(started_at, DATE '1983-10-01') AS started_at, ended_at, coalesce(CAST(first_game_id AS VARCHAR), '0000000001') AS first_game_id,
                             CAST(last_game_id AS VARCHAR) AS last_game_id
                      FROM grid LEFT JOIN records r USING (streak_type, competition_type)""",
    "badged": """SELECT s.*, s.length >= greatest(2, CAST(floor(r.length * 0.7::DOUBLE) AS BIGINT)) AS is_historical
                 FROM streaks s JOIN all_records r USING (streak_type, competition_type)""",
}
_DAYS = "* REPLACE (CAST(started_at AS VARCHAR) AS started_at, CAST(ended_at AS VARCHAR) AS ended_at)"


def streaks_sql(body: str) -> str:
    return sql(body, "form_lines", "people", extra=STREAK_VIEWS)


def found_streaks(spark, sf):
    return streaks.streaks(L.form_lines(spark, sf), L.active_people(spark, sf), parts=parts_of(L.table(spark, sf, "events")))


def completed_records(spark, sf, found):
    lowest = L.people(spark, sf).agg(F.min("player_id")).first()[0]
    return streaks.complete_records(found, lowest)


def stored_streaks(spark, sf):
    """Streaks are stored once; records, badges and lists are made from them."""
    return write_and_reload(found_streaks(spark, sf), "streaks")


def badged_streaks(spark, sf):
    found = stored_streaks(spark, sf)
    return streaks.with_badges(found, completed_records(spark, sf, found))


@query("streaks", streaks_sql(f"SELECT {_DAYS} FROM streaks"))
def all_streaks(spark, sf):
    return found_streaks(spark, sf)


@query("streak_records", streaks_sql(f"SELECT {_DAYS} FROM all_records"))
def streak_records(spark, sf):
    return completed_records(spark, sf, found_streaks(spark, sf))


@query("streak_badges", streaks_sql(f"SELECT {_DAYS} FROM badged"))
def streak_badges(spark, sf):
    return badged_streaks(spark, sf)


@query("streak_summary", streaks_sql("""
    SELECT g.streak_type, count(b.length) AS total_streaks, coalesce(max(b.length), 0) AS max_length,
           coalesce(CAST(sum(b.length) AS DOUBLE) / nullif(count(b.length), 0), 0) AS avg_length,
           count(*) FILTER (WHERE b.is_historical) AS notable_count,
           greatest(2, CAST(floor(max(r.length) * 0.7::DOUBLE) AS BIGINT)) AS notable_threshold
    FROM grid g LEFT JOIN badged b USING (streak_type, competition_type) JOIN all_records r USING (streak_type, competition_type)
    WHERE g.competition_type = 'regular' GROUP BY g.streak_type"""))
def streak_summary(spark, sf):
    found = stored_streaks(spark, sf)
    records = completed_records(spark, sf, found)
    return streaks.streak_summary(streaks.with_badges(found, records), records)


# ---- scans ----------------------------------------------------------------------------------

_SOURCE = "SELECT id, date, season, status = 3 OR (id % 5 = 0) AS is_finished FROM games"
_GAPS = """
    SELECT id, season, CAST(date AS VARCHAR) AS date, island FROM walked w WHERE gap AND island <= coalesce(
        (SELECT min(island) FROM (SELECT season, island FROM walked WHERE present GROUP BY season, island HAVING count(*) >= 3) e
         WHERE e.season = w.season), island)"""


@query("gap_scan", sql(_GAPS, "games", extra={
    "source": _SOURCE,
    "walked": """SELECT *, CAST(sum(gap::INT) OVER (PARTITION BY season ORDER BY date DESC, id DESC) AS BIGINT) AS island FROM (
        SELECT s.*, g.present, s.is_finished AND NOT g.present AS gap FROM source s
        JOIN (SELECT id, status = 3 AND id % 2 = 0 OR (status = 1 AND coalesce(home_score, 0) > 0 AND date < DATE '2001-01-01') AS present FROM games) g ON s.id = g.id)"""}))
def gap_scan(spark, sf):
    """The store lacks every odd finished game; the source also counts each fifth game as finished."""
    games = L.games(spark, sf)
    source = games.selectExpr("id", "date", "season", "status = 3 or id % 5 = 0 is_finished")
    stored = games.filter("status <> 3 or id % 2 = 0")
    return gaps.gap_scan(source, stored, "2001-01-01").select("id", "season", "date", "island")


@query("frontier", sql("""
    SELECT season, (SELECT max(season) FROM games WHERE status = 3 AND season < '1999') AS frontier
    FROM (SELECT DISTINCT season FROM games) WHERE season > (SELECT max(season) FROM games WHERE status = 3 AND season < '1999')""", "games"))
def frontier(spark, sf):
    """Seasons still to load when the store ends in 1998-99."""
    games = L.games(spark, sf)
    stored = games.filter("season < '1999'")
    listed = games.select("season").distinct()
    return gaps.empty_seasons(listed, stored).withColumn("frontier", gaps.frontier(stored).scalar())
