"""Leader boards, rollups, standings, careers, awards, series and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.functions.awards import AWARD_PRIORITY
from formline.operators import boxscore, careers, champions, leaders, rollups, series, standings
from formline.plans import league as L
from formline.plans.league import sql
from formline.plans.listings import season_rows
from formline.plans.registry import query

_SUMS = rollups.SUM_COLUMNS


@query("leaders_avg", sql("""
    SELECT player_id, CAST(sum(pts) AS DOUBLE) / count(*) AS value, count(*) AS games FROM line_stats
    GROUP BY player_id HAVING count(*) >= 5 ORDER BY value DESC, player_id LIMIT 25""", "line_stats"))
def leaders_avg(spark, sf):
    return leaders.top_average(L.line_stats(spark, sf), "pts", limit=25)


@query("leaders_ratio", sql("""
    SELECT player_id, CAST(sum(fgm) AS DOUBLE) / CAST(sum(fga) AS DOUBLE) AS value, count(*) AS games,
           CAST(sum(fgm) AS BIGINT) AS total_made, CAST(sum(fga) AS BIGINT) AS total_attempts FROM line_stats
    GROUP BY player_id HAVING count(*) >= 5 AND sum(fga) >= 300 ORDER BY value DESC, player_id LIMIT 25""", "line_stats"))
def leaders_ratio(spark, sf):
    return leaders.top_ratio(L.line_stats(spark, sf), *leaders.RATIO_STATS["fg_pct"], limit=25)


@query("leaders_season", sql("""
    SELECT player_id, CAST(sum(ast) AS DOUBLE) / count(*) AS value, count(*) AS games FROM box_lines WHERE season = '1997-98'
    GROUP BY player_id HAVING count(*) >= 5 ORDER BY value DESC, player_id LIMIT 10""", "box_lines"))
def leaders_season(spark, sf):
    return leaders.top_players(L.box_lines(spark, sf), "ast", season="1997-98")


@query("leaders_multi", sql(
    "SELECT metric, player_id, value, games, place FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, player_id) AS place FROM ("
    + " UNION ALL ".join(f"SELECT '{s}' AS metric, player_id, CAST({s} AS DOUBLE) / games AS value, games FROM m" for s in leaders.BOARD_STATS)
    + ")) WHERE place <= 10", "box_lines", extra={"m": """
    SELECT player_id, count(*) AS games, sum(pts) AS pts, sum(reb) AS reb, sum(ast) AS ast, sum(stl) AS stl, sum(blk) AS blk
    FROM box_lines WHERE season = (SELECT max(season) FROM box_lines) GROUP BY player_id HAVING count(*) >= 5"""}))
def leaders_multi(spark, sf):
    return leaders.boards(L.box_lines(spark, sf))


@query("season_rollup", sql("SELECT * REPLACE (CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date) FROM season_rows", "season_rows"))
def season_rollup(spark, sf):
    return season_rows(spark, sf).drop("is_detailed")


_SIDES = """
    SELECT game_id, team_id, """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS total_{c}" for c in _SUMS) + """,
           CASE WHEN avg(plus_minus) <> 0 THEN avg(plus_minus) END AS avg_plus_minus,
           coalesce(CAST(sum(fgm) AS DOUBLE) / nullif(CAST(sum(fga) AS DOUBLE), 0), 0) AS fg_pct,
           coalesce(CAST(sum(fg3m) AS DOUBLE) / nullif(CAST(sum(fg3a) AS DOUBLE), 0), 0) AS fg3_pct,
           coalesce(CAST(sum(ftm) AS DOUBLE) / nullif(CAST(sum(fta) AS DOUBLE), 0), 0) AS ft_pct
    FROM box_lines GROUP BY game_id, team_id"""


@query("side_rollup", sql("SELECT * FROM sides", "box_lines", extra={"sides": _SIDES}))
def side_rollup(spark, sf):
    return rollups.side_rollup(L.box_lines(spark, sf))


@query("score_repair", sql("""
    SELECT id, home_score, away_score, score_repaired,
           CASE WHEN score_repaired THEN CASE WHEN home_score > away_score THEN home_team_id WHEN away_score > home_score THEN away_team_id END
                ELSE winner_team_id END AS winner_team_id
    FROM (SELECT g.id, g.home_team_id, g.away_team_id, g.winner_team_id,
                 CAST(CASE WHEN p.n >= 2 AND broken THEN coalesce(p.h, g.home_score) ELSE g.home_score END AS BIGINT) AS home_score,
                 CAST(CASE WHEN p.n >= 2 AND broken THEN coalesce(p.a, g.away_score) ELSE g.away_score END AS BIGINT) AS away_score,
                 coalesce(p.n >= 2 AND broken AND coalesce(p.h, g.home_score) IS NOT NULL AND coalesce(p.a, g.away_score) IS NOT NULL, FALSE) AS score_repaired
          FROM (SELECT *, coalesce(home_score, 0) = 0 OR coalesce(away_score, 0) = 0 AS broken FROM games) g
          LEFT JOIN (SELECT s.game_id, count(*) AS n, max(CASE WHEN s.team_id = g.home_team_id THEN total_pts END) AS h,
                            max(CASE WHEN s.team_id = g.away_team_id THEN total_pts END) AS a
                     FROM sides s JOIN games g ON s.game_id = g.id GROUP BY s.game_id) p ON g.id = p.game_id)""",
    "games", "box_lines", extra={"sides": _SIDES}))
def score_repair(spark, sf):
    sides = rollups.side_rollup(L.box_lines(spark, sf))
    return rollups.repaired_scores(L.games(spark, sf), sides).select("id", "home_score", "away_score", "score_repaired", "winner_team_id")


def _means(games: str, divisor: str, agg: bool) -> str:
    def total(c: str) -> str:
        return f"sum({c})" if agg else c

    parts = [f"CAST({total(c)} AS DOUBLE) / {divisor} AS {c}" for c in rollups.AVERAGED]
    parts.append(f"CAST(coalesce({total('min_seconds')}, 0) AS DOUBLE) / 60.0::DOUBLE / {divisor} AS mpg")
    parts += [f"coalesce(CAST({total(m)} AS DOUBLE) / nullif(CAST({total(a)} AS DOUBLE), 0), 0) AS {n}" for n, (m, a) in rollups.RATIOS.items()]
    parts.append(f"coalesce({total('plus_minus')}, 0) / {divisor} AS plus_minus")
    return f"{games} AS games, " + ", ".join(parts)


_STORED = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY team_id) AS rn FROM season_rows WHERE type = 'Regular Season' AND season < (SELECT max(season) FROM season_rows) AND games_played > 0) WHERE rn = 1"


@query("season_average", sql(f"""
    SELECT player_id, season, 'season row' AS source, {_means('games_played', 'CAST(games_played AS DOUBLE)', False)} FROM stored UNION ALL
    SELECT player_id, season, 'stat lines', {_means('count(*)', 'CAST(CASE WHEN count(*) FILTER (WHERE min_seconds > 0) > 0 THEN count(*) FILTER (WHERE min_seconds > 0) ELSE count(*) END AS DOUBLE)', True)}
    FROM box_lines WHERE rs AND (player_id, season) NOT IN (SELECT (player_id, season) FROM stored) GROUP BY player_id, season""",
    "season_rows", extra={"stored": _STORED}))
def season_average(spark, sf):
    """The regular seasons' rows are stored; the newest season is not yet, and is averaged from its stat lines."""
    lines = L.box_lines(spark, sf)
    newest = lines.agg(F.max("season")).scalar()
    return rollups.season_averages(lines, rollups.season_rollup(lines).filter(F.col("season") < newest))


@query("season_summary", sql(f"""
    SELECT player_id, team_id, season, type, {_means('games_played', 'CAST(games_played AS DOUBLE)', False)} FROM season_rows""", "season_rows"))
def season_summary(spark, sf):
    return rollups.season_summaries(season_rows(spark, sf))


@query("career_totals", sql(f"""
    SELECT player_id, type, {_means('CAST(sum(games_played) AS BIGINT)', 'CAST(sum(games_played) AS DOUBLE)', True)} FROM season_rows GROUP BY player_id, type""", "season_rows"))
def career_totals(spark, sf):
    return rollups.career_totals(season_rows(spark, sf))


@query("experience", sql("""
    SELECT p.id, CAST(coalesce(s.n, p.season_exp, 0) AS BIGINT) AS experience FROM players p
    LEFT JOIN (SELECT player_id, count(DISTINCT season) AS n FROM box_lines GROUP BY player_id) s ON p.id = s.player_id""",
    "players", "box_lines"))
def experience(spark, sf):
    return rollups.experience(L.players(spark, sf), rollups.season_rollup(L.box_lines(spark, sf)))


_TENS = "(pts >= 10)::INT + (reb >= 10)::INT + (ast >= 10)::INT + (stl >= 10)::INT + (blk >= 10)::INT"


@query("career_highs", sql(f"""
    SELECT player_id, count(*) AS total_games, {", ".join(f"max({c}) AS max_{c}" for c in careers.BEST_COLUMNS)},
           count_if(pts >= 60) AS games_60_pts, count_if(pts >= 50 AND pts < 60) AS games_50_pts, count_if(pts >= 40 AND pts < 50) AS games_40_pts,
           count_if(reb >= 20) AS games_20_reb, count_if(ast >= 20) AS games_20_ast, count_if(stl >= 5) AS games_5_stl,
           count_if(blk >= 5) AS games_5_blk, count_if(fg3m >= 10) AS games_10_3pm,
           count_if({_TENS} >= 3) AS triple_doubles, count_if({_TENS} >= 2) AS double_doubles
    FROM line_stats GROUP BY player_id""".replace("count_if(", "count(*) FILTER (WHERE "), "line_stats"))
def career_highs(spark, sf):
    return careers.career_highs(L.line_stats(spark, sf))


@query("high_detail", sql("""
    SELECT player_id, stat, value, CAST(date AS VARCHAR) AS date, game_id, season, vs_team_id FROM (
      SELECT *, row_number() OVER (PARTITION BY player_id, stat ORDER BY value DESC, date DESC, game_id DESC, season DESC, vs_team_id DESC) AS rn FROM ("""
    + " UNION ALL ".join(
        f"SELECT player_id, '{c}' AS stat, CAST({c} AS DOUBLE) AS value, date, game_id, season, "
        f"CASE WHEN team_id = home_team_id THEN away_team_id ELSE home_team_id END AS vs_team_id FROM box_lines WHERE {c} IS NOT NULL"
        for c in careers.BEST_COLUMNS) + ")) WHERE rn = 1", "box_lines"))
def high_detail(spark, sf):
    return careers.high_details(L.box_lines(spark, sf))


@query("recent_form", sql("""
    SELECT player_id, span, count(*) AS games, count(*) FILTER (WHERE min_seconds > 0) AS games_played,
           CAST(sum(min_seconds) AS DOUBLE) / 60.0::DOUBLE / d AS mpg, sum(pts)::DOUBLE / d AS ppg, sum(reb)::DOUBLE / d AS rpg,
           sum(ast)::DOUBLE / d AS apg, sum(stl)::DOUBLE / d AS spg, sum(blk)::DOUBLE / d AS bpg, sum(tov)::DOUBLE / d AS topg,
           coalesce(sum(fgm)::DOUBLE / nullif(sum(fga)::DOUBLE, 0), 0) AS fg_pct, coalesce(sum(fg3m)::DOUBLE / nullif(sum(fg3a)::DOUBLE, 0), 0) AS fg3_pct,
           coalesce(sum(ftm)::DOUBLE / nullif(sum(fta)::DOUBLE, 0), 0) AS ft_pct, sum(coalesce(plus_minus, 0)) / d AS plus_minus
    FROM (SELECT *, CAST(CASE WHEN sum((min_seconds > 0)::INT) OVER (PARTITION BY player_id, span) > 0
                    THEN sum((min_seconds > 0)::INT) OVER (PARTITION BY player_id, span) ELSE count(*) OVER (PARTITION BY player_id, span) END AS DOUBLE) AS d
          FROM (SELECT r.*, s.span FROM topped r JOIN (SELECT 'last_7_days' AS span, 7 AS days UNION ALL SELECT 'last_month', 30) s
                ON r.game_date >= greatest(r.top, DATE '2022-01-15') - s.days))
    GROUP BY player_id, span, d""", "form_lines", extra={"topped": """
        SELECT *, max(game_date) OVER (PARTITION BY player_id) AS top FROM form_lines"""}))
def recent_form(spark, sf):
    return careers.recent_form(L.form_lines(spark, sf).withColumnRenamed("game_date", "date"), "2022-01-15")


_RESULTS = """
    SELECT season, winner_team_id AS team_id, 1 AS win FROM games WHERE status = 3 AND rs AND winner_team_id IS NOT NULL UNION ALL
    SELECT season, CASE WHEN winner_team_id = home_team_id THEN away_team_id ELSE home_team_id END, 0 FROM games
    WHERE status = 3 AND rs AND winner_team_id IS NOT NULL"""


@query("record_rank", sql("""
    SELECT *, row_number() OVER (PARTITION BY conference ORDER BY pct DESC, team_id) AS conf_rank FROM (
        SELECT t.id AS team_id, t.full_name, t.conference, CAST(coalesce(w, 0) AS BIGINT) AS wins, CAST(coalesce(l, 0) AS BIGINT) AS losses,
               CAST(coalesce(w + l, 0) AS BIGINT) AS total, coalesce(w::DOUBLE / nullif(w + l, 0), 0) AS pct
        FROM teams t LEFT JOIN (SELECT team_id, sum(win) AS w, sum(1 - win) AS l FROM results WHERE season = '1999-00' GROUP BY team_id) r ON t.id = r.team_id)""",
    "games", "teams", extra={"results": _RESULTS}))
def record_rank(spark, sf):
    return standings.team_records(L.games(spark, sf), L.teams(spark, sf), "1999-00")


@query("standings", sql("""
    SELECT *, row_number() OVER (PARTITION BY season, conference ORDER BY pct DESC, team_id) AS conf_rank FROM (
        SELECT r.season, r.team_id, abbreviation, full_name, conference, division, CAST(sum(win) AS BIGINT) AS wins,
               CAST(sum(1 - win) AS BIGINT) AS losses, sum(win)::DOUBLE / count(*) AS pct
        FROM results r JOIN teams t ON r.team_id = t.id GROUP BY ALL)""", "games", "teams", extra={"results": _RESULTS}))
def season_standings(spark, sf):
    return standings.season_standings(L.games(spark, sf), L.teams(spark, sf))


@query("standings_by_score", sql("""
    SELECT *, row_number() OVER (PARTITION BY season, conference ORDER BY pct DESC, team_id) AS conf_rank FROM (
        SELECT s.season, s.team_id, full_name, conference, division, CAST(sum(win) AS BIGINT) AS wins, CAST(sum(1 - win) AS BIGINT) AS losses,
               count(*) FILTER (WHERE win = 1 AND at_home) AS home_wins, count(*) FILTER (WHERE win = 1 AND NOT at_home) AS away_wins,
               sum(win)::DOUBLE / count(*) AS pct
        FROM (SELECT season, home_team_id AS team_id, (home_score > away_score)::INT AS win, TRUE AS at_home FROM games WHERE rs AND home_score <> away_score
              UNION ALL SELECT season, away_team_id, (away_score > home_score)::INT, FALSE FROM games WHERE rs AND home_score <> away_score) s
        JOIN teams t ON s.team_id = t.id GROUP BY ALL)""", "games", "teams"))
def standings_by_score(spark, sf):
    return standings.score_standings(L.games(spark, sf), L.teams(spark, sf))


@query("awards_clean", sql("SELECT player_id, season, award_type, award_name FROM awards", "awards"))
def awards_clean(spark, sf):
    return L.awards(spark, sf).drop("description")


_PRIORITY = "CASE award_type " + " ".join(
    f"WHEN '{a}' THEN {i}" for i, a in enumerate(AWARD_PRIORITY)) + " ELSE 99 END"


@query("awards_grouped", sql(f"""
    SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY {_PRIORITY}, award_name) AS place FROM (
        SELECT player_id, award_name, max(award_type) AS award_type, count(*) AS award_count, string_agg(season, ',' ORDER BY season DESC) AS seasons,
               CASE WHEN max(award_type) = 'Champion' THEN 'NBA Champion' ELSE award_name END AS display_name
        FROM awards GROUP BY player_id, award_name)""", "awards"))
def awards_grouped(spark, sf):
    return leaders.grouped_awards(L.awards(spark, sf))


@query("award_leaders", sql("""
    SELECT player_id, full_name, is_active, award_count, seasons FROM (
        SELECT player_id, count(*) AS award_count, string_agg(DISTINCT season, ',' ORDER BY season DESC) AS seasons
        FROM awards WHERE award_type = 'All-Star' GROUP BY player_id) a JOIN players p ON a.player_id = p.id WHERE is_active
    ORDER BY award_count DESC, player_id LIMIT 20""", "awards", "players"))
def award_leaders(spark, sf):
    return leaders.award_leaders(L.awards(spark, sf), L.players(spark, sf), "all-star", active_only=True, limit=20)


_SERIES = """
    SELECT season, t1 AS team1_id, t2 AS team2_id, count(*) FILTER (WHERE winner_team_id = t1) AS t1_wins,
           count(*) FILTER (WHERE winner_team_id = t2) AS t2_wins, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
           arg_max(rnd, (date, code)) FILTER (WHERE rnd IS NOT NULL) AS round,
           coalesce(arg_max(pos, (date, code)) FILTER (WHERE rnd IS NOT NULL), 99) AS position,
           CAST({score1} AS BIGINT) AS t1_score, CAST({score2} AS BIGINT) AS t2_score
    FROM (SELECT *, least(home_team_id, away_team_id) AS t1, greatest(home_team_id, away_team_id) AS t2,
                 CASE WHEN home_team_id < away_team_id THEN home_score ELSE away_score END AS s1,
                 CASE WHEN home_team_id < away_team_id THEN away_score ELSE home_score END AS s2, {place}
          FROM games WHERE {rows}) GROUP BY season, t1, t2"""
_PLAYOFF = _SERIES.format(
    score1="0", score2="0", rows="po AND status = 3",
    place="CAST(substring(code, 8, 1) AS BIGINT) AS rnd, CAST(substring(code, 9, 1) AS BIGINT) AS pos")
_CUP_END = "substring(code, 7, 4)"
_CUP = _SERIES.format(
    score1="coalesce(arg_max(s1, (date, code, s1, s2)) FILTER (WHERE winner_team_id IS NOT NULL), 0)",
    score2="coalesce(arg_max(s2, (date, code, s1, s2)) FILTER (WHERE winner_team_id IS NOT NULL), 0)",
    rows=f"ist AND status = 3 AND (NOT rs OR substring(code, 6, 5) IN ('01201', '01202', '01203', '01204', '01229', '01230'))",
    place=f"""CAST(CASE WHEN code LIKE '006%' THEN 4 WHEN {_CUP_END} IN ('1201', '1202', '1203', '1204') THEN 2
                   WHEN {_CUP_END} IN ('1229', '1230') THEN 3 END AS BIGINT) AS rnd,
              CAST(CASE WHEN code LIKE '006%' THEN 0 WHEN {_CUP_END} = '1201' THEN 0 WHEN {_CUP_END} = '1202' THEN 1 WHEN {_CUP_END} = '1203' THEN 2
                   WHEN {_CUP_END} = '1204' THEN 3 WHEN {_CUP_END} = '1229' THEN 0 WHEN {_CUP_END} = '1230' THEN 1 END AS BIGINT) AS pos""")


@query("pair_series", sql("SELECT * FROM s", "games", extra={"s": _PLAYOFF}))
def pair_series(spark, sf):
    return series.pair_series(series.playoff_games(L.games(spark, sf)), code="code")


@query("series_rounds", sql("""
    SELECT *, CASE round WHEN 1 THEN 'Primera Ronda' WHEN 2 THEN 'Semis de Conferencia' WHEN 3 THEN 'Finales de Conferencia'
                   WHEN 4 THEN 'Finales NBA' END AS round_name FROM s WHERE round BETWEEN 1 AND 4""", "games", extra={"s": _PLAYOFF}))
def series_rounds(spark, sf):
    return series.playoff_bracket(L.games(spark, sf), code="code")


@query("cup_rounds", sql("""
    SELECT *, CASE round WHEN 2 THEN 'Cuartos de Final' WHEN 3 THEN 'Semifinales' WHEN 4 THEN 'Final (NBA Cup)' END AS round_name
    FROM s WHERE round BETWEEN 1 AND 4""", "games", extra={"s": _CUP}))
def cup_rounds(spark, sf):
    return series.cup_bracket(L.games(spark, sf), code="code")


@query("nested_rounds", sql("""
    SELECT season, round, count(*) AS n_series, string_agg(a.abbreviation || '-' || b.abbreviation || ' ' || t1_wins || ':' || t2_wins, ','
           ORDER BY position, team1_id, team2_id) AS series
    FROM s JOIN teams a ON team1_id = a.id JOIN teams b ON team2_id = b.id WHERE round BETWEEN 1 AND 4 GROUP BY season, round""",
    "games", "teams", extra={"s": _PLAYOFF}))
def nested_rounds(spark, sf):
    nested = series.nested_rounds(series.playoff_bracket(L.games(spark, sf), code="code"), L.teams(spark, sf))
    text = F.transform("series", lambda s: F.concat(
        s["team1_abbr"], F.lit("-"), s["team2_abbr"], F.lit(" "), s["t1_wins"].cast("string"), F.lit(":"), s["t2_wins"].cast("string")))
    return nested.select("season", "round", F.size("series").alias("n_series"), text.alias("series"))


@query("game_headers", sql("""
    SELECT g.id, CAST(g.date AS VARCHAR) AS date, g.season, home_team_id, away_team_id,
           coalesce(h.full_name, 'Team ' || home_team_id) AS home_team, coalesce(a.full_name, 'Team ' || away_team_id) AS away_team,
           coalesce(h.abbreviation, 'T1') AS home_team_abbr, coalesce(a.abbreviation, 'T2') AS away_team_abbr,
           coalesce(home_score, 0) AS home_score, coalesce(away_score, 0) AS away_score, rs, po, pi, ist
    FROM games g LEFT JOIN east h ON g.home_team_id = h.id LEFT JOIN east a ON g.away_team_id = a.id""",
    "games", "teams", extra={"east": "SELECT * FROM teams WHERE conference = 'East'"}))
def game_headers(spark, sf):
    """Only half of the teams are known, so that the fallback texts occur."""
    return boxscore.game_headers(L.games(spark, sf), L.teams(spark, sf).filter("conference = 'East'"))


@query("box_score", sql("""
    SELECT game_id, player_id, coalesce(p.full_name, 'Player ' || player_id) AS player, coalesce(t.abbreviation, 'ID ' || team_id) AS team, team_id,
           min_seconds, min_seconds // 60 || ':' || lpad(CAST(min_seconds % 60 AS VARCHAR), 2, '0') AS min, pts, reb, ast, plus_minus
    FROM box_lines b LEFT JOIN (SELECT * FROM players WHERE is_active) p ON b.player_id = p.id LEFT JOIN teams t ON b.team_id = t.id""",
    "box_lines", "players", "teams"))
def box_score(spark, sf):
    known = L.players(spark, sf).filter("is_active")
    return boxscore.player_lines(L.box_lines(spark, sf), known, L.teams(spark, sf)).select(
        "game_id", "player_id", "player", "team", "team_id", "min_seconds", "min", "pts", "reb", "ast", "plus_minus")


@query("champion_propagation", sql("""
    SELECT DISTINCT r.player_id, r.season, w.award_type, w.award_name FROM winners w
    JOIN (SELECT DISTINCT season, team_id, player_id FROM season_rows) r ON w.season = r.season AND w.team_id = r.team_id
    WHERE NOT EXISTS (SELECT 1 FROM awards a WHERE a.player_id = r.player_id AND a.season = r.season AND a.award_type = w.award_type)""",
    "games", "season_rows", "awards", extra={"winners": """
        SELECT season, arg_max_null(winner_team_id, (date, code, winner_team_id)) AS team_id, 'Champion' AS award_type, 'NBA Champion' AS award_name
        FROM games WHERE po GROUP BY season UNION ALL
        SELECT season, arg_max_null(winner_team_id, (date, code, winner_team_id)), 'NBA Cup', 'NBA Cup Champion' FROM games WHERE code LIKE '006%' GROUP BY season"""}))
def champion_propagation(spark, sf):
    return champions.new_titles(L.games(spark, sf), season_rows(spark, sf), L.awards(spark, sf), code="code").drop("description")
