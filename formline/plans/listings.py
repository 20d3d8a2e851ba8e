"""Filters, searches, pages, rankings and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.functions.seasons import season_bounds
from formline.operators import filters, paging, rankings, relations, rollups, search, validation
from formline.operators.page_index import By, PageIndex
from formline.operators.running import parts_of
from formline.plans import league as L
from formline.plans.league import sql
from formline.plans.registry import query
from formline.session import shared_dir


def season_rows(spark, sf):
    """A task of the join may hold a group for each line and type, so its tasks follow the lines."""
    return rollups.season_rollup(L.box_lines(spark, sf, parts_of(L.table(spark, sf, "lineitem"), 300_000)))


@query("table_counts", """
    SELECT 'region' AS table_name, count(*) AS rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation
    UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier
    UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def table_counts(spark, sf):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    return rollups.table_counts({n: L.table(spark, sf, n) for n in names})


@query("team_list", sql("SELECT id, full_name, division FROM teams WHERE conference = 'East'", "teams"))
def team_list(spark, sf):
    return filters.teams(L.teams(spark, sf), conference="East").select("id", "full_name", "division")


@query("entity_search", sql("""
    SELECT id, full_name, position FROM players
    WHERE full_name ILIKE '%RING%' AND position ILIKE '%o%' AND is_active
      AND id IN (SELECT player_id FROM box_lines WHERE season = '1998-99' AND team_id = 3 AND (rs OR po OR pi OR ist))""",
    "players", "box_lines"))
def entity_search(spark, sf):
    found = filters.players(
        L.players(spark, sf), name="RING", position="o", active_only=True,
        memberships=season_rows(spark, sf), team_id=3, season="1998-99")
    return found.select("id", "full_name", "position")


@query("game_search", sql("""
    SELECT id, CAST(date AS VARCHAR) AS date, season, home_team_id, away_team_id, home_score, away_score FROM games
    WHERE (home_team_id = 3 OR away_team_id = 3) AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND status = 3 AND rs""",
    "games"))
def game_search(spark, sf):
    found = filters.games(
        L.games(spark, sf), team_id=3, start="1996-01-01", end="1998-12-31", finished_only=True, competition="Regular Season")
    return found.select("id", "date", "season", "home_team_id", "away_team_id", "home_score", "away_score")


@query("games_page", sql("""
    SELECT id, CAST(date AS VARCHAR) AS date FROM games WHERE season = (SELECT max(season) FROM games)
    ORDER BY games.date DESC, id DESC LIMIT 20 OFFSET 20""", "games"))
def games_page(spark, sf):
    latest = filters.games_page(L.games(spark, sf))
    return paging.page(latest, [F.desc("date"), F.desc("id")], 2, 20).select("id", "date")


@query("page_totals", sql("SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM games", "games"))
def page_totals(spark, sf):
    return paging.page_count(L.games(spark, sf), 20)


@query("page_concat", sql("""
    SELECT id, full_name, CAST(part AS BIGINT) AS part FROM (
        SELECT id, full_name, CASE WHEN is_active THEN 0 ELSE 1 END AS part FROM players)
    ORDER BY part, full_name, id LIMIT 200 OFFSET 1200""", "players"))
def page_concat(spark, sf):
    people = L.players(spark, sf).select("id", "full_name", "is_active")
    parts = [people.filter("is_active").drop("is_active"), people.filter("not is_active").drop("is_active")]
    return paging.page_of_parts(parts, [F.asc("full_name"), F.asc("id")], 7, 200)


_BY_POINTS = "SELECT id, pts, row_number() OVER (ORDER BY pts DESC, id) - 1 AS place, count(*) OVER () AS total FROM form_lines"


def lines_by_points(spark, sf):
    """The stat lines laid out by points, most first."""
    lines = L.form_lines(spark, sf).select("id", "pts", "player_id")
    return PageIndex.build(lines, [By("pts", True), By("id")], shared_dir(spark, "by-points"))


@query("deep_page", sql("""
    SELECT id, CAST(pts AS BIGINT) AS pts FROM n WHERE place // 50 = total // 50 * 2 // 3""", "form_lines", extra={"n": _BY_POINTS}))
def deep_page(spark, sf):
    index = lines_by_points(spark, sf)
    return index.page(index.total // 50 * 2 // 3 + 1, 50).select("id", "pts")


@query("page_after", sql("""
    SELECT id, CAST(pts AS BIGINT) AS pts FROM (SELECT *, row_number() OVER (ORDER BY place) AS k FROM n WHERE pts < 30 OR (pts = 30 AND id > 5000)) WHERE k <= 50""",
    "form_lines", extra={"n": _BY_POINTS}))
def page_after(spark, sf):
    return lines_by_points(spark, sf).after({"pts": 30, "id": 5000}, 50).select("id", "pts")


@query("fact_search", sql("""
    SELECT game_id, player_id, pts, CAST(date AS VARCHAR) AS date FROM box_lines
    WHERE team_id = 3 AND season = '1997-98' AND pts >= 40""", "box_lines"))
def fact_search(spark, sf):
    return filters.stat_lines(L.box_lines(spark, sf), team_id=3, season="1997-98", min_points=40).select(
        "game_id", "player_id", "pts", "date")


@query("sum_range", sql("""
    SELECT id, home_score + away_score AS total_points FROM games
    WHERE status = 3 AND home_score + away_score BETWEEN 180 AND 230
    ORDER BY home_score + away_score DESC, date DESC, id DESC LIMIT 50""", "games"))
def sum_range(spark, sf):
    return filters.games_by_total(L.games(spark, sf), 180, 230, limit=50).select("id", "total_points")


def _recent(name: str, window: str, days: int) -> None:
    @query(name, sql(f"""
        SELECT id, player_id, CAST(game_date AS VARCHAR) AS game_date, pts FROM form_lines
        WHERE game_date >= (SELECT max(game_date) FROM form_lines) - {days}""", "form_lines"))
    def recent(spark, sf):
        return filters.recent(L.form_lines(spark, sf), window, when="game_date").select("id", "player_id", "game_date", "pts")


_recent("recent_window_day", "last_game", 0)
_recent("recent_window_week", "week", 7)
_recent("recent_window_month", "month", 30)


@query("still_playing", sql("SELECT id, CAST(to_year AS BIGINT) AS to_year FROM players WHERE to_year IS NULL OR to_year >= 2003", "players"))
def still_playing(spark, sf):
    return filters.still_playing(L.players(spark, sf), 2004).select("id", "to_year")


@query("name_prefix", sql("SELECT id, full_name FROM players WHERE lower(full_name) LIKE 'r%' OR lower(full_name) LIKE '% r%'", "players"))
def name_prefix(spark, sf):
    return search.by_letter(L.players(spark, sf), "R").select("id", "full_name")


@query("name_ladder", sql("""
    SELECT id, full_name, tier FROM (SELECT *, min(tier) OVER () AS best FROM (
        SELECT id, full_name, CAST(CASE WHEN full_name ILIKE '%ronny%' AND full_name ILIKE '%ring%' THEN 1
            WHEN full_name ILIKE '%ring%' AND full_name ILIKE 'r%' THEN 2 WHEN full_name ILIKE '%ronny ring%' THEN 3 END AS BIGINT) AS tier FROM players)
        WHERE tier IS NOT NULL) WHERE tier = best""", "players"))
def name_ladder(spark, sf):
    return search.search_ladder(L.players(spark, sf), "Ronny Ring").select("id", "full_name", "tier")


_GUESSES = """
    SELECT id AS guess_id, CASE WHEN id % 3 = 0 THEN upper(full_name) WHEN id % 3 = 1 THEN split_part(full_name, ' ', 2)
           ELSE substring(full_name, 1, 5) END AS guess,
           substring(position, 1, 1) AS letter,
           CASE id % 3 WHEN 0 THEN 'lottery' WHEN 1 THEN 'european' ELSE 'champion' END AS category
    FROM players"""


@query("name_words", sql("""
    SELECT g.guess_id, g.guess, g.letter, g.category, p.player_id IS NOT NULL AS valid, p.player_id
    FROM guesses g LEFT JOIN (
        SELECT g.guess_id, min(p.id) AS player_id FROM guesses g JOIN players p
          ON ' ' || lower(p.full_name) || ' ' LIKE '% ' || lower(trim(g.guess)) || ' %'
         AND ' ' || lower(p.full_name) LIKE '% ' || lower(g.letter) || '%'
        WHERE (g.category = 'lottery' AND p.draft_number <= 14)
           OR (g.category = 'european' AND p.country IN ('Spain', 'France', 'Serbia', 'Czechia'))
           OR (g.category = 'champion' AND p.id IN (SELECT player_id FROM awards WHERE award_type = 'Champion'))
        GROUP BY g.guess_id) p ON g.guess_id = p.guess_id""", "players", "awards", extra={"guesses": _GUESSES}))
def name_words(spark, sf):
    people = L.players(spark, sf)
    guesses = people.selectExpr(
        "id guess_id", "case id % 3 when 0 then upper(full_name) when 1 then split_part(full_name, ' ', 2) else substring(full_name, 1, 5) end guess",
        "substring(position, 1, 1) letter", "case id % 3 when 0 then 'lottery' when 1 then 'european' else 'champion' end category")
    parts = {"lottery": relations.lottery_picks(people), "european": relations.europeans(people),
             "champion": relations.award_winners(L.awards(spark, sf), "Champion")}
    members = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("category"), "player_id")
        members = part if members is None else members.unionByName(part)
    return search.validated_guesses(guesses, people, members).select("guess_id", "guess", "letter", "category", "valid", "player_id")


@query("conference_cells", sql("""
    SELECT conference, division, count(*) AS n_teams, string_agg(full_name, ',' ORDER BY full_name) AS names FROM teams
    WHERE (conference, division) IN (('East', 'AFRICA'), ('East', 'ASIA'), ('West', 'AMERICA'), ('West', 'EUROPE'))
    GROUP BY conference, division""", "teams"))
def conference_cells(spark, sf):
    cells = [("East", "AFRICA"), ("East", "ASIA"), ("West", "AMERICA"), ("West", "EUROPE")]
    return filters.conference_cells(L.teams(spark, sf), cells).select(
        "conference", "division", "n_teams", F.col("teams.full_name").alias("names"))


@query("team_by_abbreviation", sql("SELECT id, abbreviation FROM teams WHERE abbreviation ILIKE '%n1%' ORDER BY id LIMIT 1", "teams"))
def team_by_abbreviation(spark, sf):
    return filters.team_by_abbreviation(L.teams(spark, sf), "n1").select("id", "abbreviation")


@query("valid_teams", sql("""
    SELECT home_team_id, home_team_id IN (SELECT id FROM teams WHERE conference = 'East') AS valid_team, count(*) AS games
    FROM games GROUP BY 1, 2""", "games", "teams"))
def valid_teams(spark, sf):
    east = filters.teams(L.teams(spark, sf), conference="East")
    marked = filters.with_valid_team(L.games(spark, sf), east, team="home_team_id")
    return marked.groupBy("home_team_id", "valid_team").agg(F.count(F.lit(1)).alias("games"))


@query("stale_entities", sql("""
    SELECT id, CAST(last_award_sync AS VARCHAR) AS last_award_sync FROM players p
    WHERE is_active AND (last_award_sync IS NULL OR (last_award_sync < DATE '2001-07-16'
      AND id IN (SELECT player_id FROM box_lines WHERE date >= DATE '2001-07-16')))""", "players", "box_lines"))
def stale_entities(spark, sf):
    return filters.needing_award_refresh(L.players(spark, sf), L.box_lines(spark, sf), "2001-07-31").select("id", "last_award_sync")


@query("stale_in_award_month", sql("SELECT id FROM players WHERE is_active", "players"))
def stale_in_award_month(spark, sf):
    return filters.needing_award_refresh(L.players(spark, sf), L.box_lines(spark, sf), "2001-05-15").select("id")


@query("completed_games", sql("""
    SELECT id, CAST(status AS BIGINT) AS status, season FROM games WHERE (status = 3 OR (status = 1 AND home_score > 0))
      AND id IN (SELECT l_orderkey FROM lineitem)""", "games"))
def completed_games(spark, sf):
    return filters.completed_games(L.games(spark, sf), L.line_stats(spark, sf)).select("id", "status", "season")


@query("repaired_biographies", sql("""
    SELECT id, CASE WHEN height IN ('nan', 'None', '') THEN 'N/A' ELSE height END AS height, position, country FROM players""", "players"))
def repaired_biographies(spark, sf):
    return filters.repaired_biographies(L.players(spark, sf)).select("id", "height", "position", "country")


def unrepaired_lines(spark, sf):
    """Line items read as stat lines with inconsistent shots, as they may be delivered."""
    return L.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey game_id", "l_partkey player_id", "cast(round(l_extendedprice * 100) as bigint) c",
        "cast(l_quantity as bigint) q", "cast(round(l_discount * 100) as bigint) d", "cast(round(l_tax * 100) as bigint) t",
    ).selectExpr(
        "game_id", "player_id", "q pts", "c % 12 - 1 reb", "d ast", "t stl", "t % 3 blk", "q % 5 tov", "q % 7 pf",
        "q % 14 fgm", "c % 15 fga", "d fg3m", "t fg3a", "q % 9 ftm", "c % 11 fta",
    ).selectExpr("*", *[f"cast(if({a} > 0, {m} / {a}, 0) as double) {p}" for p, m, a in (
        ("fg_pct", "fgm", "fga"), ("fg3_pct", "fg3m", "fg3a"), ("ft_pct", "ftm", "fta"))])


RAW_LINES_SQL = """
    SELECT *, CASE WHEN fga > 0 THEN fgm::DOUBLE / fga ELSE 0 END AS fg_pct, CASE WHEN fg3a > 0 THEN fg3m::DOUBLE / fg3a ELSE 0 END AS fg3_pct,
           CASE WHEN fta > 0 THEN ftm::DOUBLE / fta ELSE 0 END AS ft_pct
    FROM (SELECT l_orderkey AS game_id, l_partkey AS player_id, q AS pts, c % 12 - 1 AS reb, d AS ast, t AS stl, t % 3 AS blk, q % 5 AS tov,
                 q % 7 AS pf, q % 14 AS fgm, c % 15 AS fga, d AS fg3m, t AS fg3a, q % 9 AS ftm, c % 11 AS fta
          FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q,
                       CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem))"""

_RULES_SQL = {
    **{f"check_{c}": f"{c} < 0" for c in validation.LINE_COUNTS},
    **{f"check_{c}": f"NOT ({c} BETWEEN 0 AND 1)" for c in ("fg_pct", "fg3_pct", "ft_pct")},
    **{f"check_{a}_lte_{b}": f"{a} > {b}" for a, b in validation.SHOT_PAIRS},
}


@query("constraint_violations", sql("""
    SELECT game_id, player_id, pts, violations FROM (SELECT *, concat_ws(',', """ + ", ".join(
        f"CASE WHEN {bad} THEN '{n}' END" for n, bad in _RULES_SQL.items()) + ") AS violations FROM raw_lines) WHERE violations <> ''",
    extra={"raw_lines": RAW_LINES_SQL}))
def constraint_violations(spark, sf):
    return validation.violations(unrepaired_lines(spark, sf), validation.line_rules()).select("game_id", "player_id", "pts", "violations")


@query("violation_counts", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {bad}) AS rows FROM raw_lines" for n, bad in _RULES_SQL.items()),
    extra={"raw_lines": RAW_LINES_SQL}))
def violation_counts(spark, sf):
    return validation.violation_counts(unrepaired_lines(spark, sf), validation.line_rules())


@query("key_violations", sql("""
    SELECT game_id, player_id, count(*) AS rows FROM line_stats GROUP BY game_id, player_id HAVING count(*) > 1""", "line_stats"))
def key_violations(spark, sf):
    return validation.duplicate_keys(L.line_stats(spark, sf), ["game_id", "player_id"])


@query("reference_violations", sql("""
    SELECT id, player_id FROM form_lines WHERE player_id NOT IN (SELECT player_id FROM people WHERE is_active)""", "form_lines", "people"))
def reference_violations(spark, sf):
    known = L.active_people(spark, sf)
    return validation.orphans(L.form_lines(spark, sf), "player_id", known, "player_id").select("id", "player_id")


_RANK_SQL = {
    "youngest": ("birthdate IS NOT NULL", "birthdate DESC", "CAST(birthdate AS VARCHAR)", "position || ' | ' || country"),
    "oldest": ("birthdate IS NOT NULL", "birthdate", "CAST(birthdate AS VARCHAR)", "position || ' | ' || country"),
    "heaviest": ("weight > 0", "weight DESC", "CAST(weight AS VARCHAR)", "coalesce(height, 'N/A') || ' | ' || position"),
    "lightest": ("weight > 0", "weight", "CAST(weight AS VARCHAR)", "coalesce(height, 'N/A') || ' | ' || position"),
    "tallest": ("height IS NOT NULL", "coalesce(inches, 0) DESC", "height", "position || ' | ' || country"),
    "shortest": ("height IS NOT NULL", "coalesce(inches, 999)", "height", "position || ' | ' || country"),
    "most_experienced": ("season_exp IS NOT NULL", "season_exp DESC", "CAST(season_exp AS VARCHAR)", "'Desde ' || from_year || ' | ' || position"),
    "highest_draft_pick": ("draft_number > 0", "draft_number, draft_year DESC", "CAST(draft_number AS VARCHAR)", "'Draft ' || draft_year || ' Ronda ' || draft_round"),
    "lowest_draft_pick": ("draft_number > 0", "draft_number DESC, draft_year DESC", "CAST(draft_number AS VARCHAR)", "'Draft ' || draft_year || ' Ronda ' || draft_round"),
}
_INCHES = """SELECT *, TRY_CAST(trim(split_part(height, '-', 1)) AS INTEGER) * 12 + TRY_CAST(trim(split_part(height, '-', 2)) AS INTEGER) AS inches FROM players"""


@query("rank_biographic", sql(" UNION ALL ".join(
    f"(SELECT '{n}' AS criterion, id, full_name, {v} AS value, {d} AS detail FROM measured WHERE is_active AND {w} ORDER BY {o}, id LIMIT 25)"
    for n, (w, o, v, d) in _RANK_SQL.items()), "players", extra={"measured": _INCHES}))
def rank_biographic(spark, sf):
    return rankings.biographic_rankings(L.players(spark, sf), limit=25).drop("place")


@query("seasons_listed", sql("""
    SELECT DISTINCT season, substring(season, 1, 4) || '-08-01' AS first_day,
           CAST(CAST(substring(season, 1, 4) AS INTEGER) + 1 AS VARCHAR) || '-07-31' AS last_day FROM games""", "games"))
def seasons_listed(spark, sf):
    return rollups.seasons_listed(L.games(spark, sf)).select("season", season_bounds(F.col("season")).alias("b")).select("season", "b.*")


@query("team_seasons", sql("""
    SELECT DISTINCT team_id, season FROM (
        SELECT team_id, season FROM box_lines UNION ALL
        SELECT home_team_id, season FROM games WHERE home_team_id NOT IN (SELECT team_id FROM box_lines) UNION ALL
        SELECT away_team_id, season FROM games WHERE away_team_id NOT IN (SELECT team_id FROM box_lines))""", "box_lines", "games"))
def team_seasons(spark, sf):
    lines = rollups.season_rollup(L.box_lines(spark, sf))
    return rollups.team_seasons(lines, L.games(spark, sf))
