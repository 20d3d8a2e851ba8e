"""Companions, rosters and categories."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions.awards import INDIVIDUAL_AWARDS
from formline.operators import categories, relations
from formline.operators.rollups import SEASON_TYPES
from formline.plans import league as L
from formline.plans.league import sql
from formline.plans.listings import season_rows
from formline.plans.registry import query
from formline.session import write_and_reload
from formline.sources.landing import classified_awards

STAR = 23


def stored_seasons(spark, sf) -> DataFrame:
    """The season rows, which a deployment keeps stored, made once for all that is read from them."""
    return write_and_reload(season_rows(spark, sf), "season-rows")


def busiest(rows: DataFrame, n: int = 3) -> DataFrame:
    """The players with the most season rows: the pages these companion lists are made for."""
    return rows.groupBy("player_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "player_id").limit(n)


_FOCUS = "SELECT player_id FROM season_rows GROUP BY player_id ORDER BY count(*) DESC, player_id LIMIT 3"
_LATEST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, end_date DESC NULLS FIRST, team_id DESC, type DESC) AS rn
                   FROM season_rows) WHERE rn = 1"""


@query("latest_membership", sql("SELECT player_id, season, CAST(end_date AS VARCHAR) AS end_date, team_id, type FROM latest", "season_rows", extra={"latest": _LATEST}))
def latest_membership(spark, sf):
    return relations.latest_rows(season_rows(spark, sf))


@query("companions_current", sql("""
    SELECT DISTINCT l.player_id AS focus_id, r.player_id, p.full_name, p.position FROM latest l
    JOIN season_rows r ON r.team_id = l.team_id AND r.season = l.season AND r.type = l.type AND r.player_id <> l.player_id
    JOIN players p ON p.id = r.player_id WHERE l.player_id IN (SELECT player_id FROM focus)""",
    "season_rows", "players", extra={"latest": _LATEST, "focus": _FOCUS}))
def companions_current(spark, sf):
    rows = stored_seasons(spark, sf)
    return relations.current_companions(rows, L.players(spark, sf), busiest(rows))


@query("companions_history", sql("""
    SELECT f.player_id AS focus_id, r.player_id, p.full_name, p.position, string_agg(DISTINCT r.season, ',' ORDER BY r.season DESC) AS seasons_together,
           count(DISTINCT r.season) AS total_seasons, string_agg(DISTINCT t.abbreviation, ',' ORDER BY t.abbreviation) AS teams_together
    FROM (SELECT DISTINCT player_id, team_id, season FROM season_rows WHERE player_id IN (SELECT player_id FROM focus)) f
    JOIN season_rows r ON r.team_id = f.team_id AND r.season = f.season AND r.player_id <> f.player_id
    JOIN players p ON p.id = r.player_id JOIN teams t ON t.id = r.team_id GROUP BY ALL""",
    "season_rows", "players", "teams", extra={"focus": _FOCUS}))
def companions_history(spark, sf):
    rows = stored_seasons(spark, sf)
    found = relations.companion_history(rows, L.players(spark, sf), L.teams(spark, sf), busiest(rows))
    return found.withColumn("teams_together", F.col("teams_together.abbreviation"))


@query("roster_dedupe", sql("""
    SELECT team_id, season, r.player_id, full_name, position, type, games_played, pts::DOUBLE / games_played AS ppg, reb::DOUBLE / games_played AS rpg,
           ast::DOUBLE / games_played AS apg, min_seconds::DOUBLE / 60.0::DOUBLE / games_played AS mpg
    FROM (SELECT *, row_number() OVER (PARTITION BY team_id, season, player_id ORDER BY type = 'Regular Season' DESC, games_played DESC, type DESC) AS rn,
                 max(season) OVER (PARTITION BY team_id) AS newest FROM season_rows) r
    JOIN players p ON p.id = r.player_id WHERE rn = 1 AND season = newest""", "season_rows", "players"))
def roster_dedupe(spark, sf):
    return relations.roster(season_rows(spark, sf), L.players(spark, sf))


@query("career_path", sql("""
    SELECT player_id, season, team_id, type, games_played, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date
    FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season, team_id ORDER BY type = 'Regular Season' DESC, games_played DESC, type DESC) AS rn
          FROM season_rows) WHERE rn = 1""", "season_rows"))
def career_path(spark, sf):
    return relations.career_path(season_rows(spark, sf))


_INDIVIDUAL = ", ".join(f"'{a}'" for a in INDIVIDUAL_AWARDS)
_MEMBERS = f"""
    SELECT DISTINCT 'champion' AS category, player_id FROM awards WHERE award_type = 'Champion' UNION ALL
    SELECT DISTINCT 'all_star', player_id FROM awards WHERE award_type = 'All-Star' UNION ALL
    SELECT 'lottery', id FROM players WHERE draft_number <= 14 UNION ALL
    SELECT 'conferences', player_id FROM season_rows s JOIN teams t ON s.team_id = t.id GROUP BY player_id
    HAVING count(*) FILTER (WHERE conference = 'East') > 0 AND count(*) FILTER (WHERE conference = 'West') > 0 UNION ALL
    SELECT DISTINCT 'non_mvp', player_id FROM awards WHERE award_type IN ({_INDIVIDUAL}) UNION ALL
    SELECT DISTINCT 'spanish_mate', s.player_id FROM season_rows s WHERE EXISTS (
        SELECT 1 FROM season_rows o JOIN players p ON o.player_id = p.id
        WHERE p.country = 'Spain' AND o.team_id = s.team_id AND o.season = s.season AND o.player_id <> s.player_id) UNION ALL
    SELECT 'european', id FROM players WHERE country IN ('Spain', 'France', 'Serbia', 'Czechia') UNION ALL
    SELECT DISTINCT 'lebron_mate', s.player_id FROM season_rows s
    JOIN (SELECT DISTINCT team_id, season FROM season_rows WHERE player_id = {STAR}) o ON o.team_id = s.team_id AND o.season = s.season
    WHERE s.player_id <> {STAR}"""


def _category_sources(spark, sf) -> dict:
    """The tables that categories are made from. Bitmaps need no unique rows, so stays and awards are read as they come."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in SEASON_TYPES.values()]
    lines = L.box_lines(spark, sf).filter(reduce(or_, flags))
    return {"players": L.players(spark, sf), "teams": L.teams(spark, sf), "season_rows": lines, "awards": classified_awards(L.raw_awards(spark, sf)), "star_id": STAR}


@query("category_members", sql("SELECT category, player_id FROM m", "players", "teams", "season_rows", "awards", extra={"m": _MEMBERS}))
def category_members(spark, sf):
    return relations.category_members(**_category_sources(spark, sf))


@query("category_pairs", sql("""
    SELECT a.category AS first, b.category AS second, (SELECT count(*) FROM m x JOIN m y USING (player_id)
        WHERE x.category = a.category AND y.category = b.category) AS n_players
    FROM names a JOIN names b ON a.category < b.category""",
    "players", "teams", "season_rows", "awards",
    extra={"m": _MEMBERS, "names": "SELECT unnest([" + ", ".join(f"'{c}'" for c in relations.CATEGORIES) + "]) AS category"}))
def category_pairs(spark, sf):
    """Every cell of the grid of categories: how many players fit both."""
    return categories.pair_counts(relations.category_bitmaps(**_category_sources(spark, sf)), relations.CATEGORIES)


@query("category_hints", sql("""
    SELECT player_id, full_name, total_games FROM (
        SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY total_games DESC NULLS LAST, player_id) AS n FROM (
            SELECT p.id AS player_id, p.full_name, g.total_games FROM players p
            LEFT JOIN (SELECT player_id, CAST(sum(games_played) AS BIGINT) AS total_games FROM season_rows GROUP BY player_id) g ON p.id = g.player_id
            WHERE (lower(p.full_name) LIKE 'r%' OR lower(p.full_name) LIKE '% r%') AND p.id IN (SELECT player_id FROM awards WHERE award_type = 'Champion')
            )) WHERE n = 1 ORDER BY total_games DESC NULLS LAST, player_id LIMIT 10""",
    "players", "season_rows", "awards"))
def category_hints(spark, sf):
    champions = relations.award_winners(L.awards(spark, sf), "Champion")
    return relations.hints(L.players(spark, sf), season_rows(spark, sf), champions, "r")
