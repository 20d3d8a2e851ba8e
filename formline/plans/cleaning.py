"""Cleaning of landed text: numbers, clocks, dates, ids, box scores, summaries, dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.functions import casts, people
from formline.functions import seasons as S
from formline.plans import league as L
from formline.plans.league import sql
from formline.plans.registry import query
from formline.sources import landing

_PARTS = """SELECT l_orderkey AS game_id, l_partkey AS player_id, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d,
                   CAST(round(l_tax * 100) AS BIGINT) AS t, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem"""


def parts(spark, sf):
    return L.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey game_id", "l_partkey player_id", "l_linenumber n", "cast(l_quantity as bigint) q",
        "cast(round(l_discount * 100) as bigint) d", "cast(round(l_tax * 100) as bigint) t",
        "cast(round(l_extendedprice * 100) as bigint) c")


# The same text in both engines: string building only.
_CLOCK = """CASE n WHEN 1 THEN concat(q, ':', lpad(CAST(d * 5 AS {s}), 2, '0')) WHEN 2 THEN concat('1:', lpad(CAST(q AS {s}), 2, '0'), ':', lpad(CAST(d AS {s}), 2, '0'))
    WHEN 3 THEN concat(q, '.', d) WHEN 4 THEN 'N/A' WHEN 5 THEN '' WHEN 6 THEN concat(' ', q, ':', d, ' ') END"""


@query("clean_minutes", sql(f"""
    SELECT game_id, player_id, txt, CAST(CASE
        WHEN n = 1 THEN q * 60 + d * 5 WHEN n = 2 THEN 3600 + q * 60 + d WHEN n = 3 THEN trunc(CAST(txt AS DOUBLE) * 60) WHEN n = 6 THEN q * 60 + d
        ELSE 0 END AS BIGINT) AS seconds,
        CASE WHEN n = 3 THEN trunc(CAST(txt AS DOUBLE) * 60)::BIGINT // 60 || ':' || lpad(CAST(trunc(CAST(txt AS DOUBLE) * 60)::BIGINT % 60 AS VARCHAR), 2, '0') END AS shown
    FROM (SELECT *, {_CLOCK.format(s='VARCHAR')} AS txt FROM p)""", extra={"p": _PARTS}))
def clean_minutes(spark, sf):
    rows = parts(spark, sf).withColumn("txt", F.expr(_CLOCK.format(s="string")))
    seconds = casts.clock_to_seconds(F.col("txt"))
    return rows.select("game_id", "player_id", "txt", seconds.alias("seconds"), F.when(F.col("n") == 3, casts.seconds_to_clock(seconds)).alias("shown"))


_NUMBER = """CASE n WHEN 1 THEN CAST(q AS {s}) WHEN 2 THEN concat(q, '.', d) WHEN 3 THEN concat('-', q, '.', d) WHEN 4 THEN concat(t, 'e', d % 3)
    WHEN 5 THEN CASE WHEN q % 2 = 0 THEN 'MUCHOS' ELSE 'NaN' END WHEN 6 THEN concat(' ', q, ' ') ELSE concat(q, 'd') END"""


@query("clean_numbers", sql(f"""
    SELECT game_id, player_id, txt, CAST(coalesce(trunc(num), 0) AS BIGINT) AS as_int, coalesce(num, 0) AS as_double,
           CASE WHEN trunc(num) > 0 THEN CAST(trunc(num) AS BIGINT) END AS positive,
           CASE WHEN lower(trim(txt)) NOT IN ('none', 'nan', 'null', '') THEN trim(txt) END AS as_text
    FROM (SELECT *, CASE WHEN n = 1 OR n = 6 THEN CAST(q AS DOUBLE) WHEN n IN (2, 3, 4) THEN CAST(txt AS DOUBLE) END AS num
          FROM (SELECT *, {_NUMBER.format(s='VARCHAR')} AS txt FROM p))""", extra={"p": _PARTS}))
def clean_numbers(spark, sf):
    text = F.col("txt")
    return parts(spark, sf).withColumn("txt", F.expr(_NUMBER.format(s="string"))).select(
        "game_id", "player_id", "txt", casts.safe_int(text).alias("as_int"), casts.safe_double(text).alias("as_double"),
        casts.positive_int_or_null(text).alias("positive"), casts.clean_text(text).alias("as_text"))


_SEASON_TEXT = "CASE id % 4 WHEN 0 THEN CAST(y AS {s}) WHEN 1 THEN concat(y, lpad(CAST((y + 1) % 100 AS {s}), 2, '0')) WHEN 2 THEN concat(y, ' - ', lpad(CAST((y + 1) % 100 AS {s}), 2, '0')) ELSE season END"


@query("clean_seasons", sql(f"""
    SELECT id, txt, season AS normal, CAST(y - 1 AS VARCHAR) || '-' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS previous, y - 1983 + 1 AS n_seasons
    FROM (SELECT *, {_SEASON_TEXT.format(s='VARCHAR')} AS txt FROM (SELECT id, season, date, CAST(substring(season, 1, 4) AS BIGINT) AS y FROM games))""", "games"))
def clean_seasons(spark, sf):
    rows = L.games(spark, sf).selectExpr("id", "season", "date", "cast(substring(season, 1, 4) as bigint) y").withColumn("txt", F.expr(_SEASON_TEXT.format(s="string")))
    normal = S.normalise_season(F.col("txt"))
    return rows.select("id", "txt", normal.alias("normal"), S.previous_season(normal).alias("previous"), F.size(S.seasons_until(F.col("date"))).alias("n_seasons"))


@query("parse_ids", sql("""
    SELECT id, txt, CASE substring(txt, 1, 3) WHEN '002' THEN 'RS' WHEN '004' THEN 'PO' WHEN '005' THEN 'PI' WHEN '006' THEN 'IST' ELSE 'unknown' END AS game_type,
           CASE WHEN id % 3 = 1 AND id % 10 <> 0 THEN CAST(date AS VARCHAR) END AS written_date,
           CASE WHEN id % 3 = 0 THEN season WHEN id % 3 = 1 THEN 'field' ELSE season END AS deduced,
           CASE WHEN id % 3 = 0 THEN code LIKE '006%' OR (code LIKE '002%' AND substring(code, 6, 5) IN ('01201', '01202', '01203', '01204', '01229', '01230'))
                WHEN id % 3 = 1 THEN code LIKE '006%' ELSE FALSE END AS cup
    FROM (SELECT *, CASE id % 3 WHEN 0 THEN code WHEN 1 THEN concat(substring(code, 1, 3), strftime(date, '%Y'), CASE WHEN id % 10 = 0 THEN '1331' ELSE strftime(date, '%m%d') END, '001')
                    ELSE 'x' END AS txt FROM games)""", "games"))
def parse_ids(spark, sf):
    rows = L.games(spark, sf).withColumn("txt", F.expr(
        "case id % 3 when 0 then code when 1 then concat(substring(code, 1, 3), date_format(date, 'yyyy'), if(id % 10 = 0, '1331', date_format(date, 'MMdd')), '001') else 'x' end"))
    text = F.col("txt")
    field = F.when(F.col("id") % 3 == 1, F.lit("field")).otherwise(F.lit(""))
    return rows.select(
        "id", "txt", S.game_type(text).alias("game_type"), S.game_code_date(text).alias("written_date"),
        S.deduce_season(text, field, F.lit(None).cast("string"), F.col("date")).alias("deduced"), S.is_cup_code(text, F.col("season")).alias("cup"))


@query("parse_dates", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 < 5 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""")
def parse_dates(spark, sf):
    text = F.expr("""case o_orderkey % 6 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, "yyyy-MM-dd'T'23:30:00'Z'")
        when 2 then date_format(o_orderdate, 'MM/dd/yyyy') when 3 then upper(date_format(o_orderdate, 'MMM dd, yyyy'))
        when 4 then date_format(o_orderdate, 'yyyyMMdd') else 'not-a-date' end""")
    return L.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), casts.parse_day(text).alias("day"))


@query("body_measures", sql("""
    SELECT id, CAST(coalesce(TRY_CAST(trim(split_part(height, '-', 1)) AS INTEGER) * 12 + TRY_CAST(trim(split_part(height, '-', 2)) AS INTEGER), 999) AS BIGINT) AS inches,
           CAST(round_even((TRY_CAST(trim(split_part(height, '-', 1)) AS INTEGER) * 12 + TRY_CAST(trim(split_part(height, '-', 2)) AS INTEGER)) * 2.54::DOUBLE, 0) AS BIGINT) AS cm,
           CAST(round_even(weight * 0.453592::DOUBLE, 0) AS BIGINT) AS kg, draft_number IS NOT NULL AND draft_number <= 14 AS lottery,
           country IN ('Spain', 'France', 'Serbia', 'Czechia') AS european FROM players""", "players"))
def body_measures(spark, sf):
    return L.players(spark, sf).select(
        "id", people.height_inches(F.col("height"), 999).alias("inches"), people.height_cm(F.col("height")).alias("cm"),
        people.pounds_to_kg(F.col("weight")).alias("kg"), people.is_lottery_pick(F.col("draft_number")).alias("lottery"),
        people.is_european(F.col("country")).alias("european"))


def delivered_box_scores(spark, sf):
    """Line items as a delivered box score in the old naming, with unusable ids, texts and shots."""
    return parts(spark, sf).selectExpr(
        "game_id", "if(t = 8, 'abc', cast(player_id as string)) PLAYER_ID", "cast(q % 25 as string) TEAM_ID",
        "case when d = 3 then null when d = 4 then ' ' else concat('Player ', player_id) end PLAYER_NAME",
        "case n when 1 then concat(q, ':', lpad(cast(d * 5 as string), 2, '0')) when 4 then 'N/A' when 3 then concat(q, '.', d) else '0:00' end MIN",
        "if(c % 5 = 0, 'MUCHOS', cast(c % 3 * q as string)) PTS", "cast(c % 17 as string) REB", "cast(d as string) AST",
        "cast(q % 14 as string) FGM", "if(c % 19 = 0, 'Basura', cast(c % 15 as string)) FGA", "cast(d as string) FG3M", "cast(t as string) FG3A",
        "cast(q % 9 as string) FTM", "cast(c % 11 as string) FTA")


@query("box_score_clean", sql("""
    SELECT game_id, player_id, team_id, player_name, min_seconds, pts, reb, ast, stl, fgm, fga2 AS fga, least(fg3m, fgm) AS fg3m,
           least(greatest(fg3a, fg3m), fga2) AS fg3a, ftm, greatest(fta, ftm) AS fta, coalesce(fgm::DOUBLE / nullif(fga2, 0), 0) AS fg_pct
    FROM (SELECT game_id, player_id, q % 25 AS team_id, d, t, CASE WHEN d IN (3, 4) THEN CASE WHEN pf.name IS NOT NULL THEN pf.name ELSE 'Player ' || player_id END ELSE 'Player ' || player_id END AS player_name,
                 pf.name AS spare, CASE n WHEN 1 THEN q * 60 + d * 5 WHEN 3 THEN CAST(trunc(CAST(concat(q, '.', d) AS DOUBLE) * 60) AS BIGINT) ELSE 0 END AS min_seconds,
                 CASE WHEN c % 5 = 0 THEN 0 ELSE c % 3 * q END AS pts, c % 17 AS reb, d AS ast, CAST(0 AS BIGINT) AS stl, q % 14 AS fgm, d AS fg3m, t AS fg3a, q % 9 AS ftm, c % 11 AS fta,
                 greatest(CASE WHEN c % 19 = 0 THEN 0 ELSE c % 15 END, q % 14) AS fga2
          FROM p LEFT JOIN (SELECT id, full_name AS name FROM players WHERE is_active) pf ON p.player_id = pf.id
          WHERE t <> 8 AND player_id > 0 AND q % 25 > 0)
    WHERE NOT (d IN (3, 4) AND min_seconds = 0 AND spare IS NULL AND pts = 0)""", "players", extra={"p": _PARTS}))
def box_score_clean(spark, sf):
    spare = L.players(spark, sf).filter("is_active").select(F.col("id").alias("player_id"), F.col("full_name").alias("name"))
    clean = landing.box_score_lines(delivered_box_scores(spark, sf), L.teams(spark, sf), spare)
    return clean.select("game_id", "player_id", "team_id", "player_name", "min_seconds", "pts", "reb", "ast", "stl", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta", "fg_pct")


@query("season_games", sql("""
    SELECT code AS game_id, max(season) AS season, CAST(min(date) AS VARCHAR) AS game_date, bool_or(rs) AS is_rs, bool_or(po) AS is_po, bool_or(pi) AS is_pi,
           code LIKE '002%' AND substring(code, 6, 5) IN ('01201', '01202', '01203', '01204', '01229', '01230') AS is_ist,
           coalesce(min(wl) IN ('W', 'L', ' w '), FALSE) AS is_finished
    FROM (SELECT *, CASE WHEN status <> 3 THEN CASE WHEN id % 2 = 0 THEN NULL ELSE '~' END WHEN home_score > away_score THEN 'W' ELSE 'L' END AS wl FROM games WHERE rs OR po OR pi
          UNION ALL SELECT *, CASE WHEN status <> 3 THEN CASE WHEN id % 2 = 0 THEN NULL ELSE '~' END WHEN home_score > away_score THEN 'L' ELSE ' w ' END FROM games WHERE rs OR po OR pi)
    GROUP BY code""", "games"))
def season_games(spark, sf):
    games = L.games(spark, sf)
    sides = games.select("code", "season", "date", "rs", "po", "pi", F.explode(F.expr("""array(
        case when status <> 3 then if(id % 2 = 0, null, '~') when home_score > away_score then 'W' else 'L' end,
        case when status <> 3 then if(id % 2 = 0, null, '~') when home_score > away_score then 'L' else ' w ' end)""")).alias("WL"))
    listed = sides.select(F.col("code").alias("GAME_ID"), F.col("date").cast("string").alias("GAME_DATE"), "WL", "season", "rs", "po", "pi")
    lists = {f"is_{flag}": listed.filter(flag).drop("rs", "po", "pi") for flag in ("rs", "po", "pi")}
    return landing.season_games(lists)


@query("game_summaries", sql("""
    SELECT id, CAST(CASE WHEN id % 3 = 0 THEN date + 1 ELSE date END AS VARCHAR) AS date, 3 AS status, home_team_id, away_team_id,
           coalesce(home_score, 0) AS home_score, away_score,
           CASE WHEN coalesce(home_score, 0) > away_score THEN home_team_id ELSE away_team_id END AS winner_team_id,
           CASE WHEN id % 4 = 0 THEN FALSE WHEN id % 4 = 1 THEN TRUE ELSE ist END AS ist, po,
           coalesce(CAST(home_score AS VARCHAR), '') || ',7' AS home_periods, away_score || ',9' AS away_periods
    FROM games WHERE status = 3""".replace("3 AS status", "CAST(3 AS BIGINT) AS status"), "games"))
def game_summaries(spark, sf):
    """Games written as delivered summaries (two envelopes, two period spellings), then cleaned."""
    games = L.games(spark, sf)
    side = """concat('{{"score":', coalesce(cast({s} as string), 'null'), ',"periods":[{{"{k}":', coalesce(cast({s} as string), 'null'), '}},{{"{k}":{n}}}]}}')"""
    payload = F.expr(f"""concat('{{"', if(id % 2 = 0, 'game', 'boxScoreSummary'), '":{{"gameStatus":', status, ',"gameEt":"', if(id % 3 = 0, '', concat(date, 'T19:00:00Z')),
        '","gameTimeUTC":"', date_add(date, 1), 'T00:00:00Z","gameSubtype":"', case id % 4 when 0 then 'other' when 1 then 'in-season-group' else '' end,
        '","homeTeamId":', home_team_id, ',"awayTeamId":', away_team_id, ',"homeTeam":', {side.format(s='home_score', k='score', n=7)},
        ',"awayTeam":', {side.format(s='away_score', k='points', n=9)}, '}}}}')""")
    raw = games.select(F.col("id").alias("game_id"), payload.alias("payload"))
    flags = games.select(F.col("id").alias("game_id"), *[F.col(c).alias(f"is_{c}") for c in ("rs", "po", "pi", "ist")])
    clean = landing.games_from_summaries(raw.withColumn("game_id", F.col("game_id").cast("string")), flags.withColumn("game_id", F.col("game_id").cast("string")))
    text = F.transform("quarter_scores.home", lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return clean.select(
        F.col("id").cast("bigint").alias("id"), "date", "status", "home_team_id", "away_team_id", "home_score", "away_score", "winner_team_id", "ist", "po",
        text.alias("home_periods"), F.col("quarter_scores.away").alias("away_periods"))


@query("team_dimension", sql("""
    SELECT id, full_name || ' FC' AS full_name, CASE WHEN id % 5 = 2 THEN abbreviation || 'X_' || id ELSE abbreviation || 'X' END AS abbreviation,
           CASE WHEN id < 20 THEN 'North' WHEN id % 5 = 0 THEN conference END AS conference
    FROM teams WHERE id % 5 <> 1 UNION ALL
    SELECT id, full_name, 'N' || lpad(CAST(id + 1 AS VARCHAR), 2, '0') || 'X', CASE WHEN id < 20 THEN 'North' ELSE conference END FROM teams WHERE id % 5 = 1""", "teams"))
def team_dimension(spark, sf):
    """Teams 1, 6, 11.. are already stored under the abbreviation that team id + 1 is delivered with."""
    teams = L.teams(spark, sf)
    stored = teams.filter("id % 5 < 2").selectExpr(
        "id", "full_name", "if(id % 5 = 1, concat('N', lpad(cast(id + 1 as string), 2, '0'), 'X'), abbreviation) abbreviation", "conference", "division")
    landed = teams.filter("id % 5 <> 1").selectExpr("id", "concat(full_name, ' FC') full_name", "concat(abbreviation, 'X') abbreviation")
    news = teams.filter("id < 20").selectExpr("id", "'North' conference", "division")
    return landing.team_dimension(landed, stored, news).select("id", "full_name", "abbreviation", "conference")


@query("player_dimension", sql("""
    SELECT id, CASE WHEN id % 4 = 3 THEN full_name WHEN id % 4 = 0 THEN full_name WHEN id % 4 = 1 THEN 'A. ' || full_name ELSE 'Old ' || full_name END AS full_name,
           CASE WHEN id % 4 = 1 THEN is_active ELSE NOT is_active END AS is_active FROM players""", "players"))
def player_dimension(spark, sf):
    """id % 4: 0 stored abbreviated and delivered, 1 stored only, 2 stored with another name and delivered, 3 new."""
    people_df = L.players(spark, sf)
    stored = people_df.filter("id % 4 <> 3").selectExpr(
        "id", "case when id % 4 < 2 then concat('A. ', full_name) else concat('Old ', full_name) end full_name", "is_active")
    landed = people_df.filter("id % 4 <> 1").selectExpr("id", "full_name", "not is_active is_active")
    return landing.player_dimension(landed, stored)


@query("biographies", sql("""
    SELECT id, CASE WHEN id % 5 = 0 THEN 'Stored ' || id ELSE full_name END AS full_name, CAST(birthdate AS VARCHAR) AS birthdate, height,
           CAST(weight AS BIGINT) AS weight, CASE WHEN id % 3 = 0 THEN NULL ELSE position END AS position, CAST(draft_number AS BIGINT) AS draft_number
    FROM (SELECT * REPLACE (CASE WHEN height = 'nan' THEN NULL ELSE height END AS height) FROM players)""", "players"))
def biographies(spark, sf):
    people_df = L.players(spark, sf)
    stored = people_df.selectExpr("id", "concat('Stored ', id) full_name", "'' position")
    raw = people_df.selectExpr(
        "id PERSON_ID", "if(id % 5 = 0, ' ', full_name) DISPLAY_FIRST_LAST", "concat(cast(birthdate as string), 'T00:00:00') BIRTHDATE", "height HEIGHT",
        "coalesce(concat(weight, '.9'), 'None') WEIGHT", "'' SCHOOL", "country COUNTRY", "'0' JERSEY",
        "if(id % 3 = 0, 'None', concat(' ', position)) POSITION", "draft_year DRAFT_YEAR", "draft_round DRAFT_ROUND",
        "if(draft_number is null, 'Undrafted', cast(draft_number as string)) DRAFT_NUMBER", "from_year FROM_YEAR", "to_year TO_YEAR", "season_exp SEASON_EXP")
    return landing.with_biographies(stored, raw).select("id", "full_name", "birthdate", "height", "weight", "position", "draft_number")
