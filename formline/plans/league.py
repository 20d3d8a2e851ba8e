"""The given tables seen as a league.

| domain table  | given tables        | notes                                                   |
|---------------|---------------------|---------------------------------------------------------|
| teams         | nation, region      | conference by region number                             |
| players       | part                | biography from size, brand and key                      |
| games         | orders, customer    | sides, scores, flags and code from the order            |
| box lines     | lineitem, games     | one stat line per line item, team by odd/even line      |
| form lines    | events              | time series per user for the detectors                  |
| raw awards    | lineitem            | award texts by line, tax and quantity                   |

Every statistic is integer arithmetic on the stored columns, so both engines
agree on it to the last bit. No view leaves rows of its tables out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions.awards import award_class, award_name, is_skipped

AWARD_TEXTS = [
    "NBA Finals Most Valuable Player", "NBA All-Star Most Valuable Player", "NBA Most Valuable Player",
    "NBA Champion", "All-Defensive Team", "All-Rookie Team", "All-NBA", "Olympic Gold Medal",
    "Olympic Silver Medal", "Olympic Bronze Medal", "NBA Rookie of the Year", "NBA Defensive Player of the Year",
    "NBA Sixth Man of the Year", "NBA Most Improved Player", "NBA Coach of the Year", "NBA All-Star",
    "NBA Cup Most Valuable Player", "NBA Cup All-Tournament Team", "NBA Cup Champion", "NBA Player of the Month",
    "NBA Player of the Week", "NBA Rookie of the Month", "Sporting News MVP", "IBM Award", "Rising Stars MVP",
    "All-Star Weekend Winner", "Community Cup MVP", "Hustle Award", "nba champion trophy", "Finals MVP Trophy",
]
CUP_CODES = ["01201", "01202", "01203", "01204", "01229", "01230"]
COUNTRIES = {1: "Spain", 2: "France", 3: "Serbia", 4: "Turkey", 5: "Czechia", 6: "Canada"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).selectExpr(
        "cast(n_nationkey as bigint) id", "n_name full_name",
        "concat('N', lpad(cast(n_nationkey as string), 2, '0')) abbreviation",
        "if(n_regionkey % 2 = 0, 'East', 'West') conference", "r_name division",
    )


_COUNTRY_CASE = "CASE brand " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in COUNTRIES.items()) + " ELSE 'USA' END"


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .selectExpr("p_partkey id", "p_name full_name", "p_type position", "cast(p_size as int) sz",
                    "cast(substring(p_brand, 7) as int) brand")
        .selectExpr(
            "id", "full_name", "position", f"{_COUNTRY_CASE} country",
            "if(id % 17 = 0, null, date_add(date'1980-01-01', cast(id * 37 % 9000 as int))) birthdate",
            "case when sz = 7 then null when sz = 13 then 'N/A' when sz = 17 then 'nan' "
            "else concat(cast(5 + sz % 3 as string), if(sz = 19, ' - ', '-'), cast(id % 12 as string)) end height",
            "if(sz = 11, null, 150 + 2 * sz) weight",
            "id % 3 <> 0 is_active", "sz % 20 season_exp", "1995 + sz % 8 from_year",
            "if(sz % 10 = 0, null, cast(1995 + sz % 8 + id % 12 as int)) to_year",
            "1995 + sz % 8 draft_year", "1 + sz % 2 draft_round", "if(id % 7 = 0, null, sz) draft_number",
            "if(id % 5 = 0, null, date_add(date'2001-07-20', cast(-(id % 60) as int))) last_award_sync",
        )
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    codes = "array(" + ", ".join(f"'{c}'" for c in CUP_CODES) + ")"
    return (
        sides.selectExpr(
            "o_orderkey id", "to_date(o_orderdate) date", "cast(c_nationkey as bigint) home_team_id",
            "(c_nationkey + 1 + o_orderkey % 24) % 25 away_team_id",
            "cast(round(o_totalprice * 100) as bigint) cents",
            "case o_orderstatus when 'F' then 3 when 'O' then 1 else 2 end status",
            "o_orderpriority = '1-URGENT' po", "o_orderpriority in ('2-HIGH', '3-MEDIUM') rs",
            "o_orderpriority = '5-LOW' pi", "o_orderpriority in ('2-HIGH', '4-NOT SPECIFIED') ist",
            "year(o_orderdate) - if(month(o_orderdate) >= 10, 0, 1) yr",
        )
        .selectExpr(
            "*", "concat(cast(yr as string), '-', lpad(cast((yr + 1) % 100 as string), 2, '0')) season",
            "lpad(cast(yr % 100 as string), 2, '0') yy", "lpad(cast(id % 100000 as string), 5, '0') seq",
            "if(cents % 13 = 0, null, 80 + cents % 50) home_score",
            "if(cents % 13 = 1, 0, 80 + cents div 100 % 50) away_score",
        )
        .selectExpr(
            "id", "date", "season", "rs", "ist", "po", "pi", "status", "home_team_id", "away_team_id",
            "home_score", "away_score",
            "case when home_score > away_score then home_team_id when away_score > home_score then away_team_id end winner_team_id",
            "case when po then concat('004', yy, '00', cast(1 + id % 4 as string), cast(id div 4 % 8 as string), cast(1 + id div 32 % 7 as string)) "
            f"when rs and ist then concat('002', yy, if(id % 8 < 6, element_at({codes}, cast(id % 8 % 6 + 1 as int)), seq)) "
            "when rs then concat('002', yy, seq) when ist then concat('006', yy, seq) else concat('005', yy, seq) end code",
        )
    )


GAME_COLUMNS = ["date", "season", "rs", "ist", "po", "pi", "home_team_id", "away_team_id"]


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stat lines without their game: narrow enough for questions that need no date or side."""
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "l_orderkey game_id", "l_partkey player_id", "l_linenumber % 2 = 1 at_home",
            "cast(round(l_extendedprice * 100) as bigint) c", "cast(l_quantity as bigint) q",
            "cast(round(l_discount * 100) as bigint) d", "cast(round(l_tax * 100) as bigint) t",
        )
        .selectExpr(
            "game_id", "player_id", "at_home",
            "if(c % 10 = 0, 0, c % 48 * 60 + q) min_seconds",
            "q + d pts", "c % 23 reb", "c div 23 % 22 ast", "d % 7 stl", "t % 7 blk", "(q + d) % 8 tov", "q % 7 pf",
            "5 + c % 20 fga", "(5 + c % 20) * d div 10 fgm", "least(t, 5 + c % 20) fg3a",
            "least(t, 5 + c % 20) * d div 10 fg3m", "q % 12 fta", "q % 12 * t div 8 ftm",
            "if(d = 7, null, cast(q - 25 as double)) plus_minus",
        )
    )


def box_lines(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Stat lines with date, season, flags and sides of their game; ``parts`` tasks join them, if given."""
    lines, facts = line_stats(spark, sf_dir), games(spark, sf_dir).select(F.col("id").alias("game_id"), *GAME_COLUMNS)
    if parts:
        lines, facts = lines.repartition(parts, "game_id"), facts.repartition(parts, "game_id")
    return (
        lines.join(facts, "game_id")
        .withColumn("team_id", F.when(F.col("at_home"), F.col("home_team_id")).otherwise(F.col("away_team_id")))
        .drop("at_home")
    )


def with_shares(df: DataFrame) -> DataFrame:
    """Add the three shooting shares, 0 without attempts."""
    return df.selectExpr(
        "*", "if(fga > 0, cast(fgm as double) / fga, 0D) fg_pct", "if(fg3a > 0, cast(fg3m as double) / fg3a, 0D) fg3_pct",
        "if(fta > 0, cast(ftm as double) / fta, 0D) ft_pct",
    )


def form_lines_of(events: DataFrame) -> DataFrame:
    """Events as stat lines: 10 days of events are one season of 120 playing days."""
    lines = (
        events.selectExpr(
            "event_id id", "user_id player_id", "event_type",
            "datediff(to_date(ts), date'2024-01-01') * 86400L + hour(ts) * 3600 + minute(ts) * 60 + cast(floor(second(ts)) as int) secs",
            "cast(round(value * 100) as bigint) c", "cast(get_json_object(props, '$.k') as bigint) k",
        )
        .selectExpr(
            "id", "id game_id", "player_id",
            "date_add(make_date(cast(2021 + secs div 864000 as int), 10, 20), cast(secs % 864000 div 7200 as int)) game_date",
            "concat(cast(2021 + secs div 864000 as string), '-', lpad(cast((2022 + secs div 864000) % 100 as string), 2, '0')) season",
            "(player_id + secs div 864000) % 25 team_id",
            "event_type in ('view', 'click', 'purchase') rs", "event_type in ('purchase', 'signup') ist", "event_type = 'error' po",
            "k * 30 min_seconds", "c div 300 pts", "(k * 7 + c) % 13 ast", "(k + c) % 17 reb", "k % 4 stl", "c % 3 blk",
            "(k + c) % 6 tov", "k % 7 pf", "c % 21 fga", "c % 21 * (k % 11) div 10 fgm",
            "least(c % 21, c % 8) fg3a", "least(c % 21, c % 8) * (k % 11) div 10 fg3m",
            "c % 11 fta", "c % 11 * (k % 9) div 8 ftm", "cast(c % 41 - 20 as double) plus_minus",
        )
    )
    return with_shares(lines)


def form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_lines_of(table(spark, sf_dir, "events"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users behind the events."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey player_id", "c_name full_name", "c_acctbal >= 1000 is_active")


def active_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).filter("is_active").select("player_id")


def raw_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Award texts as delivered: (player_id, season, description, team_number)."""
    texts = F.array(*[F.lit(a) for a in AWARD_TEXTS])
    place = F.expr(f"cast((l_linenumber * 9 + cast(round(l_tax * 100) as bigint) * 5 + cast(l_quantity as bigint)) % {len(AWARD_TEXTS)} + 1 as int)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("player_id"),
        F.expr("year(l_shipdate) - if(month(l_shipdate) >= 10, 0, 1)").alias("yr"),
        F.element_at(texts, place).alias("description"), F.col("l_linenumber").cast("string").alias("team_number"),
    ).selectExpr(
        "player_id", "concat(cast(yr as string), '-', lpad(cast((yr + 1) % 100 as string), 2, '0')) season", "description", "team_number")


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned awards, one per (player, season, name)."""
    from formline.sources.landing import award_rows

    return award_rows(raw_awards(spark, sf_dir))


# ---- the same views as SQL ------------------------------------------------------------------

_TEXT_LIST = "[" + ", ".join(f"'{a}'" for a in AWARD_TEXTS) + "]"
_CODE_LIST = "[" + ", ".join(f"'{c}'" for c in CUP_CODES) + "]"

VIEWS: dict[str, tuple[list[str], str]] = {
    "teams": ([], """
        SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS full_name,
               'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS abbreviation,
               CASE WHEN n_regionkey % 2 = 0 THEN 'East' ELSE 'West' END AS conference, r_name AS division
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "players": ([], f"""
        SELECT id, full_name, position, {_COUNTRY_CASE} AS country,
               CASE WHEN id % 17 = 0 THEN NULL ELSE DATE '1980-01-01' + CAST(id * 37 % 9000 AS INTEGER) END AS birthdate,
               CASE WHEN sz = 7 THEN NULL WHEN sz = 13 THEN 'N/A' WHEN sz = 17 THEN 'nan'
                    ELSE CAST(5 + sz % 3 AS VARCHAR) || CASE WHEN sz = 19 THEN ' - ' ELSE '-' END || CAST(id % 12 AS VARCHAR) END AS height,
               CASE WHEN sz = 11 THEN NULL ELSE 150 + 2 * sz END AS weight,
               id % 3 <> 0 AS is_active, sz % 20 AS season_exp, 1995 + sz % 8 AS from_year,
               CASE WHEN sz % 10 = 0 THEN NULL ELSE CAST(1995 + sz % 8 + id % 12 AS INTEGER) END AS to_year,
               1995 + sz % 8 AS draft_year, 1 + sz % 2 AS draft_round,
               CASE WHEN id % 7 = 0 THEN NULL ELSE sz END AS draft_number,
               CASE WHEN id % 5 = 0 THEN NULL ELSE DATE '2001-07-20' - CAST(id % 60 AS INTEGER) END AS last_award_sync
        FROM (SELECT p_partkey AS id, p_name AS full_name, p_type AS position, CAST(p_size AS INTEGER) AS sz,
                     CAST(substring(p_brand, 7) AS INTEGER) AS brand FROM part)"""),
    "games": ([], f"""
        SELECT id, date, season, rs, ist, po, pi, status, home_team_id, away_team_id, home_score, away_score,
               CASE WHEN home_score > away_score THEN home_team_id WHEN away_score > home_score THEN away_team_id END AS winner_team_id,
               CASE WHEN po THEN '004' || yy || '00' || CAST(1 + id % 4 AS VARCHAR) || CAST(id // 4 % 8 AS VARCHAR) || CAST(1 + id // 32 % 7 AS VARCHAR)
                    WHEN rs AND ist THEN '002' || yy || CASE WHEN id % 8 < 6 THEN {_CODE_LIST}[CAST(id % 8 % 6 + 1 AS INTEGER)] ELSE seq END
                    WHEN rs THEN '002' || yy || seq WHEN ist THEN '006' || yy || seq ELSE '005' || yy || seq END AS code
        FROM (SELECT *, CAST(yr AS VARCHAR) || '-' || lpad(CAST((yr + 1) % 100 AS VARCHAR), 2, '0') AS season,
                     lpad(CAST(yr % 100 AS VARCHAR), 2, '0') AS yy, lpad(CAST(id % 100000 AS VARCHAR), 5, '0') AS seq,
                     CASE WHEN cents % 13 = 0 THEN NULL ELSE 80 + cents % 50 END AS home_score,
                     CASE WHEN cents % 13 = 1 THEN 0 ELSE 80 + cents // 100 % 50 END AS away_score
              FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(c_nationkey AS BIGINT) AS home_team_id,
                           (c_nationkey + 1 + o_orderkey % 24) % 25 AS away_team_id,
                           CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
                           CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 2 END AS status,
                           o_orderpriority = '1-URGENT' AS po, o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS rs,
                           o_orderpriority = '5-LOW' AS pi, o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') AS ist,
                           year(o_orderdate) - CASE WHEN month(o_orderdate) >= 10 THEN 0 ELSE 1 END AS yr
                    FROM orders JOIN customer ON o_custkey = c_custkey))"""),
    "line_stats": ([], """
        SELECT game_id, player_id, at_home, CASE WHEN c % 10 = 0 THEN 0 ELSE c % 48 * 60 + q END AS min_seconds,
               q + d AS pts, c % 23 AS reb, c // 23 % 22 AS ast, d % 7 AS stl, t % 7 AS blk, (q + d) % 8 AS tov, q % 7 AS pf,
               5 + c % 20 AS fga, (5 + c % 20) * d // 10 AS fgm, least(t, 5 + c % 20) AS fg3a,
               least(t, 5 + c % 20) * d // 10 AS fg3m, q % 12 AS fta, q % 12 * t // 8 AS ftm,
               CASE WHEN d = 7 THEN NULL ELSE CAST(q - 25 AS DOUBLE) END AS plus_minus
        FROM (SELECT l_orderkey AS game_id, l_partkey AS player_id, l_linenumber % 2 = 1 AS at_home,
                     CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q,
                     CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem)"""),
    "box_lines": (["games", "line_stats"], """
        SELECT s.*, g.date, g.season, g.rs, g.ist, g.po, g.pi, g.home_team_id, g.away_team_id,
               CASE WHEN at_home THEN g.home_team_id ELSE g.away_team_id END AS team_id
        FROM line_stats s JOIN games g ON s.game_id = g.id"""),
    "form_base": ([], """
        SELECT id, player_id, event_type, secs, c, k, CAST(2021 + secs // 864000 AS INTEGER) AS yr,
               c % 21 AS fga, least(c % 21, c % 8) AS fg3a, c % 11 AS fta
        FROM (SELECT event_id AS id, user_id AS player_id, event_type,
                     date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS secs,
                     CAST(round(value * 100) AS BIGINT) AS c,
                     CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)"""),
    "form_lines": (["form_base"], """
        SELECT *, CASE WHEN fga > 0 THEN CAST(fgm AS DOUBLE) / CAST(fga AS DOUBLE) ELSE 0 END AS fg_pct,
               CASE WHEN fg3a > 0 THEN CAST(fg3m AS DOUBLE) / CAST(fg3a AS DOUBLE) ELSE 0 END AS fg3_pct,
               CASE WHEN fta > 0 THEN CAST(ftm AS DOUBLE) / CAST(fta AS DOUBLE) ELSE 0 END AS ft_pct
        FROM (SELECT id, id AS game_id, player_id,
                     make_date(yr, 10, 20) + CAST(secs % 864000 // 7200 AS INTEGER) AS game_date,
                     CAST(yr AS VARCHAR) || '-' || lpad(CAST((yr + 1) % 100 AS VARCHAR), 2, '0') AS season,
                     (player_id + secs // 864000) % 25 AS team_id,
                     event_type IN ('view', 'click', 'purchase') AS rs, event_type IN ('purchase', 'signup') AS ist,
                     event_type = 'error' AS po, k * 30 AS min_seconds, c // 300 AS pts, (k * 7 + c) % 13 AS ast,
                     (k + c) % 17 AS reb, k % 4 AS stl, c % 3 AS blk, (k + c) % 6 AS tov, k % 7 AS pf,
                     fga, fga * (k % 11) // 10 AS fgm, fg3a, fg3a * (k % 11) // 10 AS fg3m, fta, fta * (k % 9) // 8 AS ftm,
                     CAST(c % 41 - 20 AS DOUBLE) AS plus_minus
              FROM form_base)"""),
    "people": ([], "SELECT c_custkey AS player_id, c_name AS full_name, c_acctbal >= 1000 AS is_active FROM customer"),
    "raw_awards": ([], f"""
        SELECT player_id, CAST(yr AS VARCHAR) || '-' || lpad(CAST((yr + 1) % 100 AS VARCHAR), 2, '0') AS season, description, team_number
        FROM (SELECT l_partkey AS player_id, year(l_shipdate) - CASE WHEN month(l_shipdate) >= 10 THEN 0 ELSE 1 END AS yr,
                     {_TEXT_LIST}[CAST((l_linenumber * 9 + CAST(round(l_tax * 100) AS BIGINT) * 5 + CAST(l_quantity AS BIGINT)) % {len(AWARD_TEXTS)} + 1 AS INTEGER)] AS description,
                     CAST(l_linenumber AS VARCHAR) AS team_number FROM lineitem)"""),
    "awards": (["raw_awards"], """
        SELECT DISTINCT player_id, season,
               CASE WHEN description LIKE '%All-Star%' AND (description LIKE '%Most Valuable Player%' OR description LIKE '%MVP%') THEN 'All-Star MVP'
                    WHEN description LIKE '%Finals%' AND (description LIKE '%Most Valuable Player%' OR description LIKE '%MVP%') THEN 'Finals MVP'
                    WHEN description LIKE '%NBA Cup%' AND (description LIKE '%Most Valuable Player%' OR description LIKE '%MVP%') THEN 'NBA Cup MVP'
                    WHEN (description LIKE '%Most Valuable Player%' OR description LIKE '%MVP%') AND description NOT LIKE '%Cup%' THEN 'MVP'
                    WHEN description ILIKE '%NBA Defensive Player of the Year%' THEN 'DPOY'
                    WHEN description ILIKE '%NBA Cup All-Tournament Team%' THEN 'NBA Cup Team'
                    WHEN description ILIKE '%NBA Sixth Man of the Year%' THEN '6MOY'
                    WHEN description ILIKE '%NBA Most Improved Player%' THEN 'MIP'
                    WHEN description ILIKE '%NBA Player of the Month%' THEN 'POM'
                    WHEN description ILIKE '%NBA Rookie of the Month%' THEN 'ROM'
                    WHEN description ILIKE '%NBA Rookie of the Year%' THEN 'ROY'
                    WHEN description ILIKE '%NBA Player of the Week%' THEN 'POW'
                    WHEN description ILIKE '%NBA Coach of the Year%' THEN 'COY'
                    WHEN description ILIKE '%Olympic Silver Medal%' THEN 'Olympic Silver'
                    WHEN description ILIKE '%Olympic Bronze Medal%' THEN 'Olympic Bronze'
                    WHEN description ILIKE '%Olympic Gold Medal%' THEN 'Olympic Gold'
                    WHEN description ILIKE '%All-Defensive Team%' THEN 'All-Defensive'
                    WHEN description ILIKE '%NBA Cup Champion%' THEN 'NBA Cup'
                    WHEN description ILIKE '%All-Rookie Team%' THEN 'All-Rookie'
                    WHEN description ILIKE '%NBA Champion%' THEN 'Champion'
                    WHEN description ILIKE '%NBA All-Star%' THEN 'All-Star'
                    WHEN description ILIKE '%All-NBA%' THEN 'All-NBA'
                    WHEN description ILIKE '%all-star%' THEN 'All-Star'
                    ELSE 'Other' END AS award_type,
               description || CASE team_number WHEN '1' THEN ' 1st Team' WHEN '2' THEN ' 2nd Team' WHEN '3' THEN ' 3rd Team' ELSE '' END AS award_name
        FROM raw_awards
        WHERE NOT (description LIKE '%Sporting News%' OR description LIKE '%IBM Award%' OR description LIKE '%Olympic Appearance%'
                   OR description LIKE '%NBA Sportsmanship%' OR description LIKE '%J. Walter Kennedy Citizenship%'
                   OR description LIKE '%NBA Comeback Player of the Year%')"""),
    "season_rows": (["box_lines"], """
        SELECT player_id, team_id, season, type, min(date) AS start_date, max(date) AS end_date, count(*) AS games_played,
               CAST(sum(pts) AS BIGINT) AS pts, CAST(sum(reb) AS BIGINT) AS reb, CAST(sum(ast) AS BIGINT) AS ast,
               CAST(sum(stl) AS BIGINT) AS stl, CAST(sum(blk) AS BIGINT) AS blk, CAST(sum(tov) AS BIGINT) AS tov,
               CAST(sum(pf) AS BIGINT) AS pf, CAST(sum(fgm) AS BIGINT) AS fgm, CAST(sum(fga) AS BIGINT) AS fga,
               CAST(sum(fg3m) AS BIGINT) AS fg3m, CAST(sum(fg3a) AS BIGINT) AS fg3a, CAST(sum(ftm) AS BIGINT) AS ftm,
               CAST(sum(fta) AS BIGINT) AS fta, coalesce(sum(plus_minus), 0) AS plus_minus, CAST(sum(min_seconds) AS BIGINT) AS min_seconds
        FROM (SELECT *, 'Regular Season' AS type FROM box_lines WHERE rs UNION ALL
              SELECT *, 'Playoffs' AS type FROM box_lines WHERE po UNION ALL
              SELECT *, 'Play-In' AS type FROM box_lines WHERE pi UNION ALL
              SELECT *, 'NBA Cup' AS type FROM box_lines WHERE ist)
        GROUP BY player_id, team_id, season, type"""),
}


def sql(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named views, and those they need, defined in front of it."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    ctes = [f"{name} AS ({VIEWS[name][1]})" for name in ordered] + [f"{n} AS ({s})" for n, s in (extra or {}).items()]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body
