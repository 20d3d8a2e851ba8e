from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows

from pyspark.sql import functions as F

from formline.operators import (
    boxscore, careers, champions, filters, gaps, leaders, paging, rankings, relations, rollups, search, series, standings, validation,
)
from formline.schemas import PARENTS, PURGE_ORDER, TABLES, UNIQUE_KEYS
from formline.sources import landing, sinks, tables

GAMES = (
    "id string, date date, season string, rs boolean, po boolean, pi boolean, ist boolean, status int, home_team_id bigint, "
    "away_team_id bigint, home_score int, away_score int, winner_team_id bigint"
)
TEAMS = "id bigint, full_name string, abbreviation string, conference string, division string"


def game(i, home, away, winner, day=date(2024, 4, 20), hs=100, as_=90, status=3, season="2023-24", **flags):
    f = dict(rs=False, po=False, pi=False, ist=False) | flags
    return (i, day, season, f["rs"], f["po"], f["pi"], f["ist"], status, home, away, hs, as_, winner)


@pytest.fixture(scope="module")
def teams(spark):
    return spark.createDataFrame([(1, "One", "ONE", "East", "A"), (2, "Two", "TWO", "East", "A"), (3, "Three", "THR", "West", "B"),
                                  (4, "Four", "FOU", "West", "B")], TEAMS)


# ---- brackets -------------------------------------------------------------------------------


def test_series_wins_and_dates(spark, teams):
    games = spark.createDataFrame([
        game("0042300101", 2, 1, 1, date(2024, 4, 20), po=True), game("0042300102", 1, 2, 1, date(2024, 4, 22), po=True),
        game("0042300103", 2, 1, 2, date(2024, 4, 23), po=True), game("0042300104", 1, 2, 1, date(2024, 4, 25), po=True),
        game("0042300111", 3, 4, None, po=True), game("0042300121", 3, None, 3, po=True), game("00423", 2, 4, 2, po=True),
        game("0042300131", 2, 3, 2, status=1, po=True)], GAMES)
    got = {(r["team1_id"], r["team2_id"]): r for r in series.playoff_bracket(games).collect()}
    assert set(got) == {(1, 2), (3, 4)}                        # short code, missing side and unfinished game drop out
    s = got[1, 2]
    assert (s["t1_wins"], s["t2_wins"], s["first_date"], s["last_date"]) == (3, 1, date(2024, 4, 20), date(2024, 4, 25))
    assert (s["round"], s["position"], s["round_name"], s["t1_score"]) == (1, 0, "Primera Ronda", 0)
    assert (got[3, 4]["t1_wins"], got[3, 4]["t2_wins"]) == (0, 0)
    nested = series.nested_rounds(series.playoff_bracket(games), teams).first()
    assert [(x["team1_abbr"], x["team2_abbr"]) for x in nested["series"]] == [("ONE", "TWO"), ("THR", "FOU")]
    assert series.playoff_bracket(games, finished_only=False).count() == 3


def test_cup_rounds_and_score(spark):
    games = spark.createDataFrame([
        game("0022401201", 1, 2, 1, rs=True, ist=True), game("0022401229", 1, 3, 3, hs=90, as_=99, rs=True, ist=True),
        game("0062400001", 4, 1, 4, hs=120, as_=110, ist=True), game("0022400033", 1, 4, 1, rs=True, ist=True),
        game("0022401230", 2, 4, None, rs=True, ist=True)], GAMES)
    got = {r["round"]: r for r in series.cup_bracket(games).filter("round <> 3 or team1_id = 1").collect()}
    assert (got[2]["position"], got[3]["position"], got[4]["position"]) == (0, 0, 0)
    assert (got[4]["team1_id"], got[4]["t1_score"], got[4]["t2_score"], got[4]["round_name"]) == (1, 110, 120, "Final (NBA Cup)")
    assert (got[3]["t1_score"], got[3]["t2_score"], got[3]["t2_wins"]) == (90, 99, 1)
    assert series.cup_bracket(games).count() == 4             # the group game is no knock-out, but (1, 4) is the final


def test_last_decided_game_gives_the_score(spark):
    games = spark.createDataFrame([
        game("0062400001", 1, 2, 1, date(2024, 1, 1), 100, 90, ist=True), game("0062400002", 2, 1, 1, date(2024, 1, 3), 80, 95, ist=True),
        game("0062400003", 1, 2, None, date(2024, 1, 5), 70, 70, ist=True)], GAMES)
    s = series.cup_bracket(games).first()
    assert (s["t1_score"], s["t2_score"], s["t1_wins"]) == (95, 80, 2)


# ---- standings ------------------------------------------------------------------------------


def test_records_and_ranks(spark, teams):
    games = spark.createDataFrame([
        game("1", 1, 2, 1, rs=True), game("2", 2, 1, 1, rs=True), game("3", 3, 1, 3, rs=True), game("4", 3, 4, 3, rs=True, status=1),
        game("5", 1, 2, None, rs=True), game("6", 1, 2, 2, po=True)], GAMES)
    got = {r["team_id"]: (r["wins"], r["losses"], r["pct"], r["conf_rank"]) for r in standings.team_records(games, teams).collect()}
    assert got == {1: (2, 1, 2 / 3, 1), 2: (0, 2, 0.0, 2), 3: (1, 0, 1.0, 1), 4: (0, 0, 0.0, 2)}
    table = {r["team_id"]: r["conf_rank"] for r in standings.season_standings(games, teams).collect()}
    assert table == {1: 1, 2: 2, 3: 1}
    scores = {r["team_id"]: (r["wins"], r["losses"]) for r in standings.score_standings(games, teams).collect()}
    assert scores == {1: (2, 2), 2: (1, 2), 3: (2, 0), 4: (0, 1)}


# ---- rollups --------------------------------------------------------------------------------

LINES = (
    "game_id string, player_id bigint, team_id bigint, date date, season string, rs boolean, po boolean, pi boolean, ist boolean, min_seconds bigint, "
    "pts int, reb int, ast int, stl int, blk int, tov int, pf int, fgm int, fga int, fg3m int, fg3a int, ftm int, fta int, plus_minus double"
)


def stat(g, p, team, pts, seconds=600, pm=0.0, rs=True, ist=False, day=date(2024, 1, 1)):
    return (g, p, team, day, "2023-24", rs, False, False, ist, seconds, pts, 1, 1, 0, 0, 0, 0, 1, 2, 0, 0, 0, 0, pm)


def test_two_flags_count_twice_and_bench_counts(spark):
    lines = spark.createDataFrame([stat("a", 1, 1, 10, ist=True), stat("b", 1, 1, 0, seconds=0, pm=None)], LINES)
    got = {r["type"]: (r["games_played"], r["pts"], r["plus_minus"], r["min_seconds"]) for r in rollups.season_rollup(lines).collect()}
    assert got == {"Regular Season": (2, 10, 0.0, 600), "NBA Cup": (1, 10, 0.0, 600)}


def test_side_totals_and_score_repair(spark):
    lines = spark.createDataFrame([
        stat("a", 1, 1, 60), stat("a", 2, 1, 50), stat("a", 3, 2, 100), stat("b", 1, 1, 10), stat("c", 1, 1, 7, pm=4.0), stat("c", 3, 2, 7, pm=-4.0)], LINES)
    sides = rollups.side_rollup(lines)
    assert [r["avg_plus_minus"] for r in sides.filter("game_id = 'c'").orderBy("team_id").collect()] == [4.0, -4.0]
    assert sides.filter("game_id = 'a' and avg_plus_minus is not null").count() == 0
    games = spark.createDataFrame([
        game("a", 1, 2, None, hs=None, as_=0), game("b", 1, 2, None, hs=0, as_=5), game("c", 1, 2, 9, hs=0, as_=0), game("d", 1, 2, 1)], GAMES)
    got = {r["id"]: (r["home_score"], r["away_score"], r["winner_team_id"], r["score_repaired"]) for r in rollups.repaired_scores(games, sides).collect()}
    assert got == {"a": (110, 100, 1, True), "b": (0, 5, None, False), "c": (7, 7, None, True), "d": (100, 90, 1, False)}


def test_season_average_sources(spark):
    lines = spark.createDataFrame([
        stat("a", 1, 1, 10), stat("b", 1, 1, 20, seconds=0), stat("a", 2, 1, 8), stat("b", 2, 1, 4, seconds=0), stat("a", 3, 1, 6, seconds=0)], LINES)
    stored = rollups.season_rollup(lines.filter("player_id = 1"))
    got = {r["player_id"]: (r["source"], r["games"], r["pts"]) for r in rollups.season_averages(lines, stored).collect()}
    assert got == {1: ("season row", 2, 15.0), 2: ("stat lines", 2, 12.0), 3: ("stat lines", 1, 6.0)}


def test_career_and_experience(spark):
    rows_ = rollups.season_rollup(spark.createDataFrame([stat("a", 1, 1, 10), stat("b", 1, 2, 20)], LINES))
    total = rollups.career_totals(rows_).first()
    assert (total["games"], total["pts"], total["fg_pct"], total["fg3_pct"]) == (2, 15.0, 0.5, 0.0)
    people = spark.createDataFrame([(1, 9), (2, 4), (3, None)], "id bigint, season_exp int")
    assert rows(rollups.experience(people, rows_)) == [(1, 1), (2, 4), (3, 0)]


def test_leaders_need_five_games(spark):
    lines = spark.createDataFrame([stat(str(i), 1, 1, 10) for i in range(5)] + [stat(str(i), 2, 1, 99) for i in range(4)], LINES)
    assert rows(leaders.top_average(lines, "pts")) == [(1, 10.0, 5)]
    assert leaders.top_players(lines, "fg_pct").count() == 0          # too few attempts
    assert rows(leaders.top_ratio(lines, "fgm", "fga", 10)) == [(1, 0.5, 5, 5, 10)]


# ---- relations ------------------------------------------------------------------------------

STAYS = "player_id bigint, team_id bigint, season string, type string, start_date date, end_date date, games_played bigint, pts int, reb int, ast int, min_seconds bigint"


def stay(p, team, season, kind="Regular Season", games=10, end=date(2024, 4, 1)):
    return (p, team, season, kind, None, end, games, 100, 50, 20, 6000)


@pytest.fixture(scope="module")
def stays(spark):
    return spark.createDataFrame([
        stay(1, 1, "2022-23"), stay(1, 2, "2023-24", end=date(2024, 1, 1)), stay(1, 3, "2023-24", "Playoffs", 30, None),
        stay(2, 1, "2022-23"), stay(2, 2, "2023-24"), stay(3, 3, "2023-24", "Playoffs"), stay(4, 4, "2020-21"),
        stay(2, 2, "2023-24", "NBA Cup", 50)], STAYS)


@pytest.fixture(scope="module")
def folk(spark):
    return spark.createDataFrame([(1, "Al Ray", "G", "Spain", 3), (2, "Bo Ray", "F", "France", 15), (3, "Cy Al", "C", "Spain", None), (4, "Di", "G", "USA", 14)],
                                 "id bigint, full_name string, position string, country string, draft_number int")


def test_companions(spark, stays, folk, teams):
    focus = spark.createDataFrame([(1,)], "player_id bigint")
    assert [r["player_id"] for r in relations.current_companions(stays, folk, focus).collect()] == [3]     # the open end is newest
    got = {r["player_id"]: (r["total_seasons"], r["seasons_together"]) for r in relations.companion_history(stays, folk, teams, focus).collect()}
    assert got == {2: (2, ["2023-24", "2022-23"]), 3: (1, ["2023-24"])}


def test_roster_prefers_regular_season(stays, folk):
    got = {(r["team_id"], r["player_id"]): (r["type"], r["games_played"], r["ppg"]) for r in relations.roster(stays, folk).collect()}
    assert got[2, 2] == ("Regular Season", 10, 10.0) and got[3, 1][0] == "Playoffs" and (1, 1) in got


def test_categories(spark, stays, folk, teams):
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(relations.companions_of_country(stays, folk)) == [1, 2, 3]     # 1 and 3 are each other's Spaniard
    assert ids(relations.companions_of_player(stays, 1)) == [2, 3]
    assert ids(relations.lottery_picks(folk)) == [1, 4]
    assert ids(relations.europeans(folk)) == [1, 2, 3]
    assert ids(relations.in_both_conferences(stays, teams)) == [1]
    members = spark.createDataFrame([(1,), (2,), (3,)], "player_id bigint")
    assert [r["player_id"] for r in relations.hints(folk, stays, members, "a").collect()] == [1, 3]


def test_lone_spaniard_is_not_his_own_companion(spark, folk):
    lone = spark.createDataFrame([stay(1, 1, "2022-23"), stay(1, 1, "2022-23", "Playoffs"), stay(4, 1, "2022-23")], STAYS)
    assert rows(relations.companions_of_country(lone, folk)) == [(4,)]


def test_guesses(spark, folk):
    guesses = spark.createDataFrame([(1, "ray", "b", "x"), (2, "Ra", "r", "x"), (3, "al ray", "r", "x"), (4, " AL ", "c", "x"), (5, "di", "d", "x")],
                                    "guess_id int, guess string, letter string, category string")
    members = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3)], "category string, player_id bigint")
    got = {r["guess_id"]: (r["valid"], r["player_id"], r["reason"]) for r in search.validated_guesses(guesses, folk, members).collect()}
    assert got == {1: (True, 2, None), 2: (False, None, "unknown player"), 3: (True, 1, None), 4: (True, 3, None), 5: (False, None, "requirements not met")}


def test_ladder(folk):
    tiers = lambda text: sorted((r["id"], r["tier"]) for r in search.search_ladder(folk, text).collect())
    assert tiers("ray al") == [(1, 1)] and tiers("Bob Ray") == [(2, 2)] and tiers("Al") == [(1, 1), (3, 1)] and tiers("zz") == []


# ---- filters, pages, gaps -------------------------------------------------------------------


def test_game_filters(spark):
    games = spark.createDataFrame([
        game("1", 1, 2, 1, date(2024, 1, 1), rs=True), game("2", 2, 3, 2, date(2024, 1, 9), rs=True, status=1), game("3", 3, 1, 3, date(2024, 1, 5), po=True)], GAMES)
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(filters.games(games, team_id=1)) == ["3", "1"] and ids(filters.games(games, competition="Playoffs")) == ["3"]
    assert ids(filters.games(games, finished_only=True, start="2024-01-02")) == ["3"] and ids(filters.games(games, competition="unknown")) == ["2", "3", "1"]
    assert ids(filters.games_page(games, on="2024-01-05", start="2023-01-01")) == ["3"]
    assert ids(filters.recent(games, "week")) == ["2", "3"] or set(ids(filters.recent(games, "week"))) == {"2", "3"}
    assert ids(filters.recent(games, "last_game")) == ["2"]
    totals = spark.createDataFrame([game("1", 1, 2, 1), game("2", 1, 2, 1, hs=None), game("3", 1, 2, 1, hs=130)], GAMES)
    assert ids(filters.games_by_total(totals)) == ["2", "3", "1"]     # an unknown total sorts first


def brute_gap(listed):
    kept, run = [], 0
    for r in sorted(listed, key=lambda r: (r[1], r[0]), reverse=True):
        if r[2] and not r[3]:
            kept.append(r[0])
            run = 0
        elif r[3]:
            run += 1
            if run >= 3:
                break
    return sorted(kept)


def test_gap_scan_against_the_walk(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        listed = [(f"{i:03d}", date(2024, 1, 1) + timedelta(days=i // 2), rnd.random() < 0.8, rnd.random() < 0.55) for i in range(60)]
        source = spark.createDataFrame([(i, d, "2023-24", f) for i, d, f, _ in listed], "id string, date date, season string, is_finished boolean")
        stored = spark.createDataFrame([game(i, 1, 2, 1, d, status=3 if there else 2) for i, d, _, there in listed], GAMES)
        got = sorted(r["id"] for r in gaps.gap_scan(source, stored, "2024-12-01").collect())
        assert got == brute_gap(listed)


def test_frontier(spark):
    games = spark.createDataFrame([game("1", 1, 2, 1, season="2021-22"), game("2", 1, 2, 1, season="2023-24", status=1)], GAMES)
    listed = spark.createDataFrame([("2020-21",), ("2022-23",), ("2023-24",)], "season string")
    assert rows(gaps.empty_seasons(listed, games)) == [("2022-23",), ("2023-24",)]
    assert gaps.empty_seasons(listed, games.filter("status = 3 and id = 'x'")).count() == 3


def test_pages(spark):
    df = spark.range(10)
    assert [r[0] for r in paging.page(df, [F.desc("id")], 2, 4).collect()] == [5, 4, 3, 2]
    assert tuple(paging.page_count(df, 4).first()) == (10, 3)
    parts = [df.filter("id > 7"), df.filter("id < 3")]
    assert [r["id"] for r in paging.page_of_parts(parts, [F.asc("id")], 1, 3).collect()] == [8, 9, 0]
    assert [r[0] for r in paging.newest_in_order(df.withColumn("t", F.col("id")), "t", "id", 3).collect()] == [7, 8, 9]


def test_unknown_ranking(folk):
    with pytest.raises(ValueError):
        rankings.biographic_ranking(folk, "fastest")


def test_champions(spark):
    games = spark.createDataFrame([
        game("0042300101", 1, 2, 1, date(2024, 6, 1), po=True), game("0042300102", 1, 2, 2, date(2024, 6, 9), po=True), game("0062300001", 1, 2, 1, ist=True)], GAMES)
    stays_ = spark.createDataFrame([stay(1, 1, "2023-24"), stay(2, 2, "2023-24"), stay(2, 2, "2023-24", "Playoffs"), stay(3, 2, "2023-24")], STAYS)
    awards = spark.createDataFrame([(3, "2023-24", "Champion", "NBA Champion", None)], TABLES["player_awards"])
    got = rows(champions.new_titles(games, stays_, awards).select("player_id", "award_type"))
    assert got == [(1, "NBA Cup"), (2, "Champion")]
    assert champions.with_titles(games, stays_, awards).count() == 3


def test_headers_use_fallback_names(spark, teams):
    games = spark.createDataFrame([game("1", 1, 77, 1)], GAMES)
    head = boxscore.game_headers(games, teams).first()
    assert (head["home_team"], head["away_team"], head["home_team_abbr"], head["away_team_abbr"]) == ("One", "Team 77", "ONE", "T2")


# ---- landing --------------------------------------------------------------------------------


def test_box_score_old_names_and_garbage(spark, teams):
    raw = spark.createDataFrame([
        ("g", "10", "1", "P Ten", "35:30", "25", "7", None, "Basura"), ("g", "11", "1", "P Eleven", "N/A", "MUCHOS", "x", "5", "3"),
        ("g", "0", "1", "Nobody", "1:00", "1", "1", "1", "1"), ("g", "12", "99", "Stranger", "1:00", "1", "1", "1", "1"),
        ("g", "13", "2", None, "0:00", "0", "0", "0", "0"), ("g", "14", "2", " ", "0:00", "3", "0", "1", "1"), ("g", "15", "2", None, "2:00", "0", "0", "0", "0")],
        "game_id string, PLAYER_ID string, TEAM_ID string, PLAYER_NAME string, MIN string, PTS string, REB string, FGM string, FGA string")
    spare = spark.createDataFrame([(15, "Spare Name")], "player_id bigint, name string")
    got = {r["player_id"]: (r["player_name"], r["min_seconds"], r["pts"], r["fgm"], r["fga"]) for r in landing.box_score_lines(raw, teams, spare).collect()}
    assert got == {10: ("P Ten", 2130, 25, 0, 0), 11: ("P Eleven", 0, 0, 5, 5), 14: ("Player 14", 0, 3, 1, 1), 15: ("Spare Name", 120, 0, 0, 0)}


def test_box_score_new_names(spark, teams):
    raw = spark.createDataFrame([("g", 10, 1, "A", "B", "PT", "12:00", 9)], "game_id string, personId long, teamId long, firstName string, familyName string, nameI string, minutes string, points long")
    row = landing.box_score_lines(raw, teams).first()
    assert (row["player_name"], row["min_seconds"], row["pts"], row["fg_pct"]) == ("A B", 720, 9, 0.0)


def summary(status=3, key="game", home=100, away=100, **kw):
    side = lambda s: {"score": s, "periods": [{"score": 50}, {"points": s - 50}]}
    return json.dumps({key: {"gameStatus": status, "gameEt": "2024-01-15T19:30:00Z", "gameTimeUTC": "2024-01-16T00:30:00Z", "homeTeamId": 1,
                             "awayTeamId": 2, "homeTeam": side(home), "awayTeam": side(away), **kw}})


def test_summaries(spark):
    raw = spark.createDataFrame([
        ("0022300001", summary()), ("0022300002", summary(status=2)), ("0022300003", summary(key="boxScoreSummary", home=120, gameSubtype="in-season")),
        ("0022300004", json.dumps({"other": 1})), ("0022300005", summary(gameSubtype="x"))], "game_id string, payload string")
    predicted = spark.createDataFrame([(f"002230000{i}", True, False, False, True) for i in range(1, 6)], "game_id string, is_rs boolean, is_po boolean, is_pi boolean, is_ist boolean")
    got = {r["id"]: r for r in landing.games_from_summaries(raw, predicted).collect()}
    assert set(got) == {"0022300001", "0022300003", "0022300005"}
    first = got["0022300001"]
    assert (first["date"], first["season"], first["winner_team_id"], first["ist"], first["rs"]) == (date(2024, 1, 15), "2023-24", 2, True, True)   # a tie goes to the away side
    assert first["quarter_scores"]["home"] == [50, 50]
    assert got["0022300003"]["winner_team_id"] == 1 and got["0022300003"]["ist"] and not got["0022300005"]["ist"]


def test_award_load(spark):
    raw = spark.createDataFrame([(1, "2023-24", "All-NBA", "1"), (1, "2023-24", "All-NBA", "1"), (1, "2023-24", "IBM Award", None), (2, "2023-24", "NBA Champion", "")],
                                "player_id bigint, season string, description string, team_number string")
    known = spark.createDataFrame([(2, "2023-24", "Champion", "NBA Champion", None)], TABLES["player_awards"])
    assert rows(landing.award_rows(raw, known).drop("description")) == [(1, "2023-24", "All-NBA", "All-NBA 1st Team")]


# ---- validation and sinks -------------------------------------------------------------------


def test_violations(spark):
    columns = [c for c in validation.LINE_COUNTS] + ["fg_pct", "fg3_pct", "ft_pct"]
    good = dict.fromkeys(columns, 0)
    df = spark.createDataFrame([good, good | {"fgm": 3, "fga": 1, "pts": -1}, good | {"pts": None}], ", ".join(f"{c} int" for c in columns))
    bad = validation.violations(df, validation.line_rules()).collect()
    assert [sorted(r["violations"]) for r in bad] == [["check_fgm_lte_fga", "check_pts"]]
    counts = {r["rule"]: r["rows"] for r in validation.violation_counts(df, validation.line_rules()).collect()}
    assert counts["check_pts"] == 1 and counts["check_reb"] == 0
    assert rows(validation.orphans(spark.createDataFrame([(1,), (5,), (None,)], "t bigint"), "t", spark.range(3), "id")) == [(5,)]


def test_schemas_and_tables(spark, tmp_path):
    root = str(tmp_path / "store")
    tables.create_tables(spark, root)
    assert all(tables.read_table(spark, root, n).count() == 0 for n in TABLES)
    assert set(PURGE_ORDER) | set(UNIQUE_KEYS) | set(PARENTS) <= set(TABLES)
    one = spark.createDataFrame([(1, "A", "A", None, None, None, None, "East", "X")], TABLES["teams"])
    one.write.mode("overwrite").parquet(f"{root}/teams")
    tables.register_views(spark, root, ["teams"])
    assert spark.sql("select count(*) from teams").first()[0] == 1
    sinks.purge(spark, root, ["teams", "players"])
    assert tables.read_table(spark, root, "teams").count() == 0
    sinks.purge_results(spark, root, "all")


def test_upsert_and_periods(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert rows(sinks.upsert(old, new, ["k"], newest=[F.desc("v")])) == [(1, "a"), (2, "d"), (3, "e")]
    path = str(tmp_path / "p")
    sinks.replace_periods(spark.createDataFrame([(1, "x"), (2, "y")], "v int, season string"), path)
    sinks.replace_periods(spark.createDataFrame([(9, "y")], "v int, season string"), path)
    assert rows(spark.read.parquet(path).select("v", "season")) == [(1, "x"), (9, "y")]
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 5, 1),), (None,)], "d date")
    assert sinks.without_range(df, "d", F.lit("2024-04-01").cast("date"), F.lit("2024-06-01").cast("date")).count() == 2


def test_get_or_create(spark):
    stored = spark.createDataFrame([(1, "One", "ONE"), (2, "Two", None)], "id bigint, full_name string, abbreviation string")
    wanted = spark.createDataFrame([(1, ""), (2, "Second"), (3, None)], "id bigint, full_name string")
    assert rows(sinks.get_or_create(stored, wanted, truthy=True, defaults=sinks.team_defaults())) == [
        (1, "One", "ONE"), (2, "Second", None), (3, "Team 3", "TM_3")]
    assert rows(sinks.get_or_create(stored, wanted.filter("id = 1")))[0] == (1, "", "ONE")


def test_json_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2024, 1, 2), 125, 1.23456, [0.333333], {"a": 2.71828}, 5)], "id int, d date, min_seconds bigint, x double, l array<double>, m map<string,double>, _n int")
    assert json.loads(sinks.json_rows(df).first()[0]) == {"id": 1, "d": "2024-01-02", "min": "2:05", "x": 1.23, "l": [0.33], "m": {"a": 2.72}}
    root = str(tmp_path / "log")
    sinks.append_log(spark, root, [(datetime(2024, 1, 1, i), "ERROR" if i % 2 else "INFO", "m", f"msg {i}", None) for i in range(6)])
    tail = sinks.log_tail(tables.read_table(spark, root, "log_entries"), 2, "error").collect()
    assert [r["message"] for r in tail] == ["msg 3", "msg 5"]


def test_every_query_builds_on_the_smallest_tables(spark, sf):
    import __spark_entry__ as entry_points

    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 100
    assert entry_points.entry(spark).count() >= 0
    for name in ("leaders_multi", "cup_rounds", "streak_page", "box_score_clean"):
        assert queries[name](spark, sf).columns


def test_lists_are_as_long_as_asked_for(spark):
    folk = spark.range(90).selectExpr("id", "concat('N', id div 2) full_name", "true is_active")
    awards = spark.range(90).selectExpr("id player_id", "'2020-21' season", "'MVP' award_type")
    assert leaders.award_leaders(awards, folk, limit=80).count() == 80
    ranked = folk.withColumn("total", F.when(F.col("id") < 60, 1).otherwise(0))
    names = search.first_per_name(ranked, [F.desc("total"), F.asc("id")], 40)
    assert [r["id"] for r in names.orderBy("id").collect()] == list(range(0, 80, 2))     # one row per name, and k of them
    many = spark.createDataFrame([(1, date(2024, 1, 1), 10)] * 150 + [(1, date(2024, 1, 2), 20)] * 150, "player_id bigint, date date, pts bigint")
    zero = ["reb", "ast", "stl", "blk", "tov", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta"]
    lines = many.select("*", *[F.lit(0).alias(c) for c in zero], F.lit(60).alias("min_seconds"), F.lit(0.0).alias("plus_minus"), F.monotonically_increasing_id().alias("game_id"))
    form = {r["span"]: r for r in careers.recent_form(lines, "2024-01-02").collect()}
    assert form["last_7_days"]["games"] == 300 and form["last_7_days"]["ppg"] == 15
    assert careers.recent_form(lines, "2024-01-02", newest_rows=100).first()["games"] == 100


def test_board_means_leave_out_nulls(spark):
    lines = spark.createDataFrame([(1, "s", v) for v in (10, None, 20, None, 30)], "player_id bigint, season string, pts bigint")
    assert leaders.boards(lines, ["pts"]).first()["value"] == 20 == leaders.top_average(lines, "pts").first()["value"]
