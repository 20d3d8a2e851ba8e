from __future__ import annotations

import math
import random
import re
from datetime import date, timedelta
from decimal import Decimal

import pytest
from conftest import line, lines_df, rows

from pyspark.sql import Window
from pyspark.sql import functions as F

from formline.operators import streaks, trends, zscore
from formline.operators.anomalies import with_records
from formline.operators.running import Running, running
from formline.plans import league as L
from formline.plans import pages as PG

START = date(2024, 1, 1)


def test_flat_then_sixty(spark):
    items = [line(i, 1, START + timedelta(days=i), 20) for i in range(25)]
    items.append(line(99, 1, date(2024, 2, 1), 60))
    found = zscore.zscore_outliers(lines_df(spark, items)).collect()
    assert len(found) == 1 and found[0]["stat_id"] == 99
    assert found[0]["max_z_score"] > 2 and found[0]["outlier_type"] == "explosion"
    assert found[0]["games_in_sample"] == 25
    assert [f["feature"] for f in found[0]["outlier_features"]] == ["pts"]


def brute_scores(items):
    """Row by row, with running sums."""
    out, state, periods = {}, {}, {}
    for r in sorted(items, key=lambda r: (r["player_id"], r["season"], r["game_date"], r["game_id"])):
        key = (r["player_id"], r["season"])
        s = state.setdefault(key, {"n": 0, "first": None})
        prior = any(p < r["season"] for p in periods.get(r["player_id"], ()))
        if r["min_seconds"] >= 900 and s["n"] >= 5:
            mature = (r["game_date"] - s["first"]).days >= 30 and s["n"] >= 20
            if mature or prior:
                zs = {}
                for f in zscore.DEFAULT_FEATURES:
                    a, b, n = s.get(f.name, (0.0, 0.0, 0))
                    if n >= 5:
                        mean = a / n
                        zs[f.name] = (r[f.name] - mean) / math.sqrt(max(f.variance_floor, b / n - mean * mean))
                out[r["id"]] = zs
        periods.setdefault(r["player_id"], set()).add(r["season"])
        if r["min_seconds"] > 0:
            s["n"] += 1
            s["first"] = s["first"] or r["game_date"]
            for f in zscore.DEFAULT_FEATURES:
                if f.attempts and r[f.attempts] <= 0:
                    continue
                a, b, n = s.get(f.name, (0.0, 0.0, 0))
                s[f.name] = (a + r[f.name], b + r[f.name] ** 2, n + 1)
    return out


def random_lines(seed=3, players=4, per_season=45):
    rnd, items = random.Random(seed), []
    for p in range(1, players + 1):
        for y, season in ((2022, "2022-23"), (2023, "2023-24")):
            # One player has most of the rows.
            for g in range(per_season * (5 if p == 1 else 1)):
                fga, fg3a, fta = rnd.randint(0, 12), rnd.randint(0, 3), rnd.randint(0, 6)
                fg3a = min(fg3a, fga)
                fgm, fg3m, ftm = rnd.randint(0, fga), rnd.randint(0, fg3a), rnd.randint(0, fta)
                items.append(line(
                    len(items), p, date(y, 10, 20) + timedelta(days=g // (5 if p == 1 else 1) * 2), rnd.choice([0, 5, 12, 22, 33, 45]),
                    rnd.choice([0, 40, 600, 1500, 2000]), season, reb=rnd.randint(0, 12), ast=rnd.randint(0, 12), stl=rnd.randint(0, 4),
                    blk=rnd.randint(0, 4), tov=rnd.randint(0, 7), fga=fga, fgm=fgm, fta=fta, ftm=ftm, fg3a=fg3a, fg3m=fg3m,
                    fg_pct=fgm / fga if fga else 0.0, fg3_pct=fg3m / fg3a if fg3a else 0.0, ft_pct=ftm / fta if fta else 0.0,
                    rs=rnd.random() < 0.7, po=rnd.random() < 0.2, ist=rnd.random() < 0.3))
    return items


def check_scores(spark, items):
    want = brute_scores(items)
    got = {r["id"]: r for r in zscore.zscore_rows(lines_df(spark, items)).collect()}
    assert set(got) == set(want) and want
    for i, zs in want.items():
        for f in zscore.DEFAULT_FEATURES:
            z = got[i][f"z_{f.name}"]
            assert (z is None) == (f.name not in zs)
            if z is not None:
                assert z == pytest.approx(zs[f.name], abs=1e-4)


def test_scores_against_brute_force(spark):
    check_scores(spark, random_lines())


def test_scores_of_an_entity_with_nine_tenths_of_the_rows(spark):
    items = random_lines(seed=21)
    for n, r in enumerate(items):
        if n % 10:
            r["player_id"] = 1
    check_scores(spark, list({(r["player_id"], r["game_date"], r["game_id"]): r for r in items}.values()))


ORDERS = {
    "int": lambda i: i - 300, "double": lambda i: (i - 300) * 1.7 / (1 + abs(i - 300) % 5), "string": lambda i: f"{i * 37:09d}"[: 9 - i % 2], "date": lambda i: START + timedelta(days=i),
    "decimal(9,2)": lambda i: Decimal(i - 300) / 4,
}


@pytest.mark.parametrize("kind", ORDERS)
def test_running_equals_a_plain_window(spark, kind):
    """One key holds nine tenths of the rows, and keys and values may be null; orders of every type are cut into blocks."""
    rnd = random.Random(5)
    places = sorted({ORDERS[kind](i) for i in range(600)})
    data = [(rnd.choice([None, 2, 3]) if n % 10 == 0 else 1, o, rnd.choice([None, 1, 2, 7])) for n, o in enumerate(places)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, f"k int, o {kind}, v bigint")
    aggs = {"s": Running(F.col("v")), "lo": Running(F.col("v"), "min"), "hi": Running(F.col("v"), "max")}
    for keys in (["k"], []):
        for inclusive in (True, False):
            frame = Window.partitionBy(*keys).orderBy("o").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            want = df.withColumns({name: agg.fold(agg.value).over(frame) for name, agg in aggs.items()})
            got = running(df, keys, ["o"], aggs, inclusive)
            assert got.columns == want.columns and rows(got, "o") == rows(want, "o")
    falling = Window.partitionBy("k").orderBy(F.desc("o"))
    if kind == "int":
        got = running(df, ["k"], [F.desc("o")], {"s": aggs["s"]}, block=-F.shiftright("o", 6))
        assert rows(got, "o") == rows(df.withColumn("s", F.sum("v").over(falling.rowsBetween(Window.unboundedPreceding, 0))), "o")


def shape(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return re.findall(r"[A-Z][A-Za-z]+(?= |$)", re.sub(r"#\d+L?|\d+", "", plan))


def test_the_plan_does_not_depend_on_the_size_and_building_it_runs_no_job(spark):
    few, many = (lines_df(spark, random_lines(seed=3)[:n]) for n in (5, 400))
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    frames = [[zscore.zscore_outliers(x), streaks.islands(streaks.streak_rows(x)), trends.trend_scores(x)] for x in (few, many)]
    assert set(tracker.getJobIdsForGroup(None)) == before
    for a, b in zip(*frames):
        assert shape(a) == shape(b)


def test_low_value_is_no_crisis_and_turnovers_are_bad(spark):
    items = [line(i, 1, START + timedelta(days=2 * i), 30, tov=2) for i in range(25)]
    items.append(line(50, 1, date(2024, 6, 1), 0, tov=2))     # far below the mean but under the minimum
    items.append(line(51, 1, date(2024, 6, 2), 30, tov=9))    # high turnovers are negative
    found = {r["stat_id"]: r for r in zscore.zscore_outliers(lines_df(spark, items)).collect()}
    assert set(found) == {51} and found[51]["outlier_type"] == "crisis"


def test_grace_rule(spark):
    first = [line(i, 1, START + timedelta(days=i), 10) for i in range(10)] + [line(20, 1, START + timedelta(days=11), 60)]
    assert zscore.zscore_outliers(lines_df(spark, first)).count() == 0
    earlier = first + [line(90, 1, date(2022, 11, 1), 10, season="2022-23")]
    assert [r["stat_id"] for r in zscore.zscore_outliers(lines_df(spark, earlier)).collect()] == [20]


def test_season_state(spark):
    items = [line(1, 1, START, 10, fga=4, fg_pct=0.5), line(2, 1, START + timedelta(days=1), 20), line(3, 1, START + timedelta(days=2), 99, seconds=0)]
    state = zscore.season_states(lines_df(spark, items)).first()
    assert state["games_played"] == 2 and state["last_game_date"] == START + timedelta(days=1)
    acc = state["accumulated"]
    assert (acc["pts"], acc["pts_sq"], acc["pts_count"], acc["fg_pct"], acc["fg_pct_count"]) == (30.0, 500.0, 2.0, 0.5, 1.0)


def test_trend_window_edges(spark):
    ref = date(2024, 3, 31)
    items = [line(i, 1, ref - timedelta(days=40 + i), 10) for i in range(20)]
    items += [line(100, 1, ref - timedelta(days=7), 10), line(101, 1, ref - timedelta(days=6), 40), line(102, 1, ref, 40)]
    week = trends.trend_scores(lines_df(spark, items), windows=[trends.WEEK]).first()
    assert week["games_in_window"] == 2 and week["games_in_baseline"] == 23 and week["cur_pts"] == 40.0
    mean = (21 * 10 + 80) / 23
    sd = math.sqrt((21 * 100 + 2 * 1600) / 23 - mean * mean)
    assert week["z_pts"] == pytest.approx((40 - mean) / (sd / math.sqrt(2)))
    out = trends.trend_outliers(lines_df(spark, items), windows=[trends.WEEK]).first()
    assert out["outlier_type"] == "explosion" and out["comparison"]["pts"]["current_avg"] == 40.0
    only_one = [r for r in items if r["id"] != 101]
    assert trends.trend_scores(lines_df(spark, only_one), windows=[trends.WEEK]).count() == 0


def brute_streaks(items, active):
    marks = {
        "pts_20": lambda r: r["pts"] >= 20, "pts_30": lambda r: r["pts"] >= 30, "pts_40": lambda r: r["pts"] >= 40,
        "triple_double": lambda r: sum(r[c] >= 10 for c in ("pts", "reb", "ast", "stl", "blk")) >= 3,
        "reb_10": lambda r: r["reb"] >= 10, "ast_10": lambda r: r["ast"] >= 10,
        "fg_pct_60": lambda r: None if not r["fga"] else r["fg_pct"] >= 0.6,
        "fg3_pct_50": lambda r: None if not r["fg3a"] else r["fg3_pct"] >= 0.5,
        "ft_pct_90": lambda r: None if not r["fta"] else r["ft_pct"] >= 0.9,
    }
    out = []
    for p in {r["player_id"] for r in items}:
        mine = sorted((r for r in items if r["player_id"] == p), key=lambda r: (r["game_date"], r["game_id"]))
        for comp, flag in streaks.COMPETITIONS.items():
            own = [r for r in mine if r[flag]]
            for name, rule in marks.items():
                run = []
                for r in own:
                    met = rule(r) if r["min_seconds"] >= 60 else None
                    if met:
                        run.append(r)
                    elif met is False and run:
                        out.append((p, name, comp, len(run), False, run[0]["game_date"], r["game_date"], run[0]["game_id"], run[-1]["game_id"]))
                        run = []
                if run:
                    alive = p in active and run[-1]["game_id"] == own[-1]["game_id"]
                    out.append((p, name, comp, len(run), alive, run[0]["game_date"], None if alive else run[-1]["game_date"], run[0]["game_id"], run[-1]["game_id"]))
    return sorted(out, key=str)


def check_streaks(spark, items):
    active = spark.createDataFrame([(1,), (3,)], "player_id bigint")
    got = streaks.streaks(lines_df(spark, items), active)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_streaks(items, {1, 3})


def test_streaks_against_brute_force(spark):
    check_streaks(spark, random_lines(seed=8))


def test_streaks_of_an_entity_with_nine_tenths_of_the_rows(spark):
    items = random_lines(seed=9)
    for n, r in enumerate(items):
        if n % 10:
            r["player_id"] = 1
    check_streaks(spark, list({(r["player_id"], r["game_date"], r["game_id"]): r for r in items}.values()))


def test_open_streak_needs_the_last_row(spark):
    active = spark.createDataFrame([(1,)], "player_id bigint")
    items = [line(i, 1, START + timedelta(days=i), 25) for i in range(3)]
    one = lambda extra: [r for r in streaks.streaks(lines_df(spark, items + extra), active).collect() if r["streak_type"] == "pts_20"][0]
    assert one([])["is_active"] and one([])["ended_at"] is None
    bench = one([line(9, 1, START + timedelta(days=9), 0, seconds=0)])      # did not play: no break, but no longer last
    assert not bench["is_active"] and bench["ended_at"] == START + timedelta(days=2)
    broken = one([line(9, 1, START + timedelta(days=9), 3)])
    assert broken["ended_at"] == START + timedelta(days=9) and broken["last_game_id"] == 2


def test_streak_criteria_registry(spark):
    df = lines_df(spark, [
        line(1, 1, START, 25, reb=12, ast=10, fga=10, fg_pct=0.65), line(2, 1, START, 15, fga=10, fg_pct=0.55), line(3, 1, START, 0)])
    got = df.select("id", *[c.alias(n) for n, c in streaks.criteria().items()]).orderBy("id").collect()
    assert [r["pts_20"] for r in got] == [True, False, False]
    assert [r["triple_double"] for r in got] == [True, False, False]
    assert [r["fg_pct_60"] for r in got] == [True, False, None]
    with pytest.raises(ValueError):
        streaks.criteria(["pts_20", "pts_99"])
    assert list(streaks.criteria(["reb_10"])) == ["reb_10"]


def test_records_badges_and_placeholder(spark):
    active = spark.createDataFrame([(1,)], "player_id bigint")
    items = [line(i, 1, START + timedelta(days=i), 25 if i != 10 else 0) for i in range(16)]          # 10 then 5
    items += [line(100 + i, 2, START + timedelta(days=i), 25 if i < 7 else 0) for i in range(8)]      # 7
    found = streaks.streaks(lines_df(spark, items), active)
    records = streaks.complete_records(found, 1)
    best = {(r["streak_type"], r["competition_type"]): r for r in records.collect()}
    assert len(best) == 27 and best["pts_20", "regular"]["length"] == 10
    empty = best["ast_10", "playoffs"]
    assert (empty["length"], empty["started_at"], empty["first_game_id"]) == (1, date(1983, 10, 1), "0000000001")
    badged = streaks.with_badges(found, records)
    assert sorted((r["length"], r["is_historical"]) for r in badged.filter("streak_type = 'pts_20'").collect()) == [(5, False), (7, True), (10, True)]
    summary = {r["streak_type"]: r for r in streaks.streak_summary(badged, records).collect()}
    assert len(summary) == 9 and summary["pts_20"]["total_streaks"] == 3 and summary["pts_20"]["notable_threshold"] == 7
    assert summary["ast_10"]["total_streaks"] == 0 and summary["ast_10"]["notable_threshold"] == 2


def test_badges_do_not_deal_streaks_out_by_pair(spark, sf):
    """With 27 pairs a task would get all streaks of one; the records are broadcast instead, whatever Spark expects of sizes."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = spark.createDataFrame([(1, "pts_20", "regular", 10)], "player_id bigint, streak_type string, competition_type string, length bigint")
        records = found.select("streak_type", "competition_type", "length", "player_id")
        for made in (streaks.with_badges(found, records), with_records(found, records)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and made.count() == 1
        plan = PG.streak_progress(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_ties_of_records(spark):
    active = spark.createDataFrame([(1,)], "player_id bigint")
    items = [line(i, 5, START + timedelta(days=i), 25) for i in range(3)] + [line(50 + i, 4, START + timedelta(days=i), 25) for i in range(3)]
    items += [line(80 + i, 3, START + timedelta(days=1 + i), 25) for i in range(3)]
    record = streaks.streak_records(streaks.streaks(lines_df(spark, items), active)).filter("streak_type = 'pts_20'").first()
    assert record["player_id"] == 4


def test_running_badges(spark):
    items = [line(i, 1, START + timedelta(days=i), 25) for i in range(4)] + [line(50 + i, 2, START + timedelta(days=10 + i), 25) for i in range(3)]
    got = streaks.running_badges(streaks.streak_rows(lines_df(spark, items))).filter("streak_type = 'pts_20'").orderBy("player_id").collect()
    # Player 1 at its second game; player 2 needs 70 percent of the record of 4, again 2.
    assert [(r["player_id"], r["length"], r["threshold"]) for r in got] == [(1, 2, 2), (2, 2, 2)]


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return final.count("Exchange hashpartitioning")


def test_rows_are_exchanged_once_by_block(spark, sf):
    lines = L.form_lines(spark, sf)
    # The rows; the block totals twice; the first periods. For the runs: rows, totals twice, partly aggregated runs.
    assert exchanges(zscore.zscore_outliers(lines)) == 4
    assert exchanges(streaks.islands(streaks.streak_rows(lines))) == 4
