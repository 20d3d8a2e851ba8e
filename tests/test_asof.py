from __future__ import annotations

import random
import re
from datetime import date, timedelta

import pytest
from conftest import lines_df, rows
from test_detectors import random_lines

from pyspark.sql import functions as F

from formline.operators import trends
from formline.operators.asof import asof_join

LEFT = "k bigint, at date, n bigint"
RIGHT = "k bigint, day date, tie bigint, v string"


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_with_one_huge_group(spark, strict):
    """One group has nine tenths of the rows; ties, nulls, groups without a match, equal days."""
    rnd = random.Random(7)
    day = lambda: date(2020, 1, 1) + timedelta(days=rnd.randrange(400))
    key = lambda: 1 if rnd.random() < 0.9 else rnd.randrange(2, 6)
    left = [(key(), day(), n) for n in range(600)] + [(None, day(), 600), (1, None, 601), (9, day(), 602), (1, date(2019, 1, 1), 603)]
    right = [(key(), day(), n % 5, f"v{n}") for n in range(500)] + [(None, day(), 1, "x"), (1, None, 1, "y")]
    found = asof_join(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT), ["k"], "at", "day", {"v": "v", "was": "day"}, tie="tie", strict=strict)

    def last(k, at):
        fit = [r for r in right if None not in (k, at, r[1]) and r[0] == k and (r[1] < at if strict else r[1] <= at)]
        best = max(fit, key=lambda r: (r[1], r[2], r[3]), default=None)
        return (best[3], best[1]) if best else (None, None)

    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((k, at, n, *last(k, at)) for k, at, n in left), key=repr)


def test_trend_history_has_the_trend_of_every_day(spark):
    lines = lines_df(spark, random_lines(seed=41, players=2, per_season=15))
    history = trends.trend_history(lines)
    days = sorted({(r.player_id, r.game_date, r.season) for r in lines.select("player_id", "game_date", "season").collect()})
    assert rows(history.select("player_id", "reference_date").distinct()) != []
    for player, day, season in days[:: max(1, len(days) // 4)]:
        reference = spark.createDataFrame([(player, day, season)], "player_id bigint, reference_date date, reference_period string")
        want = trends.trend_scores(lines, reference)
        got = history.filter((F.col("player_id") == player) & (F.col("reference_date") == F.lit(day))).select(*want.columns)
        assert rows(got, "window_type") == rows(want, "window_type")


def test_trend_history_sends_only_days_through_the_asof_join(spark, monkeypatch):
    widths = []

    def seen(left, *rest):
        widths.append(len(left.columns))
        return asof_join(left, *rest)

    monkeypatch.setattr(trends, "asof_join", seen)
    trends.trend_history(lines_df(spark, random_lines(seed=5, players=1, per_season=3)))
    assert widths == [3, 3]


def test_trend_history_moves_values_and_no_sums(spark):
    """An exchange by entity carries one column a feature; running sums and what the as-of joins find stay in their task."""
    history = trends.trend_history(lines_df(spark, random_lines(seed=5, players=1, per_season=3)))
    plan = history._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange\nInput \[(\d+)\]: \[(.*)\]\nArguments: hashpartitioning\((.*), \d+\)", plan)
    assert moved and not [columns for _, columns, _ in moved if re.search(r"upto|run_|was|__in_|__last|__found", columns)]
    assert max(int(n) for n, _, by in moved if re.fullmatch(r"player_id#\d+L?", by)) < 2 * len(trends.DEFAULT_FEATURES)


def test_trend_history_adds_up_the_days_of_big_entities_first(spark):
    """The same rows whether no, some or all entities are big; two seasons on one day, rows without a player, day, season or id."""
    items = random_lines(seed=43, players=3, per_season=12) + [r | {"player_id": 1} for r in random_lines(seed=44, players=1, per_season=40)]
    again = [r | {"id": r["id"] + 90000, "game_id": r["game_id"] + 90000, "season": "1999-00"} for r in items[::4]]
    odd = [items[i] | {"id": 99000 + i, "game_id": 99000 + i} | cut for i, cut in enumerate(({"player_id": None}, {"game_date": None}, {"season": None}, {"game_id": None}, {"min_seconds": None}))]
    lines = lines_df(spark, items + again + odd).repartition(3)
    got = [trends.trend_history(lines, parts=parts, most=most) for parts, most in ((None, 10**6), (3, 60), (5, 0))]
    assert len(rows(got[0])) > 20 and rows(got[0]) == rows(got[1]) == rows(got[2])
    counts = sorted(r["count"] for r in lines.groupBy("player_id").count().collect())
    assert any(n <= 60 for n in counts) and any(n > 60 for n in counts)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_of_sides_dealt_out_alike(spark, strict):
    rnd = random.Random(8)
    day = lambda: None if rnd.random() < 0.05 else date(2020, 1, 1) + timedelta(days=rnd.randrange(60))
    left = spark.createDataFrame([(rnd.choice([1, 2, 3, None]), day(), n) for n in range(200)], LEFT).repartition(4, "k")
    right = spark.createDataFrame([(rnd.choice([1, 2, None]), day(), n % 5, f"v{n}") for n in range(150)], RIGHT).repartition(4, "k")
    want = asof_join(left, right, ["k"], "at", "day", {"v": "v", "was": "day"}, "tie", strict)
    got = asof_join(left, right, ["k"], "at", "day", {"v": "v", "was": "day"}, "tie", strict, True)
    assert rows(got) == rows(want)
    # The sides are dealt out once each, and their union is not dealt out again.
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
