from __future__ import annotations

import glob
import random
import re
import time
from datetime import date, timedelta

import pyarrow.parquet as pq
import pytest
from conftest import LINE_SCHEMA, line, lines_df, rows
from test_detectors import random_lines

from pyspark.sql import functions as F

from formline.operators import rollups, streaks, trends, zscore
from formline.sources.keyed_log import KeyedLog
from formline.streaming.lines import week_of
from formline.streaming.rollups import RollupStream
from formline.streaming.streaks import StreakStream, merged_runs, segments
from formline.streaming.zscore import ZScoreStream


def ordered_parts(items, n=4):
    """The rows of every entity in time order, cut into n consecutive parts."""
    items = sorted(items, key=lambda r: (r["game_date"], r["game_id"]))
    size = len(items) // n + 1
    return [items[i:i + size] for i in range(0, len(items), size)]


def land(spark, folder, parts):
    for part in parts:
        lines_df(spark, part).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)   # files are picked up in the order of their modification time


def source(spark, folder):
    return spark.readStream.schema(LINE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_zscore_stream_equals_batch(spark, tmp_path):
    items = random_lines(seed=11, players=3, per_season=25)
    parts = ordered_parts(items, 3)
    land(spark, tmp_path / "in", parts)
    job = ZScoreStream(spark, str(tmp_path / "out"), LINE_SCHEMA)
    job.start(source(spark, tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    want = zscore.zscore_outliers(lines_df(spark, items))
    cols = ["stat_id", "headline_z", "outlier_type", "games_in_sample"]
    assert rows(job.outliers().select(*cols)) == rows(want.select(*cols)) and want.count() > 0
    want = trends.trend_outliers(lines_df(spark, items))
    assert rows(job.trends().select(*TRENDS)) == rows(want.select(*TRENDS))


def muddled(items, n, seed):
    """Parts in the order of time, with rows repeated in the same and in later parts, rows one or two parts late, and corrections."""
    rnd, parts, truth = random.Random(seed), ordered_parts(items, n), {}
    out = [[] for _ in parts]
    for at, part in enumerate(parts):
        for r in part:
            put = rnd.random()
            here = min(n - 1, at + 1 + (put < 0.03)) if put < 0.1 else at
            out[here].append(r)
            truth[r["id"]] = r
            if put > 0.9:
                out[rnd.randrange(here, n)].append(r)
            elif put > 0.87 and here + 1 < n:
                truth[r["id"]] = r | {"pts": r["pts"] + 17}
                out[rnd.randrange(here + 1, n)].append(truth[r["id"]])
    return out, list(truth.values())


ZSCORE = ["stat_id", "headline_z", "outlier_type", "games_in_sample"]
TRENDS = ["player_id", "window_type", "reference_date", "max_z_score", "games_in_window", "games_in_baseline"]


def test_zscore_and_trend_streams_with_repeats_late_rows_and_corrections(spark, tmp_path):
    parts, truth = muddled(random_lines(seed=12, players=3, per_season=25), 3, 1)
    job = ZScoreStream(spark, str(tmp_path / "a"), LINE_SCHEMA)
    for number, part in enumerate(parts):
        job.process(lines_df(spark, part), number)
    job.process(lines_df(spark, parts[-1]), len(parts) - 1)     # the last batch is tried again
    job.process(lines_df(spark, parts[-1]), len(parts))         # and delivered again
    batch = lines_df(spark, truth)
    want = zscore.zscore_outliers(batch)
    assert rows(job.outliers().select(*ZSCORE)) == rows(want.select(*ZSCORE)) and want.count() > 0
    assert rows(job.trends().select(*TRENDS)) == rows(trends.trend_outliers(batch).select(*TRENDS))


def test_earlier_period_without_playing_time_ends_the_grace(spark, tmp_path):
    bench = [line(900, 1, date(2023, 1, 5), 0, seconds=0, season="2022-23")]
    season = [line(i, 1, date(2023, 11, 1) + timedelta(days=i), 20) for i in range(8)] + [line(50, 1, date(2023, 12, 1), 60)]
    for order in ([bench, season], [season, bench]):            # the earlier row may even come last
        job = ZScoreStream(spark, str(tmp_path / str(len(order[0]))), LINE_SCHEMA, with_trends=False)
        for number, part in enumerate(order):
            job.process(lines_df(spark, part), number)
        assert [r["stat_id"] for r in job.outliers().collect()] == [50]


def test_trend_baseline_reaches_back_over_the_whole_period(spark, tmp_path):
    items = [line(i, 1, date(2021, 1, 1) + timedelta(days=20 * i), 10 + i % 5) for i in range(41)]
    items += [line(100 + i, 1, date(2023, 4, 2) + timedelta(days=i), 40) for i in range(2)]
    job = ZScoreStream(spark, str(tmp_path / "a"), LINE_SCHEMA)
    for number, part in enumerate([items[:30], items[30:]]):
        job.process(lines_df(spark, part), number)
    got = job.trends().filter("window_type = 'week'").first()
    assert got["games_in_baseline"] == 43


def test_bootstrap_loads_history_once(spark, tmp_path):
    items = random_lines(seed=13, players=2, per_season=25)
    parts = ordered_parts(items, 3)
    zs, runs = ZScoreStream(spark, str(tmp_path / "z"), LINE_SCHEMA, with_trends=False), StreakStream(spark, str(tmp_path / "s"), LINE_SCHEMA)
    active = spark.createDataFrame([(1,)], "player_id bigint")
    for job in (zs, runs):
        assert job.bootstrap(lines_df(spark, parts[0] + parts[1]))
        job.process(lines_df(spark, parts[2]), 0)
        assert not job.bootstrap(lines_df(spark, parts[0]))
    assert rows(zs.outliers().select(*ZSCORE)) == rows(zscore.zscore_outliers(lines_df(spark, items)).select(*ZSCORE))
    want = streaks.streaks(lines_df(spark, items), active)
    assert rows(runs.streaks(active).select(*want.columns)) == rows(want)


def test_streak_stream_equals_batch(spark, tmp_path):
    items = random_lines(seed=21, players=3, per_season=20)
    land(spark, tmp_path / "in", ordered_parts(items, 3))
    active = spark.createDataFrame([(1,), (2,)], "player_id bigint")
    job = StreakStream(spark, str(tmp_path / "out"), LINE_SCHEMA)
    job.start(source(spark, tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    want = streaks.streaks(lines_df(spark, items), active)
    assert rows(job.streaks(active).select(*want.columns)) == rows(want) and want.count() > 50


def test_streak_stream_with_repeats_late_rows_and_corrections(spark, tmp_path):
    parts, truth = muddled(random_lines(seed=22, players=3, per_season=15), 3, 2)
    active = spark.createDataFrame([(1,), (2,)], "player_id bigint")
    job = StreakStream(spark, str(tmp_path / "a"), LINE_SCHEMA)
    for number, part in enumerate(parts):
        job.process(lines_df(spark, part), number)
    job.process(lines_df(spark, parts[-1]), len(parts) - 1)
    job.process(lines_df(spark, parts[1]), len(parts))
    for r in parts[1]:
        truth = [r if t["id"] == r["id"] else t for t in truth]     # the latest delivery of a row counts
    want = streaks.streaks(lines_df(spark, truth), active)
    assert rows(job.streaks(active).select(*want.columns)) == rows(want) and want.count() > 50


def test_streak_stream_takes_rules_and_string_ids(spark, tmp_path):
    schema = LINE_SCHEMA.replace("game_id bigint", "game_id string")
    items = [line(i, 1, date(2024, 1, 1) + timedelta(days=i), 25 if i != 4 else 3) | {"game_id": f"g{i:03d}"} for i in range(8)]
    rules = lambda: streaks.criteria(["pts_20"])
    job = StreakStream(spark, str(tmp_path / "a"), schema, rules=rules, competitions={"regular": "rs"})
    for number in range(2):
        job.process(spark.createDataFrame(items[4 * number:4 * number + 4], schema), number)
    found = job.streaks(spark.createDataFrame([(1,)], "player_id bigint"))
    assert sorted((r["length"], r["first_game_id"], r["is_active"]) for r in found.collect()) == [(3, "g005", True), (4, "g000", False)]


def rolled(job, want):
    return rows(job.rollups().select(*want.columns)) == rows(want)


def test_rollup_stream(spark, tmp_path):
    items = random_lines(seed=31, players=2, per_season=10)
    job = RollupStream(spark, str(tmp_path / "r"), LINE_SCHEMA.replace("game_date", "date") + ", pi boolean")
    frame = lambda part: lines_df(spark, part).withColumnRenamed("game_date", "date").withColumn("pi", F.lit(False))
    parts = ordered_parts(items, 3)
    for i, part in enumerate(parts):
        job.process(frame(part), i)
    job.process(frame(parts[2]), 2)                     # repeated batch replaces itself
    job.process(frame(parts[0] + parts[0]), 3)          # rows delivered again count once, and move nothing
    assert job.spark.read.parquet(job.rows.path).filter("run = 6").count() == 0
    want = rollups.season_rollup(frame(items))
    assert rolled(job, want)
    one = next(r for r in parts[0] if r["rs"]) | {"pts": 99}
    job.process(frame([one]), 4)                        # a corrected row moves one row for each of its types
    moved = job.spark.read.parquet(job.rows.path).filter("run = 8")
    assert moved.count() == 1 + one["po"] + one["ist"]
    assert rolled(job, rollups.season_rollup(frame([one if r["id"] == one["id"] else r for r in items])))


def test_rollup_stream_takes_out_days_and_moves_rows(spark, tmp_path):
    """Corrections take the earliest and latest days away until nothing kept is left; rows change day, team and season."""
    frame = lambda part: lines_df(spark, part).withColumnRenamed("game_date", "date").withColumn("pi", F.lit(False))
    items = {i: line(i, 1, date(2024, 1, 1) + timedelta(days=5 * i), 10 + i) for i in range(8)}
    job = RollupStream(spark, str(tmp_path / "r"), LINE_SCHEMA.replace("game_date", "date") + ", pi boolean", kept=2)
    job.process(frame(list(items.values())), 0)
    steps = [
        {0: {"rs": False}, 1: {"rs": False}, 2: {"rs": False}}, {7: {"team_id": 2}, 6: {"season": "2024-25"}}, {3: {"game_date": date(2024, 6, 1)}},
        {3: {"game_date": date(2023, 12, 1), "player_id": 2}, 0: {"rs": True}},
    ]
    for number, step in enumerate(steps, 1):
        for i, change in step.items():
            items[i] = items[i] | change
        job.process(frame([items[i] for i in step]), number)
        assert rolled(job, rollups.season_rollup(frame(list(items.values())))), number


def test_rows_that_move_to_another_week_and_entity(spark, tmp_path):
    """A row that comes again elsewhere leaves its old week, period and entity."""
    items = {r["id"]: r for r in random_lines(seed=14, players=2, per_season=12)}
    parts = ordered_parts(list(items.values()), 2)
    zs, runs = ZScoreStream(spark, str(tmp_path / "z"), LINE_SCHEMA), StreakStream(spark, str(tmp_path / "s"), LINE_SCHEMA)
    ids = [r["id"] for r in parts[0]]
    last = [items[ids[3]] | {"game_date": date(2024, 6, 20)}, items[ids[5]] | {"player_id": 2}, items[ids[7]] | {"season": "2021-22", "game_date": date(2021, 11, 5)}]
    for number, part in enumerate([*parts, last]):
        for job in (zs, runs):
            job.process(lines_df(spark, part), number)
    for r in last:
        items[r["id"]] = r
    batch, active = lines_df(spark, list(items.values())), spark.createDataFrame([(1,), (2,)], "player_id bigint")
    assert rows(zs.outliers().select(*ZSCORE)) == rows(zscore.zscore_outliers(batch).select(*ZSCORE))
    assert rows(zs.trends().select(*TRENDS)) == rows(trends.trend_outliers(batch).select(*TRENDS))
    want = streaks.streaks(batch, active)
    assert rows(runs.streaks(active).select(*want.columns)) == rows(want)


def test_a_batch_reads_its_own_weeks_however_long_the_history(spark, tmp_path):
    """Rows in the folders that a batch reads stay as few over many batches; a merge reads one slot."""
    job = StreakStream(spark, str(tmp_path / "s"), LINE_SCHEMA, rules=lambda: streaks.criteria(["pts_20"]), competitions={"regular": "rs"})
    read = []
    for number in range(20):
        part = [line(10 * number + i, i, date(2024, 1, 1) + timedelta(days=7 * number + i % 7), 15 + i) for i in range(10)]
        part += [line(3, 3, date(2024, 1, 4), number)] if number == 15 else []      # one late correction
        job.lines.lines.read_folders.clear()
        job.process(lines_df(spark, part), number)
        read.append(sum(pq.ParquetFile(f).metadata.num_rows for folder in job.lines.lines.read_folders for f in glob.glob(f"{folder.removeprefix('file:')}/*.parquet")))
    assert max(read[1:15] + read[16:]) <= 10 and read[15] <= 21
    assert job.streaks(spark.createDataFrame([(9,)], "player_id bigint")).filter("player_id = 9").first()["length"] == 20


def aggregates(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("SortAggregate"), plan.count("Aggregate"), plan.count("Join")


def test_runs_are_grouped_by_hash_in_bounded_tasks(spark):
    lines = lines_df(spark, random_lines(seed=23, players=3, per_season=15))
    rows_of = streaks.streak_rows(lines, parts=37)
    assert aggregates(streaks.islands(rows_of))[0] == 0 and "REPARTITION_BY_NUM" in rows_of._jdf.queryExecution().executedPlan().toString()
    active = spark.createDataFrame([(1,), (2,)], "player_id bigint")
    want = streaks.streaks(lines, active)
    assert rows(streaks.streaks(lines, active, parts=37)) == rows(want) and want.count() > 50


def test_every_step_over_runs_has_its_own_number_of_tasks(spark):
    """Also where the session has few shuffle partitions: the runs are neither held nor sorted in so few tasks."""
    lines = lines_df(spark, random_lines(seed=29, players=4, per_season=12) + [line(9990, None, date(2023, 11, 1), 25), line(9991, None, date(2023, 11, 2), 25)])
    active = spark.createDataFrame([(1,), (None,)], "player_id bigint")
    found = streaks.streaks(lines, active, parts=37)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ShuffledHashJoin \[player_id#\d+L, competition_type#\d+\]", plan)
    for keys in (["player_id", "__block"], ["player_id"], ["player_id", "streak_type", "competition_type", "island"], ["player_id", "competition_type"]):
        assert re.search(r"hashpartitioning\(" + ", ".join(rf"{k}#\d+L?" for k in keys) + r", 37\), REPARTITION_BY_NUM", plan), keys
    assert rows(found) == rows(streaks.streaks(lines, active)) and found.filter("player_id is null and not is_active").count() > 0


def test_runs_of_segments_need_one_window_and_keep_rows_without_a_day(spark):
    items = [line(3008, 1, None, 25), line(5000, 1, None, 2), line(8986, 1, None, 25), line(9000, 1, date(2021, 11, 1), 25), line(9001, 1, date(2021, 11, 6), 2)]
    df = lines_df(spark, items).withColumn("__week", week_of("game_date"))
    made = segments(df, ["player_id", "__week"], streaks.criteria(["pts_20"]), {"regular": "rs"})
    found = merged_runs(made, "player_id", "__week", 5)
    assert [(r["length"], r["first"]["game"], r["last"]["game"], r["broken_on"]) for r in found.collect()] == [(3, 3008, 9000, date(2021, 11, 6))]


def test_a_log_compares_rows_with_later_runs_only(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "l"), "k bigint, v bigint", ["k"], F.shiftright("k", 4), once=True)
    log.write(spark.range(64).selectExpr("id k", "0L v"), 0)
    assert aggregates(log.read())[1:] == (0, 0)
    log.write(spark.createDataFrame([(3, 1), (20, 1)], "k bigint, v bigint"), 1)
    log.write(spark.createDataFrame([(3, 2), (70, 2)], "k bigint, v bigint"), 2)
    assert dict(log.read().filter("v > 0").collect()) == {3: 2, 20: 1, 70: 2} and log.read().count() == 65
    assert dict(log.read(before=2).filter("v > 0").collect()) == {3: 1, 20: 1} and log.stored().count() == 68
