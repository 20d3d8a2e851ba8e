from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from conftest import line, lines_df, rows
from test_detectors import random_lines

from formline.operators import anomalies, scoring
from formline.operators.paging import top_entries
from formline.sources import sinks
from pyspark.sql import functions as F


def random_features(spark, n=400, seed=1):
    rnd = random.Random(seed)
    items = []
    for i in range(n):
        base = rnd.gauss(0, 1)
        items.append(line(
            i, i % 5, date(2020 + i % 4, 1, 1) + timedelta(days=i), int(20 + 8 * base), 600 + rnd.randint(0, 1500), f"{2020 + i % 4}-{21 + i % 4}",
            ast=rnd.randint(0, 9), reb=int(abs(5 + 3 * base)), stl=rnd.randint(0, 3), blk=rnd.randint(0, 3), tov=rnd.randint(0, 5), pf=rnd.randint(0, 6),
            fg_pct=rnd.random(), fg3_pct=rnd.random(), ft_pct=rnd.random(), fga=int(10 + 4 * base + rnd.random()), fta=rnd.randint(0, 9), fg3a=rnd.randint(0, 6)))
    return scoring.feature_rows(lines_df(spark, items))


def matrix(df):
    return np.array([[r[f] for f in scoring.MODEL_FEATURES] for r in df.orderBy("id").collect()])


def test_feature_rows(spark):
    items = [line(1, 1, date(2024, 1, 1), 5, seconds=299), line(2, 1, date(2024, 1, 1), None, seconds=300)]
    got = scoring.feature_rows(lines_df(spark, items)).collect()
    assert [(r["id"], r["pts"], r["min"]) for r in got] == [(2, 0.0, 5.0)]
    three = [line(i, 1, date(2024, 1, 1), season=s) for i, s in enumerate(["2021-22", "2022-23", "2023-24"])]
    assert scoring.feature_rows(lines_df(spark, three), "2022-23").count() == 2
    assert scoring.feature_rows(lines_df(spark, three), "2022-23", "2022-23").count() == 1


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (4.0, 5.0, 7.0), (7.0, 8.0, 7.0)], "a double, b double, c double")
    scaler = scoring.Scaler.fit(df, ["a", "b", "c"])
    assert scaler.means == (4.0, 5.0, 7.0) and scaler.deviations[0] == pytest.approx(math.sqrt(6)) and scaler.deviations[2] == 1.0
    scaled = scaler.transform(df)
    assert all(r["c"] == 0.0 and not math.isnan(r["a"]) for r in scaled.collect())
    assert [r["a"] for r in scaler.inverse(scaled).orderBy("a").collect()] == pytest.approx([1.0, 4.0, 7.0])
    with pytest.raises(ValueError):
        scoring.Scaler.fit(df.filter("a > 100"), ["a", "b", "c"])


def test_season_weights(spark):
    seasons = ["2020-21", "2021-22", "2022-23", "2023-24"]
    df = spark.createDataFrame([(s,) for s in seasons], "season string")
    w = [r["weight"] for r in scoring.season_weights(df).orderBy("season").collect()]
    assert w == sorted(w) and sum(w) == pytest.approx(4) and w[3] / w[0] == pytest.approx(math.exp(0.3))
    assert {r["weight"] for r in scoring.season_weights(df, 0.0).collect()} == {1.0}
    old = spark.createDataFrame([("2010-11",), ("2023-24",)], "season string")
    w = [r["weight"] for r in scoring.season_weights(old, 0.5).orderBy("season").collect()]
    assert w[1] / w[0] > 10
    assert scoring.season_weights(df.filter("season = 'x'")).count() == 0


def test_temporal_split(spark):
    rnd = random.Random(2)
    data = [(i, date(2024, 1, 1) + timedelta(days=rnd.choice([1, 1, 1, 1, 5, 6, 9]))) for i in range(103)]
    got = scoring.temporal_split(spark.createDataFrame(data, "game_id bigint, game_date date")).collect()
    order = sorted(data, key=lambda r: (r[1], r[0]))
    assert {r["game_id"] for r in got if r["is_train"]} == {i for i, _ in order[:int(103 * 0.8)]} and len(got) == 103


def test_reconstruction_equals_numpy(spark):
    df = random_features(spark)
    model = scoring.fit_reconstruction(df, sizes=(3,))
    x = matrix(df)
    z = (x - x.mean(0)) / x.std(0)
    _, vectors = np.linalg.eigh(z.T @ z / len(z))
    rest = np.eye(14) - vectors[:, -3:] @ vectors[:, -3:].T
    squares = (z @ rest.T) ** 2
    got = model.score(df).orderBy("id").collect()
    assert [r["error"] for r in got] == pytest.approx(list(squares.mean(1)))
    assert got[0]["contributions"]["pts"] == pytest.approx(squares[0, 0] / squares[0].sum())
    assert sum(got[5]["contributions"].values()) == pytest.approx(1.0)
    assert model.validation_loss == pytest.approx(squares.mean())


def test_model_selection_weights_and_storage(spark, tmp_path):
    df = random_features(spark).withColumn("is_train", F.col("id") < 300).withColumn("weight", F.lit(2.0))
    plain = scoring.fit_reconstruction(df, "is_train", (2, 5, 9))
    assert plain.components == 9                      # more components never reconstruct worse
    weighted = scoring.fit_reconstruction(df, "is_train", (9,), "weight")
    assert np.array(weighted.projection) == pytest.approx(np.array(plain.projection), abs=1e-8)   # equal weights change nothing
    sinks.save_model(spark, plain, str(tmp_path / "model"))
    again = sinks.load_model(spark, str(tmp_path / "model"))
    assert again == plain
    with pytest.raises(ValueError):
        scoring.fit_reconstruction(df.filter("id < 0"))


def test_percentiles_and_quantile(spark):
    rnd = random.Random(4)
    train = [float(rnd.choice([0, 0, 0, 1, 2, 3, 5, 8])) for _ in range(90)] + [float(i) / 7 for i in range(40)]
    scored = [0.0, 0.5, 1.0, 9.0, -1.0, 2.0, 2.0]
    t = spark.createDataFrame([(e,) for e in train], "error double")
    s = spark.createDataFrame(list(enumerate(scored)), "id int, error double")
    got = [r["percentile"] for r in scoring.error_percentiles(t, s).orderBy("id").collect()]
    quantiles = [scoring.quantile(t, q).first()[0] for q in (0.0, 0.5, 0.99, 1.0)]
    assert got == pytest.approx([100 * np.mean(np.array(train) < e) for e in scored])
    assert quantiles == pytest.approx([np.percentile(train, 100 * q) for q in (0.0, 0.5, 0.99, 1.0)])


def test_league_outliers(spark):
    df = random_features(spark).drop("min")
    active = spark.createDataFrame([(0,), (1,), (2,)], "player_id bigint")
    got = scoring.league_outliers(df, active, sizes=(4, 6), threshold=90.0)
    out = got.collect()
    assert len(out) == df.filter("player_id < 3").count()
    assert all(r["is_outlier"] == (r["percentile"] >= 90.0) and 0 <= r["percentile"] <= 100 for r in out)
    top = anomalies.top_league_outliers(got, active, "season", limit=5).collect()
    assert [r["percentile"] for r in top] == sorted((r["percentile"] for r in out if r["is_outlier"]), reverse=True)[:5]
    assert len(top[0]["top_features"]) == 3


def test_top_entries(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": -5.0, "c": 3.0, "d": 3.0},)], "m map<string,double>")
    assert [e["feature"] for e in df.select(top_entries(F.col("m"), 3)).first()[0]] == ["c", "d", "a"]
    assert [e["value"] for e in df.select(top_entries(F.col("m"), 2, by_size=True)).first()[0]] == [-5.0, 3.0]


def test_failing_detector_is_reported(spark):
    good = spark.createDataFrame([(1,), (2,)], "x int")
    results, summary = anomalies.run_detectors(
        spark, {"a": lambda: good, "b": lambda: good.select(F.raise_error(F.lit("broken")).alias("x")), "c": lambda: good.limit(1)}, skip=("c",))
    assert set(results) == {"a"} and rows(results["a"]) == [(1,), (2,)]
    got = {r["detector"]: (r["rows"], r["status"].split(":")[0].split(" ")[0]) for r in summary.collect()}
    assert got["a"] == (2, "ok") and got["b"] == (None, "failed") and got["c"] == (None, "skipped") and got["total"][0] == 2


def test_increment_with_a_stored_model_equals_the_full_run(spark, tmp_path):
    lines = lines_df(spark, random_lines(seed=41, players=4, per_season=30))
    active = spark.createDataFrame([(1,), (2,), (3,)], "player_id bigint")
    rows_ = scoring.temporal_split(scoring.season_weights(scoring.feature_rows(lines)))
    model = scoring.fit_reconstruction(rows_, "is_train", (2, 4), "weight")
    sinks.save_model(spark, model, str(tmp_path / "model"))
    errors = model.score(rows_).filter("is_train").select("error")
    want = scoring.league_outliers(lines, active, sizes=(2, 4)).filter("season = '2023-24' and is_outlier")
    got = scoring.score_increment(lines.filter("season = '2023-24'"), active, sinks.load_model(spark, str(tmp_path / "model")), errors)
    assert rows(got.select("stat_id", F.round("reconstruction_error", 9), "percentile")) == rows(want.select("stat_id", F.round("reconstruction_error", 9), "percentile"))
    assert scoring.score_increment(lines, active, model, errors, outliers_only=False).filter("not is_outlier").count() > 0
