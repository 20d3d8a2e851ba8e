from datetime import date

import pytest
from pyspark.sql import functions as F

from formline.functions import awards, boxline, casts, people
from formline.functions import seasons as S


def evaluate(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_clock(spark):
    cases = {"35:30": 2130, "5:30": 330, "65:00": 3900, "1:05:30": 3930, "35.5": 2130, "": 0, None: 0, "0:00": 0, "48:00": 2880,
             "N/A": 0, "a:b": 0, "1:2:3:4": 0, " 5 : 07 ": 307, "nan": 0, "inf": 0}
    assert evaluate(spark, casts.clock_to_seconds, list(cases)) == list(cases.values())


def test_clock_text(spark):
    assert evaluate(spark, casts.seconds_to_clock, [0, 59, 2304, 3930, None], "bigint") == ["0:00", "0:59", "38:24", "65:30", "0:00"]


def test_season_text(spark):
    texts = ["2023-24", "202324", "2023", "2023 - 24", "1999", "abc"]
    assert evaluate(spark, S.normalise_season, texts) == ["2023-24", "2023-24", "2023-24", "2023-24", "1999-00", "abc"]
    assert evaluate(spark, S.previous_season, ["2024-25", "2000-01", "2010-11"]) == ["2023-24", "1999-00", "2009-10"]


def test_safe_int(spark):
    cases = {"10": 10, "10.7": 10, "-5": -5, "0": 0, None: 0, "": 0, "abc": 0, "   ": 0, "1e2": 100, "-5.9": -5, "NaN": 0,
             "Infinity": 0, "10d": 0, "1e400": 0, " 7 ": 7}
    assert evaluate(spark, casts.safe_int, list(cases)) == list(cases.values())


def test_safe_double(spark):
    cases = {"10.5": 10.5, "10": 10.0, "-5.5": -5.5, "0": 0.0, None: 0.0, "abc": 0.0, "1.5e2": 150.0, "nan": 0.0}
    assert evaluate(spark, casts.safe_double, list(cases)) == list(cases.values())


def test_positive_int(spark):
    assert evaluate(spark, casts.positive_int_or_null, ["3", "0", "-1", "0.9", "2.9", "x", None]) == [3, None, None, None, 2, None, None]


def test_clean_text(spark):
    assert evaluate(spark, casts.clean_text, [" a ", "None", "NaN", "null", "", "  ", None, "nano"]) == ["a", None, None, None, None, None, None, "nano"]


def test_parse_day(spark):
    texts = ["2024-01-15", "2024-01-15T10:30:00Z", "2024-01-15 23:59:00", "01/15/2024", "JAN 15, 2024", "20240115", None, "not-a-date", "2024-13-45"]
    assert evaluate(spark, casts.parse_day, texts) == [date(2024, 1, 15)] * 6 + [None] * 3


def test_game_codes(spark):
    codes = ["0012300001", "0022300001", "0032300001", "0042300001", "0052300001", "0062300001", "9992300001", "00", None]
    assert evaluate(spark, S.game_type, codes) == ["PRESEASON", "RS", "ALLSTAR", "PO", "PI", "IST", "unknown", "unknown", "unknown"]
    assert evaluate(spark, S.game_code_date, ["00220231015001", "00220240315001", "0022300001", "00220231315001"]) == [
        date(2023, 10, 15), date(2024, 3, 15), None, None]
    assert evaluate(spark, S.game_code_season, ["0022300123", "0028300123", "x"]) == ["2023-24", "1983-84", None]


def test_cup_codes(spark):
    codes = ["0062300001", "0022301201", "0022300005", "0022400005", "0022400061", "0042400005"]
    df = spark.createDataFrame([(c, "2024-25" if c[3:5] == "24" else "2023-24") for c in codes], "c string, s string")
    assert [r[0] for r in df.select(S.is_cup_code(F.col("c"), F.col("s"))).collect()] == [True, True, False, True, False, False]


def test_height(spark):
    texts = ["6-9", "6 - 9", "6-9-3", "6", "abc", "x-9", "", None]
    assert evaluate(spark, lambda c: people.height_inches(c, 5), texts) == [81, 81, 81, 5, 5, 5, 5, 5]
    assert evaluate(spark, people.height_cm, ["6-9", "6-3", None, "x"]) == [206, 190, None, None]
    assert evaluate(spark, people.pounds_to_kg, [250, 0, -3, None], "int") == [113, None, None, None]


def test_names(spark):
    assert evaluate(spark, lambda c: people.has_word_starting(c, "J"), ["LeBron James", "Joe Doe", "Al Bajo"]) == [True, True, False]
    assert evaluate(spark, people.looks_abbreviated, ["S. Gilgeous", "Sam G", None]) == [True, False, False]


def test_shot_repair(spark):
    cases = [  # fgm fga fg3m fg3a ftm fta -> repaired
        ((12, 10, 0, 0, 0, 0), (12, 12, 0, 0, 0, 0)),
        ((10, 20, 5, 3, 0, 0), (10, 20, 5, 5, 0, 0)),
        ((3, 20, 5, 6, 0, 0), (3, 20, 3, 6, 0, 0)),
        ((3, 5, 2, 9, 0, 0), (3, 5, 2, 5, 0, 0)),
        ((0, 0, 0, 0, 7, 5), (0, 0, 0, 0, 7, 7)),
        ((2, 1, 4, 3, 1, 0), (2, 2, 2, 2, 1, 1)),
    ]
    names = ["fgm", "fga", "fg3m", "fg3a", "ftm", "fta"]
    df = spark.createDataFrame([c[0] for c in cases], ", ".join(f"{n} int" for n in names))
    fixed = boxline.repaired_shots(*[F.col(n) for n in names])
    assert [tuple(r) for r in df.select(*[fixed[n] for n in names]).collect()] == [c[1] for c in cases]


@pytest.mark.parametrize("line, dd, td", [
    ((25, 12, 10, 3, 2), True, True), ((20, 15, 5, 1, 0), True, False), ((18, 16, 10, 12, 4), True, True), ((9, 9, 9, 9, 9), False, False),
    ((30, None, None, None, None), False, False)])
def test_doubles(spark, line, dd, td):
    df = spark.createDataFrame([line], "pts int, reb int, ast int, stl int, blk int")
    assert tuple(df.select(boxline.is_double_double(), boxline.is_triple_double()).first()) == (dd, td)


def test_winner_periods_progress(spark):
    df = spark.createDataFrame([(120, 115), (100, 100), (None, 3), (1, 2)], "h int, a int")
    assert [r[0] for r in df.select(boxline.winner(F.lit(7), F.lit(8), F.col("h"), F.col("a"))).collect()] == [7, None, None, 8]
    one = spark.createDataFrame([([30, 28, 32, 30, 9], [28, 30, 27, 30])], "h array<int>, a array<int>")
    shown = one.select(boxline.period_scores(F.col("h"), F.col("a"))).first()[0]
    assert [tuple(p) for p in shown] == [("Q1", 30, 28), ("Q2", 28, 30), ("Q3", 32, 27), ("Q4", 30, 30), ("OT1", 9, 0)]
    got = spark.createDataFrame([(3, 10), (12, 10), (1, 3), (1, 0)], "n int, r int").select(boxline.progress_percent(F.col("n"), F.col("r"))).collect()
    assert [r[0] for r in got] == [30, 100, 33, 0]


def test_award_text(spark):
    cases = {
        "NBA Most Valuable Player": "MVP", "NBA Finals Most Valuable Player": "Finals MVP", "NBA All-Star Most Valuable Player": "All-Star MVP",
        "NBA Cup Most Valuable Player": "NBA Cup MVP", "City Cup MVP": "Other", "NBA Cup All-Tournament Team": "NBA Cup Team", "All-NBA": "All-NBA",
        "nba champion": "Champion", "All-Star Weekend": "All-Star", "NBA Rookie of the Month": "ROM", "Olympic Gold Medal": "Olympic Gold", "Something": "Other"}
    assert evaluate(spark, awards.award_class, list(cases)) == list(cases.values())
    df = spark.createDataFrame([("All-NBA", "1"), ("All-NBA", " 2 "), ("All-NBA", "3"), ("All-NBA", "4"), ("All-NBA", None)], "d string, n string")
    assert [r[0] for r in df.select(awards.award_name(F.col("d"), F.col("n"))).collect()] == [
        "All-NBA 1st Team", "All-NBA 2nd Team", "All-NBA 3rd Team", "All-NBA", "All-NBA"]
    assert evaluate(spark, awards.is_skipped, ["The Sporting News MVP", "All-NBA"]) == [True, False]


def test_season_calendar(spark):
    df = spark.createDataFrame([(date(2024, 10, 1),), (date(2024, 9, 30),)], "d date")
    assert [r[0] for r in df.select(S.season_of(F.col("d"))).collect()] == ["2024-25", "2023-24"]
    all_seasons = df.select(S.seasons_until(F.col("d"))).first()[0]
    assert all_seasons[0] == "1983-84" and all_seasons[-1] == "2024-25" and len(all_seasons) == 42
    assert tuple(evaluate(spark, S.season_bounds, ["2023-24"])[0]) == (date(2023, 8, 1), date(2024, 7, 31))
