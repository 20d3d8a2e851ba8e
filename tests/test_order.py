"""Values at positions, pages far down, several boards at once and names by word, against plain Python."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from formline.operators import rankings, ranks, scoring, search
from formline.operators.page_index import By, PageIndex
from formline.session import shared_dir


@pytest.mark.parametrize("kind", ["double", "bigint", "date", "string"])
def test_values_at_equal_sorting(spark, kind):
    rnd = random.Random(kind)
    make = {
        "double": lambda: rnd.choice([rnd.gauss(0, 1), 0.0, 7.5, -3.25]), "bigint": lambda: rnd.randrange(-50, 10**12) if rnd.random() < 0.5 else 4,
        "date": lambda: date(2020, 1, 1) + timedelta(days=int(rnd.expovariate(0.05))), "string": lambda: f"00{rnd.randrange(300)}",
    }[kind]
    values = [make() if rnd.random() > 0.05 else None for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").repartition(7)
    known = sorted(v for v in values if v is not None)
    places = [0, 1, 17, 2500, 2501, len(known) - 1, len(known), -1]
    got, smaller = ranks.values_at(df, "x", places)
    assert got == [known[p] if 0 <= p < len(known) else None for p in places]
    assert smaller[:6] == [sum(v < known[p] for v in known) for p in places[:6]]


def test_values_at_widens_a_bracket_that_misses(spark, monkeypatch):
    df = spark.range(4000).selectExpr("cast(id as double) x")
    assert ranks.values_at(df, "x", [2000], margin=0.0)[0] == [2000.0]
    monkeypatch.setattr(ranks, "SKETCH_SIZE", 8)  # ranks off by a tenth and more
    for p in (3, 1234, 3990):
        assert ranks.values_at(df, "x", [p], margin=0.0001) == ([float(p)], [p])


def test_values_at_sorts_a_bracket_only(spark, monkeypatch):
    seen = []
    plain = ranks.write_and_reload
    monkeypatch.setattr(ranks, "write_and_reload", lambda df, label: seen.append(plain(df, label)) or seen[-1])
    df = spark.range(200_000).selectExpr("cast(hash(id) as double) x")
    ranks.values_at(df, "x", [150_000])
    assert len(seen) == 1 and seen[0].count() < 200_000 * 0.02


def test_values_at_edges(spark):
    empty = spark.createDataFrame([], "x double")
    assert ranks.values_at(empty, "x", [0]) == ([None], [0])
    nulls = spark.createDataFrame([(None,)], "x double")
    assert ranks.values_at(nulls, "x", [0])[0] == [None] and scoring.quantile(nulls, 0.5, "x").first()[0] is None
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (float("-inf"),)], "x double")
    got = ranks.values_at(odd, "x", [0, 1, 2, 3])[0]
    assert got[:3] == [float("-inf"), 1.0, float("inf")] and math.isnan(got[3])
    same = spark.createDataFrame([(2.0,)] * 50, "x double")
    assert ranks.values_at(same, "x", [0, 49]) == ([2.0, 2.0], [0, 0])


def test_split_by_key(spark):
    rnd = random.Random(5)
    rows = [(i, date(2024, 1, 1) + timedelta(days=int(rnd.random() ** 3 * 6))) for i in range(500)] + [(None, date(2024, 1, 1)), (900, None)]
    df = spark.createDataFrame(rows, "game_id bigint, game_date date").repartition(5)
    for share in (0.0, 0.1, 0.5, 0.8, 1.0):
        got = {r["game_id"] for r in scoring.temporal_split(df, share=share).collect() if r["is_train"]}
        order = sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0] is None, r[0] or 0))
        chosen = order[:int(len(rows) * share)]
        assert got == {r[0] for r in chosen if r[0] is not None or r[1] < chosen[-1][1]}
    assert scoring.temporal_split(df).count() == len(rows)
    plan = scoring.temporal_split(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def _sorted(rows, order):
    for by in reversed(order):  # nulls first, last where descending
        at = {"a": 0, "b": 1, "id": 2}[by.column]
        rows = sorted(rows, key=lambda r: (r[at] is not None, r[at] if r[at] is not None else 0), reverse=by.descending)
    return rows


@pytest.mark.parametrize("order", [
    [By("a"), By("id")], [By("a", True), By("b"), By("id", True)], [By("b", True), By("a"), By("id")]])
def test_pages_equal_offsets(spark, order):
    rnd = random.Random(len(order))
    rows = [(rnd.choice([None, 1, 2, 2, 2, 9]), rnd.choice([None, "x", "y"]) and rnd.randrange(5), i) for i in range(700)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, id bigint").repartition(6)
    index = PageIndex.build(df, order, shared_dir(spark, "pages"), ranges=9)
    want = _sorted(rows, order)
    assert index.total == 700 and index.pages(33) == 22
    for number in (1, 2, 11, 21, 22, 23):
        assert [tuple(r) for r in index.page(number, 33).collect()] == want[(number - 1) * 33:number * 33]
    for at in (0, 5, 350, 690, 699):
        last = dict(zip(("a", "b", "id"), want[at]))
        assert [tuple(r) for r in index.after(last, 20).collect()] == want[at + 1:at + 21]
    gone = {"a": 2, "b": 1, "id": 10**6 if not order[-1].descending else -1}  # a key that is not in the listing
    behind = _sorted([*rows, (2, 1, gone["id"])], order)
    place = behind.index((2, 1, gone["id"]))
    assert [tuple(r) for r in index.after(gone, 7).collect()] == behind[place + 1:place + 8]


def test_a_page_reads_its_ranges_only(spark):
    df = spark.range(10_000).selectExpr("hash(id) a", "id")
    index = PageIndex.build(df, [By("a"), By("id")], shared_dir(spark, "pages"), ranges=20)
    files = lambda d: len(d.inputFiles()) if d else 0
    page = index.page(100, 50)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [__part" in plan.replace("isnotnull(__part", "__part") and files(index.rows) == 20
    assert index.page(201, 50).count() == 0
    assert PageIndex(spark, index.rows.inputFiles()[0].split("/rows/")[0], index.order).page(7, 50).collect() == index.page(7, 50).collect()
    empty = PageIndex.build(df.filter("id < 0"), [By("id")], shared_dir(spark, "pages"))
    assert empty.total == 0 and empty.page(1, 10).count() == 0 and empty.after({"id": 3}, 5).count() == 0


def test_boards_from_one_scan(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, 10, 20])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, x bigint, y bigint").repartition(5)
    text = F.coalesce(F.col("y").cast("string"), F.lit("-"))
    boards = {
        "low": rankings.Board(F.col("x").isNotNull(), [F.col("x")], F.col("x").cast("string"), text),
        "high": rankings.Board(F.col("x") > 0, [-F.col("x"), F.col("y")], F.col("x").cast("string"), text),
        "none": rankings.Board(F.col("x") > 5, [F.col("x")], F.col("x").cast("string"), text),
    }
    found = rankings.top_boards(df, boards, "id", limit=12)
    got = {(r["criterion"], r["place"]): r["id"] for r in found.collect()}
    known = [r for r in rows if r[1] is not None]
    low = sorted(known, key=lambda r: (r[1], r[0]))[:12]
    high = sorted(known, key=lambda r: (-r[1], r[2] is not None, r[2] or 0, r[0]))[:12]
    assert got == {("low", i + 1): r[0] for i, r in enumerate(low)} | {("high", i + 1): r[0] for i, r in enumerate(high)}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        rankings.biographic_rankings(df, ["weight"])


def test_boards_sort_no_whole_table(spark):
    """Of each board a task keeps its first rows in a queue: what it holds does not grow with what it reads."""
    df = spark.range(2000).selectExpr("id", "id * 7919 % 1000 x").repartition(3)
    boards = {n: rankings.Board(F.col("x") >= 0, [c], F.col("x").cast("string"), F.lit("-")) for n, c in (("low", F.col("x")), ("high", -F.col("x")))}
    found = rankings.top_boards(df, boards, "id", limit=4)
    assert found._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject(") == 2
    got = [(r["criterion"], r["place"], r["id"], r["value"]) for r in found.orderBy("criterion", "place").collect()]
    numbers = [(i * 7919 % 1000, i) for i in range(2000)]
    want = [("high", k + 1, i, str(x)) for k, (x, i) in enumerate(sorted(numbers, key=lambda n: (-n[0], n[1]))[:4])]
    assert got == want + [("low", k + 1, i, str(x)) for k, (x, i) in enumerate(sorted(numbers)[:4])]


def test_names_by_word(spark):
    rnd = random.Random(3)
    words = ["ann", "bo", "cy", "de", "x", ""]
    names = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 6))) for _ in range(200)} | {"ann ann ann bo", "", "zed"})
    runs = sorted({" ".join(rnd.choice(words[:5]) for _ in range(rnd.randrange(1, 5))) for _ in range(150)} | {"zed", "an", "ann  bo", "zed zed"})
    index = search.word_index(spark.createDataFrame([(n,) for n in names], "name string"))
    got = {tuple(r) for r in search.names_with_runs(spark.createDataFrame([(r,) for r in runs], "run string"), index).collect()}
    assert got == {(r, n) for r in runs for n in names if f" {r} " in f" {n} "}
    assert index.count() == sum(2 * len(n.split(" ")) - 1 for n in names)


def test_guesses_with_gaps(spark):
    players = spark.createDataFrame([(5, "Ann Bo"), (3, "ANN BO"), (4, "Cy Ann"), (9, None), (None, "Ann Bo")], "id bigint, full_name string")
    members = spark.createDataFrame([("k", 5), ("k", 3), ("k", 3), ("j", 4), (None, 4), ("k", None)], "category string, player_id bigint")
    guesses = spark.createDataFrame([
        (1, " ann ", "b", "k"), (2, "Ann Bo", "A", "k"), (3, "ann", "c", "j"), (4, "ann", "z", "j"), (5, "nn", "a", "k"),
        (6, None, "a", "k"), (7, "ann", None, "k"), (8, "ann", "a", None), (9, "", "a", "k"), (9, "", "a", "k")],
        "guess_id int, guess string, letter string, category string")
    got = sorted((r["guess_id"], r["valid"], r["player_id"], r["reason"]) for r in search.validated_guesses(guesses, players, members).collect())
    unknown, unmet = "unknown player", "requirements not met"
    assert got == [
        (1, True, 3, None), (2, True, 3, None), (3, True, 4, None), (4, False, None, unmet), (5, False, None, unknown), (6, False, None, unknown),
        (7, False, None, unmet), (8, False, None, unmet), (9, False, None, unknown), (9, False, None, unknown)]
