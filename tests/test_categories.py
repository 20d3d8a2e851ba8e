from __future__ import annotations

import random
from itertools import combinations

from conftest import rows

from pyspark.sql import functions as F

from formline.operators import categories, relations

IDS = [-70_000, -32_768, -1, 0, 1, 2, 32_768, 32_769, 65_537, 1_000_000, 5_000_000_000]


def test_bits_come_back_as_their_ids(spark):
    marked = spark.createDataFrame([("a", i) for i in IDS] * 2 + [("a", None), ("b", 1)], "category string, player_id bigint")
    maps = categories.bitmaps(marked)
    assert sorted(r["player_id"] for r in categories.members(maps.filter("category = 'a'")).collect()) == IDS
    assert rows(categories.members(categories.bitmaps(marked.filter("category = 'none'")))) == []


def test_groups_of_categories_against_sets(spark):
    rng = random.Random(5)
    sets = {c: {rng.randrange(-40_000, 140_000) for _ in range(400)} | set(rng.sample(IDS, 5)) for c in "abcd"} | {"e": set()}
    maps = categories.bitmaps(spark.createDataFrame([(c, i) for c, ids in sets.items() for i in ids], "category string, player_id bigint"))
    groups = {"two": ["a", "b"], "three": ["d", "a", "c"], "one": ["c"], "empty": ["a", "e"]}
    got = {g: set() for g in groups}
    for r in categories.members(categories.intersections(maps, groups)).collect():
        got[r["category"]].add(r["player_id"])
    assert got == {g: set.intersection(*(sets[c] for c in of)) for g, of in groups.items()}
    want = [(a, b, len(sets[a] & sets[b])) for a, b in combinations("abcde", 2)]
    assert rows(categories.pair_counts(maps, "edcba")) == want


def test_roster_categories_against_pairs(spark):
    rng = random.Random(6)
    ids = [rng.randrange(1, 100_000) for _ in range(60)]
    people = [(i, rng.choice(["Spain", "France", "USA", None])) for i in ids[:50]]  # ten players have no biography
    sides = [(t, rng.choice(["East", "West", "North", None])) for t in range(1, 9)]
    stays = [(rng.choice(ids), rng.choice([*range(1, 10), None]), rng.choice(["2001-02", "2002-03", "2003-04", None])) for _ in range(150)] * 2
    stays += [(ids[0], 1, "1999-00")] * 40 + [(None, 1, "2001-02")]  # a team of one player is nobody's companion
    nation, conference, star = dict(people), dict(sides), ids[3]
    want = {"mate": set(), "star_mate": set(), "both": set()}
    for p, t, s in stays:
        for q, u, v in stays:
            if None not in (p, q, t, s) and (t, s) == (u, v) and p != q:
                want["mate"] |= {p} if nation.get(q) == "Spain" else set()
                want["star_mate"] |= {p} if q == star else set()
    for p in ids:
        seen = {conference.get(t) for q, t, _ in stays if q == p}
        want["both"] |= {p} if {"East", "West"} <= seen else set()
    df = spark.createDataFrame(stays, "player_id bigint, team_id bigint, season string")
    maps = categories.roster_bitmaps(
        df, spark.createDataFrame(sides, "id bigint, conference string"), spark.createDataFrame(people, "id bigint, country string"),
        {"mate": F.col("country") == "Spain", "star_mate": F.col("id") == star}, "both",
    )
    got = {c: set() for c in want}
    for r in categories.members(maps).collect():
        got[r["category"]].add(r["player_id"])
    assert got == want and all(want.values())
    chosen = spark.createDataFrame([p for p in people if p[1] == "Spain"], "player_id bigint, country string")
    assert {r[0] for r in relations.companions_of(df, chosen).collect()} == want["mate"]
