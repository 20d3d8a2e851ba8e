"""Categories as bitmaps: a bit for each player, in buckets of 32,768 ids.

A bitmap does not mind repeated rows, so facts need not be made unique first, and members of several categories are an AND of
bitmaps instead of joins of memberships. A category costs 4 KB a bucket, whatever the number of facts behind it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 32_768  # fixed by the bitmap functions
_BUCKET_BYTES = BUCKET_BITS // 8


def marks(rows: DataFrame, rules: Mapping[str, Column], id_col: str = "player_id") -> DataFrame:
    """(category, player_id) for each rule that a row fits; a rule that is null does not fit. Repeats stay."""
    fitting = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(F.col(id_col).alias("player_id"), F.explode(fitting).alias("category")).select("category", "player_id")


def bitmaps(marked: DataFrame) -> DataFrame:
    """(category, bucket, bits) of (category, player_id) rows; rows without an id are left out."""
    once = marked.filter("player_id is not null").distinct()  # hashed before the bitmap aggregate, which sorts its input
    return once.groupBy("category", F.bitmap_bucket_number("player_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("player_id")).alias("bits"))


def united(parts: Sequence[DataFrame]) -> DataFrame:
    """(category, bucket, bits) of several such frames, a row for each category and bucket."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("category", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def intersections(maps: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(category, bucket, bits) of the players in all categories of each group; ``category`` is the name of the group.

    ``maps`` has one row for each category and bucket. A bitmap goes once to each group that it is part of; a bucket that one
    of the group's categories lacks has no common players.
    """
    listed = F.array(*[
        F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, sorted(set(of)))).alias("parts")) for name, of in groups.items()
    ])
    mine = maps.select(F.explode(F.filter(listed, lambda g: F.array_contains(g["parts"], F.col("category")))).alias("g"), "bucket", "bits")
    both = mine.groupBy(F.col("g.name").alias("category"), "bucket").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"), F.first(F.size("g.parts")).alias("parts"))
    return both.filter("n = parts").select("category", "bucket", "bits")


def pair_counts(maps: DataFrame, names: Sequence[str]) -> DataFrame:
    """(first, second, n_players) for all pairs of categories, also those without a common player."""
    pairs = {f"{a}\t{b}": (a, b) for a, b in combinations(sorted(names), 2)}
    sizes = intersections(maps, pairs).groupBy("category").agg(F.sum(F.bitmap_count("bits")).alias("n_players"))
    grid = maps.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in pairs.items()], "category string, first string, second string")
    return grid.join(sizes, "category", "left").select("first", "second", F.coalesce("n_players", F.lit(0)).cast("bigint").alias("n_players"))


def members(maps: DataFrame) -> DataFrame:
    """(category, player_id) of the set bits."""
    value = lambda at: F.conv(F.hex(F.substring("bits", at + 1, F.lit(1))), 16, 10).cast("int")
    filled = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(_BUCKET_BYTES - 1)), lambda at: F.struct(at.alias("at"), value(at).alias("value"))),
        lambda b: b["value"] > 0,
    )
    parts = maps.select("category", "bucket", F.explode(filled).alias("b"))
    bits = parts.select("category", "bucket", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).filter(F.getbit("b.value", F.col("bit")) == 1)
    place = (F.col("b.at") * 8 + F.col("bit")).cast("bigint")
    return bits.select(
        "category",
        F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BUCKET_BITS + place + 1).otherwise(F.col("bucket") * BUCKET_BITS - place).alias("player_id"),
    )


def roster_bitmaps(
    stays: DataFrame, teams: DataFrame, people: DataFrame, chosen: Mapping[str, Column], both: str, first: str = "East", second: str = "West",
) -> DataFrame:
    """Bitmaps of the categories that rest on who played where, from one pass over ``stays`` (player_id, team_id, season).

    For each entry of ``chosen`` (a rule over ``people``): the players that shared a team and season with any *other* player
    that fits the rule. ``both`` names the category of players with stays in two conferences. A team and season is one bitmap
    a bucket, split by who is chosen: those not chosen are companions if the other part holds anybody, those chosen if it
    holds a second one. Stays without a team or season make no companions; repeats do not matter. The window runs over the
    bitmaps of a team and season, which are bounded by the ids (4 KB for 32,768), not by the rows.
    """
    names = list(chosen)
    flags = people.select(F.col("id").alias("player_id"), *[F.coalesce(rule, F.lit(False)).alias(f"is_{k}") for k, rule in enumerate(chosen.values())])
    sides = teams.select(F.col("id").alias("team_id"), "conference")
    stints = stays.filter("player_id is not null").select("player_id", "team_id", "season").distinct()
    known = stints.join(flags, "player_id", "left").join(sides, "team_id", "left")
    is_chosen = [F.coalesce(f"is_{k}", F.lit(False)).alias(f"is_{k}") for k in range(len(names))]
    rosters = known.groupBy("team_id", "season", "conference", F.bitmap_bucket_number("player_id").alias("bucket"), *is_chosen).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("player_id")).alias("bits"))
    squad = Window.partitionBy("team_id", "season")
    sizes = [F.sum(F.when(F.col(f"is_{k}"), F.bitmap_count("bits")).otherwise(0)).over(squad).alias(f"n_{k}") for k in range(len(names))]
    counted = rosters.select("*", *sizes)
    whole = F.col("team_id").isNotNull() & F.col("season").isNotNull()
    found = [F.when(whole & (F.col(f"n_{k}") > F.col(f"is_{k}").cast("int")), F.lit(name)) for k, name in enumerate(names)]
    found += [F.when(F.col("conference").isin(first, second), F.concat(F.lit(f"{both}\t"), "conference"))]
    pieces = counted.select("bucket", "bits", F.explode(F.array_compact(F.array(*found))).alias("category"))
    maps = pieces.groupBy("category", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return intersections(maps, {n: [n] for n in names} | {both: [f"{both}\t{first}", f"{both}\t{second}"]})
