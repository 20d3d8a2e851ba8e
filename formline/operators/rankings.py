"""Rankings: several boards from one pass, and the biographic ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.people import height_inches


@dataclass(frozen=True)
class Board:
    """Rows that ``keep`` holds for, least ``order`` first (whole numbers, nulls in front), with what the board shows."""

    keep: Column
    order: Sequence[Column]
    value: Column
    detail: Column


def top_boards(rows: DataFrame, boards: dict[str, Board], key: str, carry: Sequence[str] = (), limit: int = 10) -> DataFrame:
    """The first ``limit`` rows of every board: ``criterion``, ``place``, the key, ``carry``, ``value``, ``detail``.

    A board reads its columns alone, and a task keeps no more than the first ``limit`` rows of it, however many rows it reads: nothing
    is sorted, and what is moved depends on tasks and boards. Ties go by ``key``.
    """
    width = max(len(b.order) for b in boards.values())
    firsts = []
    for name, b in boards.items():
        order = [c.cast("bigint") for c in b.order] + [F.lit(0).cast("bigint")] * (width - len(b.order))
        cells = rows.filter(b.keep).select(
            key, *carry, F.lit(name).alias("criterion"), F.array(*order).alias("__rank"), b.value.alias("value"), b.detail.alias("detail"))
        firsts.append(cells.orderBy("__rank", key).limit(limit))
    first = Window.partitionBy("criterion").orderBy("__rank", key)
    placed = reduce(DataFrame.unionAll, firsts).withColumn("place", F.row_number().over(first))
    return placed.filter(F.col("place") <= limit).drop("__rank")


def _text(column: str, missing: str):
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(missing))


def _joined(*parts):
    return F.concat(*parts)


def _boards() -> dict[str, Board]:
    origin = _joined(_text("position", "N/A"), F.lit(" | "), _text("country", "N/A"))
    build = _joined(_text("height", "N/A"), F.lit(" | "), _text("position", "N/A"))
    since = _joined(F.lit("Desde "), _text("from_year", "?"), F.lit(" | "), _text("position", "N/A"))
    draft = _joined(F.lit("Draft "), _text("draft_year", "?"), F.lit(" Ronda "), _text("draft_round", "?"))
    born, weighed, tall = F.col("birthdate").isNotNull(), F.col("weight") > 0, F.col("height").isNotNull()
    picked = F.col("draft_number") > 0
    day, born_on = F.date_format("birthdate", "yyyy-MM-dd"), F.unix_date("birthdate")
    pick, weight = F.col("draft_number").cast("string"), F.col("weight").cast("string")
    return {
        "youngest": Board(born, [-born_on], day, origin),
        "oldest": Board(born, [born_on], day, origin),
        "heaviest": Board(weighed, [-F.col("weight")], weight, build),
        "lightest": Board(weighed, [F.col("weight")], weight, build),
        "tallest": Board(tall, [-height_inches(F.col("height"), 0)], F.col("height"), origin),
        "shortest": Board(tall, [height_inches(F.col("height"), 999)], F.col("height"), origin),
        "most_experienced": Board(F.col("season_exp").isNotNull(), [-F.col("season_exp")], F.col("season_exp").cast("string"), since),
        "highest_draft_pick": Board(picked, [F.col("draft_number"), -F.col("draft_year")], pick, draft),
        "lowest_draft_pick": Board(picked, [-F.col("draft_number"), -F.col("draft_year")], pick, draft),
    }


CRITERIA = [
    "youngest", "oldest", "heaviest", "lightest", "tallest", "shortest",
    "most_experienced", "highest_draft_pick", "lowest_draft_pick",
]


def biographic_rankings(players: DataFrame, criteria: Sequence[str] = tuple(CRITERIA), active_only: bool = True, limit: int = 10) -> DataFrame:
    """Top players by each of the criteria: criterion, place, id, name, value as text, detail text."""
    known = _boards()
    for criterion in criteria:
        if criterion not in known:
            raise ValueError(f"unknown criterion {criterion!r}, use one of {CRITERIA}")
    rows = players.filter("is_active") if active_only else players
    found = top_boards(rows, {c: known[c] for c in criteria}, "id", ["full_name"], limit)
    return found.select("criterion", "place", "id", "full_name", "value", "detail")


def biographic_ranking(players: DataFrame, criterion: str, active_only: bool = True, limit: int = 10) -> DataFrame:
    """Top players by one criterion: id, name, value as text, detail text."""
    found = biographic_rankings(players, [criterion], active_only, limit)
    return found.orderBy("place").select("id", "full_name", "value", "detail")
