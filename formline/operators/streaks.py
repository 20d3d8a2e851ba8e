"""Streaks of rows that meet a criterion: extend, break or freeze, per entity and competition."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.boxline import is_triple_double
from formline.operators.running import Running, running
from formline.operators.zscore import Keys

# Competitions by game flag, share of the record that counts as historic,
# shooting criteria with their least relevant length, placeholder of an empty record.
COMPETITIONS = {"regular": "rs", "playoffs": "po", "nba_cup": "ist"}
HISTORIC_SHARE = 0.7
SHOOTING_TYPES = ["fg_pct_60", "fg3_pct_50", "ft_pct_90"]
PLACEHOLDER_DAY = "1983-10-01"
PLACEHOLDER_GAME = "0000000001"
MIN_SECONDS = 60


def _at_least(column: str, level: int) -> Column:
    return F.coalesce(F.col(column), F.lit(0)) >= level


def _rate(attempts: str, rate: str, level: float) -> Column:
    """Null (frozen) without attempts."""
    return F.when(F.coalesce(F.col(attempts), F.lit(0)) != 0, F.coalesce(F.col(rate), F.lit(0.0)) >= level)


def criteria(selected: Sequence[str] | None = None) -> dict[str, Column]:
    """Registry of row predicates: true extends, false breaks, null freezes. Unknown names are an error."""
    known = {
        "pts_20": _at_least("pts", 20),
        "pts_30": _at_least("pts", 30),
        "pts_40": _at_least("pts", 40),
        "triple_double": is_triple_double(),
        "reb_10": _at_least("reb", 10),
        "ast_10": _at_least("ast", 10),
        "fg_pct_60": _rate("fga", "fg_pct", 0.60),
        "fg3_pct_50": _rate("fg3a", "fg3_pct", 0.50),
        "ft_pct_90": _rate("fta", "ft_pct", 0.90),
    }
    if selected is None:
        return known
    unknown = sorted(set(selected) - set(known))
    if unknown:
        raise ValueError(f"unknown streak types: {unknown}")
    return {name: known[name] for name in selected}


def streak_rows(
    lines: DataFrame,
    rules: dict[str, Column] | None = None,
    competitions: dict[str, str] = COMPETITIONS,
    keys: Keys = Keys(),
    parts: int | None = None,
) -> DataFrame:
    """Long form of the rows that extend or break: (entity, type, competition, day, game, place, met, island).

    ``island`` counts the breaks before the row, so a run and the break that ends
    it share a number; ``place`` numbers the entity's rows. All type/competition
    counters run in one window over the entity, before the rows are multiplied;
    grouping by entity and more columns then needs no further exchange. A row becomes
    up to 27 rows: ``parts`` bounds what a task makes of its share (see :func:`running`).
    """
    rules = criteria() if rules is None else rules

    def counted(base: DataFrame, sums: dict[str, Column]) -> DataFrame:
        return running(base, [keys.entity], [keys.when, keys.tie], {name: Running(c) for name, c in sums.items()}, parts=parts)

    return _pair_rows(lines, rules, competitions, keys, [keys.entity], counted)


def streak_cells(
    lines: DataFrame, rules: dict[str, Column], competitions: dict[str, str], keys: Keys, cell: Sequence[str], parts: int | None = None,
) -> DataFrame:
    """:func:`streak_rows` with the breaks counted inside each cell only, the rows of which are few."""
    order = Window.partitionBy(*cell).orderBy(keys.when, keys.tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def counted(base: DataFrame, sums: dict[str, Column]) -> DataFrame:
        dealt = base.repartition(parts, *cell) if parts else base
        return dealt.withColumns({name: F.coalesce(F.sum(c).over(order), F.lit(0)) for name, c in sums.items()})

    return _pair_rows(lines, rules, competitions, keys, cell, counted)


def _pair_rows(
    lines: DataFrame, rules: dict[str, Column], competitions: dict[str, str], keys: Keys, group: Sequence[str],
    counted: Callable[[DataFrame, dict[str, Column]], DataFrame],
) -> DataFrame:
    played = F.col(keys.seconds) >= MIN_SECONDS
    base = lines.select(
        *group, keys.when, keys.tie,
        *[F.when(played, met).alias(f"met_{name}") for name, met in rules.items()],
        *[F.coalesce(F.col(flag), F.lit(False)).alias(f"in_{comp}") for comp, flag in competitions.items()],
    )
    pairs = [(rule, comp) for comp in competitions for rule in rules]
    sums = {f"brk_{rule}_{comp}": (F.col(f"in_{comp}") & ~F.col(f"met_{rule}")).cast("int").cast("bigint") for rule, comp in pairs}
    cells = F.array(*[
        F.struct(
            F.lit(rule).alias("streak_type"), F.lit(comp).alias("competition_type"),
            F.when(F.col(f"in_{comp}"), F.col(f"met_{rule}")).alias("met"),
            F.coalesce(F.col(f"brk_{rule}_{comp}"), F.lit(0).cast("bigint")).alias("breaks"),
        )
        for rule, comp in pairs
    ])
    live = F.filter(cells, lambda c: c["met"].isNotNull())
    return (
        counted(base, sums | {"place": F.lit(1).cast("bigint")}).select(*group, keys.when, keys.tie, "place", F.inline(live))
        .withColumn("island", F.col("breaks") - (~F.col("met")).cast("int"))
        .drop("breaks")
    )


def run_columns(keys: Keys = Keys()) -> list[Column]:
    """Length, first and last met row and breaking day of a group of rows.

    Everything kept while rows are added up has a fixed width (if the ids have), so Spark aggregates by hash and sorts nothing.
    """
    met, when, tie = F.col("met"), F.col(keys.when), F.col(keys.tie)
    place = F.when(met, F.col("place"))
    return [
        F.count_if(met).alias("length"),
        F.min_by(when, place).alias("__first_day"), F.min_by(tie, place).alias("__first_game"),
        F.max_by(when, place).alias("__last_day"), F.max_by(tie, place).alias("__last_game"),
        F.min(F.when(~met, when)).alias("broken_on"),
    ]


def grouped_runs(rows: DataFrame, group: Sequence[str], keys: Keys = Keys()) -> DataFrame:
    """The rows of :func:`streak_rows` brought together by ``group``, type, competition and island."""
    ends = [F.when(F.col("length") > 0, F.struct(F.col(f"__{x}_day").alias("day"), F.col(f"__{x}_game").alias("game"))).alias(x) for x in ("first", "last")]
    return (
        rows.groupBy(*group, "streak_type", "competition_type", "island").agg(*run_columns(keys))
        .select(*group, "streak_type", "competition_type", "island", "length", *ends, "broken_on")
    )


def islands(rows: DataFrame, keys: Keys = Keys(), parts: int | None = None) -> DataFrame:
    """Length, first and last met row and breaking day of each run; ``parts`` tasks bring the runs together, if given."""
    if parts:
        rows = rows.repartition(parts, keys.entity, "streak_type", "competition_type", "island")
    return grouped_runs(rows, [keys.entity], keys).filter("length > 0")


def last_rows(lines: DataFrame, competitions: dict[str, str] = COMPETITIONS, keys: Keys = Keys()) -> DataFrame:
    """The entity's last row of each competition, counting rows without playing time too."""
    place = F.struct(F.col(keys.when).alias("day"), F.col(keys.tie).alias("game"))
    wide = lines.groupBy(keys.entity).agg(
        *[F.max(F.when(F.col(flag), place)).alias(comp) for comp, flag in competitions.items()]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("competition_type"), F.col(c).alias("final")) for c in competitions])
    return wide.select(keys.entity, F.inline(cells)).filter("final is not null")


def streaks(
    lines: DataFrame,
    active: DataFrame,
    rules: dict[str, Column] | None = None,
    competitions: dict[str, str] = COMPETITIONS,
    keys: Keys = Keys(),
    parts: int | None = None,
) -> DataFrame:
    """All streaks of all entities, without the historic badge.

    A broken streak ends on the day of the breaking row. An unbroken one is active
    if its entity is in ``active`` and its last row is also the entity's last row of
    the competition; otherwise it ends with its last row. With ``parts`` every step
    over rows or runs has so many tasks, whatever the session's number of shuffle
    partitions, and runs pass by a task's few last rows unsorted.
    """
    runs = islands(streak_rows(lines, rules, competitions, keys, parts), keys, parts)
    flagged = active.select(keys.entity).distinct().withColumn("entity_active", F.lit(True))
    finals = last_rows(lines, competitions, keys).join(flagged, keys.entity, "left")
    if parts:
        runs, finals = (side.repartition(parts, keys.entity, "competition_type") for side in (runs, finals))
        finals = finals.hint("shuffle_hash")
    is_active = (
        F.col("broken_on").isNull()
        & F.coalesce(F.col("entity_active"), F.lit(False))
        & F.coalesce(F.col("last.game") == F.col("final.game"), F.lit(False))
    )
    return (
        runs.join(finals, [keys.entity, "competition_type"], "left")
        .withColumn("is_active", is_active)
        .select(
            keys.entity, "streak_type", "competition_type", "length", "is_active",
            F.col("first.day").alias("started_at"),
            F.when(F.col("broken_on").isNotNull(), F.col("broken_on"))
            .when(~F.col("is_active"), F.col("last.day")).alias("ended_at"),
            F.col("first.game").alias("first_game_id"), F.col("last.game").alias("last_game_id"),
        )
    )


def streak_records(found: DataFrame, entity: str = "player_id") -> DataFrame:
    """Longest streak per (type, competition); ties go to the earliest start, then the lowest entity."""
    order = F.struct(
        F.col("length"), (-F.unix_date("started_at")).alias("start"), (-F.col(entity)).alias("low"),
    )
    detail = F.struct(entity, "length", "started_at", "ended_at", "first_game_id", "last_game_id")
    return (
        found.groupBy("streak_type", "competition_type").agg(F.max_by(detail, order).alias("best"))
        .select("streak_type", "competition_type", "best.*")
    )


def type_grid(spark, types: Sequence[str] | None = None, competitions: Sequence[str] = tuple(COMPETITIONS)) -> DataFrame:
    """Every (type, competition) pair: one literal row, expanded."""
    types = list(criteria()) if types is None else list(types)
    one = spark.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in competitions])).alias("competition_type")
    )
    return one.select(F.explode(F.array(*[F.lit(t) for t in types])).alias("streak_type"), "competition_type")


def complete_records(found: DataFrame, any_entity: int | None, entity: str = "player_id") -> DataFrame:
    """Records for every pair; pairs without a streak get the placeholder (length 1, 1983-10-01)."""
    grid = type_grid(found.sparkSession)
    records = streak_records(found, entity)
    missing = F.col("length").isNull()
    return grid.join(records, ["streak_type", "competition_type"], "left").select(
        "streak_type", "competition_type",
        F.when(missing, F.lit(any_entity)).otherwise(F.col(entity)).cast("bigint").alias(entity),
        F.coalesce("length", F.lit(1)).cast("bigint").alias("length"),
        F.when(missing, F.lit(PLACEHOLDER_DAY).cast("date")).otherwise(F.col("started_at")).alias("started_at"),
        "ended_at",
        F.when(missing, F.lit(PLACEHOLDER_GAME)).otherwise(F.col("first_game_id").cast("string")).alias("first_game_id"),
        F.col("last_game_id").cast("string").alias("last_game_id"),
    )


def historic_threshold(record_length: Column) -> Column:
    return F.greatest(F.lit(2).cast("bigint"), F.floor(record_length * HISTORIC_SHARE))


def with_badges(found: DataFrame, records: DataFrame) -> DataFrame:
    """Mark streaks that reach 70 percent of the record of their (type, competition).

    There is one record a pair, however many streaks, so the records go to the streaks.
    """
    limits = records.select("streak_type", "competition_type", historic_threshold(F.col("length")).alias("__limit"))
    return (
        found.join(F.broadcast(limits), ["streak_type", "competition_type"], "left")
        .withColumn("is_historical", F.coalesce(F.col("length") >= F.col("__limit"), F.lit(False)))
        .drop("__limit")
    )


def streak_summary(badged: DataFrame, records: DataFrame, competition: str = "regular") -> DataFrame:
    """Count, longest, mean length, historic count and threshold per type; types without streaks included."""
    stats = badged.filter(F.col("competition_type") == competition).groupBy("streak_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"),
        F.sum("length").alias("total_length"), F.count_if("is_historical").alias("historic"),
    )
    limits = records.filter(F.col("competition_type") == competition).select("streak_type", F.col("length").alias("record"))
    zero = F.lit(0).cast("bigint")
    return (
        type_grid(badged.sparkSession, competitions=[competition])
        .join(stats, "streak_type", "left").join(limits, "streak_type", "left")
        .select(
            "streak_type",
            F.coalesce("n", zero).alias("total_streaks"),
            F.coalesce("longest", zero).alias("max_length"),
            F.coalesce(F.try_divide(F.col("total_length"), F.col("n")), F.lit(0.0)).alias("avg_length"),
            F.coalesce("historic", zero).alias("notable_count"),
            historic_threshold(F.coalesce("record", F.lit(2).cast("bigint"))).alias("notable_threshold"),
        )
    )


def running_badges(rows: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """The row at which each streak first reaches 70 percent (at least 2) of the record *so far*.

    ``rows`` come from :func:`streak_rows`. The record so far is a running maximum
    per (type, competition) over all entities in time order.
    """
    group = [keys.entity, "streak_type", "competition_type", "island"]
    met = rows.filter("met")
    lengths = running(met, group, [keys.when, keys.tie], {"length": Running(F.lit(1).cast("bigint"))})
    pair = ["streak_type", "competition_type"]
    records = running(lengths, pair, [keys.when, keys.tie, keys.entity], {"__record": Running(F.col("length"), "max")})
    reached = records.withColumn("threshold", historic_threshold(F.col("__record"))).filter("length >= threshold")
    first = F.min(F.struct(keys.when, keys.tie, "length", "threshold")).alias("r")
    return reached.groupBy(*group).agg(first).select(keys.entity, "streak_type", "competition_type", "r.*")
