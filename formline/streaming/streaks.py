"""Incremental streaks as an algebra of segments.

The rows of an entity in one week make a segment: for each type and competition its leading run, the runs closed inside it, its
trailing run, and whether it has a break. Segments that follow each other merge to a segment of the same form, in any grouping:
a trailing run, the whole runs of unbroken segments after it and the leading run of the next broken one are one run. So a row
that arrives, late or corrected or not, changes one segment, made again from the lines of its week alone, and no line of another
week is read. Runs across weeks are put together from the segments when the streaks are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators.running import parts_of
from formline.operators.streaks import COMPETITIONS, criteria, grouped_runs, streak_cells
from formline.operators.zscore import Keys
from formline.sources.keyed_log import KeyedLog
from formline.streaming.lines import NO_DAY, LineStore, numbers

HISTORY = -1  # the batch number of a bootstrap


def segments(lines: DataFrame, cell: list[str], rules: dict[str, Column], competitions: dict[str, str] = COMPETITIONS, keys: Keys = Keys(), parts: int | None = None) -> DataFrame:
    """The runs of each cell: island 0 leads, the last may be open at the end; a run of length 0 only says that the cell begins with a break.

    A cell is an entity's week, so its rows are few and one window numbers them. The last row of each competition
    is a run of its own, without a type.
    """
    numbered = streak_cells(lines, rules, competitions, keys, cell, parts)
    place = F.struct(F.col(keys.when).alias("day"), F.col(keys.tie).alias("game"))
    runs = grouped_runs(numbered, cell, keys).filter("length > 0 or island = 0")
    flags = F.array_compact(F.array(*[F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(comp)) for comp, flag in competitions.items()]))
    finals = lines.withColumn("competition_type", F.explode(flags)).groupBy(*cell, "competition_type").agg(F.max(place).alias("last"))
    return runs.unionByName(finals, allowMissingColumns=True)


def merged_runs(found: DataFrame, entity: str, week: str, parts: int | None = None) -> DataFrame:
    """All runs of all entities from their segments, in the form of :func:`formline.operators.streaks.islands`.

    A leading run belongs to what was open before its week, so it is numbered by the broken weeks before; an open trailing run
    by those up to its own week. Pieces with one number are one run. A week has one leading run, which its first break closes,
    and at most one open trailing run, which comes after it: one window numbers both.
    """
    group = [entity, "streak_type", "competition_type"]
    found = found.filter("streak_type is not null")
    closing = F.expr("if(island = 0 and broken_on is not null, 1L, 0L)")
    # As many rows as an entity has weeks, twice at most.
    upto = F.sum("closing").over(Window.partitionBy(*group).orderBy(week, "island").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A break without a day leaves runs of the week without days open: of those only the largest counts.
    ends = ["length", "first", "last", "broken_on"]
    dayless = (F.col(week) == NO_DAY) & (F.col("island") > 0)
    pieces = found.filter("island = 0 or broken_on is null")
    largest = pieces.filter(dayless).groupBy(*group, week).agg(F.max(F.struct(*ends)).alias("r")).select(*group, week, F.lit(1).cast("bigint").alias("island"), "r.*")
    pieces = pieces.filter(~dayless).select(*largest.columns).unionByName(largest).withColumn("closing", closing)
    pieces = (pieces.repartition(parts, *group) if parts else pieces).withColumn("number", upto - F.col("closing"))
    at = F.when(F.col("length") > 0, F.col(week) * 2 + (F.col("island") > 0).cast("int"))  # orders the pieces of a run
    across = pieces.groupBy(*group, "number").agg(
        F.sum("length").alias("length"), *[f(F.col(f"{x}.{c}"), at).alias(f"{x}_{c}") for x, f in (("first", F.min_by), ("last", F.max_by)) for c in ("day", "game")],
        F.max("broken_on").alias("broken_on"),
    )
    ends = [F.struct(F.col(f"{x}_day").alias("day"), F.col(f"{x}_game").alias("game")).alias(x) for x in ("first", "last")]
    across = across.select(*group, "length", *ends, "broken_on")
    inside = found.filter("island > 0 and broken_on is not null").select(*across.columns)
    return across.unionByName(inside).filter("length > 0")


class StreakStream:
    """Detector with its tables below ``root``: lines and segments, both by week."""

    def __init__(
        self, spark: SparkSession, root: str, lines_schema: str, keys: Keys = Keys(), rules: Callable[[], dict[str, Column]] = criteria,
        competitions: dict[str, str] = COMPETITIONS,
    ):
        self.spark, self.keys, self.rules, self.competitions = spark, keys, rules, competitions
        self.lines = LineStore(spark, f"{root}/lines", lines_schema, keys)
        self.cell = [keys.entity, "__week"]
        kinds = dict(spark.createDataFrame([], lines_schema).dtypes)
        place = f"struct<day:{kinds[keys.when]},game:{kinds[keys.tie]}>"
        schema = f"{keys.entity} {kinds[keys.entity]}, __week bigint, streak_type string, competition_type string, island bigint, length bigint, first {place}, last {place}, broken_on {kinds[keys.when]}"
        self.segments = KeyedLog(spark, f"{root}/segments", T.StructType.fromDDL(schema), self.cell, F.col("__week"), many=True, payload="competition_type")

    def bootstrap(self, history: DataFrame) -> bool:
        """Load history into an empty detector, before its first batch; a detector that has lines is left as it is."""
        if not self.lines.is_empty():
            return False
        self.process(history, HISTORY)
        return True

    def process(self, batch: DataFrame, number: int) -> None:
        """Store one micro-batch and make the segments again that it touches."""
        arrivals = self.lines.write(batch, number)
        touched = arrivals.select(*self.cell).distinct()
        weeks = numbers(arrivals, "__week")
        mine = self.lines.rows(weeks, number + 1).join(touched, self.cell, "left_semi")
        made = segments(mine, self.cell, self.rules(), self.competitions, self.keys, parts_of(arrivals))
        self.segments.write(made.unionByName(touched, allowMissingColumns=True), number, weeks)

    def streaks(self, active: DataFrame) -> DataFrame:
        """All streaks so far, in the form of the batch operator."""
        k, now = self.keys, self.segments.read()
        finals = now.filter("streak_type is null").groupBy(k.entity, "competition_type").agg(F.max("last").alias("final"))
        flagged = active.select(k.entity).distinct().withColumn("__entity_active", F.lit(True))
        is_active = (
            F.col("broken_on").isNull() & F.coalesce(F.col("__entity_active"), F.lit(False)) & F.coalesce(F.col("last.game") == F.col("final.game"), F.lit(False))
        )
        return (
            merged_runs(now, k.entity, "__week", parts_of(self.segments.stored(), 300_000)).join(finals, [k.entity, "competition_type"], "left").join(flagged, k.entity, "left")
            .withColumn("is_active", is_active)
            .select(
                k.entity, "streak_type", "competition_type", "length", "is_active", F.col("first.day").alias("started_at"),
                F.when(F.col("broken_on").isNotNull(), F.col("broken_on")).when(~F.col("is_active"), F.col("last.day")).alias("ended_at"),
                F.col("first.game").alias("first_game_id"), F.col("last.game").alias("last_game_id"),
            )
        )

    def start(self, source: DataFrame, checkpoint: str):
        return (
            source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
