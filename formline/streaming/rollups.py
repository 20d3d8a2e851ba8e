"""Season rollups kept current by retraction: what a row said before is taken out, what it says now is put in.

A batch reads the lines of the weeks that it touches as they were and as they are. The difference of their sums is added to the
stored rollup row of each (player, team, season, type) that really changed; no season is computed again. First and last day
are no sums: a row keeps its ``KEPT`` earliest and latest days with how many games each has. Only if all days that a
row keeps of a longer list are taken out is that row made again from its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators.rollups import SEASON_TYPES, SUM_COLUMNS
from formline.operators.zscore import Keys
from formline.sources.keyed_log import KeyedLog, hash_slot
from formline.streaming.lines import LineStore, numbers

KEPT = 8
GROUP = ["player_id", "team_id", "season", "type"]
#: Stored sums and the addend of a row; plus-minus in millionths, so that what is taken out is exactly what was put in.
ADDENDS = {
    "games_played": "1L", **{c: f"coalesce(cast({c} as bigint), 0L)" for c in SUM_COLUMNS},
    "plus_minus": "coalesce(cast(round(plus_minus * 1000000) as bigint), 0L)", "seconds": "coalesce(cast(min_seconds as bigint), 0L)", "with_seconds": "if(min_seconds is null, 0L, 1L)",
}


def summed_days(*days: Column) -> Column:
    """Arrays of (day, n) as one, with the n of a day added up and days of no games left out, in the order of days."""
    both = F.concat(*days)
    distinct = F.array_sort(F.array_distinct(F.transform(both, lambda d: d["day"])))
    added = F.transform(distinct, lambda day: F.struct(
        day.alias("day"), F.aggregate(F.filter(both, lambda d: d["day"] == day), F.lit(0).cast("bigint"), lambda n, d: n + d["n"]).alias("n")))
    return F.filter(added, lambda d: d["n"] > 0)


class RollupStream:
    """Lines by week and rollup rows by season below ``root``."""

    def __init__(self, spark: SparkSession, root: str, lines_schema: str, row_id: str = "id", kept: int = KEPT):
        self.spark, self.kept = spark, kept
        keys = Keys(when="date", row_id=row_id)
        self.lines = LineStore(spark, f"{root}/lines", lines_schema, keys)
        kinds = {f.name: f for f in T.StructType.fromDDL(lines_schema).fields}
        self.day = kinds["date"].dataType
        days = f"array<struct<day:{self.day.simpleString()},n:bigint>>"
        sums = ", ".join(f"{c} bigint" for c in ADDENDS)
        schema = T.StructType([kinds["player_id"], kinds["team_id"], kinds["season"], *T.StructType.fromDDL(f"type string, {sums}, low {days}, high {days}, whole boolean").fields])
        self.rows = KeyedLog(spark, f"{root}/rollups", schema, GROUP, hash_slot("season", slots=1 << 20))

    def _by_group(self, signed: DataFrame) -> DataFrame:
        """Sums and days of each group of lines that carry a ``sign``."""
        types = F.array_compact(F.array(*[F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(name)) for name, flag in SEASON_TYPES.items()]))
        by_day = signed.withColumn("type", F.explode(types)).groupBy(*GROUP, F.col("date").alias("day")).agg(
            F.sum("sign").alias("n"), *[F.expr(f"sum(sign * {e}) as __{c}") for c, e in ADDENDS.items()])
        # At most one entry for each day of a season.
        entry = F.when(F.col("day").isNotNull() & (F.col("n") != 0), F.struct("day", "n"))
        return by_day.groupBy(*GROUP).agg(*[F.sum(f"__{c}").alias(c) for c in ADDENDS], F.collect_list(entry).alias("days"))

    def _row(self, groups: DataFrame) -> DataFrame:
        """Stored rows of groups that were summed from nothing."""
        ordered = summed_days(F.col("days"))
        return groups.withColumn("days", ordered).select(
            *GROUP, *ADDENDS, F.slice("days", 1, self.kept).alias("low"),
            F.slice(F.reverse("days"), 1, self.kept).alias("high"), (F.size("days") <= self.kept).alias("whole"))

    def process(self, batch: DataFrame, number: int) -> None:
        arrivals = self.lines.write(batch, number)
        touched, weeks = arrivals.select(*self.lines.cell).distinct(), numbers(arrivals, "__week")
        now, was = (self.lines.rows(weeks, n).join(touched, self.lines.cell, "left_semi") for n in (number + 1, number))
        moves = self._by_group(now.withColumn("sign", F.lit(1)).unionByName(was.withColumn("sign", F.lit(-1))))
        moves = moves.filter(" or ".join([f"{c} <> 0" for c in ADDENDS] + ["size(days) > 0"]))
        slots = numbers(arrivals.select(self.rows.slot.alias("slot")), "slot")
        none = F.array().cast(self.rows.schema["low"].dataType)
        old = self.rows.read(slots, number).select(*GROUP, *[F.col(c).alias(f"__{c}") for c in [*ADDENDS, "low", "high", "whole"]])
        both = moves.join(old, GROUP, "left").withColumns({
            "__low": F.coalesce("__low", none), "__high": F.coalesce("__high", none), "__whole": F.coalesce("__whole", F.lit(True)),
        })
        # Of a list that is not whole, days beyond its last entry are unknown: they neither enter nor leave it.
        in_low = F.filter("days", lambda d: F.col("__whole") | (d["day"] <= F.array_max(F.transform("__low", lambda x: x["day"]))))
        in_high = F.filter("days", lambda d: F.col("__whole") | (d["day"] >= F.array_min(F.transform("__high", lambda x: x["day"]))))
        low, high = summed_days(F.col("__low"), in_low), F.reverse(summed_days(F.col("__high"), in_high))
        merged = both.withColumns({"__low": low, "__high": high}).select(
            *GROUP, *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in ADDENDS],
            F.slice("__low", 1, self.kept).alias("low"), F.slice("__high", 1, self.kept).alias("high"), (F.col("__whole") & (F.size("__low") <= self.kept)).alias("whole"),
        )
        self.rows.write(merged, number, slots)
        spent = self.rows.read(slots, number + 1).filter("games_played > 0 and not whole and (size(low) = 0 or size(high) = 0)").select(*GROUP)
        if not spent.isEmpty():
            self._again(merged, spent, slots, number)

    def _again(self, merged: DataFrame, spent: DataFrame, slots: list[int], number: int) -> None:
        """Make the rows of ``spent`` from their lines, whatever weeks they are in."""
        path = f"{self.lines.path}/staged/batch={number}/spent"
        spent.write.mode("overwrite").parquet(path)
        spent = self.spark.read.schema(spent.schema).parquet(path)
        mine = self.lines.rows(self.lines.lines.slots(), number + 1).join(spent, ["player_id", "team_id", "season"], "left_semi")
        whole = self._row(self._by_group(mine.withColumn("sign", F.lit(1))).join(spent, GROUP, "left_semi"))
        self.rows.write(merged.join(spent, GROUP, "left_anti").unionByName(whole), number, slots)

    def rollups(self) -> DataFrame:
        """The rollup rows, in the form of the batch operator."""
        return self.rows.read().filter("games_played > 0").select(
            *GROUP, F.get("low", F.lit(0))["day"].alias("start_date"), F.get("high", F.lit(0))["day"].alias("end_date"), "games_played", *SUM_COLUMNS,
            (F.col("plus_minus") / 1e6).alias("plus_minus"), F.when(F.col("with_seconds") > 0, F.col("seconds")).alias("min_seconds"), F.lit(True).alias("is_detailed"),
        )

    def start(self, source: DataFrame, checkpoint: str):
        return (
            source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
