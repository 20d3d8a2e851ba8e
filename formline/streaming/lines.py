"""The stored lines of a stream, by week: the latest delivery of a row counts, and a batch reads the weeks that it touches.

An index of row ids tells where a row was before. A row that comes again with another entity, period or week is taken out of its
old place by a line marked as gone, so both places are known to have changed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators.zscore import Keys
from formline.sources.keyed_log import KeyedLog, id_slot

NO_DAY = -1_000_000  # the week of rows without a day


def week_of(day: str) -> Column:
    """Weeks from Monday, 5 January 1970."""
    return F.coalesce(F.floor(F.datediff(F.col(day), F.lit("1970-01-05").cast("date")) / 7).cast("bigint"), F.lit(NO_DAY).cast("bigint"))


def numbers(df: DataFrame, column: str) -> list[int]:
    """The distinct values of a column of weeks or slots, which are few."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


class LineStore:
    """Lines below ``path`` in slots of a week, the id index beside them, and the arrivals of the last batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Keys = Keys()):
        self.spark, self.path, self.keys = spark, path, keys
        plain = T.StructType.fromDDL(schema)
        self.columns = plain.fieldNames()
        kinds = {f.name: f for f in plain.fields}
        self.cell = [keys.entity, keys.period, "__week"]
        week, gone = T.StructField("__week", T.LongType()), T.StructField("__gone", T.BooleanType())
        self.schema = T.StructType([*plain.fields, week, gone])
        self.lines = KeyedLog(spark, f"{path}/lines", self.schema, [keys.row_id, *self.cell], F.col("__week"), once=True)
        place = T.StructType([kinds[keys.row_id], kinds[keys.entity], kinds[keys.period], week])
        self.ids = KeyedLog(spark, f"{path}/ids", place, [keys.row_id], id_slot(place, keys.row_id), once=True)

    def write(self, batch: DataFrame, number: int) -> DataFrame:
        """Keep a batch, rows repeated inside it once; returns its lines and those that it takes out of other places.

        ``number`` rises from batch to batch; a repeated batch replaces itself.
        """
        k, staged = self.keys, f"{self.path}/staged/batch={number}"
        one = batch.groupBy(k.row_id).agg(F.max_by(F.struct(*self.columns), F.xxhash64(*self.columns)).alias("r")).select("r.*")
        one.withColumn("__week", week_of(k.when)).write.mode("overwrite").parquet(f"{staged}/in")
        fresh = self.spark.read.schema(T.StructType(self.schema.fields[:-1])).parquet(f"{staged}/in")
        slots = numbers(fresh.select(self.ids.slot.alias("slot")), "slot")
        was = self.ids.read(slots, number).withColumnsRenamed({c: f"was_{c}" for c in (k.row_id, *self.cell)})
        moved = fresh.join(was, F.col(k.row_id) == F.col(f"was_{k.row_id}"))
        same = F.lit(True)
        for c in self.cell:
            same &= F.col(c).eqNullSafe(F.col(f"was_{c}"))
        taken = moved.filter(~same).select(k.row_id, *[F.col(f"was_{c}").alias(c) for c in self.cell], F.lit(True).alias("__gone"))
        both = fresh.withColumn("__gone", F.lit(False)).unionByName(taken, allowMissingColumns=True)
        both.write.mode("overwrite").parquet(f"{staged}/out")
        arrivals = self.spark.read.schema(self.schema).parquet(f"{staged}/out")
        self.lines.write(arrivals, number, numbers(arrivals, "__week"))
        self.ids.write(arrivals.filter("not __gone"), number, slots)
        self.lines.delete(f"{self.path}/staged/batch={n}" for n in (number - 2, number - 3))
        return arrivals

    def rows(self, weeks: Iterable[int], before: int) -> DataFrame:
        """The lines of some weeks as they stand before batch ``before``, with their week; other weeks are not read."""
        return self.lines.read(weeks, before).filter("not __gone").drop("__gone")

    def is_empty(self) -> bool:
        return not self.lines.slots()
