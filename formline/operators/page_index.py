"""Listings laid out in their order, so that a page far down costs what the first one costs.

``orderBy().offset()`` sends all rows before the page through one task. Here the listing is written once, by ranges of its
order, each row with its place in its range; a page is then a filter on range and place, which reads one page of rows,
and the page after a given row is found in the one range that can hold it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACES = (1 << 33) - 1  # monotonically_increasing_id: task number above 33 bits, row number of the task below


@dataclass(frozen=True)
class By:
    """One column of the order; nulls come first, or last where it is descending."""

    column: str
    descending: bool = False

    def sorting(self) -> Column:
        return F.desc(self.column) if self.descending else F.asc(self.column)

    def beyond(self, column: Column, value) -> Column:
        """True where the column comes after ``value``."""
        if self.descending:
            return F.lit(False) if value is None else F.coalesce(column < F.lit(value), F.lit(True))
        return column.isNotNull() if value is None else F.coalesce(column > F.lit(value), F.lit(False))


def _after(order: Sequence[By], last: dict, column) -> Column:
    """Rows whose key comes after ``last``; ``column`` finds a column by its name."""
    cases = []
    for i, by in enumerate(order):
        same = [column(b.column).eqNullSafe(F.lit(last[b.column])) for b in order[:i]]
        cases.append(reduce(and_, [*same, by.beyond(column(by.column), last[by.column])]))
    return reduce(or_, cases)


class PageIndex:
    """Opens what ``build`` wrote. ``order`` must be the one of the build, its last column unique."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[By]):
        self.order = tuple(order)
        self.rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
        self.ranges = spark.read.parquet(f"{path}/ranges")
        self.starts: list[tuple[int, int, int]] = []  # (range, rows before it, its rows): a row for each range, a parameter of the build
        total = 0
        for part, n in sorted(tuple(r) for r in self.ranges.select("part", "n").collect()):
            self.starts.append((part, total, n))
            total += n
        self.total = total

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[By], path: str, ranges: int = 64) -> PageIndex:
        """Write the listing to ``path``: one exchange by ranges, sorted within them."""
        keys = [by.sorting() for by in order]
        laid = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("__row", F.monotonically_increasing_id())
        laid = laid.withColumns({"__part": F.shiftright("__row", 33).cast("int"), "__place": F.col("__row").bitwiseAND(F.lit(_PLACES))})
        laid = laid.drop("__row")
        laid.write.partitionBy("__part").parquet(f"{path}/rows")
        laid.limit(0).write.parquet(f"{path}/columns")  # an empty listing leaves no file that tells its columns
        written = df.sparkSession.read.schema(laid.schema).parquet(f"{path}/rows")
        key = F.struct(*[by.column for by in order])
        written.groupBy(F.col("__part").alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.max_by(key, F.col("__place")).alias("last")).write.parquet(f"{path}/ranges")
        return cls(df.sparkSession, path, order)

    def pages(self, size: int) -> int:
        return -(-self.total // size)

    def between(self, first: int, end: int) -> DataFrame:
        """The rows at places ``first`` to ``end`` - 1 (from 0) in their order; only the ranges that hold them are read."""
        parts, cases = [], []
        for part, start, n in self.starts:
            if n and start < end and first < start + n:
                parts.append(part)
                cases.append((F.col("__part") == part) & F.col("__place").between(max(first - start, 0), min(end - start, n) - 1))
        found = self.rows.filter(F.col("__part").isin(parts)).filter(reduce(or_, cases)) if parts else self.rows.filter(F.lit(False))
        return found.orderBy("__part", "__place").limit(max(end - first, 0)).drop("__part", "__place")

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1)."""
        return self.between((number - 1) * size, number * size)

    def after(self, last: dict, size: int) -> DataFrame:
        """The ``size`` rows after the key ``last`` (order column -> value), which need not be in the listing any more."""
        part = self.ranges.filter(_after(self.order, last, lambda c: F.col("last")[c])).agg(F.min("part")).first()[0]
        if part is None:
            return self.between(0, 0)
        place = self.rows.filter(F.col("__part") == part).filter(_after(self.order, last, F.col)).agg(F.min("__place")).first()[0]
        first = next(start for p, start, _ in self.starts if p == part) + place
        return self.between(first, first + size)
