"""Running aggregates per group that stay balanced when one group is huge.

An ordinary window gives every group to one task. Here a group is cut into blocks along its order (weeks, ranges of ids or
of values): block totals are added up on the map side, a window over the few totals of a group gives what each block
starts from, and that start joins the block's rows as one more row in front of them. The window over the rows then
works on a block, not on a group. The plan is the same at every size and has one exchange of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is sum, min or max of ``value``."""

    value: Column
    kind: str = "sum"

    def fold(self, column: Column) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.kind](column)


#: Rows of a task where each becomes dozens.
ROWS_A_TASK = 100_000


def parts_of(stored: DataFrame, rows: int = ROWS_A_TASK) -> int | None:
    """Tasks for a stored table, which Spark counts from its files' footers; none of its own for a table of few rows."""
    n = -(-stored.count() // rows)
    return n if n > stored.sparkSession.sparkContext.defaultParallelism else None


def block_of(df: DataFrame, name: str) -> Column:
    """A coarser value of column ``name`` that never falls while the column rises; it depends on the type alone."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.trunc(c, "week")
    if isinstance(kind, T.IntegralType):
        return F.shiftright(c.cast("bigint"), 6)
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        size = F.floor(F.log2(F.abs(c)) * 1024)  # 1024 blocks for each doubling
        sign = F.when(F.isnan(c), 2).otherwise(F.signum(c).cast("int"))
        return F.when(c.isNotNull(), F.struct(sign.alias("sign"), F.when(sign == 1, size).when(sign == -1, -size).alias("size")))
    if isinstance(kind, T.StringType):
        return F.substring(c, 1, 8)
    return c


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    aggregates: dict[str, Running],
    inclusive: bool = True,
    block: Column | None = None,
    parts: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """Add running aggregates over each group of ``keys`` in ``order`` (which must be unique in a group).

    With ``inclusive=False`` a row sees only the rows before it. No keys means one group, the whole input. ``block`` must not
    fall along ``order``; by default it is a coarser value of the first order column, which is then given by name.
    ``parts`` deals the rows and the totals out to so many tasks, for callers that know how many rows there are and multiply them afterwards.
    ``whole`` leaves groups uncut, without an exchange, for rows that are dealt out by some of the keys and are bounded in a group.
    """
    keys, order = list(keys), list(order)
    if whole:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.withColumns({name: agg.fold(agg.value).over(frame) for name, agg in aggregates.items()})
    block = block_of(df, order[0]) if block is None else block
    inputs = {f"__in_{name}": agg.value for name, agg in aggregates.items()}
    rows = df.withColumns({"__block": block, "__row": F.lit(1), **inputs})
    # Dealt out before the inputs are made from them, the rows for the totals are narrow.
    dealt = df.withColumn("__block", block).repartition(parts, *keys, "__block").withColumns(inputs) if parts else rows
    totals = dealt.groupBy(*keys, "__block").agg(*[agg.fold(F.col(f"__in_{name}")).alias(f"__in_{name}") for name, agg in aggregates.items()])
    if parts and keys:
        totals = totals.repartition(parts, *keys)
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "__block", F.lit(0).alias("__row"), *[agg.fold(F.col(f"__in_{name}")).over(earlier).alias(f"__in_{name}") for name, agg in aggregates.items()]
    )
    # The sum of sums is wider than the summed column.
    wide = {f.name: f.dataType for f in starts.schema.fields if f.name.startswith("__in_")}
    rows = rows.withColumns({name: F.col(name).cast(kind) for name, kind in wide.items()})
    frame = Window.partitionBy(*keys, "__block").orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = rows.unionByName(starts, allowMissingColumns=True)
    if parts:
        whole = whole.repartition(parts, *keys, "__block")
    folded = whole.withColumns({name: agg.fold(F.col(f"__in_{name}")).over(frame) for name, agg in aggregates.items()})
    return folded.filter("__row = 1").drop("__block", "__row", *inputs)
