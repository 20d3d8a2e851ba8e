"""Point-in-time sums kept as a tree of nodes for each (entity, period).

A node holds the sums of the rows of ``8 ** level`` weeks. What the rows of some week start from is the sum of the nodes left of its
path: at most seven on each level below the top. A late or corrected row changes the node of its week and one node above it on each level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators.zscore import Feature, Keys, baseline_inputs
from formline.sources.keyed_log import KeyedLog

BITS = 3  # a node has 8 children
LEVELS = 2  # weeks and 8 weeks, as a period is about a year; on the top level a path has all nodes of the period to its left
_LEVEL_SLOTS, _MIDDLE = 100_000_000, 2_000_000


def slot(level: int, at: int) -> int:
    return level * _LEVEL_SLOTS + at + _MIDDLE


class PrefixTree:
    def __init__(self, spark: SparkSession, path: str, lines_schema: str, features: Sequence[Feature], keys: Keys):
        self.keys, self.inputs = keys, baseline_inputs(features, keys)
        kinds = {f.name: f for f in T.StructType.fromDDL(lines_schema).fields}
        wide = {name: "decimal(38,0)" if "decimal" in expression else "bigint" for name, expression in self.inputs.items()}
        sums = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in wide.items()))
        head = "level int, at bigint, rows bigint, first_week bigint, last_week bigint, games bigint"
        schema = T.StructType([kinds[keys.entity], kinds[keys.period], *T.StructType.fromDDL(head).fields, T.StructField("first_day", kinds[keys.when].dataType), *sums.fields])
        self.wide = wide
        self.log = KeyedLog(spark, path, schema, [keys.entity, keys.period, "level", "at"], F.col("level") * F.lit(_LEVEL_SLOTS) + F.col("at") + _MIDDLE, once=True)

    def _folded(self, rows: DataFrame, *group: str) -> DataFrame:
        """Sums of nodes."""
        sums = [f"cast(sum({name}) as {kind}) as {name}" for name, kind in self.wide.items()]
        head = ["coalesce(sum(rows), 0L) as rows", "min(first_week) as first_week", "max(last_week) as last_week", "coalesce(sum(games), 0L) as games", "min(first_day) as first_day"]
        return rows.groupBy(*group).agg(*map(F.expr, head + sums))

    def update(self, lines: DataFrame, touched: DataFrame, weeks: Sequence[int], number: int) -> None:
        """Make the nodes of the touched (entity, period, __week) from the lines of those weeks, then the nodes above them."""
        k = self.keys
        pair, played = [k.entity, k.period], f"{k.seconds} > 0"
        ones = lines.selectExpr(
            *pair, "__week", "1L as rows", "__week as first_week", "__week as last_week", f"if({played}, 1L, null) as games",
            f"if({played}, {k.when}, null) as first_day", *[f"{e} as {n}" for n, e in self.inputs.items()],
        )
        # A week that lost its last row keeps a node of nothing.
        leaves = self._folded(ones.unionByName(touched, allowMissingColumns=True), *pair, "__week")
        self.log.write(leaves.withColumns({"level": F.lit(0), "at": F.col("__week")}), number, [slot(0, w) for w in weeks])
        for level in range(1, LEVELS):
            parents = sorted({w >> BITS * level for w in weeks})
            children = self.log.read([slot(level - 1, (p << BITS) + i) for p in parents for i in range(1 << BITS)], number + 1)
            mine = touched.select(*pair, F.shiftright("__week", BITS * level).alias("at")).distinct()
            above = children.withColumn("at", F.shiftright("at", BITS)).join(mine, [*pair, "at"], "left_semi")
            self.log.write(self._folded(above, *pair, "at").withColumn("level", F.lit(level)), number, [slot(level, p) for p in parents])

    def totals(self, pairs: DataFrame, spans: Sequence[tuple[int, int]], number: int) -> DataFrame:
        """(entity, period, first_week, last_week) of pairs, which have rows within ``spans`` only; pairs without rows are left out."""
        top, pair = LEVELS - 1, [self.keys.entity, self.keys.period]
        slots = {slot(top, a) for first, last in spans for a in range(first >> BITS * top, (last >> BITS * top) + 1)}
        nodes = self.log.read(slots, number + 1).filter("rows > 0").join(pairs, pair, "left_semi")
        return nodes.groupBy(*pair).agg(F.min("first_week").alias("first_week"), F.max("last_week").alias("last_week"))

    def starts(self, pairs: DataFrame, spans: Sequence[tuple[int, int, int]], number: int) -> DataFrame:
        """For every week from ``from_week`` on in which a pair has rows: the sums of all rows of the pair before that week.

        ``pairs``: entity, period, from_week, first_week, last_week; ``spans``: the combinations of the three weeks that occur.
        """
        pair = [self.keys.entity, self.keys.period]
        weeks = self.log.read({slot(0, w) for _, start, last in spans for w in range(start, last + 1)}, number + 1).filter("rows > 0")
        weeks = weeks.select(*pair, F.col("at").alias("__week")).join(pairs.select(*pair, "from_week", "first_week"), pair).filter("__week >= from_week")
        left = []  # (level, at) of the nodes left of a week's path
        slots = set()
        for level in range(LEVELS):
            low = f"shiftright(first_week, {BITS * level})"
            if level < LEVELS - 1:
                low = f"greatest({low}, shiftleft(shiftright(__week, {BITS * (level + 1)}), {BITS}))"
            here = f"shiftright(__week, {BITS * level})"
            left.append(f"transform(if({low} < {here}, sequence({low}, {here} - 1), array()), a -> struct({level} as level, a as at))")
            for first, start, last in spans:
                begin = first >> BITS * level
                if level < LEVELS - 1:
                    begin = max(begin, (start >> BITS * (level + 1)) << BITS)
                slots.update(slot(level, a) for a in range(begin, last >> BITS * level))
        wanted = weeks.select(*pair, "__week", F.expr(f"inline(concat({', '.join(left)}))"))
        nodes = self.log.read(slots, number + 1).join(wanted, [*pair, "level", "at"])
        return self._folded(nodes, *pair, "__week").drop("rows", "first_week", "last_week")
