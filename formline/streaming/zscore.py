"""Incremental Z-scores and trends, equal to the batch operators whatever the order of delivery.

Every micro-batch is an ordinary DataFrame job. Its lines are stored by week and change the nodes of a tree of sums
(:mod:`formline.streaming.prefix`). The rows of a touched (entity, period) are scored from the touched week on, starting
from the tree's sums; earlier rows keep their scores. So a row in the order of time reads its own week alone, a late row its
week and the later ones of its period, and nothing depends on how long the history is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators import trends
from formline.operators.zscore import DEFAULT_FEATURES, Z_THRESHOLD, Feature, Keys, add_scores, outliers_of, zscore_outliers
from formline.sources.keyed_log import KeyedLog, hash_slot
from formline.streaming.lines import LineStore, numbers, week_of
from formline.streaming.prefix import PrefixTree

HISTORY = -1  # the batch number of a bootstrap
_TREND_WEEKS = -(-max(w.days for w in (trends.WEEK, trends.MONTH)) // 7)


class ZScoreStream:
    """Detector with its tables below ``root``: lines, tree of sums, entities with their periods, outliers, trends."""

    def __init__(
        self, spark: SparkSession, root: str, lines_schema: str,
        features: Sequence[Feature] = DEFAULT_FEATURES, keys: Keys = Keys(), threshold: float = Z_THRESHOLD, with_trends: bool = True,
    ):
        self.spark, self.features, self.keys, self.threshold, self.with_trends = spark, list(features), keys, threshold, with_trends
        self.lines = LineStore(spark, f"{root}/lines", lines_schema, keys)
        self.tree = PrefixTree(spark, f"{root}/tree", lines_schema, self.features, keys)
        self.pair, self.cell = [keys.entity, keys.period], [keys.entity, keys.period, "__week"]
        kinds = dict(spark.createDataFrame([], lines_schema).dtypes)
        entity = f"{keys.entity} {kinds[keys.entity]}"
        periods = f"{entity}, periods array<struct<period:{kinds[keys.period]},first_week:bigint,last_week:bigint>>"
        self.entities = KeyedLog(spark, f"{root}/entities", periods, [keys.entity], hash_slot(keys.entity), once=True)
        nothing = spark.createDataFrame([], lines_schema)
        week = T.StructField("__week", T.LongType())
        self.found = KeyedLog(
            spark, f"{root}/outliers", T.StructType([*zscore_outliers(nothing, self.features, keys, threshold).schema.fields, week]), self.cell, F.col("__week"), many=True, payload="stat_id")
        shape = trends.trend_outliers(nothing, features=self.features, keys=keys, threshold=threshold).schema
        self.forms = KeyedLog(spark, f"{root}/trends", shape, [keys.entity], hash_slot(keys.entity), many=True, payload="window_type")
        self.root = root

    def bootstrap(self, history: DataFrame) -> bool:
        """Load history into an empty detector, before its first batch; a detector that has lines is left as it is."""
        if not self.lines.is_empty():
            return False
        self.process(history, HISTORY)
        return True

    def process(self, batch: DataFrame, number: int) -> None:
        """Store one micro-batch and score again what it touches."""
        arrivals = self.lines.write(batch, number)
        touched, weeks = arrivals.select(*self.cell).distinct(), numbers(arrivals, "__week")
        self.tree.update(self.lines.rows(weeks, number + 1).join(touched, self.cell, "left_semi"), touched, weeks, number)
        pairs = self._pairs(touched, weeks, number)
        self._score(pairs, touched, number)
        if self.with_trends:
            self._trends(touched, number)

    def _pairs(self, touched: DataFrame, weeks: list[int], number: int) -> DataFrame:
        """(entity, period, from_week, first_week, last_week, first_period) of what is to be scored again.

        An entity whose first period changes has the grace of its other periods changed: those are scored from their start.
        """
        k = self.keys
        people = touched.select(k.entity).distinct()
        slots = numbers(people.select(self.entities.slot.alias("slot")), "slot")
        old = self.entities.read(slots, number).join(people, k.entity, "left_semi").select(k.entity, F.inline("periods")).withColumnRenamed("period", k.period)
        ranges = old.join(touched.select(*self.pair).distinct(), self.pair, "left_semi").select("first_week", "last_week").distinct().collect()  # weeks, so few
        now = self.tree.totals(touched, [*((w, w) for w in weeks), *map(tuple, ranges)], number)
        kept = old.join(touched.select(*self.pair).distinct(), self.pair, "left_anti")
        spans = kept.unionByName(now.select(*kept.columns))
        periods = F.sort_array(F.collect_list(F.struct(F.col(k.period).alias("period"), "first_week", "last_week")))
        listed = spans.groupBy(k.entity).agg(periods.alias("periods"))
        none = F.array().cast(self.entities.schema["periods"].dataType)
        self.entities.write(people.join(listed, k.entity, "left").withColumn("periods", F.coalesce("periods", none)), number, slots)

        listed = self.entities.read(slots, number + 1).join(people, k.entity, "left_semi")
        spans = listed.select(k.entity, F.get("periods", F.lit(0))["period"].alias("first_period"), F.inline("periods")).withColumnRenamed("period", k.period)
        was = old.groupBy(k.entity).agg(F.min(k.period).alias("was_first"))
        moved = spans.join(was, k.entity).filter(
            (F.col(k.period) > F.least("was_first", "first_period")) & (F.col(k.period) <= F.greatest("was_first", "first_period")))
        begins = touched.groupBy(*self.pair).agg(F.min("__week").alias("from_week")).unionByName(moved.select(*self.pair, F.col("first_week").alias("from_week")))
        begins = begins.groupBy(*self.pair).agg(F.min("from_week").alias("from_week"))
        path = f"{self.root}/pairs/batch={number}"
        spans.join(begins, self.pair).select(*self.pair, "from_week", "first_week", "last_week", "first_period").write.mode("overwrite").parquet(path)
        self.entities.delete([f"{self.root}/pairs/batch={number - 2}"])
        return self.spark.read.parquet(path)

    def _score(self, pairs: DataFrame, touched: DataFrame, number: int) -> None:
        """Rows of a week start from the sums before it; a window over the few rows of an entity's week does the rest."""
        k = self.keys
        spans = [tuple(r) for r in pairs.select("first_week", "from_week", "last_week").distinct().collect()]  # weeks, so few
        weeks = {w for _, start, last in spans for w in range(start, last + 1)}
        lines = self.lines.rows(weeks, number + 1).join(pairs.select(*self.pair, "from_week", "first_period"), self.pair).filter("__week >= from_week")
        past = {"games": f"if({k.seconds} > 0, 1L, null)", **self.tree.inputs}
        starts = self.tree.starts(pairs, spans, number)
        starts = starts.selectExpr(*self.cell, "first_day as __first_day", *[f"{c} as __{c}" for c in past])
        before = f"over (partition by {', '.join(self.cell)} order by {k.when}, {k.tie} rows between unbounded preceding and 1 preceding)"
        state = lines.join(starts, self.cell, "left").selectExpr(
            *self.lines.columns, "first_period", "__week",
            f"least(__first_day, min(if({k.seconds} > 0, {k.when}, null)) {before}) as first_day",
            *[f"coalesce(__{c}, 0) + coalesce(sum({e}) {before}, 0) as {'games_before' if c == 'games' else c}" for c, e in past.items()],
        )
        found = outliers_of(add_scores(state, self.features, k).filter("scored"), self.features, k, self.threshold)
        cells = lines.select(*self.cell).unionByName(touched).distinct()
        self.found.write(found.withColumn("__week", week_of(k.when)).unionByName(cells, allowMissingColumns=True), number, weeks)

    def _trends(self, touched: DataFrame, number: int) -> None:
        """Trends at the last row of every entity in the batch: its reference period and the days of the longest window."""
        k = self.keys
        people = touched.select(k.entity).distinct()
        slots = numbers(people.select(self.forms.slot.alias("slot")), "slot")
        spans = self.entities.read(slots, number + 1).join(people, k.entity, "left_semi").filter(F.size("periods") > 0)
        final = F.array_max(F.transform("periods", lambda p: p["last_week"]))
        starts = F.transform(F.filter("periods", lambda p: p["last_week"] == F.col("final")), lambda p: p["first_week"])
        spans = spans.withColumn("final", final).select(k.entity, "final", F.least(F.array_min(starts), F.col("final") - _TREND_WEEKS).alias("start"))
        weeks = {w for a, b in spans.select("start", "final").distinct().collect() for w in range(a, b + 1)}
        lines = self.lines.rows(weeks, number + 1).join(spans, k.entity).filter("__week between start and final").drop("start", "final")
        reference = trends.last_days(lines, k)
        found = trends.trend_outliers(lines, reference, features=self.features, keys=k, threshold=self.threshold)
        self.forms.write(found.unionByName(people, allowMissingColumns=True), number, slots)

    def outliers(self) -> DataFrame:
        return self.found.read().drop("__week")

    def trends(self) -> DataFrame:
        return self.forms.read()

    def start(self, source: DataFrame, checkpoint: str):
        return (
            source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
