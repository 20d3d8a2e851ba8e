"""Writing: upserts, period replacement, purging, nested JSON, log, model tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.functions.casts import seconds_to_clock
from formline.operators.scoring import Reconstruction, Scaler
from formline.schemas import PURGE_ORDER, TABLES


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], newest: Sequence[Column] | None = None) -> DataFrame:
    """``target`` with the rows of ``updates`` put in by key.

    Repeated keys inside ``updates`` are settled by ``newest`` (a sort order, the first row wins)
    if given. The result is a new table: write it to a fresh path, then switch readers over.
    """
    if newest:
        order = Window.partitionBy(*keys).orderBy(*newest)
        updates = updates.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return target.join(updates.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(
        updates.select(*target.columns))


def get_or_create(existing: DataFrame, wanted: DataFrame, key: str = "id", truthy: bool = False, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Dimension with all wanted keys. Delivered non-null values win; ``truthy`` also ignores empty text and 0.

    ``defaults`` fills the columns that are still empty in newly created rows.
    """
    columns = [c for c in existing.columns if c != key]
    news = wanted.groupBy(key).agg(*[F.max(c).alias(f"__{c}") for c in columns if c in wanted.columns], F.lit(True).alias("__w"))
    joined = existing.withColumn("__e", F.lit(True)).join(news, key, "full_outer")
    updates = {}
    for c in columns:
        value = F.col(c)
        if c in wanted.columns:
            new = F.col(f"__{c}")
            if truthy:
                kind = existing.schema[c].dataType
                empty = F.lit("") if isinstance(kind, T.StringType) else F.lit(0) if isinstance(kind, T.NumericType) else None
                new = F.when(new != empty, new) if empty is not None else new
            value = F.coalesce(new, value)
        if defaults and c in defaults:
            value = F.when(F.col("__e").isNull(), F.coalesce(value, defaults[c])).otherwise(value)
        updates[c] = value
    return joined.withColumns(updates).select(*existing.columns)


def team_defaults() -> dict[str, Column]:
    """Names of a team that is only known by its id."""
    key = F.col("id").cast("string")
    return {"full_name": F.concat(F.lit("Team "), key), "abbreviation": F.concat(F.lit("TM_"), key)}


def player_defaults() -> dict[str, Column]:
    return {"full_name": F.concat(F.lit("Player "), F.col("id").cast("string"))}


def replace_periods(df: DataFrame, path: str, period: str = "season") -> None:
    """Overwrite exactly the periods present in ``df``; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def without_range(df: DataFrame, column: str, first: Column, last: Column) -> DataFrame:
    """Rows outside a closed range, used to clear a period before it is computed again."""
    return df.filter(F.col(column).isNull() | ~F.col(column).between(first, last))


def purge(spark: SparkSession, root: str, names: Sequence[str] = tuple(PURGE_ORDER)) -> None:
    """Empty tables, children before parents."""
    for name in [n for n in PURGE_ORDER if n in names]:
        spark.createDataFrame([], TABLES[name]).write.mode("overwrite").parquet(f"{root}/{name}")


# The tables of each group of detector results.
RESULT_GROUPS = {
    "league": ["league_outliers"],
    "player": ["player_outliers", "player_trends", "season_states"],
    "streaks": ["streaks", "streak_records"],
}


def purge_results(spark: SparkSession, root: str, group: str) -> None:
    """Empty one group of detector results, or ``all``."""
    groups = list(RESULT_GROUPS) if group == "all" else [group]
    purge(spark, root, [name for g in groups for name in RESULT_GROUPS[g]])


# ---- nested JSON ----------------------------------------------------------------------------


def _rounded(value: Column, kind: T.DataType, digits: int) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(value, digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _rounded(x, kind.elementType, digits))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _rounded(v, kind.valueType, digits))
    if isinstance(kind, T.StructType):
        fields = [_rounded(value[f.name], f.dataType, digits).alias(f.name) for f in kind.fields if not f.name.startswith("_")]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.date_format(value, "yyyy-MM-dd" if isinstance(kind, T.DateType) else "yyyy-MM-dd'T'HH:mm:ss")
    return value


def json_rows(df: DataFrame, digits: int = 2, clock_columns: Sequence[str] = ("min_seconds",)) -> DataFrame:
    """Each row as JSON text: ISO days, play time as ``M:SS``, rounded numbers, no internal ``_`` fields."""
    fields = []
    for f in df.schema.fields:
        if f.name.startswith("_"):
            continue
        c = F.col(f"`{f.name}`")
        value = seconds_to_clock(c) if f.name in clock_columns else _rounded(c, f.dataType, digits)
        fields.append(value.alias("min" if f.name == "min_seconds" else f.name))
    return df.select(F.to_json(F.struct(*fields)).alias("json"))


# ---- log ------------------------------------------------------------------------------------


def append_log(spark: SparkSession, root: str, entries: Sequence[tuple[datetime, str, str, str, str | None]]) -> None:
    spark.createDataFrame(list(entries), TABLES["log_entries"]).coalesce(1).write.mode("append").parquet(f"{root}/log_entries")


def log_tail(log: DataFrame, n: int = 50, level: str | None = None) -> DataFrame:
    """The newest n entries (of a level), oldest first."""
    rows = log.filter(F.col("level") == level.upper()) if level else log
    keys = ["ts", "level", "module", "message"]
    return rows.orderBy(*[F.desc(k) for k in keys]).limit(n).orderBy(*keys)


# ---- model ----------------------------------------------------------------------------------


def save_model(spark: SparkSession, model: Reconstruction, path: str) -> None:
    """Model as one small table: a row per feature with its scale and projection."""
    rows = [
        (i, f, m, s, list(p), model.components, model.validation_loss, model.version)
        for i, (f, m, s, p) in enumerate(zip(model.scaler.features, model.scaler.means, model.scaler.deviations, model.projection))
    ]
    schema = "place int, feature string, mean double, deviation double, projection array<double>, components int, loss double, version string"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Reconstruction:
    rows = spark.read.parquet(path).orderBy("place").collect()
    if not rows:
        raise ValueError(f"no model in {path}")
    scaler = Scaler(tuple(r["feature"] for r in rows), tuple(r["mean"] for r in rows), tuple(r["deviation"] for r in rows))
    return Reconstruction(scaler, tuple(tuple(r["projection"]) for r in rows), rows[0]["components"], rows[0]["loss"], rows[0]["version"])
