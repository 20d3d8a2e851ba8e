"""Registry of the queries: name, builder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Days as ISO text and whole numbers as bigint, so that both engines deliver the same types."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``."""
    def register(build: Builder) -> Builder:
        QUERIES[name] = lambda spark, sf_dir: flat(build(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return build

    return register
