"""Reading domain tables with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formline.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet table ``root/name`` with its declared schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_relational(
    spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """Table of a relational store, read in parallel ranges of a numeric column."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, **options,
    ).load()


def create_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    """Create missing tables as empty Parquet folders with the declared schemas."""
    for name in names or list(TABLES):
        spark.createDataFrame([], TABLES[name]).write.mode("ignore").parquet(f"{root}/{name}")


def register_views(spark: SparkSession, root: str, names: list[str] | None = None) -> None:
    for name in names or list(TABLES):
        read_table(spark, root, name).createOrReplaceTempView(name)
