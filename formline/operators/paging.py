"""Pages, ordered lists and top entries of maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1). ``order`` must end in a unique key."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """One row: total rows and ceil(total / size) pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def page_of_parts(parts: list[DataFrame], order: list[Column], number: int, size: int) -> DataFrame:
    """Page over several listings laid end to end: all of the first part, then the second, and so on."""
    joined = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("part", F.lit(i))
        joined = tagged if joined is None else joined.unionByName(tagged)
    return page(joined, [F.asc("part"), *order], number, size)


def top_entries(values: Column, n: int, by_size: bool = False) -> Column:
    """The n map entries with the largest value, or with the largest absolute value; names settle ties."""
    ranked = F.transform(F.map_entries(values), lambda e: F.struct(
        (-(F.abs(e["value"]) if by_size else e["value"])).alias("rank"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.slice(F.sort_array(ranked), 1, n), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("value")))


def newest_in_order(df: DataFrame, when: str, tie: str, n: int) -> DataFrame:
    """The n newest rows, oldest first."""
    return df.orderBy(F.desc(when), F.desc(tie)).limit(n).orderBy(when, tie)
