"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.session import write_and_reload

#: Texts are worked on in pieces of about this size.
PIECE_BYTES = 1 << 20
#: Bytes of text that a training sample holds for a group at most.
SAMPLE_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` with underscores added until no column of ``df`` has the name, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null becomes the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def text_pieces(raw: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes, cut at spaces, so that a huge text needs little memory at a time.

    A text without a space is one piece. The spaces at the cuts stay in the pieces.
    """
    start, end = 0, len(raw)
    while end - start > size:
        cut = raw.rfind(b" ", start + 1, start + size)
        if cut < 0:
            cut = raw.find(b" ", start + size)
            if cut < 0:
                break
        yield raw[start:cut]
        start = cut
    yield raw[start:end]


def bounded_sample(rows: DataFrame, groups: list[str], limit: int, id_col: str = "id", size_col: str | None = None, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``limit`` rows of each group, those with the smallest hashes of their id, in the columns of ``rows``.

    ``rows`` has an id once in a group. With ``size_col`` the sizes of the rows taken also sum to ``max_bytes`` at most, and a
    row of more than a sixteenth of that is left out, so that no single row takes the place of all others. A first pass counts
    the groups (there are few: labels, languages); a second keeps about twice the limit of each by hash, so that the rows
    ranked in one task are as few for a huge table as for a small one.
    """
    if size_col:
        rows = rows.filter(F.col(size_col) <= max_bytes // 16)
    counts = rows.groupBy(*groups).count().withColumnsRenamed({g: f"{g}_of" for g in groups})
    same = [F.col(g) == F.col(f"{g}_of") for g in groups]
    part = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    near = rows.join(F.broadcast(counts), same).filter(part <= F.lit(2.0 * limit + 50) / F.col("count")).select(*rows.columns, part.alias("part_of"))
    order = Window.partitionBy(*groups).orderBy("part_of", id_col)
    kept = near.withColumn("rank_of", F.row_number().over(order)).filter(F.col("rank_of") <= limit)
    if size_col:
        kept = kept.withColumn("upto", F.sum(size_col).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") <= max_bytes)
    return kept.select(*rows.columns)


def sampled_texts(rows: DataFrame, groups: list[str], limit: int, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(groups, id, text): at most ``limit`` rows and ``max_bytes`` bytes of text for each group of (groups, id, text).

    Of the rows of one id in a group only the text with the smallest hash is taken, once, however often the id is repeated.
    Ids and sizes are chosen first; whole texts are moved only for the rows chosen, at most ``limit`` a group, which are broadcast.
    """
    narrow = rows.filter("id is not null").select(*groups, "id", F.struct(mark_of().alias("mark"), F.octet_length("text").alias("size")).alias("t"))
    one = narrow.groupBy(*groups, "id").agg(F.min("t").alias("t")).select(*groups, "id", "t.mark", "t.size")
    chosen = bounded_sample(one, groups, limit, size_col="size", max_bytes=max_bytes).drop("size")
    keys = [*groups, "id", "mark"]
    theirs = chosen.withColumnsRenamed({c: f"{c}_" for c in keys})
    mine = rows.withColumn("mark", mark_of())
    found = mine.join(F.broadcast(theirs), [F.col(c) == F.col(f"{c}_") for c in keys], "left_semi")
    return found.groupBy(*keys).agg(F.min("text").alias("text")).drop("mark")


def mark_of(text: str = "text"):
    """A hash that tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keep_rows(docs: DataFrame, decided: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``decided`` drops.

    ``decided`` has (id, mark, kept), one row for each row of ``docs``; ``mark`` is ``mark_of(text)``. Rows that agree in id
    and text are one key: such a key loses all its rows, none, or all but one. Texts are moved only by the anti-join.
    """
    per_key = decided.groupBy("id", "mark").agg(F.sum(F.col("kept").cast("int")).alias("keeps"), F.count(F.lit(1)).alias("n"))
    touched = write_and_reload(per_key.filter("keeps < n").select("id", "mark", (F.col("keeps") > 0).alias("one")), label)
    # Keys of which one row stays (the same row delivered twice) get files of their own, so that Spark sees their size.
    tied = write_and_reload(touched.filter("one").select("id", "mark"), f"{label}-tied")
    mark, other, other_mark = free_name(docs, "row_mark", "other_id", "other_mark")
    gone, again = (x.select(F.col("id").alias(other), F.col("mark").alias(other_mark)) for x in (touched, tied))
    same = F.col(id_col).eqNullSafe(F.col(other)) & (F.col(mark) == F.col(other_mark))
    marked = docs.withColumn(mark, mark_of(text_col))
    stay = marked.join(gone, same, "left_anti")
    one_of = marked.join(again, same, "left_semi").dropDuplicates([id_col, mark])
    return stay.unionByName(one_of).select(*[F.col(f"`{c}`") for c in docs.columns])
