"""Exact dedup: a tree of merges over sorted runs of digests.

Every partition of the digests is a run, sorted by digest and cut into slices by hash. In each round the runs of a slice
meet in groups of ``fan_in``; the group is merged in digest order and equal texts collapse to one entry that keeps the best
identifier and the number of rows so far. After ``log(runs)`` rounds a slice is one run. A text that fills a third of
all rows is one entry in each run from the start, so no task ever sees its copies together.

Equality is verified at each level: entries are equal only if SHA-256, byte length and a second, independent hash agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import keep_rows, mark_of, raw_texts, shuffle_partitions
from formline.session import write_and_reload

FAN_IN = 8
KEY = ["digest", "n_bytes", "second"]
_RUN = "slice int, run int, digest binary, n_bytes bigint, second bigint, keep_id bigint, keep_row bigint, n bigint"


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = raw_texts(pc.ascii_lower(batch.column(2)))
        second = pa.array((xxhash.xxh64_intdigest(t) for t in texts), pa.uint64()).view(pa.int64())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), digests, pa.array([len(t) for t in texts], pa.int64()), second],
            names=["id", "mark", *KEY],
        )


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, digest, n_bytes, second, row) for each row; A-Z are lower-cased first, null counts as empty."""
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), mark_of(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    hashed = picked.mapInArrow(_hash_batches, "id bigint, mark bigint, digest binary, n_bytes bigint, second bigint")
    return hashed.withColumn("row", F.monotonically_increasing_id())


def _merger(keep: str):
    def rank(id_, row):
        if id_ is None:
            return (1, 0, row)
        return (0, -id_ if keep == "largest" else id_, row)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Collapse neighbours with one key; rows come sorted, so one entry is held at a time."""
        key, best, n, out = None, None, 0, []
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] == key:
                    n += row[7]
                    if rank(*row[5:7]) < rank(*best):
                        best = row[5:7]
                    continue
                if key is not None:
                    out.append((*key, *best, n))
                key, best, n = row[:5], row[5:7], row[7]
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        if key is not None:
            out.append((*key, *best, n))
            yield _batch(out, schema)

    return merge


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def merge_runs(digests: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: the key, keep_id, keep_row and the number of rows."""
    if keep not in ("largest", "smallest") or fan_in < 2:
        raise ValueError("keep is 'largest' or 'smallest', fan_in at least 2")
    slices = shuffle_partitions(digests.sparkSession)
    runs = digests.rdd.getNumPartitions()
    order = ["slice", "run", *KEY]
    level = digests.select(
        F.pmod(F.col("second"), F.lit(slices)).cast("int").alias("slice"), F.spark_partition_id().alias("run"), *KEY,
        F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("bigint").alias("n"),
    ).sortWithinPartitions(*order).mapInArrow(_merger(keep), _RUN)
    while True:
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition(slices, "slice", "run")
        level = level.sortWithinPartitions(*order).mapInArrow(_merger(keep), _RUN)
        runs = -(-runs // fan_in)
        if runs <= 1:
            return level.select(*KEY, "keep_id", "keep_row", "n")


def exact_groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, mark.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. The row with the largest id stays
    (``keep='smallest'``: the smallest; a null id only if there is no other). Of rows that tie, repeated rows, exactly one
    stays. Extra columns are ignored; an empty table gives an empty result.
    """
    digests = write_and_reload(text_digests(docs, id_col, text_col), "digests")
    kept = merge_runs(digests, keep, fan_in)
    found = digests.join(kept, KEY)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "mark",
    )


def drop_exact_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as they came."""
    groups = exact_groups(docs, keep, id_col, text_col)
    return keep_rows(docs, groups.select(F.col("doc_id").alias("id"), "mark", "kept"), "exact-gone", id_col, text_col)
