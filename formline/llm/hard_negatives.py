"""Hard negatives from one shared, bounded list of candidates for each cluster of anchors (as in MAXIMUS).

Anchors are clustered by direction. For a cluster with centre c whose anchors lie within the angle t of c, no anchor a has a
product with a candidate x above |a| |x| cos(max(0, angle(c, x) - t)). That bound, but for |a|, is the same for the whole cluster:
each block of candidates is sorted by it once, and every anchor of the cluster walks the sorted list until the bound of the
next candidate is below what the anchor still looks for. From there on the rest of the list is certified to hold nothing.

Anchors are handled in slices of bounded size: a slice is broadcast, the candidates pass by in their own partitions without a
shuffle, and only each task's best few rows of an anchor are moved. A first pass finds the positives, a second, which knows their
scores and so the window of each, the negatives. Every slice is a job of its own whose result is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.session import shared_dir, write_and_reload

#: Anchors of a slice at most, and bytes of their vectors.
SLICE_ROWS = 1 << 14
SLICE_BYTES = 16 << 20
#: Candidates whose bounds are sorted together, in bytes of their vectors.
BLOCK_BYTES = 8 << 20
#: Length of the first steps of a walk; later ones double.
STEP = 256
EXACT = 1 << 53
_FOUND = "anchor bigint, of int, id bigint, score bigint"


@dataclass
class Cluster:
    members: np.ndarray  # places in the slice
    centre: np.ndarray
    angle: float


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def angles(directions: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions @ centre, -1.0, 1.0))


def cluster_anchors(vectors: np.ndarray, rounds: int = 8) -> list[Cluster]:
    """Spherical k-means with about sqrt(n) centres that start at evenly spaced anchors; every anchor is in one cluster."""
    n = len(vectors)
    if not n:
        return []
    directions = unit(vectors)
    k = max(1, int(np.sqrt(n)))
    centres = directions[np.linspace(0, n - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = np.argmax(directions @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, directions)
        moved = unit(sums)
        live = np.linalg.norm(moved, axis=1) > 0
        centres[live] = moved[live]
    at = np.argmax(directions @ centres.T, axis=1)
    out = []
    for c in range(k):
        members = np.flatnonzero(at == c)
        if len(members):
            real = members[np.linalg.norm(vectors[members], axis=1) > 0]  # a zero vector's products are zero whatever the bound
            out.append(Cluster(members, centres[c], float(angles(directions[real], centres[c]).max(initial=0.0))))
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-number vectors."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if most < EXACT:
        return (left @ right.T).astype(np.int64)
    if most >= 2.0**62:
        raise ValueError("components are too large for products of 64 bits")
    return left.astype(np.int64) @ right.astype(np.int64).T


class Best:
    """The best ``k`` (score, id) of each of ``n`` seekers; higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.who = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min)  # a lower score than this is of no use

    def add(self, who: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(who):
            return
        who, score, id_ = np.append(self.who, who), np.append(self.score, score), np.append(self.id, id_)
        order = np.lexsort((id_, -score, who))
        who, score, id_ = who[order], score[order], id_[order]
        first = np.searchsorted(who, who)
        place = np.arange(len(who)) - first
        stay = place < self.k
        self.who, self.score, self.id = who[stay], score[stay], id_[stay]
        full = place == self.k - 1
        self.least[who[full]] = score[full]


def walk(cluster: Cluster, vectors: np.ndarray, block: np.ndarray, ready, visit) -> int:
    """Let every member walk the block's list; ``ready(members, bound)`` says who is done, ``visit(members, rows, scores)`` takes scores.

    Returns the number of (member, candidate) products, which tests hold against the product of both sizes.
    """
    sizes = np.linalg.norm(block, axis=1)
    gap = np.maximum(0.0, angles(unit(block), cluster.centre) - cluster.angle)
    reach = sizes * np.cos(gap)
    order = np.argsort(-reach, kind="stable")
    reach = reach[order]
    lengths = np.linalg.norm(vectors, axis=1)
    slack = 1e-6 * float(sizes.max(initial=0.0))  # rounding of the angles
    members, at, step, done = cluster.members, 0, STEP, 0
    while at < len(order):
        members = members[~ready(members, lengths[members] * (reach[at] + slack))]
        if not len(members):
            break
        rows = order[at:at + step]
        visit(members, rows, products(vectors[members], block[rows]))
        done += len(members) * len(rows)
        at, step = at + step, step * 2
    return done


@dataclass
class Slice:
    """Anchors that are broadcast together; ``low``, ``high``: windows of the negatives' scores, one column for each positive."""

    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    clusters: list[Cluster]
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class PositiveSeek:
    """The best rows of an anchor's own label, its own row among them."""

    def __init__(self, part: Slice, k: int):
        self.part, self.best = part, Best(len(part.row), k)

    def ready(self, members, bound):
        return bound < self.best.least[members]

    def block(self, ids, labels):
        def visit(members, rows, scores):
            use = (self.part.label[members][:, None] == labels[rows][None, :]) & (scores >= self.best.least[members][:, None])
            who, what = np.nonzero(use)
            self.best.add(members[who], scores[who, what], ids[rows[what]])

        return visit

    def rows(self):
        return self.part.row[self.best.who], np.zeros(len(self.best.who), np.int32), self.best.id, self.best.score


class NegativeSeek:
    """The best rows of other labels in the window of each positive of an anchor."""

    def __init__(self, part: Slice, k: int):
        self.part, self.width = part, part.low.shape[1]
        self.best = Best(len(part.row) * self.width, k)

    def _least(self, members):
        seekers = members[:, None] * self.width + np.arange(self.width)
        least = np.maximum(self.best.least[seekers], self.part.low[members])
        return np.where(self.part.high[members] < self.part.low[members], np.iinfo(np.int64).max, least)

    def ready(self, members, bound):
        return bound < self._least(members).min(axis=1)

    def block(self, ids, labels):
        def visit(members, rows, scores):
            other = self.part.label[members][:, None] != labels[rows][None, :]
            for of in range(self.width):
                least, most = self._least(members)[:, of], self.part.high[members][:, of]
                who, what = np.nonzero(other & (scores >= least[:, None]) & (scores <= most[:, None]))
                self.best.add(members[who] * self.width + of, scores[who, what], ids[rows[what]])

        return visit

    def rows(self):
        return self.part.row[self.best.who // self.width], (self.best.who % self.width).astype(np.int32), self.best.id, self.best.score


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of one array; shorter ones are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _scan(candidates: DataFrame, part: Slice, seek, k: int, width: int) -> DataFrame:
    """One pass of the candidates: each task gives its best rows for each anchor of the slice."""
    shared = candidates.sparkSession.sparkContext.broadcast(part)
    size = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        found = seek(own, k)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                ids, labels = (piece.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                block = _matrix(piece.column(2), width)
                visit = found.block(ids, labels)
                for cluster in own.clusters:
                    walk(cluster, own.vectors, block, found.ready, visit)
        rows = found.rows()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["anchor", "of", "id", "score"])

    return candidates.mapInArrow(scan, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of all tasks for each (anchor, of), with their place from 1."""
    order = Window.partitionBy("anchor", "of").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _anchor_slices(candidates: DataFrame, is_anchor: Column, width: int):
    """Anchors with a row number of their own, and the number of slices they are cut into by that number.

    A file of the written anchors holds the rows of one task. Each is numbered on from the files before it, so that a slice has
    exactly ``rows`` anchors (the last one fewer), also if one id is repeated in any number of rows.
    """
    spark = candidates.sparkSession
    rows = max(1, min(SLICE_ROWS, SLICE_BYTES // (8 * max(1, width))))
    mark = F.monotonically_increasing_id()
    marked = write_and_reload(candidates.filter(is_anchor).withColumn("mark", mark), "anchors")
    part, at = F.shiftrightunsigned("mark", 33), F.col("mark").bitwiseAND((1 << 33) - 1)
    # One row for each file of anchors.
    sizes = marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    numbered = marked.withColumn("part", part).join(starts, "part").select((F.col("before") + at).alias("anchor"), "id", "label", "vector")
    numbered = numbered.withColumn("slice", F.floor(F.col("anchor") / rows).cast("int"))
    path = shared_dir(spark, "anchor-slices")
    numbered.write.partitionBy("slice").parquet(path)
    stored = spark.read.schema(numbered.schema).parquet(path)
    n = marked.count()
    return stored, -(-n // rows)


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor row and each of its positives.

    ``vectors`` holds an id, a label and a vector of whole numbers; the score of two rows is the inner product. An anchor's positives
    are its first ``positives`` other rows of the same label; the negatives of a positive are the first ``negatives`` rows of another label
    whose score lies within the two percentages ``window`` of the positive's score. Higher scores come first, ties by smaller id.

    Rows with a null id, label, vector or component take no part. Shorter vectors count as filled up with zeros. Repeated rows are
    rows of their own: a copy of an anchor is an anchor too, and each is the other's positive. An anchor without positives, or a
    positive without a row in its window, gives no row; so does an empty table. Extra columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    no_gap = ~F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & no_gap
    candidates = vectors.filter(usable).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), is_anchor.alias("is_anchor"),
    )
    width = candidates.agg(F.max(F.size("vector"))).first()[0] or 0
    anchors, n_slices = _anchor_slices(candidates, F.col("is_anchor"), width)
    candidates = candidates.drop("is_anchor")
    low, high = window
    results = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    for number in range(n_slices):
        own = anchors.filter(F.col("slice") == number)
        held = own.select("anchor", "id", "label", "vector").orderBy("anchor").toArrow().combine_chunks()  # SLICE_ROWS rows, SLICE_BYTES bytes at most
        vector = held.column("vector").combine_chunks()
        part = Slice(held.column("anchor").to_numpy(), held.column("label").to_numpy(), _matrix(vector, width), [])
        part.clusters = cluster_anchors(part.vectors)
        # One more than asked for: the anchor's own row may be among them, as the entry with its id and its own score.
        near = _ranked(_scan(candidates, part, PositiveSeek, positives + 1, width), positives + 1)
        self_score = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x).cast("bigint")
        selves = own.select("anchor", F.col("id").alias("anchor_id"), self_score.alias("self_score"))
        near = near.join(selves, "anchor")
        is_self = (F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("self_score"))
        by_place = Window.partitionBy("anchor").orderBy("place")
        copies = F.sum(is_self.cast("int")).over(by_place)
        near = near.withColumn("copies", copies).filter(~(is_self & (F.col("copies") == 1)))
        near = near.withColumn("of", F.row_number().over(by_place) - 1).filter(F.col("of") < positives)
        chosen = write_and_reload(near.select("anchor", "anchor_id", "of", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        places = np.full((len(part.row), positives), np.iinfo(np.int64).min)
        got = chosen.select("anchor", "of", "positive_score").toArrow()  # at most SLICE_ROWS times the number of positives
        places[np.searchsorted(part.row, got.column(0).to_numpy()), got.column(1).to_numpy()] = got.column(2).to_numpy()
        missing = places == np.iinfo(np.int64).min
        score = np.where(missing, 0, places)
        part.low = np.where(missing, 1, -((-low * score) // 100))
        part.high = np.where(missing, 0, (high * score) // 100)
        hard = _ranked(_scan(candidates, part, NegativeSeek, negatives, width), negatives)
        hard = hard.select("anchor", "of", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank"))
        rows = chosen.join(hard, ["anchor", "of"]).select(*results.columns)
        results = results.unionByName(write_and_reload(rows, "hard-negatives"))
    return results
