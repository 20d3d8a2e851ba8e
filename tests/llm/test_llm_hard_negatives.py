import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.llm import hard_negatives as hard

SCHEMA = "vec_id bigint, label bigint, vector array<double>, id string, anchor string, score string, `of` string"


def brute(rows, positives=5, negatives=3):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None for x in r[2])]
    out = []
    for k, (a, label, v) in enumerate(rows):
        if a % 50:
            continue
        scored = sorted(((-sum(int(x) * int(y) for x, y in zip(v, w)), i, m, n) for n, (i, m, w) in enumerate(rows)), key=lambda s: s[:2])
        for score, positive, _, _ in [s for s in scored if s[2] == label and s[3] != k][:positives]:
            fit = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:negatives]
            out += [(a, positive, rank, s[1], -score, -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in hard.mine_hard_negatives(df, F.col("vec_id") % 50 == 0, **kw).collect())


def some_rows(n, seed, width=6, size=40):
    rnd = np.random.default_rng(seed)
    return [(int(i), int(rnd.integers(4)), [float(x) for x in rnd.integers(-size, size, width)]) for i in range(n)]


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(hard, "SLICE_ROWS", 7)
    monkeypatch.setattr(hard, "BLOCK_BYTES", 6 * 8 * 50)
    monkeypatch.setattr(hard, "STEP", 4)


def test_equals_brute_force_over_several_slices(spark, small_pieces):
    rows = some_rows(900, 1)
    assert mined(spark, rows) == brute(rows)


def test_edge_rows(spark, small_pieces):
    """Nulls, zero and shorter vectors, ties, one vector in a third of all rows, repeated anchors, ids repeated with another vector."""
    rows = some_rows(400, 2, size=5)
    rows += [(1000 + i, i % 4, [3.0, 1.0, 0.0, 0.0, 2.0, -1.0]) for i in range(200)]
    rows += [rows[50], rows[50], rows[100], (150, 1, [1.0, 2.0]), (150, 2, [0.0] * 6), (None, 1, [1.0] * 6), (2000, None, [1.0] * 6), (2050, 1, None)]
    rows += [(2100, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2150, 3, []), (2200, 9, [5.0] * 6)]
    padded = [(i, m, None if v is None else [*v, *[0.0] * (6 - len(v))]) for i, m, v in rows]
    assert mined(spark, rows) == brute(padded)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [2.0])]) == []
    assert mined(spark, [(50, 1, [])]) == []


def test_large_components():
    big = np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 5.0], [1.0, 1.0]])
    assert hard.products(*big).tolist() == [[2**60 + 15, 2**30 + 3]]
    with pytest.raises(ValueError):
        hard.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_walks_end_early_where_anchors_cluster():
    """Candidates far from a narrow cluster are never multiplied, and nothing within reach is missed."""
    rnd = np.random.default_rng(4)
    centres = hard.unit(rnd.normal(size=(8, 16)))
    block = np.round(1000 * hard.unit(centres[rnd.integers(0, 8, 4000)] + 0.02 * rnd.normal(size=(4000, 16))))
    anchors = np.round(1000 * hard.unit(centres[np.arange(64) % 8] + 0.02 * rnd.normal(size=(64, 16))))
    part = hard.Slice(np.arange(64), np.zeros(64, np.int64), anchors, hard.cluster_anchors(anchors))
    seek = hard.PositiveSeek(part, 5)
    visit = seek.block(np.arange(4000), np.zeros(4000, np.int64))
    done = sum(hard.walk(c, anchors, block, seek.ready, visit) for c in part.clusters)
    scores = hard.products(anchors, block)
    want = np.sort(scores, axis=1)[:, ::-1][:, :5]
    assert np.array_equal(seek.best.score.reshape(64, 5), want)
    assert done < 0.5 * scores.size
