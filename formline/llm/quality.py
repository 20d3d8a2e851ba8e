"""Compression classifier: texts compress better with a dictionary of their own kind.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad. A text is compressed piece by
piece with each (pieces, so that a long text keeps leaning on the dictionaries and not on itself); the difference of the two
sizes per byte of text, good texts above, becomes a probability through a logistic curve fitted on other labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import bounded_sample, raw_texts, sampled_texts
from formline.session import write_and_reload

DICTIONARY_BYTES = 65_536
LEVEL = 3
PIECE = 512
SAMPLE_PER_LABEL = 2000  # rows of a label for its dictionary, and as many for the curve


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes] | None  # good, bad
    slope: float
    shift: float
    empty: float  # the value of a text without bytes

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in self.dictionaries:
            # A dictionary that could not be trained is the texts themselves.
            data = zstandard.ZstdCompressionDict(raw)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def score(self, gain: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * gain + self.shift, -40, 40)))


def gains(raws: list[bytes], compressors: list[zstandard.ZstdCompressor], empty: float) -> np.ndarray:
    """Bytes that the good dictionary saves against the bad one, per byte of text."""
    good, bad = compressors
    out = np.full(len(raws), empty)
    for k, raw in enumerate(raws):
        if raw:
            saved = 0
            for start in range(0, len(raw), PIECE):
                piece = raw[start:start + PIECE]
                saved += len(bad.compress(piece)) - len(good.compress(piece))
            out[k] = saved / len(raw)
    return out


def train_dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[k:k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the last of it serves as it is
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def fit_curve(gain: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a slight pull to zero."""
    scale = float(gain.std()) or 1.0
    a, w = np.c_[gain / scale, np.ones(len(gain))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (label - p) - 1e-2 * w)
    return float(w[0] / scale), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, part: Column, per_label: int = SAMPLE_PER_LABEL, id_col: str = "doc_id", text_col: str = "text",
    label_id_col: str = "doc_id", label_col: str = "quality",
) -> Model:
    """Fit on labelled rows. ``part`` is a column over ``labels``: 'dictionary', 'curve' or null for rows not to learn from.

    At most ``per_label`` rows and ``common.SAMPLE_BYTES`` bytes of each label and part are used, those with the smallest hash
    of their id, an id once; texts above a sixteenth of those bytes are left out. Labels other than 0 and 1 are left out. Without rows of both labels the score is the same for every text.
    """
    known = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("label"), part.alias("part"))
    known = known.filter("id is not null and label in (0, 1) and part in ('dictionary', 'curve')").distinct()
    chosen = bounded_sample(known, ["part", "label"], per_label)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    # At most 4 x per_label ids: the bound is proven, so they are broadcast and the texts stay where they are.
    labelled = texts.join(F.broadcast(chosen), F.col("doc") == F.col("id")).select("id", "label", "part", "text")
    sample = write_and_reload(sampled_texts(labelled, ["part", "label"], per_label).repartition(16), "quality-sample")

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode() for _, t in sorted(zip(rows["id"], rows["text"]))]
        return pd.DataFrame([(key[0], train_dictionary(texts))], columns=["label", "dictionary"])

    rows = sample.filter("part = 'dictionary'").select("label", "id", "text").groupBy("label").applyInPandas(train, "label int, dictionary binary").collect()
    found = {r["label"]: bytes(r["dictionary"]) for r in rows}
    neutral = Model(None, 0.0, 0.0, 0.0)
    if len(found) < 2 or not all(found.values()):
        return neutral
    model = Model((found[1], found[0]), 0.0, 0.0, 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            gain = gains(raw_texts(batch.column(1)), compressors, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain)], names=["label", "gain"])

    curve = sample.filter("part = 'curve'").select("label", "text").mapInArrow(measure, "label int, gain double").collect()  # 2 x per_label rows at most
    pairs = np.array(sorted((r["gain"], r["label"]) for r in curve), float).reshape(-1, 2)
    if len(set(pairs[:, 1])) < 2:
        return neutral
    model.slope, model.shift = fit_curve(pairs[:, 0], pairs[:, 1])
    # An empty text is no good text: it scores like the worst labelled ones.
    model.empty = float(pairs[:, 0].min())
    return model


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row, whole texts; null counts as empty. Repeated rows are scored one by one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        compressors = model.compressors() if model.dictionaries else None
        for batch in batches:
            gain = gains(raw_texts(batch.column(1)), compressors, model.empty) if compressors else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(gain))], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, score double")
