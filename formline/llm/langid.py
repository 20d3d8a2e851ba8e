"""Language ID by the nearest of several centroids per language.

A text is a vector of byte trigrams (A-Z lower-cased, other ASCII non-letters as a space, trigrams over two words left
out), weighted by TF-IDF and scaled to length one. Each language has a few centroids (spherical k-means over a bounded
sample of its labelled rows); the nearest by cosine wins. Trigrams that the sample never showed lengthen the vector without
adding to any product, so a text in an unknown language or script is far from every centroid and is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import raw_texts, sampled_texts, text_pieces
from formline.session import write_and_reload

SAMPLE_PER_LANGUAGE = 600  # rows of a language that the model is fitted on
CENTROIDS = 3
LEAST_COSINE = 0.01  # a text further from every centroid is rejected
LEAST_OF_LONG = 0.03  # the same for a text of at least _LONG trigrams; README has the rates
_LONG = 30
_SLOTS = 1 << 16  # hashed trigrams
_TOGETHER = 32  # texts whose vectors are held at a time
_WORD_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]  # of each centroid
    slot: np.ndarray  # hashed trigram -> number of a feature; the last number stands for all unseen ones
    idf: np.ndarray
    centroids: np.ndarray  # (features, centroids), zero in the last row
    least: np.ndarray  # of each centroid: the cosine below which a text is too far


def trigrams(raw: bytes) -> np.ndarray:
    """Hashed trigrams, repeats included."""
    found = []
    for piece in text_pieces(raw):
        b = np.frombuffer(b" " + piece.translate(_WORD_BYTES) + b" ", np.uint8).astype(np.uint32)
        inside = b[1:-1] != 0x20
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[inside]
        found.append((code * np.uint32(0x9E3779B1)) >> np.uint32(16))
    return found[0] if len(found) == 1 else np.concatenate(found)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vectors(raws: list[bytes], model: Model) -> np.ndarray:
    """(texts, features) of TF-IDF with length one; unseen trigrams count in the last feature."""
    out = np.stack([np.bincount(model.slot[trigrams(r)], minlength=len(model.idf)) for r in raws]) * model.idf
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def nearest(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid and the cosine, for each text."""
    best, cosine = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for start in range(0, len(texts), _TOGETHER):
        products = vectors(texts[start:start + _TOGETHER], model) @ model.centroids
        best[start:start + _TOGETHER] = products.argmax(axis=1)
        cosine[start:start + _TOGETHER] = products.max(axis=1)
    return best, np.clip(cosine, 0, 1)


def _sample(labelled: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text): the rows of each language with the smallest hashes of their id, ``per_language`` and SAMPLE_BYTES at most; texts without a letter are left out."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).cast("string").rlike("\\p{L}"))
    mine = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return sampled_texts(mine, ["lang"], per_language).select("lang", "text")


def fit(
    labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", least: float = LEAST_COSINE,
) -> Model:
    """Fit on at most ``per_language`` rows and ``common.SAMPLE_BYTES`` bytes of each language, an id once.

    Rows without a letter, a language or an id, and texts above a sixteenth of those bytes, are left out.

    A text is rejected below the cosine ``least``, the same for each language whatever its sample holds; ``predictor`` asks more of long texts.
    Document frequencies are summed by Spark, each language is clustered in a task of its own, and only the model itself
    (slots, weights, a few centroids per language) comes to the driver.
    """
    spark = labelled.sparkSession
    sample = write_and_reload(_sample(labelled, per_language, id_col, text_col, lang_col).repartition(16), "lang-sample")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                total[np.unique(trigrams(raw))] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "df"])

    known = sample.select("text").mapInArrow(slots, "slot int, df bigint").groupBy("slot").agg(F.sum("df").alias("df"))
    n = sample.count()
    known = known.filter(F.col("df") >= min(2, n)).orderBy("slot").collect()  # at most _SLOTS rows
    slot, idf = np.full(_SLOTS, len(known), np.int32), np.ones(len(known) + 1)
    for k, row in enumerate(known):
        slot[row["slot"]] = k
        idf[k] = 1 + np.log((1 + n) / (1 + row["df"]))
    idf[-1] = 1 + np.log(1 + n)
    shared = spark.sparkContext.broadcast(Model([], slot, idf, np.zeros((len(idf), 0)), np.zeros(0)))

    def cluster(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(t.encode() for t in rows["text"])
        data = np.empty((len(texts), len(idf)), np.float32)
        for start in range(0, len(texts), _TOGETHER):
            data[start:start + _TOGETHER] = vectors(texts[start:start + _TOGETHER], shared.value)
        data[:, -1] = 0
        rng = np.random.default_rng(len(texts))
        k = min(centroids, len(texts))
        centre = data[rng.choice(len(texts), k, replace=False)]
        for _ in range(12):
            mine = (data @ centre.T).argmax(axis=1)
            centre = np.stack([data[mine == c].sum(axis=0) if (mine == c).any() else centre[c] for c in range(k)])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame([(key[0], c.astype(np.float64).tolist()) for c in centre], columns=["lang", "centre"])

    rows, bound = sample.groupBy("lang").applyInPandas(cluster, "lang string, centre array<double>").collect(), least
    if not rows:  # nothing to learn from: every text is rejected
        rows, bound = [{"lang": UNKNOWN, "centre": [0.0] * len(idf)}], 1.0
    rows.sort(key=lambda r: (r["lang"], r["centre"]))
    return Model([r["lang"] for r in rows], slot, idf, np.array([r["centre"] for r in rows]).T.copy(), np.full(len(rows), bound))


def too_far(raws: list[bytes], best: np.ndarray, cosine: np.ndarray, model: Model) -> np.ndarray:
    """Whether each text is below its bound: a single word may share few trigrams with its language, a longer text does not."""
    far = cosine < model.least[best]
    for k in np.flatnonzero(~far & (cosine < LEAST_OF_LONG)):
        far[k] = len(trigrams(raws[k])) >= _LONG
    return far


def predictor(spark, model: Model):
    """A column function of a text: struct of lang, score (cosine, 0 to 1) and rejected.

    ``und`` with score 0, rejected, for a null text or one without a letter.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(text: pa.Array) -> pa.Array:
        model, raws = shared.value, raw_texts(text)
        best, cosine = nearest(raws, model)
        void = np.array([not has_letter(r.decode()) for r in raws], bool)
        lang = [UNKNOWN if v else model.languages[b] for v, b in zip(void, best)]
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(np.where(void, 0.0, cosine)), pa.array(void | too_far(raws, best, cosine, model))],
            names=["lang", "score", "rejected"],
        )

    return predict


def predict_language(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row; repeated rows are judged one by one, extra columns are ignored."""
    predict = predictor(docs.sparkSession, model)
    judged = docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col).cast("string")).alias("judged"))
    return judged.select("doc_id", F.col("judged.lang").alias("lang_pred"), "judged.score", "judged.rejected")


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is too far from every language, has no letter or is null."""
    predict = predictor(docs.sparkSession, model)
    return docs.filter(~predict(F.col(text_col).cast("string"))["rejected"])
