"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the training texts.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is ``n`` consecutive words of a
benchmark item; an item with fewer words is one window. Each task maps words to numbers of the benchmark's vocabulary,
looks only at places where a whole window's worth of words is known, filters them by a rolling hash against the
sorted hash set, and verifies every hit word by word.

The broadcast is bounded: items are packed into slices of at most ``max_windows`` windows and a further slice is a further
pass over the texts, so a benchmark of any size works and none is cut.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import free_name, raw_texts, text_pieces

WINDOW = 10
MAX_WINDOWS = 2_000_000
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    if len(words) <= n:
        return [tuple(words)]
    return list(zip(*(words[k:] for k in range(n))))


class NgramSet:
    """The windows of some items: vocabulary, sorted hashes by window length, and the exact windows with their items."""

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], n: int):
        self.items: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item, words in items:
            for window in windows_of(words, n):
                of = self.items[window]
                if item is not None:  # the windows of an item without an id count, only its name is missing
                    of.add(item)
        self.number = {w: k for k, w in enumerate(sorted({w for window in self.items for w in window}))}
        by_length = defaultdict(list)
        for window in self.items:
            by_length[len(window)].append([self.number[w] for w in window])
        self.hashes = {k: np.unique(self._hash(np.array(v, np.int64).reshape(-1), k, np.arange(0, k * len(v), k))) for k, v in by_length.items()}

    @staticmethod
    def _hash(numbers: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
        value = np.zeros(len(starts), np.uint64)
        for k in range(length):
            value = value * _STEP + numbers[starts + k].astype(np.uint64) + np.uint64(1)
        return value

    def scan(self, words: list[bytes]) -> list[tuple[int, int, set[int]]]:
        """(start, length, items) of each occurrence of a window."""
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        known = numbers >= 0
        if not known.any():
            return []
        total, found = np.r_[0, np.cumsum(known)], []
        for length, hashes in self.hashes.items():
            if length > len(words):
                continue
            starts = np.flatnonzero(total[length:] - total[:-length] == length)
            if len(starts):
                starts = starts[np.isin(self._hash(numbers, length, starts), hashes)]
            for s in starts.tolist():
                items = self.items.get(tuple(words[s:s + length]))
                if items is not None:
                    found.append((s, length, items))
        return found

    @property
    def longest(self) -> int:
        return max(self.hashes, default=1)


def scan_text(raw: bytes, grams: NgramSet) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, hit spans of words [start, end) merged and in order, and the items found."""
    n_words, spans, items, tail = 0, [], set(), []
    for piece in text_pieces(raw):
        words = tail + words_of(piece)
        base = n_words - len(tail)
        for start, length, of in grams.scan(words):
            spans.append((base + start, base + start + length))
            items |= of
        n_words = base + len(words)
        tail = words[-(grams.longest - 1):] if grams.longest > 1 else []
    return n_words, merge_spans(spans), items


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; what stands between two cut words goes with them, one space stays."""
    raw = text.encode()
    plain, places, at = raw.translate(_WORD_BYTES), [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at := at + len(word)))
    kept, end = [], 0
    for a, b in spans:
        kept.append(raw[end:places[a][0]].rstrip())
        end = places[b - 1][1]
    kept.append(raw[end:].lstrip() if end else raw)
    return b" ".join(x for x in kept if x).decode()


def benchmark_slices(benchmark: DataFrame, n: int, max_windows: int, item_col: str, text_col: str) -> Iterator[NgramSet]:
    """The benchmark streams through the driver item by item; only one slice is held at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("bigint"), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        words = words_of((text or "").encode())
        size += max(0, len(words) - n) + 1
        if held and size > max_windows:
            yield NgramSet(held, n)
            held, size = [], max(0, len(words) - n) + 1
        held.append((item, words))
    yield NgramSet(held, n)


_FOUND = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<bigint>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", keep_text: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans[, text]) for each row of ``docs``.

    ``spans`` are merged ranges [first, last) of word numbers that lie inside some occurrence of a window. Null and empty
    texts have no words and no hits; empty items have no window; those without an id count as hits and are not listed; repeated rows are judged
    one by one. Extra columns are ignored. An empty table gives an empty result, an empty benchmark no hits.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    spark = docs.sparkSession
    out = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.expr("named_struct('n_words', 0L, 'spans', cast(array() as array<struct<first:bigint,last:bigint>>), 'items', cast(array() as array<bigint>))").alias("found"),
    ).select("doc_id", "text", "found.*")
    slices = benchmark_slices(benchmark, n, max_windows, item_col, item_text_col)
    grams = next(slices)
    while grams is not None:
        shared, grams = spark.sparkContext.broadcast(grams), next(slices, None)
        with_text = keep_text or grams is not None  # a further pass needs the text again

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, with_text=with_text) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lengths, spans, items = [], [], []
                for raw, old_spans, old_items in zip(raw_texts(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    n_words, hit, of = scan_text(raw, shared.value)
                    lengths.append(n_words)
                    merged = merge_spans([*hit, *((x["first"], x["last"]) for x in old_spans)])
                    spans.append([{"first": a, "last": b} for a, b in merged])
                    items.append(sorted(of | set(old_items)))
                kept = batch.column(1) if with_text else pa.nulls(batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), kept, pa.array(lengths, pa.int64()), pa.array(spans, batch.schema.field(3).type), pa.array(items, batch.schema.field(4).type)],
                    names=["doc_id", "text", "n_words", "spans", "items"],
                )

        out = out.mapInArrow(scan, f"doc_id bigint, text string, {_FOUND}")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["last"] - s["first"])
    kept = ["text"] if keep_text else []
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans", *kept)


def item_digest(items: list[int]) -> str:
    """Of the item ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW, **columns: str) -> DataFrame:
    """``docs`` without contaminated rows (``remove='documents'``) or with the hit spans cut out of their texts (``'spans'``).

    Columns stay as they came. A text of which nothing is left becomes the empty text; its row stays.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    text_col = columns.get("text_col", "text")
    whole, = free_name(docs, "row_text")
    slices = benchmark_slices(benchmark, n, MAX_WINDOWS, columns.get("item_col", "item_id"), columns.get("item_text_col", "text"))
    out = docs
    for each in _cutter(docs.sparkSession, slices, remove):
        out = out.withColumn(whole, each(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
        if remove == "documents":
            out = out.filter(F.col(whole)).drop(whole)
        else:
            out = out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(whole))).drop(whole)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _cutter(spark, slices: Iterator[NgramSet], remove: str):
    for grams in slices:
        shared = spark.sparkContext.broadcast(grams)
        yield _is_clean(shared) if remove == "documents" else _without_hits(shared)


def _is_clean(shared):
    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([not scan_text(raw, shared.value)[1] for raw in raw_texts(text)], pa.bool_())

    return clean


def _without_hits(shared):
    @F.arrow_udf("string")
    def without(text: pa.Array) -> pa.Array:
        out = []
        for raw in raw_texts(text):
            spans = scan_text(raw, shared.value)[1]
            out.append(cut_words(raw.decode(), spans) if spans else raw.decode())
        return pa.array(out, pa.string())

    return without
