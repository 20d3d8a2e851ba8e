"""Token counts by rank-synchronous merging of byte-pair symbols.

The pre-tokens of a batch are one ragged array: symbol numbers end to end and where each sequence begins. A round looks up the
rank of every neighbouring pair, takes each sequence's lowest rank, and merges all places of that pair in all sequences at once.
Sequences without a pair left are done; the symbols that survive are their tokens. Merging the places of a pair together
equals merging one by one, as no pair that a merged symbol stands in has a lower rank (checked when a vocabulary is loaded).

Sequences above ``LONG`` symbols would need a pass over the whole sequence for each of their many ranks. They are merged rank by
rank too, but with the places of each rank in a bucket of its own, so that a round touches only the places it merges.

The tokenizer's library cleans and splits texts into pre-tokens, plain ASCII words are split by the file's own pattern; the merging is done here. The file is read by the driver
(at most ``MAX_FILE_BYTES``) and broadcast, so that executors need no copy.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import raw_texts, text_pieces

LIMIT = 2048
LONG = 512
MAX_FILE_BYTES = 64 << 20
#: Counts of distinct words that a task remembers; when full it starts again. Longer words than ``SHORT_CHUNK`` are not remembered.
REMEMBERED = 1 << 18
SHORT_CHUNK = 64
#: Symbols merged together at a time, and bytes of text of which the chunks are held.
BATCH_SYMBOLS = 1 << 20
HELD_BYTES = 4 << 20
NONE = np.iinfo(np.int64).max
#: Symbols of the byte alphabet are letters below this number.
LETTERS = 1 << 9
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


class Merges:
    """The merge table of a vocabulary as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            made[a + b] = rank
        for rank, (a, b) in enumerate(pairs):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError(f"merge {rank} uses a symbol that a later merge makes; such vocabularies are not supported")
        self.vocab, self.size = vocab, 1 + max(vocab.values(), default=0)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for pairs that do not merge."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)


def every_other(places: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Of places that overlap their predecessor (``follows``) the first, third, ... of each run: merging from the left."""
    at = np.arange(len(places))
    start = np.maximum.accumulate(np.where(follows, 0, at))
    return places[(at - start) % 2 == 0]


def merge_ragged(symbols: np.ndarray, starts: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols survive in each sequence; ``starts`` holds the first place of each (none is empty)."""
    left = np.diff(np.append(starts, len(symbols)))
    alive = np.arange(len(starts))  # the sequences still in work
    while len(alive):
        n = left[alive]
        owner = np.repeat(np.arange(len(alive)), n)
        rank = np.full(len(symbols), NONE)
        rank[:-1] = merges.rank(symbols[:-1], symbols[1:])
        first = np.cumsum(n) - n
        rank[first + n - 1] = NONE  # no pair across sequences
        low = np.minimum.reduceat(rank, first)
        places = np.flatnonzero((rank == low[owner]) & (rank != NONE))
        follows = np.append(False, (np.diff(places) == 1) & (owner[places[1:]] == owner[places[:-1]])) if len(places) else np.zeros(0, bool)
        places = every_other(places, follows)
        symbols[places] = merges.product[rank[places]]
        stay = np.ones(len(symbols), bool)
        stay[places + 1] = False
        left[alive] -= np.bincount(owner[places], minlength=len(alive))
        going = (low != NONE) & (left[alive] > 1)
        stay &= going[owner]
        symbols, alive = symbols[stay], alive[going]
    return left


def merge_long(symbols: np.ndarray, merges: Merges) -> int:
    """How many symbols survive in one long sequence: places wait in a bucket for each rank, ranks come in order."""
    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n, NONE)
    rank[:-1] = merges.rank(symbols[:-1], symbols[1:])
    buckets: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def put(places: np.ndarray) -> None:
        places = places[rank[places] != NONE]
        places = places[np.argsort(rank[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[places])) + 1
        for part in np.split(places, cuts) if len(places) else ():
            r = int(rank[part[0]])
            if r not in buckets:
                buckets[r] = []
                heapq.heappush(waiting, r)
            buckets[r].append(part)

    put(np.arange(n - 1))
    count = n
    while waiting:
        r = heapq.heappop(waiting)
        places = np.unique(np.concatenate(buckets.pop(r)))
        places = places[rank[places] == r]  # a place whose symbol or neighbour went has another rank by now
        if not len(places):
            continue
        places = every_other(places, np.append(False, after[places[:-1]] == places[1:]))
        gone = after[places]
        symbols[places] = merges.product[r]
        rank[gone] = NONE
        after[places] = after[gone]
        inner = after[places] < n
        before[after[places][inner]] = places[inner]
        count -= len(places)
        with_left = places[before[places] >= 0]
        changed = np.unique(np.concatenate([places, before[with_left]]))
        follow = after[changed]
        rank[changed] = NONE
        pairs = changed[follow < n]
        rank[pairs] = merges.rank(symbols[pairs], symbols[after[pairs]])
        put(pairs)
    return count


class Counter:
    """Counts the tokens of texts with one vocabulary file."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model = spec["model"]
        plain = {"dropout": None, "continuing_subword_prefix": None, "ignore_merges": False, "byte_fallback": False}
        if model["type"] != "BPE" or any(model.get(k) not in (v, None, "") for k, v in plain.items()):
            raise ValueError("only plain byte-pair models are supported")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) or any(_SPACE.search(t) for t in special):
            raise ValueError("added tokens that are cleaned, bound to words or hold spaces are not supported")
        tokenizer = Tokenizer.from_str(file)
        self.clean, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.plain_words = _plain_pattern(spec)
        self.merges = Merges(model["vocab"], model["merges"])
        end = model.get("end_of_word_suffix") or ""
        inner, last = (np.full(LETTERS, -1, np.int64) for _ in range(2))
        for symbol, number in model["vocab"].items():
            if len(symbol) == 1 and ord(symbol) < LETTERS:
                inner[ord(symbol)] = number
            if len(symbol) == 1 + len(end) and symbol.endswith(end) and ord(symbol[0]) < LETTERS:
                last[ord(symbol[0])] = number
        self.inner, self.last = inner, last
        self.known: dict[str, int] = {}  # of plain words and of odd chunks; only the latter hold control characters or letters beyond ASCII

    def count_words(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token (none is empty)."""
        out, first, size = np.zeros(len(words), np.int64), 0, 0
        for k, word in enumerate(words):
            size += len(word)
            if size > BATCH_SYMBOLS:
                out[first:k + 1] = self._count_batch(words[first:k + 1])
                first, size = k + 1, 0
        if first < len(words):
            out[first:] = self._count_batch(words[first:])
        return out

    def _count_batch(self, words: list[str]) -> np.ndarray:
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        n = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(n)
        symbols = self.inner[letters]
        symbols[ends - 1] = self.last[letters[ends - 1]]
        if (symbols < 0).any():
            raise ValueError("the vocabulary lacks a symbol for some byte")
        out, long = np.zeros(len(words), np.int64), n > LONG
        for k in np.flatnonzero(long):
            out[k] = merge_long(symbols[ends[k] - n[k]:ends[k]].copy(), self.merges)
        if not long.all():
            own = n[~long]
            out[~long] = merge_ragged(symbols[np.repeat(~long, n)], np.cumsum(own) - own, self.merges)
        return out

    def _count_odd(self, chunks: list[str]) -> list[int]:
        """The number of tokens of each chunk, cleaned and split by the library."""
        parts = [[w for w, _ in self.split.pre_tokenize_str(self.clean.normalize_str(c) if self.clean else c) if w] for c in chunks]
        words = list({w for part in parts for w in part})
        counts = dict(zip(words, self.count_words(words).tolist()))
        return [sum(map(counts.__getitem__, part)) for part in parts]

    def _words(self, text: str) -> tuple[list[str], list[str]]:
        """The pre-tokens of the plain chunks of a text (runs without a space), and the other chunks."""
        if self.plain_words is None:
            return [], [c for c in _SPACE.split(text) if c]
        odd = []
        if not text.isascii() or _CONTROL.search(text):
            is_plain = str.isascii if not _CONTROL.search(text) else lambda c: c.isascii() and not _CONTROL.search(c)
            chunks = [c for c in _SPACE.split(text) if c]
            odd = [c for c in chunks if not is_plain(c)]
            text = " ".join([c for c in chunks if is_plain(c)])
        return self.plain_words.findall(text.lower()), odd

    def count(self, texts: list[bytes]) -> list[int]:
        """The number of tokens of each text in UTF-8; the new words of about ``HELD_BYTES`` of text are merged together."""
        totals, held, size = [0] * len(texts), [], 0
        for k, raw in enumerate(texts):
            for piece in text_pieces(raw):
                text = piece.decode()
                if self.special and self.special.search(text):
                    rest = self.special.split(text)
                    totals[k] += len(rest) - 1
                    held.extend((k, *self._words(part)) for part in rest)
                else:
                    held.append((k, *self._words(text)))
                size += len(piece)
                if size > HELD_BYTES:
                    self._settle(held, totals)
                    held, size = [], 0
        self._settle(held, totals)
        return totals

    def _settle(self, held: list[tuple[int, list[str], list[str]]], totals: list[int]) -> None:
        known = self.known
        words = list({w for _, plain, _ in held for w in plain}.difference(known))
        known.update(zip(words, self.count_words(words).tolist()))
        chunks = list({c for _, _, odd in held for c in odd}.difference(known))
        known.update(zip(chunks, self._count_odd(chunks)))
        for k, plain, odd in held:
            totals[k] += sum(map(known.__getitem__, plain)) + sum(map(known.__getitem__, odd))
        if len(known) > REMEMBERED:
            known.clear()
        for x in (words, chunks):
            for key in x:
                if len(key) > SHORT_CHUNK:
                    known.pop(key, None)


def _plain_pattern(spec: dict):
    """The pattern that splits cleaned ASCII text as the library does, None for files with other steps than those seen through here.

    On printable ASCII, composing letters changes nothing, lower-casing is ``str.lower`` and the byte alphabet is ASCII itself;
    the file's own pattern finds the same words, as letters, digits and spaces are then the same for every pattern library.
    """
    clean = (spec["normalizer"] or {}).get("normalizers", [])
    split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [x["type"] for x in clean] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in split] != ["Split", "ByteLevel"]:
        return None
    spaces, cut, alphabet = clean[1], split[0], split[1]
    if spaces["pattern"] != {"Regex": r"\s+"} or spaces["content"] != " " or cut["behavior"] != "Removed" or not cut["invert"]:
        return None
    if "Regex" not in cut["pattern"] or alphabet["add_prefix_space"] or alphabet["use_regex"]:
        return None
    return regex.compile(cut["pattern"]["Regex"])


def read_vocabulary(path: str) -> str:
    """The text of a vocabulary file, of which the size is checked."""
    with open(path, encoding="utf-8") as file:
        text = file.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return text


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``, as the library of the file at ``path`` counts.

    No begin or end token is added and nothing is cut; the vocabulary's special strings inside a text are one token each. A null
    text counts as empty and has no tokens. Ids may be null or repeated: rows are judged one by one. Extra columns are ignored,
    whatever their names. An empty table gives an empty result. Texts are worked on in pieces, a text without a space at once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(path))
    Counter(shared.value)  # unsupported files fail here

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = raw_texts(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counter.count(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = picked.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
