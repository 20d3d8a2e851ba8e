"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are cut into ``radius + 2`` blocks. Two fingerprints that differ in at most ``radius`` bits agree in at least
two whole blocks, so each fingerprint is filed once under every pair of blocks, and only files are compared: whatever the
size of the corpus, a row is shuffled ten times (radius 3). A file with more than ``refine_above`` members is filed again
under quarters of the remaining bits (any pair within the radius still shares one), which spreads a hot file over many.

Inside a file fingerprints are stored as bit planes, one machine word per 64 of them. Distances grow plane by plane in
vertical counters, three planes per carry-save step, and blocks of which every lane is past the radius are abandoned.

A file gives a spanning forest of its links, never all pairs, and the components of all forests are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import PIECE_BYTES, keep_rows, mark_of, raw_texts, shuffle_partitions, text_pieces
from formline.llm.components import connected_components
from formline.session import write_and_reload

SEED = 42
SHINGLE = 3
RADIUS = 3
REFINE_ABOVE = 4096
_HASHES = 50_000  # shingle hashes that are counted together
_FEW = 48  # files up to this size are compared as one list of lanes over many files
_LANES = 4096  # lanes of a block
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# Fingerprints


def _shingle_hashes(words: list[bytes], size: int, seed: int) -> Iterator[int]:
    return map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(size)))), repeat(seed))


def _bit_counts(hashes: np.ndarray, starts: list[int]) -> np.ndarray:
    """(texts, 64): how many hashes of each text have bit k, texts beginning at ``starts``."""
    one = np.uint64(1)
    return np.stack([np.add.reduceat((hashes >> np.uint64(k)) & one, starts) for k in range(64)], axis=1).astype(np.int64)


def _pack(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """A bit is 1 if more than half of the hashes have it."""
    return np.packbits(counts * 2 > totals[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _fingerprint_of_long(raw: bytes, size: int, seed: int) -> int:
    counts, total, tail = np.zeros((1, 64), np.int64), 0, []
    for piece in text_pieces(raw.lower()):
        words = tail + piece.split()
        n = len(words) - size + 1
        if n > 0:
            counts += _bit_counts(np.fromiter(_shingle_hashes(words, size, seed), np.uint64, n), [0])
            total += n
        tail = words[-(size - 1):] if size > 1 else []
    if total:
        return int(_pack(counts, np.array([total]))[0])
    return xxhash.xxh64_intdigest(b" ".join(tail), seed) if tail else 0


def fingerprints_of(raws: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The unsigned 64-bit SimHash of the word shingles of each text; 0 without words, the whole sequence if there are fewer words."""
    out = np.zeros(len(raws), np.uint64)
    waiting: list[tuple[int, int, Iterator[int]]] = []
    n_waiting = 0

    def flush() -> None:
        nonlocal waiting, n_waiting
        sizes = np.array([n for _, n, _ in waiting], np.int64)
        hashes = np.fromiter(chain.from_iterable(h for _, _, h in waiting), np.uint64, n_waiting)
        out[[at for at, _, _ in waiting]] = _pack(_bit_counts(hashes, np.r_[0, np.cumsum(sizes)[:-1]]), sizes)
        waiting, n_waiting = [], 0

    for at, raw in enumerate(raws):
        if len(raw) > PIECE_BYTES:
            out[at] = _fingerprint_of_long(raw, size, seed)
            continue
        words = raw.lower().split()
        if not words:
            continue
        if len(words) < size:
            out[at] = xxhash.xxh64_intdigest(b" ".join(words), seed)
            continue
        n = len(words) - size + 1
        waiting.append((at, n, _shingle_hashes(words, size, seed)))
        n_waiting += n
        if n_waiting >= _HASHES:
            flush()
    if waiting:
        flush()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = fingerprints_of(raw_texts(batch.column(2)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["id", "mark", "print"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, print) for each row, the fingerprint as a signed bigint."""
    picked = docs.select(F.col(id_col).cast("bigint").alias("id"), mark_of(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_fingerprint_batches, "id bigint, mark bigint, print bigint")


# Bit-sliced comparison


class Counter:
    """A vertical counter: one number per lane, bit k of all lanes in ``bits[k]``; ``over`` marks lanes that overflowed."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.radius = radius
        self.bits = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.over = np.zeros(shape, np.uint64)

    def _carry(self, carry: np.ndarray, level: int) -> None:
        for k in range(level, len(self.bits)):
            self.bits[k], carry = self.bits[k] ^ carry, self.bits[k] & carry
        self.over |= carry

    def add3(self, p: np.ndarray, q: np.ndarray, r: np.ndarray) -> None:
        """Three planes at once: a full adder turns them into a sum and a carry of the next weight."""
        half = p ^ q
        self._carry(half ^ r, 0)
        self._carry((p & q) | (half & r), 1)

    def past(self) -> np.ndarray:
        """Lanes whose number is above the radius."""
        above, level = self.over.copy(), np.full_like(self.over, _FULL)
        for k in range(len(self.bits) - 1, -1, -1):
            if self.radius >> k & 1:
                level &= self.bits[k]
            else:
                above |= level & self.bits[k]
                level &= ~self.bits[k]
        return above

    def keep(self, alive: np.ndarray) -> None:
        self.bits, self.over = [b[alive] for b in self.bits], self.over[alive]


def to_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit planes of uint64 values, lane i in bit i of the row; the number of lanes is a multiple of 64."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` lanes of the last axis as booleans."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """For each position, whether ``a`` and ``b`` (uint64) differ in at most ``radius`` bits."""
    n = len(a)
    size = min(_LANES, -(-n // 64) * 64)
    padded = np.full(-(-n // size) * size, _FULL)
    padded[:n] = a ^ b
    planes = to_planes(padded).reshape(64, -1, size // 64)
    counter, alive = Counter(planes.shape[1:], radius), np.arange(planes.shape[1])
    out = np.zeros(planes.shape[1:], np.uint64)
    for start in range(0, 63, 3):
        counter.add3(*planes[start:start + 3])
        if start % 15 == 12:
            ok = (counter.past() != _FULL).any(axis=1)
            if not ok.all():
                alive, planes = alive[ok], planes[:, ok]
                counter.keep(ok)
                if not len(alive):
                    return np.zeros(n, bool)
    counter._carry(planes[63], 0)
    out[alive] = ~counter.past()
    return lanes(out.reshape(-1), n)


def forest_of_many(prints: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links of many small files laid end to end; ``ends[i]`` is the end of the file of position i."""
    left, right, step = [], [], 1
    at = np.arange(len(prints))
    while True:
        at = at[at + step < ends[at]]
        if not len(at):
            break
        hit = at[within(prints[at], prints[at + step], radius)]
        left.append(hit)
        right.append(hit + step)
        step += 1
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    links = []
    if left:
        for i, j in zip(np.concatenate(left).tolist(), np.concatenate(right).tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return prints[pairs[:, 0]], prints[pairs[:, 1]]


def forest_of_one(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links of one large file: 64 members at a time against all that follow them, block by block."""
    n, left, right = len(prints), [], []
    group = np.arange(n)
    for start in range(0, n, 64):
        asked = prints[start:start + 64]
        wanted = (((asked[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)) * _FULL).T[:, :, None]  # (64, q, 1)
        for low in range(start, n, 64 * _LANES):
            part = prints[low:low + 64 * _LANES]
            padded = np.zeros(-(-len(part) // 64) * 64, np.uint64)
            padded[:len(part)] = part
            planes = to_planes(padded)
            counter, done = Counter((len(asked), planes.shape[1]), radius), False
            for k in range(0, 63, 3):
                counter.add3(*(planes[k + d] ^ wanted[k + d] for d in range(3)))
                if k % 15 == 12 and (counter.past() == _FULL).all():
                    done = True
                    break
            if done:
                continue
            counter._carry(planes[63] ^ wanted[63], 0)
            near = lanes(~counter.past(), len(part))
            for q in range(len(asked)):
                found = low + np.flatnonzero(near[q])
                names = group[found]
                mine = group[start + q]
                if len(names) and (names != mine).any():
                    for other in np.unique(names[names != mine]).tolist():
                        left.append(mine)
                        right.append(other)
                    group[np.isin(group, np.unique(names))] = mine
    return prints[np.array(left, np.int64)], prints[np.array(right, np.int64)]


def _scanner(radius: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (file, key, print) come sorted; a file that reaches over batches is carried on."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            table, key, prints = (np.concatenate(x) for x in zip(*held))
            prints = prints.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])])
            stops = np.r_[starts[1:], len(prints)]
            if not last:  # the last file may go on
                starts, stops = starts[:-1], stops[:-1]
                cut = stops[-1] if len(stops) else 0
                held, size = [(table[cut:], key[cut:], prints[cut:].view(np.int64))], 0
            length = stops - starts
            small = (length > 1) & (length <= _FEW)
            found = []
            if small.any():
                at = np.concatenate([np.arange(a, b) for a, b in zip(starts[small], stops[small])])
                ends = np.repeat(np.cumsum(length[small]), length[small])
                found.append(forest_of_many(prints[at], ends, radius))
            for a, b in zip(starts[length > _FEW], stops[length > _FEW]):
                found.append(forest_of_one(prints[a:b], radius))
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                size += batch.num_rows
                if size >= 200_000:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return scan


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int) -> tuple[list[int], list[list[int]]]:
    """The masks of all pairs of blocks, and for each the ``radius + 1`` masks that add a part of the remaining bits."""
    parts = np.array_split(np.arange(64), radius + 2)
    bits_of = lambda bits: sum(1 << int(b) for b in bits)
    first, second = [], []
    for i in range(radius + 2):
        for j in range(i + 1, radius + 2):
            base = bits_of(parts[i]) | bits_of(parts[j])
            rest = [b for b in range(64) if not base >> b & 1]
            first.append(base)
            second.append([base | bits_of(p) for p in np.array_split(rest, radius + 1)])
    return first, second


def links(prints: DataFrame, radius: int = RADIUS, refine_above: int = REFINE_ABOVE) -> DataFrame:
    """(a, b) over the distinct fingerprints ``print`` so that components equal those of all pairs within ``radius``."""
    if not 0 <= radius <= 15:
        raise ValueError("radius is from 0 to 15")
    first, second = masks(radius)
    n = shuffle_partitions(prints.sparkSession)
    file = lambda k, m: F.struct(F.lit(k).alias("file"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key"))
    filed = prints.select("print", F.inline(F.array(*[file(k, m) for k, m in enumerate(first)])))
    filed = write_and_reload(filed, "filed")
    large = filed.groupBy("file", "key").count().filter(F.col("count") > refine_above).select("file", "key")
    large = write_and_reload(large, "large-files").withColumn("large", F.lit(True))
    ways = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in second])
    known = filed.join(large, ["file", "key"], "left")
    again = known.filter("large").select("print", "file", F.posexplode(F.element_at(ways, F.col("file") + 1)).alias("part", "mask"))
    again = again.select(
        "print", (F.lit(len(first)) + F.col("file") * (radius + 1) + F.col("part")).alias("file"), F.col("print").bitwiseAND(F.col("mask")).alias("key")
    )
    files = known.filter("large is null").select("file", "key", "print").unionByName(again)
    sorted_files = files.select("file", "key", "print").repartition(n, "file", "key").sortWithinPartitions("file", "key")
    return sorted_files.mapInArrow(_scanner(radius), "a bigint, b bigint")


def near_groups(
    docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", refine_above: int = REFINE_ABOVE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id, print, mark.

    ``component_id`` is the smallest id that can be reached over links of at most ``radius`` differing bits, the own id
    included. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share a fingerprint.
    Null ids are never a component's id unless it has no other. An empty table gives an empty result.
    """
    prints = write_and_reload(fingerprints(docs, id_col, text_col), "prints")
    # A fingerprint is one node however many rows have it.
    nodes = write_and_reload(prints.groupBy("print").agg(F.min("id").alias("low")), "print-nodes")
    found = connected_components(links(nodes.select("print"), radius, refine_above)).select(F.col("node").alias("print"), "component")
    placed = nodes.join(found, "print", "left").select("print", "low", F.coalesce("component", "print").alias("component"))
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = placed.join(lows, "component").select("print", "component_id")
    return prints.join(classes, "print").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "print", "mark"
    )


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id (ties: the smallest hash of its text)."""
    groups = write_and_reload(near_groups(docs, radius, id_col, text_col), "near-groups")
    # Only rows that carry their component's id can stay; the few of them that share it are told apart by their text.
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("mark").alias("best"))
    first = first.withColumnRenamed("component_id", "own")
    decided = groups.join(first, groups["doc_id"].eqNullSafe(first["own"]), "left")
    stays = F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("best")), F.lit(False))
    return keep_rows(docs, decided.select(F.col("doc_id").alias("id"), "mark", stays.alias("kept")), "near-gone", id_col, text_col)
