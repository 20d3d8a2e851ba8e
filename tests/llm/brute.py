"""Plain versions of the operators, quadratic or worse, to hold results against."""

from __future__ import annotations

import base64
import hashlib
import re

import xxhash

#: Rows that are easy to get wrong: repeated rows, ties, nulls, empty, blank, one word, non-ASCII, very long.
EDGE = [
    (1, "Hello World again my friend"), (2, "hello world AGAIN my friend"), (2, "hello world AGAIN my friend"), (3, None), (4, ""), (5, " \n\t "), (6, "Ünïcode É É"),
    (7, "ünïcode É É"), (None, "hello world again my friend"), (8, "one"), (9, "ONE"), (10, "word " * 30_000), (11, "one two"), (12, "!!! ??? ...\x0b\x0c"), (13, "12 34"),
    (14, None), (15, "Привет мир, как дела сегодня"), (16, "x" * 50_000), (17, "a b c"),
]
CLASHES = ["id", "mark", "print", "digest", "row_mark", "row_text", "keep_id", "words", "cell", "n", "Text_", "judged", "lang_pred"]


def edge_docs(spark, rows=None):
    """Documents with the edge rows and with columns named like those that the operators use inside."""
    rows = EDGE if rows is None else rows
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASHES) for i, t in rows], schema)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base32_sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def exact(rows):
    """[(doc_id, keep_id, group_size, text_sha256)] sorted."""
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[lower(t)], len(groups[lower(t)]), sha(lower(t))) for i, t in rows), key=repr)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, radius=3):
    """The smallest id reachable from each position."""
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a + 1, len(prints)):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                up[find(b)] = find(a)
    lows = {}
    for k, i in enumerate(ids):
        if i is not None:
            lows[find(k)] = min(i, lows.get(find(k), i))
    return [lows.get(find(k)) for k in range(len(ids))]


def leaks(rows, items, n=10):
    """[(doc_id, n_words, n_hit, items)] sorted."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, of = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k:k + size]))):
                    hit |= set(range(k, k + size))
                    of |= found
        out.append((i, len(w), len(hit), tuple(sorted(of))))
    return sorted(out, key=repr)


def manifest(rows, fan_out=16):
    """rows: (doc_id, source, lang, n_chars, text). {leaf: (doc_id, subroot, root, proof, folded, verified)} as a sorted list."""
    import zlib

    def h(*parts):
        return sha("".join(parts))

    def leaf(values):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        """The top digest and, for each node, its (left, right) at each level."""
        paths, place = [[] for _ in nodes], list(range(len(nodes)))
        level = nodes
        while len(level) > 1:
            for k, p in enumerate(place):
                run = level[p // fan_out * fan_out:][:fan_out]
                paths[k].append((run[:p % fan_out], run[p % fan_out + 1:]))
                place[k] = p // fan_out
            level = [h(*level[i:i + fan_out]) for i in range(0, len(level), fan_out)]
        return level[0], paths

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((leaf(r), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = {s: tree([x[0] for x in sources[s]]) for s in order}
    root, upper = tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, up in zip(order, upper):
        for (own, r), path in zip(sources[s], trees[s][1]):
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf((*r[:4], None if r[4] is None else lower(r[4]))) if altered else own
            proof = h(*(x for left, right in path + up for x in (*left, *right)))
            for left, right in path + up:
                node = h(*left, node, *right)
            out.append((r[0], own, trees[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)
