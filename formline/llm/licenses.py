"""License scans: passages compared with license templates by the Dice coefficient over word bigrams.

Passages are the lines, the paragraphs (up to an empty line) and the whole of a text, in words of digits, letters and
non-ASCII characters, A-Z lower-cased, copyright lines left out. Two sets of bigrams of sizes m and n can reach a coefficient t
only if ``t / (2 - t) <= m / n <= (2 - t) / t``: templates are kept by size, so a passage meets only those that can match.

A license that is only a part of a longer passage is found by windows: any run of consecutive words, over lines and paragraphs,
copyright lines with and without. Only bigrams of a template can begin and end its best window, and only where enough of
them stand close together are windows counted, so ordinary prose costs one lookup a word.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import raw_texts
from formline.llm.decontaminate import words_of

THRESHOLD = 0.8

# License names and the usual notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def _dropped(line: bytes) -> bool:
    return line.lstrip()[:9].lower() == b"copyright"


def normal_words(raw: bytes) -> list[bytes]:
    return [w for line in raw.split(b"\n") if not _dropped(line) for w in words_of(line)]


class Templates:
    """Bigram counts of the templates, ordered by size."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold is above 0 and at most 1")
        self.threshold = threshold
        found = []
        for name, text in templates:
            words = normal_words(text.encode())
            if len(words) > 1:
                found.append((len(words) - 1, name, Counter(zip(words, words[1:]))))
        found.sort(key=lambda x: x[:2])
        self.sizes = [size for size, _, _ in found]
        self.found = found
        self.known = frozenset(gram for _, _, grams in found for gram in grams)
        self.most = (2 - threshold) / threshold * max(self.sizes, default=0)
        self.number = {gram: k for k, gram in enumerate(sorted(self.known))}
        # How often template t has bigram g.
        self.times = np.zeros((len(found), len(self.number)), np.int64)
        for t, (_, _, grams) in enumerate(found):
            for gram, k in grams.items():
                self.times[t, self.number[gram]] = k

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        """The highest coefficient of at least the threshold and the license (ties: the first name)."""
        n = len(words) - 1
        if n < 1 or n > self.most or self.known.isdisjoint(zip(words, words[1:])):
            return None
        t = self.threshold
        low, high = bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        grams, best = Counter(zip(words, words[1:])), None
        for size, name, template in self.found[low:high]:
            common = sum(min(k, grams[g]) for g, k in template.items() if g in grams)
            dice = 2 * common / (size + n)
            if dice >= t and (best is None or (-dice, name) < (-best[0], best[1])):
                best = (dice, name)
        return best


    def _hits(self, raw: bytes, copyrights: bool) -> np.ndarray:
        """(4, hits): of each known bigram its place, its number, the place of its first word among all words and that word's line."""
        rows, last, n, place = [], None, 0, 0
        for at, line in enumerate(raw.split(b"\n")):
            words = words_of(line)
            if words and (copyrights or not _dropped(line)):
                grams = list(zip(words, words[1:]))
                if last is not None and (k := self.number.get((last[0], words[0]))) is not None:
                    rows.append((n - 1, k, last[1], last[2]))
                if not self.known.isdisjoint(grams):
                    rows += [(n + i, k, place + i, at) for i, g in enumerate(grams) if (k := self.number.get(g)) is not None]
                n += len(words)
                last = (words[-1], place + len(words) - 1, at)
            place += len(words)
        return np.array(rows, np.int64).reshape(-1, 4).T

    def _windows_of(self, hits: np.ndarray) -> Iterator[tuple[float, str, int, int, int, int]]:
        """(dice, license, first and last word, first and last line): of each template the best window from each place where one can begin."""
        t = self.threshold
        for (size, name, _), times in zip(self.found, self.times):
            least, widest = max(1, math.ceil(size * t / (2 - t) - 1e-9)), size * (2 - t) / t + 1e-9
            mine = hits[:, times[hits[1]] > 0]
            if mine.shape[1] < least:
                continue
            at, gram, place, line = mine
            for i in np.flatnonzero(at[least - 1:] - at[:len(at) - least + 1] < widest).tolist():
                left, common, best = {}, 0, None
                stop = np.searchsorted(at, at[i] + widest)
                for j, (a, g) in enumerate(zip(at[i:stop].tolist(), gram[i:stop].tolist()), i):
                    rest = left.get(g, times[g])
                    if rest > 0:
                        left[g], common = rest - 1, common + 1
                        dice = 2 * common / (size + a - int(at[i]) + 1)
                        if dice >= t and (best is None or dice > best[0]):
                            best = (dice, j)
                if best:
                    yield best[0], name, int(place[i]), int(place[best[1]]) + 1, int(line[i]), int(line[best[1]])

    def windows(self, raw: bytes) -> list[tuple[float, str, int, int]]:
        """(dice, license, first and last line) of windows that share no word, the best first (ties: the longest, first name, first word)."""
        both = [True] if not any(map(_dropped, raw.split(b"\n"))) else [True, False]
        hits = (h for h in (self._hits(raw, c) for c in both) if h.shape[1])
        found = sorted({w for h in hits for w in self._windows_of(h)}, key=lambda w: (-w[0], w[2] - w[3], *w[1:]))
        firsts, lasts, out = [], [], []
        for dice, name, a, b, top, end in found:
            k = bisect_left(firsts, a)
            if (k == len(firsts) or firsts[k] > b) and (not k or lasts[k - 1] < a):
                firsts.insert(k, a)
                lasts.insert(k, b)
                out.append((dice, name, top, end))
        return out


def passages(raw: bytes, most: float) -> Iterator[tuple[str, int, int, list[bytes]]]:
    """(kind, numbers of its first and last line, words): lines, paragraphs of several lines, and the whole text of several paragraphs.

    A passage with more than ``most`` + 1 words is too large for every template and is not put together.
    """
    whole: list[bytes] | None = []
    paragraph: list[bytes] | None = []
    first, last, lines, paragraphs = 0, 0, 0, 0
    for at, line in enumerate([*raw.split(b"\n"), b""]):
        words = [] if _dropped(line) else words_of(line)
        if words:
            yield "line", at, at, words
            if not lines:
                first, paragraphs = at, paragraphs + 1
            lines, last = lines + 1, at
            paragraph = _joined(paragraph, words, most)
            whole = _joined(whole, words, most)
        if not line.strip() and lines:
            if lines > 1 and paragraph is not None:
                yield "paragraph", first, last, paragraph
            paragraph, lines = [], 0
    if paragraphs > 1 and whole is not None:
        yield "text", 0, last, whole


def _joined(held: list[bytes] | None, words: list[bytes], most: float) -> list[bytes] | None:
    return None if held is None or len(held) + len(words) > most + 1 else held + words


def scan_licenses(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, license and dice of the best passage (ties: first name, then first line), matches
    (array of kind, line, license, dice in order of line).

    Texts without a matching passage, null and empty texts have null, null and an empty array. A text of one line or one
    paragraph is not compared again as a larger passage. A window (kind ``window``, at the line of its first word) counts unless
    the lines of a matching passage with the same license hold it. Repeated rows are judged one by one; extra columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("line", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            names, scores, matches = [], [], []
            for raw in raw_texts(batch.column(1)):
                whole = [(kind, a, b, *hit) for kind, a, b, words in passages(raw, known.most) if (hit := known.best(words))]
                found = [(kind, a, name, dice) for kind, a, _, dice, name in whole]
                for dice, name, a, b in known.windows(raw):
                    if not any(name == x[4] and x[1] <= a and b <= x[2] for x in whole):
                        found.append(("window", a, name, dice))
                found.sort(key=lambda x: (x[1], x[0]))
                best = min(found, key=lambda x: (-x[3], x[2], x[1]), default=None)
                names.append(best and best[2])
                scores.append(best and best[3])
                matches.append([dict(zip(("kind", "line", "license", "dice"), m)) for m in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(matches, kind)], names=["doc_id", "license", "dice", "matches"]
            )

    Templates(templates, threshold)
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(scan, "doc_id bigint, license string, dice double, matches array<struct<kind:string,line:bigint,license:string,dice:double>>")
