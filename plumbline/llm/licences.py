"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is normalised to lower-case runs of letters and digits; lines and punctuation don't bound a passage. Every window of
words is a candidate for the templates of a size that allows the threshold: with sizes a and b, Dice is at most
2 min(a, b) / (a + b). A template's windows worth trying begin and end with one of its bigrams, for leaving others off only
helps; and a start is tried only if the template's bigrams within reach suffice for the threshold.

Passages are taken from the best window of all templates downwards, each where it overlaps none that was taken before
(versions of one licence share most of their words, so a passage of one is also alike to others): of equal ones that of the
larger template, then the earlier one. The result is that of trying all windows of all templates in this order. Of a
document the best passage of each licence is reported. Templates are short notices and the whole texts of common licences
(`licence_texts`).

Null and empty texts have none; null ids stay null; repeated rows give repeated results; an empty table gives none; other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.wordsplit import runs
from plumbline.session import ship_package

LEAST = 0.8
WORD = re.compile(r"[^\W_]+")
MATCH = "doc_id long, licence string, dice double, first_word long, end_word long"
#: Starts that are ruled out together.
START_BLOCK = 64
TEXTS = Path(__file__).with_name("licence_texts")

#: Notices of common public licences. Fixed values.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def templates_of() -> tuple[tuple[str, str], ...]:
    """(licence, text) of all notices and whole texts, read where the job is planned and sent to the tasks."""
    return NOTICES + tuple((f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt")))


def bigrams(text: str) -> Counter:
    """Word bigrams of a normalised text with their numbers."""
    words = WORD.findall(text.lower())
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """2 |a and b| / (|a| + |b|) of multisets."""
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Templates:
    """Templates as numbers of bigrams."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float = LEAST) -> None:
        rows = [(name, b) for name, b in ((name, bigrams(text)) for name, text in templates) if b]
        self.names, self.least, self.share = [n for n, _ in rows], least, least / (2 - least)
        self.words = {w: k for k, w in enumerate(sorted({w for _, b in rows for pair in b for w in pair}), 1)}  # 0: any other
        self.codes = np.unique(np.array([self._code(x, y) for _, b in rows for x, y in b], np.int64))
        self.counts = np.zeros((len(rows), len(self.codes)), np.int32)
        for k, (_, b) in enumerate(rows):
            self.counts[k, np.searchsorted(self.codes, [self._code(x, y) for x, y in b])] = list(b.values())
        self.member = self.counts > 0
        self.sizes = self.counts.sum(1)

    def _code(self, x: str, y: str) -> int:
        return self.words[x] * (len(self.words) + 1) + self.words[y]

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, bounds of the texts among them)."""
        plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")
        words = pc.split_pattern(plain, " ")
        bounds = np.asarray(words.offsets.to_numpy(zero_copy_only=False), np.int64)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter((self.words.get(w, 0) for w in distinct), np.int64, len(distinct))
        return number[np.asarray(coded.indices.to_numpy(zero_copy_only=False), np.int64)], bounds - bounds[0]

    def passages(self, words: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first word, end word) of one document's numbered words."""
        code = words[:-1] * (len(self.words) + 1) + words[1:]
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        at = np.flatnonzero(self.codes[place] == code) if len(self.codes) else np.zeros(0, np.int64)
        if not len(at):
            return []
        own = place[at]
        likely = np.flatnonzero(self.member[:, own].sum(1) >= self.share * self.sizes - 1e-9)
        searches = {int(k): Search(self, int(k), at, own) for k in likely}
        # starts by what they can reach at most; a start's best window is settled when it comes first, and taken when it still does
        queue = [entry for k, x in searches.items() for entry in x.starts()]
        heapq.heapify(queue)
        taken: list[tuple[int, int]] = []  # (first, end) of passages in their order
        best: dict[str, tuple[float, int, int]] = {}
        while queue:
            value, settled, _, first, _, k, s, end = heapq.heappop(queue)
            after = bisect.bisect_right(taken, (first, math.inf))
            if after and taken[after - 1][1] > first:
                continue
            limit = taken[after][0] if after < len(taken) else math.inf
            if not settled or end > limit:
                found = searches[k].best_from(s, limit)
                if found:
                    heapq.heappush(queue, (-found[0], 1, -int(self.sizes[k]), first, self.names[k], k, s, found[1]))
                continue
            taken.insert(after, (first, end))
            best.setdefault(self.names[k], (-value, first, end))
        return sorted(((name, *x) for name, x in best.items()), key=lambda x: (x[2], x[0]))


class Search:
    """Windows of one document for one template; at, own: where the document has known bigrams."""

    def __init__(self, templates: Templates, k: int, at: np.ndarray, own: np.ndarray) -> None:
        mine = templates.member[k, own]
        self.k, self.name, self.least = k, templates.names[k], templates.least
        self.at, self.size = at[mine], int(templates.sizes[k])
        own, n = own[mine], int(mine.sum())
        # a bigram counts in a window as often as the template has it: not if so many of its kind precede it in the window
        order = np.argsort(own, kind="stable")
        back = np.arange(n) - templates.counts[k, own[order]]
        self.earlier = np.full(n, -1)
        same = (back >= 0) & (own[order[np.maximum(back, 0)]] == own[order])
        self.earlier[order[same]] = order[back[same]]
        self.stop = np.searchsorted(self.at, self.at + int(self.size / templates.share + 1e-9), "left")

    def starts(self) -> list[tuple]:
        """An entry of the queue for each start of which a window may be alike enough, with what it can reach."""
        n, size = len(self.at), self.size
        reach = self.stop - np.arange(n)
        bound = 2 * reach / (reach + size)
        for block in range(0, n, START_BLOCK):
            part = slice(block, min(block + START_BLOCK, n))
            if (bound[part] >= self.least - 1e-12).any():
                most = int((self.earlier[block : self.stop[part.stop - 1]] < part.stop).sum())  # at least what any start of the block has
                bound[part] = np.minimum(bound[part], 2 * most / (most + size))
        return [(-float(bound[s]), 0, -size, int(self.at[s]), self.name, self.k, s, 0) for s in np.flatnonzero(bound >= self.least - 1e-12).tolist()]

    def best_from(self, s: int, limit: float) -> tuple[float, int] | None:
        """(Dice, end word) of the best window from a start that ends at a word before the limit."""
        stop = min(int(self.stop[s]), int(np.searchsorted(self.at, limit - 2, "right")))
        if stop <= s:
            return None
        shared = np.cumsum(self.earlier[s:stop] < s)
        value = 2 * shared / (self.at[s:stop] - self.at[s] + 1 + self.size)
        e = int(value.argmax())
        return (float(value[e]), int(self.at[s + e]) + 2) if value[e] >= self.least - 1e-12 else None


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] | None = None, least: float = LEAST) -> DataFrame:
    """A row for each licence found in a document."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Templates(templates_of() if templates is None else templates, least))  # a fixed set of templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for begin, part in runs(batch.column(1)):
                words, bounds = table.numbered(part)
                rows = [(begin + k, *x) for k in range(len(part)) for x in table.passages(words[bounds[k] : bounds[k + 1]])]
                columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
                columns += [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "licence", "dice", "first_word", "end_word"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MATCH)
