"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some words of a window and ignore the others, so a window's hash survives substitutions at ignored places.
Hashes of the benchmark items' windows under every mask are looked up for every window of every whole document; around a
hit, item and document are laid over each other on its diagonal, which counts when any stretch of it is long enough and
agrees in `AGREEMENT` of its words. Reported is the best stretch (match +1, substitution -2) if it does, else the best one
that does.

The benchmark is the query set. It is taken in blocks of at most `BLOCK_WORDS` words, each block sent to all tasks; any
number of items is done in as many passes as it has blocks, and documents are never shuffled. Items of equal words are one
item, named by their least id.

Words are as for near-duplicates (lower case, no punctuation at the ends). Items of less than `SPAN` words are sought whole and
exactly; items and documents without words match nothing. Rows with null ids: documents' matches carry the null id, items
are left out. Repeated documents give repeated rows. Empty tables give none. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.wordsplit import content_codes, hashed_runs, mix
from plumbline.session import settle, ship_package

#: Every stretch of SPAN words or more that agrees in AGREEMENT of them has a hit: s substitutions leave s + 1 runs of 4 s
#: matches or more, so one has four words, but for fifteen words with three substitutions in four runs of three. Fixed values.
MASKS = ("1111", "11101")
#: Shorter items are sought whole and exactly.
SPAN = 12
#: A stretch must have so many words (or all of a shorter item) and agree in this share of them.
LEAST_WORDS = 13
AGREEMENT = 0.8
#: A stretch agrees in AGREEMENT of its words when its matches less MISS times its substitutions are not negative.
MISS = round(AGREEMENT / (1 - AGREEMENT))
BLOCK_WORDS = 1_000_000
#: So many hits are looked at together.
HITS = 20_000
_FILTER_BITS = 22
MATCH = "doc_id long, item_id long, doc_start long, item_start long, length long, matches long"


def window_codes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash of each window's picked words."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        factor = np.uint64(0x9E3779B97F4A7C15)
        power = np.uint64(1)
        for k, bit in enumerate(mask):
            power = power * factor
            if bit == "1":
                code += words[k : k + n] * power
        return mix(code)


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """(begin, end) of the stretch with the most matches less twice the substitutions."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.argmin(sums[: end + 1])), end


def agreeing_stretch(same: np.ndarray, least: int) -> tuple[int, int]:
    """(begin, end) of the stretch of `least` words or more with the most matches less MISS times the substitutions, the
    first of equals; (0, 0) where none agrees in AGREEMENT of its words."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISS))])
    if len(same) < least:
        return 0, 0
    score = sums[least:] - np.minimum.accumulate(sums[: len(sums) - least])
    end = int(np.argmax(score))
    if score[end] < 0:
        return 0, 0
    return int(np.argmin(sums[: end + 1])), end + least


class Block:
    """Items of one pass, ready for lookups."""

    def __init__(self, items: list[tuple[int, np.ndarray]], masks: tuple[str, ...] = MASKS) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum([len(w) for _, w in items])]).astype(np.int64)
        self.words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        sizes = np.diff(self.bounds)
        self.seeds = []
        whole = {"1" * int(n) for n in sizes if 0 < n < SPAN}
        for mask, seeded in [*((m, True) for m in masks), *((m, False) for m in sorted(whole))]:
            codes, owner, place = [], [], []
            for k, (_, words) in enumerate(items):
                if len(words) >= SPAN if seeded else len(words) == len(mask):
                    own = window_codes(words, mask)
                    codes.append(own)
                    owner.append(np.full(len(own), k))
                    place.append(np.arange(len(own)))
            if not codes:
                continue
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            known = np.zeros(1 << _FILTER_BITS, bool)
            known[code >> np.uint64(64 - _FILTER_BITS)] = True
            self.seeds.append((mask, seeded, code[order], np.concatenate(owner)[order], np.concatenate(place)[order], known))

    def find(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item id, start in the document, start in the item, length, matches), one for a document, item and diagonal."""
        tried: set[tuple[int, int, int]] = set()
        found = []
        for mask, seeded, codes, owner, place, known in self.seeds:
            own = window_codes(words, mask)
            maybe = np.flatnonzero(known[own >> np.uint64(64 - _FILTER_BITS)])
            low = np.searchsorted(codes, own[maybe], "left")
            count = np.searchsorted(codes, own[maybe], "right") - low
            doc = np.searchsorted(bounds, maybe, "right") - 1
            real = (count > 0) & (maybe + len(mask) <= bounds[doc + 1])
            maybe, low, count, doc = maybe[real], low[real], count[real], doc[real]
            before = np.concatenate([[0], np.cumsum(count)])
            for begin in range(0, int(before[-1]), HITS):
                hit = np.arange(begin, min(begin + HITS, int(before[-1])))
                window = np.searchsorted(before, hit, "right") - 1
                k = low[window] + hit - before[window]
                at, d, item, own_at = maybe[window], doc[window], owner[k], place[k]
                if seeded:
                    near = self._near(words, bounds, at, d, item, own_at)
                    at, d, item, own_at = at[near], d[near], item[near], own_at[near]
                for key in zip(d.tolist(), item.tolist(), (at - bounds[d] - own_at).tolist(), strict=True):
                    if key in tried:
                        continue
                    tried.add(key)
                    match = self._verify(words[bounds[key[0]] : bounds[key[0] + 1]], *key[1:])
                    if match:
                        found.append((key[0], int(self.ids[key[1]]), *match))
        return found

    def _near(self, words: np.ndarray, bounds: np.ndarray, at: np.ndarray, doc: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a stretch that counts lies within reach of each hit. A longer one can be cut in parts of less than
        2 * LEAST_WORDS words, of which one counts by itself and has a hit of its own."""
        reach = np.arange(-2 * LEAST_WORDS, 2 * LEAST_WORDS + 1)
        there = at[:, None] + reach
        own = (self.bounds[item] + place)[:, None] + reach
        inside = (there >= bounds[doc][:, None]) & (there < bounds[doc + 1][:, None]) & (own >= self.bounds[item][:, None]) & (own < self.bounds[item + 1][:, None])
        same = words[np.clip(there, 0, len(words) - 1)] == self.words[np.clip(own, 0, len(self.words) - 1)]
        sums = np.zeros((len(at), len(reach) + 1), np.int32)
        np.cumsum(np.where(inside, np.where(same, 1, -MISS), -1000), axis=1, out=sums[:, 1:])
        low = np.minimum.accumulate(sums, axis=1)
        near = (sums[:, LEAST_WORDS:] >= low[:, :-LEAST_WORDS]).any(axis=1)
        short = np.flatnonzero(np.diff(self.bounds)[item] < LEAST_WORDS)
        near[short] = (sums[short, SPAN:] >= low[short, :-SPAN]).any(axis=1)
        return near

    def _verify(self, doc: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int, int] | None:
        own = self.words[self.bounds[item] : self.bounds[item + 1]]
        first = max(0, -diagonal)
        last = min(len(own), len(doc) - diagonal)
        same = own[first:last] == doc[first + diagonal : last + diagonal]
        least = min(LEAST_WORDS, len(own))
        begin, end = best_stretch(same)
        matches = int(same[begin:end].sum())
        if end - begin < least or matches < AGREEMENT * (end - begin):
            begin, end = agreeing_stretch(same, least)
            matches = int(same[begin:end].sum())
            if end == begin:
                return None
        return first + begin + diagonal, first + begin, end - begin, matches


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks; only one is on the driver at a time."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, words, bounds in hashed_runs(batch.column(1)):
                own = [words[a:b] for a, b in zip(bounds, bounds[1:])]
                codes = [content_codes(w) if len(w) else (None, None) for w in own]
                ids = batch.column(0).slice(begin, len(own))
                yield pa.RecordBatch.from_arrays([ids, pa.array([w.tobytes() for w in own], pa.binary()), *(pa.array([c[k] for c in codes], pa.int64()) for k in range(2))], names=["item", "words", "c1", "c2"])

    chosen = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    rows = chosen.mapInArrow(coded, "item long, words binary, c1 long, c2 long").where("c1 IS NOT NULL")
    distinct = rows.groupBy("c1", "c2").agg(F.min("item").alias("item"), F.first("words").alias("words")).orderBy("item", "c1", "c2")
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in distinct.toLocalIterator():
        words = np.frombuffer(row["words"], np.uint64)
        held.append((row["item"], words))
        size += len(words)
        if size >= block_words:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for every verified overlap of a document with a benchmark item."""
    spark = docs.sparkSession
    ship_package(spark)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(block: object) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = MATCH.replace(" long", "").split(", ")
            for batch in batches:
                for begin, words, bounds in hashed_runs(batch.column(1)):
                    found = block.value.find(words, bounds)
                    ids = batch.column(0).take(pa.array([begin + x[0] for x in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in found], pa.int64()) for k in range(1, 6))], names=names)

        return chosen.mapInArrow(run, MATCH)

    result = None
    for block in item_blocks(benchmark, item_col, item_text, block_words):
        found = search(spark.sparkContext.broadcast(block))
        result = found if result is None else settle(result).unionByName(settle(found))
    return result if result is not None else spark.createDataFrame([], MATCH)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of the documents that overlap no benchmark item."""
    spark = docs.sparkSession
    ship_package(spark)
    place = docs.columns.index(text_col)

    def without(frame: DataFrame, block: object) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for begin, words, bounds in hashed_runs(batch.column(place)):
                    clean[[begin + x[0] for x in block.value.find(words, bounds)]] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        return frame.mapInArrow(run, frame.schema)

    for number, block in enumerate(item_blocks(benchmark, item_col, item_text, block_words)):
        docs = without(settle(docs) if number else docs, spark.sparkContext.broadcast(block))
    return docs
