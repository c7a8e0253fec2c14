"""Quality classifier: random Fourier features, ridge regression from summed normal equations, isotonic calibration.

1. Every whole text becomes `len(FEATURES)` statistics; nothing but the text enters them.
2. They are standardised and mapped to `WAVES` random cosines, which approximate a Gaussian kernel.
3. Every partition of labelled rows sums its own normal equations; the sums are added in a tree and solved once.
4. On a fold kept from the fit, raw scores are counted on a fixed grid and made monotone by pooling adjacent violators;
   scores are interpolated between the pools.

Labelled rows are used whole, but for the held-out fifth (CRC32 of the id as text, modulo 5, is 0). The fold that is 1
calibrates. Null labels and labels of unknown documents don't count; repeated ones count each. Null and empty texts are
scored like any. Without labels of both kinds in both folds every score is the share of ones (1 without labels).
An empty table gives none. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bitmaps import bitmap_of, hits
from plumbline.llm.trees import sum_vectors, vector_batch
from plumbline.llm.wordsplit import mix, runs, split_words
from plumbline.session import settle, ship_package

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digits", "blanks", "stops", "commas", "marks",
    "symbols", "bars", "other_ascii", "beyond_ascii", "distinct_words", "top_word", "repeated_windows", "upper_words",
    "marked_words", "log_lines", "line_words", "copied_lines", "short_lines", "unstopped_lines",
)
WAVES = 256
RIDGE = 1e-3
THRESHOLD = 0.3
GRID = 1024
LOW, HIGH = -0.5, 1.5

_CLASSES = ("upper", "digits", "blanks", "stops", "commas", "marks", "symbols", "bars", "other_ascii", "beyond_ascii")
_TABLE = np.zeros(256, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\n\x0b\x0c", ".", ",;:", "!?", "#*$%&<>@^~+=_\\", "|", "\"'()[]{}-/`"), 1):
    _TABLE[[ord(x) for x in _chars]] = _k
_TABLE[128:] = len(_CLASSES)


def byte_shares(texts: pa.Array) -> np.ndarray:
    """Share of each class of bytes in each text."""
    joined = pc.binary_join_element_wise(texts, pa.scalar("\n", texts.type), pa.scalar("", texts.type))  # laid out anew, and no text is empty
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kinds = _TABLE[data]
    starts = offsets[:-1] - offsets[0]
    sizes = np.diff(offsets)
    return np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(1, len(_CLASSES) + 1)], 1) / sizes[:, None]


def statistics(texts: pa.Array) -> np.ndarray:
    """Features of texts (large strings without nulls), one row each."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    chars = np.asarray(pc.utf8_length(texts).to_numpy(zero_copy_only=False), float)
    out[:, 0] = np.log1p(chars)
    out[:, 4:14] = byte_shares(texts)
    at, bounds, distinct = split_words(texts)
    length = np.array([len(w) for w in distinct], float)
    upper = np.array([w.isupper() and len(w) > 1 for w in distinct], float)
    marked = np.array([not w[-1:].isalnum() and w[-1:] not in ".,;:" for w in distinct], float) if distinct else np.zeros(0)
    code = np.arange(1, len(distinct) + 1, dtype=np.uint64)[at]
    with np.errstate(over="ignore"):
        window = mix(code[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ mix(code[1:-1]) + mix(code[2:] * np.uint64(3))) if len(code) > 2 else np.zeros(0, np.uint64)
    for k in range(n):
        a, b = int(bounds[k]), int(bounds[k + 1])
        m = b - a
        out[k, 1] = np.log1p(m)
        if m:
            own = at[a:b]
            counts = np.unique(own, return_counts=True)[1]
            out[k, 2] = length[own].mean()
            out[k, 3] = (length[own] > 12).mean()
            out[k, 14] = len(counts) / m
            out[k, 15] = counts.max() / m
            if m > 2:
                out[k, 16] = 1 - len(np.unique(window[a : b - 2])) / (m - 2)
            out[k, 17] = upper[own].mean()
            out[k, 18] = marked[own].mean()
        lines = [x for x in texts[k].as_py().split("\n") if x.strip()]
        out[k, 19] = np.log1p(len(lines))
        if lines:
            out[k, 20] = np.log1p(m / len(lines))
            out[k, 21] = 1 - len(set(lines)) / len(lines)
            out[k, 22] = sum(len(x) < 30 for x in lines) / len(lines)
            out[k, 23] = sum(x[-1] not in ".!?" for x in lines) / len(lines)
    return out


def features(docs: DataFrame, id_col: str, text_col: str, only: np.ndarray | None = None) -> DataFrame:
    """doc_id and x, the statistics of every text, or with a bitmap `only` of those whose id may be in it."""
    chosen = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if chosen.value is not None:
                batch = batch.filter(pa.array(hits(batch.column(0), chosen.value)))
            for begin, part in runs(batch.column(1)):
                x = statistics(part)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(x)), rows], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def fold(id_col: str = "doc_id") -> Column:
    """CRC32 of the id as text, modulo 5; null ids are in no fold but 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5, F.lit(1))


@dataclass
class Model:
    """Everything that scoring needs."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray | None
    knots: np.ndarray
    heights: np.ndarray

    def waves(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        d = len(FEATURES)
        turns = rng.normal(0, 1 / np.sqrt(d), (d, WAVES))
        shift = rng.random(WAVES) * 2 * np.pi
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / WAVES) * np.cos(z @ turns + shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.waves(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), float(self.heights[0]))
        return np.clip(np.interp(self.raw(x), self.knots, self.heights), 0, 1)


def _vectors(rows: DataFrame, width: int, of: object) -> np.ndarray:
    """Sum over labelled rows (x, y) of of(x, y), a vector of `width` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
                total += of(x, np.asarray(batch.column(1), float))
        yield vector_batch(total)

    found = sum_vectors(rows.select("x", "y").mapInArrow(run, "v binary"), np.float64)
    return np.zeros(width) if found is None else found


def pool(counts: np.ndarray, ones: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression on a grid: pools' weighted centres and their shares of ones, rising."""
    pools: list[list[float]] = []
    for n, k, c in zip(counts, ones, centres, strict=True):
        if not n:
            continue
        pools.append([n, k, n * c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> Model:
    """The model from features (doc_id, x) and labels, without the held-out fifth."""
    marks = labels.where(F.col(label_col).isNotNull()).select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    known = settle(rows.join(marks, "doc_id").withColumn("fold", fold()).where("fold <> 0"))
    d = len(FEATURES)
    first = _vectors(known, 2 * d + 2, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(y), y.sum()]]))
    n, ones = first[-2:]
    mean = first[:d] / max(n, 1)
    scale = np.sqrt(np.maximum(first[d : 2 * d] / max(n, 1) - mean**2, 1e-8))
    model = Model(mean, scale, None, np.zeros(1), np.array([ones / n if n else 1.0]))
    w = WAVES + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.waves(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y), y.sum()]])

    sums = _vectors(known.where("fold <> 1"), w * w + w + 2, equations)
    m, own = sums[-2:]
    if not 0 < own < m:
        return model
    gram = sums[: w * w].reshape(w, w)
    penalty = np.eye(w) * RIDGE * m
    penalty[-1, -1] = 0
    fitted = Model(mean, scale, np.linalg.solve(gram + penalty + 1e-9 * np.eye(w), sums[w * w : w * w + w]), model.knots, model.heights)

    def grid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cell = np.clip(((fitted.raw(x) - LOW) / (HIGH - LOW) * GRID).astype(int), 0, GRID - 1)
        return np.concatenate([np.bincount(cell, minlength=GRID), np.bincount(cell, y, GRID)])

    counted = _vectors(known.where("fold = 1"), 2 * GRID, grid)
    counts, positives = counted[:GRID], counted[GRID:]
    if not 0 < positives.sum() < counts.sum():
        return model
    centres = LOW + (np.arange(GRID) + 0.5) * (HIGH - LOW) / GRID
    fitted.knots, fitted.heights = pool(counts, positives, centres)
    return fitted


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = settle(features(docs, id_col, text_col))
    model = spark.sparkContext.broadcast(fit(rows, labels, label_id, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of the documents that the classifier accepts."""
    spark = docs.sparkSession
    ship_package(spark)
    known = bitmap_of(labels.select(F.col("doc_id").cast("long")))  # texts stay where they are: only statistics are joined
    model = spark.sparkContext.broadcast(fit(settle(features(docs, id_col, text_col, known)), labels))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for begin, part in runs(batch.column(place)):
                good[begin : begin + len(part)] = model.value.score(statistics(part)) >= THRESHOLD
            yield batch if good.all() else batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
