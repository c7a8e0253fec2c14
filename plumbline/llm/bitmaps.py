"""A bitmap of ids, of fixed size, that spares a shuffle most rows that its join would drop.

It is built on the executors and added up in a tree; false positives only cost their transfer, as the join that follows
decides. However many ids there are, the broadcast has `BITS / 8` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.trees import fold_vectors, vector_batch
from plumbline.llm.wordsplit import mix

BITS = 1 << 25


def _places(ids: pa.Array) -> np.ndarray:
    return (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """Packed bits of the ids in the frame's only column."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[_places(batch.column(0))] = True
        if bits.any():
            yield vector_batch(np.packbits(bits, bitorder="little"))

    found = fold_vectors(ids.mapInArrow(mark, "v binary"), np.uint8, np.bitwise_or)
    return np.zeros(BITS // 8, np.uint8) if found is None else found


def hits(ids: pa.Array, bitmap: np.ndarray) -> np.ndarray:
    """Which ids may be among those of the bitmap."""
    at = _places(ids)
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def packed_texts(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """doc_id and z, the compressed text, of the rows (doc_id, text) whose id may be among those of the bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            kept = np.flatnonzero(hits(batch.column(0), shared.value))
            if len(kept):
                packed = [squeeze.compress((batch.column(1)[k].as_py() or "").encode()) for k in kept.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(packed, pa.binary())], names=["doc_id", "z"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, z binary")


def unpack_texts(column: pa.Array) -> pa.Array:
    """Texts of a column that `packed_texts` made."""
    open_up = zstandard.ZstdDecompressor()
    return pa.array([open_up.decompress(x.as_py()).decode() for x in column], pa.large_string())
