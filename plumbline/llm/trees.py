"""Sums of vectors over all partitions in a tree; one vector reaches the driver and no task adds up more than `FAN_IN`.

Vectors travel compressed: most are mostly zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

FAN_IN = 16


def vector_batch(vector: np.ndarray) -> pa.RecordBatch:
    """A row (column `v`, binary) that holds a vector."""
    return pa.RecordBatch.from_arrays([pa.array([packed(vector)], pa.binary())], names=["v"])


def packed(vector: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(vector.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def fold_vectors(partials: DataFrame, kind: type, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """All equally long vectors (column `v`; at most one a partition) folded into one; None without rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                v = unpacked(x.as_py(), kind)
                total = v if total is None else join(total, v)
        if total is not None:
            yield vector_batch(total)

    tasks = max(2, partials.rdd.getNumPartitions())
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        partials = partials.repartition(tasks).mapInArrow(fold, "v binary")
    found = partials.first()
    return None if found is None else unpacked(found["v"], kind)


def sum_vectors(partials: DataFrame, kind: type = np.int64) -> np.ndarray | None:
    """Their sum."""
    return fold_vectors(partials, kind, np.add)
