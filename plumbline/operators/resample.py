"""Resampling of a regular raster to another step: nearest, linear, or cubic (tensor product of not-a-knot splines).

All three are separable: first every meridian of the raster is brought to the target latitudes, then every target
parallel to the target longitudes. A group is one line of the raster, never the raster. Lines with the same places are
solved together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import ship_package

METHODS = ("nearest", "linear", "cubic")


def spline_seconds(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of not-a-knot splines through the columns of y; four knots at least."""
    n, h = len(t), np.diff(t)
    matrix, right = np.zeros((n, n)), np.zeros_like(y)
    k = np.arange(1, n - 1)
    matrix[k, k - 1], matrix[k, k], matrix[k, k + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    slopes = np.diff(y, axis=0) / h[:, None]
    right[1:-1] = 6 * np.diff(slopes, axis=0)
    matrix[0, :3] = h[1], -(h[0] + h[1]), h[0]
    matrix[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    return np.linalg.solve(matrix, right)


def along(t: np.ndarray, y: np.ndarray, at: np.ndarray, method: str) -> np.ndarray:
    """Columns of y, given at t, at the places `at`; NaN outside of t. Lines too short for a cubic are taken linearly."""
    out = np.full((len(at), y.shape[1]), np.nan)
    inside = (at >= t[0] - 1e-9) & (at <= t[-1] + 1e-9)
    x = np.clip(at[inside], t[0], t[-1])
    if len(t) == 1:
        out[inside] = y[0]
        return out
    k = np.clip(np.searchsorted(t, x, "right") - 1, 0, len(t) - 2)
    h, u = t[k + 1] - t[k], x - t[k]
    w = (u / h)[:, None]
    if method == "nearest":
        out[inside] = np.where(w <= 0.5, y[k], y[k + 1])  # halfway: the lower one
    elif method == "linear" or len(t) < 4:
        out[inside] = y[k] + np.where(w == 0, 0, w * (y[k + 1] - y[k]))
    else:
        s = spline_seconds(t, y)
        h, u = h[:, None], u[:, None]
        slope = (y[k + 1] - y[k]) / h - h * (2 * s[k] + s[k + 1]) / 6
        out[inside] = y[k] + slope * u + s[k] / 2 * u**2 + (s[k + 1] - s[k]) / (6 * h) * u**3
    return out


def _lines(frame: DataFrame, keep: str, run_along: str, targets: np.ndarray, method: str) -> DataFrame:
    grouped = frame.groupBy(keep).agg(F.array_sort(F.collect_list(F.struct(F.col(run_along).alias("t"), F.col("value").alias("y")))).alias("line"))
    flat = grouped.select(keep, F.col("line.t").alias("t"), F.transform("line.y", lambda y: F.coalesce(y, F.lit(float("nan")))).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same: dict[bytes, list[int]] = {}
            for k in range(batch.num_rows):
                same.setdefault(np.asarray(batch.column(1)[k].values).tobytes(), []).append(k)
            for places, members in same.items():
                y = np.stack([np.asarray(batch.column(2)[k].values, float) for k in members], 1)
                z = along(np.frombuffer(places), y, targets, method)
                kept = np.asarray(batch.column(0), float)[members]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(kept, len(targets))), pa.array(np.tile(targets, len(members))), pa.array(z.T.ravel(), from_pandas=True)], names=["a", "b", "value"])

    return flat.mapInArrow(run, "a double, b double, value double").select(F.col("a").alias(keep), F.col("b").alias(run_along), "value")


def resample(raster: DataFrame, step_lat: float, step_lon: float, method: str = "linear", south: float | None = None, north: float | None = None, west: float | None = None, east: float | None = None) -> DataFrame:
    """lat, lon, value on a grid of the given steps from the south-west corner; NULL outside and where data is missing.

    Sides that aren't given are the raster's.
    """
    if method not in METHODS:
        raise ValueError(f"{method} is none of {METHODS}")
    ship_package(raster.sparkSession)
    edge = raster.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if edge[0] is None:
        return raster.select("lat", "lon", "value")
    south, north, west, east = (given if given is not None else found for given, found in zip((south, north, west, east), edge, strict=True))
    lats, lons = np.arange(south, north + step_lat / 2, step_lat), np.arange(west, east + step_lon / 2, step_lon)
    return _lines(_lines(raster.select("lat", "lon", "value"), "lon", "lat", lats, method), "lat", "lon", lons, method)
