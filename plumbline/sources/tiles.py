"""Binary elevation and residual-terrain tiles, .npy matrices and catalogues.

Tiles are read through Spark's binary source, so any store will do; a task decodes one tile at a time. Given a box, the folder's
listing is met with it first: only tiles that the box meets are opened, and only cells in it become rows.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import constants as C
from plumbline.session import ship_package

#: Divisors that turn stored whole numbers into units.
FUNCTIONAL_SCALE = {"ha": 1000.0, "dg": 10.0, "xi": 10.0, "eta": 10.0, "dem": 1.0}
CELLS = 2500
UNITS_PER_DEGREE = 36_000_000 // 100  # whole hundredths of an arc second
#: South, north, west and east borders in degrees.
Box = tuple[float, float, float, float]


def read_terrain_tiles(spark: SparkSession, path: str, kind: str = "dg", cells: int = CELLS, size: int = 5, box: Box | None = None) -> DataFrame:
    """ilat, ilon (whole hundredths of a second, of the cell's centre) and value of tiles named like N05W075.dg.

    A tile has cells x cells big-endian 16-bit numbers in columns from west, each from north to south. Missing ones are
    left out. box: only cells with their centres in it or one cell beside it.
    """
    ship_package(spark)
    scale = FUNCTIONAL_SCALE[kind]
    unit = size * UNITS_PER_DEGREE // cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lat, lon, content in zip(batch.column("lat").to_pylist(), batch.column("lon").to_pylist(), batch.column("content"), strict=True):
                z = np.frombuffer(content.as_py(), ">i2", cells * cells).astype(float).reshape(cells, cells)  # [column, row]
                col, row = np.nonzero(z != C.TILE_NODATA)
                north = (lat + size) * UNITS_PER_DEGREE
                ilat = north - unit // 2 - row.astype(np.int64) * unit
                ilon = lon * UNITS_PER_DEGREE + unit // 2 + col.astype(np.int64) * unit
                if box is not None:
                    south, north, west, east = (x * UNITS_PER_DEGREE for x in box)
                    inside = (ilat >= south - unit) & (ilat <= north + unit) & (ilon >= west - unit) & (ilon <= east + unit)
                    row, col, ilat, ilon = row[inside], col[inside], ilat[inside], ilon[inside]
                for at in range(0, len(row), 200_000):
                    part = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ilat[part]), pa.array(ilon[part]), pa.array(z[col[part], row[part]] / scale)], names=["ilat", "ilon", "value"])

    return _located(spark, path, kind, size, box).mapInArrow(run, "ilat long, ilon long, value double")


def read_hgt(spark: SparkSession, path: str, box: Box | None = None) -> DataFrame:
    """lat, lon, value of one-degree elevation tiles (.hgt): elevations below zero are zero, missing ones left out. box: only cells
    in it or one cell beside it."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lat, lon, content in zip(batch.column("lat").to_pylist(), batch.column("lon").to_pylist(), batch.column("content"), strict=True):
                z = np.frombuffer(content.as_py(), ">i2")
                n = round(len(z) ** 0.5)
                z = z.reshape(n, n)  # [row from north, column]
                row, col = np.nonzero(z != C.TILE_NODATA)
                if box is not None:
                    step = 1 / (n - 1)
                    y, x = lat + 1 - row * step, lon + col * step
                    inside = (y >= box[0] - 1.5 * step) & (y <= box[1] + 1.5 * step) & (x >= box[2] - 1.5 * step) & (x <= box[3] + 1.5 * step)
                    row, col = row[inside], col[inside]
                for at in range(0, len(row), 200_000):
                    r, c = row[at : at + 200_000], col[at : at + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(lat + 1 - r / (n - 1)), pa.array(lon + c / (n - 1)), pa.array(np.maximum(z[r, c], 0).astype(float))], names=["lat", "lon", "value"])

    return _located(spark, path, "hgt", 1, box).mapInArrow(run, "lat double, lon double, value double")


#: Paths of tiles that one read names: those of a box as large as the globe.
MOST_PATHS = 70_000


def tile_listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, name, lat, lon (of the south-west corner, from the name) of the tile files of a folder; none is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select("path")
    name = F.regexp_extract("path", r"([NS]\d{2}[EW]\d{3})[^/]*$", 1)
    sign = lambda at, bad: F.when(F.substring("name", at, 1) == bad, -1).otherwise(1)
    lat = sign(1, "S") * F.substring("name", 2, 2).cast("int")
    lon = sign(4, "W") * F.substring("name", 5, 3).cast("int")
    return files.withColumn("name", name).where("name <> ''").select("path", "name", lat.alias("lat"), lon.alias("lon"))


def tiles_of(listing: DataFrame, box: Box, size: int, margin: float = 0.0) -> DataFrame:
    """The listing's tiles (lat, lon of the corner, `size` degrees) that the box with a margin around it meets."""
    south, north, west, east = box
    return listing.where((F.col("lat") <= north + margin) & (F.col("lat") + size >= south - margin) & (F.col("lon") <= east + margin) & (F.col("lon") + size >= west - margin))


def _located(spark: SparkSession, path: str, suffix: str, size: int, box: Box | None = None) -> DataFrame:
    """lat, lon and content of tile files, of those that meet the box alone where there is one."""
    listing = tile_listing(spark, path, suffix)
    if box is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path)
    else:
        chosen = [r["path"] for r in tiles_of(listing, box, size).select("path").limit(MOST_PATHS + 1).collect()]
        if len(chosen) > MOST_PATHS:
            raise ValueError(f"more than {MOST_PATHS} tiles meet the box; read them without one")
        if not chosen:
            return spark.createDataFrame([], "lat int, lon int, content binary")
        files = spark.read.format("binaryFile").load(chosen)
    return files.select("path", "content").join(F.broadcast(listing) if box is not None else listing, "path").select("lat", "lon", "content")


def npy_header(data: bytes) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """(dtype, shape, column order, offset of the data) of a .npy file's first bytes, versions 1 to 3."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = data[6] >= 2
    length = int.from_bytes(data[8 : 12 if wide else 10], "little")
    start = 12 if wide else 10
    head = ast.literal_eval(data[start : start + length].decode("utf-8" if data[6] >= 3 else "latin-1"))
    return np.dtype(head["descr"]), tuple(head["shape"]), bool(head["fortran_order"]), start + length


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """row_id and values of the rows of .npy matrices; a matrix of more than 2 GB belongs in Parquet."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                kind, shape, columns, offset = npy_header(data)
                m = np.frombuffer(data, kind, int(np.prod(shape)), offset).reshape(shape, order="F" if columns else "C")
                m = m.reshape(len(m), -1).astype(float)
                for at in range(0, len(m), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(at + 1024, len(m)))), pa.array(list(m[at : at + 1024]), pa.list_(pa.float64()))], names=["row_id", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row_id long, values array<double>")


def choose_model(catalogue: DataFrame, wanted: str, degree: int | None = None) -> DataFrame:
    """The catalogue entry (name) to take for a wanted model: the exact name, else the shortest that contains it, a given
    degree at its end being preferred."""
    name, key = F.lower("name"), wanted.lower()
    rank = F.when(name == key, 0).when(F.lit(degree is not None) & name.rlike(rf"[_-]?{degree}$") & name.contains(key), 1).when(name.contains(key), 2)
    return catalogue.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", F.length("name"), "name").limit(1).drop("rank")


def tiles_needed(index: DataFrame, south: float, north: float, west: float, east: float, size: int = 5) -> DataFrame:
    """Names in an index whose tile meets the box; names hold [NS]dd[EW]ddd."""
    lat = F.regexp_extract("name", r"[NS](\d{2})[EW]\d{3}", 1).try_cast("int") * F.when(F.col("name").rlike(r"S\d{2}[EW]\d{3}"), -1).otherwise(1)
    lon = F.regexp_extract("name", r"[NS]\d{2}[EW](\d{3})", 1).try_cast("int") * F.when(F.col("name").rlike(r"[NS]\d{2}W\d{3}"), -1).otherwise(1)
    placed = index.withColumn("lat", lat).withColumn("lon", lon)
    return placed.where((F.col("lat") < north) & (F.col("lat") + size > south) & (F.col("lon") < east) & (F.col("lon") + size > west))


def missing_tiles(needed: DataFrame, there: DataFrame) -> DataFrame:
    """Needed names that aren't there."""
    return needed.join(there.select("name"), "name", "left_anti")
