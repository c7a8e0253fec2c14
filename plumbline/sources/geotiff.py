"""Single-band GeoTIFF files on geographic coordinates, read and written without an imaging library.

Writing follows the public TIFF 6.0 and GeoTIFF layouts: one deflated strip for each line, pixel scale and tie point, a
geographic coordinate system by its EPSG number, and the no-data value as text. Reading knows strips that are plain,
deflated or LZW-coded, without predictor. A raster is one task's work, so its cells are bounded by `MOST_CELLS`.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import constants as C
from plumbline.operators.grids import raster_index
from plumbline.session import ship_package

MOST_CELLS = 200_000_000
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8}
_CODES = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d"}


def encode(values: np.ndarray, west: float, north: float, step_lon: float, step_lat: float, epsg: int = 4686, nodata: float = C.NODATA) -> bytes:
    """A GeoTIFF of an array of float32 or float64, north first; west and north are the outer corner of the first cell."""
    rows, cols = values.shape
    strips = [zlib.compress(np.ascontiguousarray(line).astype(line.dtype.newbyteorder("<")).tobytes()) for line in values]
    start = 8
    offsets = start + np.concatenate([[0], np.cumsum([len(s) for s in strips])])[:-1]
    tags: list[tuple[int, int, tuple | bytes]] = [
        (256, 4, (cols,)), (257, 4, (rows,)), (258, 3, (values.dtype.itemsize * 8,)), (259, 3, (8,)), (262, 3, (1,)), (273, 4, tuple(int(x) for x in offsets)), (277, 3, (1,)), (278, 4, (1,)),
        (279, 4, tuple(len(s) for s in strips)), (284, 3, (1,)), (339, 3, (3,)), (33550, 12, (step_lon, step_lat, 0.0)), (33922, 12, (0.0, 0.0, 0.0, west, north, 0.0)),
        (34735, 3, (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, epsg)), (42113, 2, f"{nodata:g}\0".encode()),
    ]
    body = b"".join(strips)
    directory = start + len(body)
    directory += directory % 2
    extra_at = directory + 2 + 12 * len(tags) + 4
    entries, extra = b"", b""
    for tag, kind, data in tags:
        raw = data if isinstance(data, bytes) else struct.pack(f"<{len(data)}{_CODES[kind]}", *data)
        n = len(data)
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, n, extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    head = struct.pack("<2sHI", b"II", 42, directory)
    return (head + body).ljust(directory, b"\0") + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, widths from 9 to 12 that grow one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        while bits >= width:
            code = (held >> (bits - width)) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def decode(data: bytes) -> tuple[np.ndarray, float, float, float, float, float | None]:
    """(values, west, north, step_lon, step_lat, nodata) of a file that `encode` or a like writer made."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    (count,) = struct.unpack_from(f"{order}H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        place = at + 2 + 12 * k + 8
        if _SIZES.get(kind, 9) * n > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if kind == 2:
            tags[tag] = (data[place : place + n].rstrip(b"\0").decode("ascii", "replace"),)
        elif kind in _CODES:
            tags[tag] = struct.unpack_from(f"{order}{n}{_CODES[kind]}", data, place)
    cols, rows, bits, coding = tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(259, (1,))[0]
    if tags.get(277, (1,))[0] != 1 or tags.get(317, (1,))[0] != 1 or 273 not in tags:
        raise ValueError("only single-band files in strips without predictor are read")
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
    unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress}[coding]
    flat = b"".join(unpack(data[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
    values = np.frombuffer(flat, f"{order}{kind}{bits // 8}", rows * cols).reshape(rows, cols).astype(float)
    sx, sy, _ = tags[33550]
    i, j, _, x, y, _ = tags[33922][:6]
    nodata = float(tags[42113][0]) if 42113 in tags and tags[42113][0].strip() else None
    return values, x - i * sx, y + j * sy, sx, sy, nodata


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """row, col, lat, lon (of the centres) and value of GeoTIFF files; cells without data are left out."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                values, west, north, sx, sy, nodata = decode(content.as_py())
                row, col = np.nonzero(~np.isnan(values) & (values != (np.nan if nodata is None else nodata)))
                for at in range(0, len(row), 200_000):
                    r, c = row[at : at + 200_000], col[at : at + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(north - (r + 0.5) * sy), pa.array(west + (c + 0.5) * sx), pa.array(values[r, c])], names=["row", "col", "lat", "lon", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row int, col int, lat double, lon double, value double")


def write_geotiff(points: DataFrame, path: str, value: str = "value", single: bool = False, nodata: float = C.NODATA, epsg: int = 4686) -> None:
    """One file of a raster of points (lat, lon, value), north first; gaps hold the no-data value."""
    spark = points.sparkSession
    ship_package(spark)
    indexed = raster_index(points.select("lat", "lon", F.col(value).cast("double").alias("value")))
    edge = indexed.agg(F.max("row"), F.max("col"), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if edge[0] is None:
        raise ValueError("no points")
    rows, cols = edge[0] + 1, edge[1] + 1
    if rows * cols > MOST_CELLS:
        raise ValueError(f"{rows} x {cols} cells; at most {MOST_CELLS} go into one file")
    sy = (edge[3] - edge[2]) / (rows - 1) if rows > 1 else 1.0
    sx = (edge[5] - edge[4]) / (cols - 1) if cols > 1 else 1.0
    west, north = edge[4] - sx / 2, edge[3] + sy / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raster = np.full((rows, cols), nodata, np.float32 if single else np.float64)
        for batch in batches:
            v = batch.column("value").to_numpy(zero_copy_only=False)
            raster[batch.column("row").to_numpy(), batch.column("col").to_numpy()] = np.where(np.isnan(v), nodata, v)
        yield pa.RecordBatch.from_arrays([pa.array([encode(raster, west, north, sx, sy, epsg, nodata)], pa.binary())], names=["payload"])

    folder = f"{path}.writing-{uuid.uuid4().hex}"
    made = indexed.select("row", "col", "value").repartition(1).mapInArrow(run, "payload binary")
    made.select(F.col("payload").cast("string").alias("value")).write.text(folder)  # the sink keeps bytes and adds a line feed
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source = hadoop.Path(folder)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [x.getPath() for x in files.listStatus(source) if x.getPath().getName().startswith("part-")]
    files.delete(hadoop.Path(path), False)
    files.rename(part, hadoop.Path(path))
    files.delete(source, True)
