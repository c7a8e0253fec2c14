"""Writers: lossless Parquet for stages, tab-separated text for exchange, raster text grids and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import constants as C
from plumbline.operators.grids import raster_index


def write_stage(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def write_table(frame: DataFrame, path: str, digits: int | None = None) -> None:
    """Tab-separated with header; doubles with a fixed number of digits where it is given."""
    if digits is not None:
        frame = frame.select(*(F.format_string(f"%.{digits}f", c).alias(c) if kind == "double" else F.col(c) for c, kind in frame.dtypes))
    frame.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_points(points: DataFrame, path: str) -> None:
    """lat, lon, h without header, as synthesis tools read it."""
    points.select("lat", "lon", "h").write.mode("overwrite").csv(path, sep="\t", header=False)


def write_grid(points: DataFrame, path: str, value: str = "value", nodata: float = C.NODATA) -> None:
    """A raster as text lines (north first): row number and blank-separated cells, gaps filled with the nodata value."""
    indexed = raster_index(points)
    cells = indexed.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", value))).alias("m"))
    width = indexed.agg(F.max("col")).first()[0]
    if width is None:
        return
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width)), lambda c: F.coalesce(F.element_at("m", c), F.lit(nodata)).cast("string")), " ")
    cells.select("row", line.alias("line")).repartitionByRange("row").sortWithinPartitions("row").select(F.concat_ws(" ", "row", "line").alias("value")).write.mode("overwrite").text(path)


def report_lines(stats: DataFrame) -> DataFrame:
    """One text line for each row: name=value pairs."""
    return stats.select(F.concat_ws("\t", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in stats.columns)).alias("line"))
