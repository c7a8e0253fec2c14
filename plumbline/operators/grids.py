"""Grids: basis nodes, pixels, tiles, bilinear sampling, rasters as long tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.spherical import wrap_longitude
from plumbline.functions.text import tile_name


def reuter_rows(spark: SparkSession, n: int, low: int = 1, high: int | None = None) -> DataFrame:
    """Circles of latitude of the Reuter grid of order n: l, lat (degrees), count of nodes. Poles are left out."""
    step = math.pi / (n + 1)
    phi = F.lit(-math.pi / 2) + F.col("l") * F.lit(step)
    rows = spark.range(low, (n if high is None else high) + 1).withColumnRenamed("id", "l").withColumn("phi", phi)
    count = F.floor(F.lit(2 * math.pi) / F.acos((F.lit(math.cos(step)) - F.sin("phi") * F.sin("phi")) / (F.cos("phi") * F.cos("phi"))))
    return rows.select("l", F.degrees("phi").alias("lat"), count.cast("int").alias("count"))


def reuter_nodes(spark: SparkSession, n: int, south: float = -90, north: float = 90, west: float = -180, east: float = 180) -> DataFrame:
    """node_id, l, m, lat, lon of the grid's nodes within a region, borders included. Circles outside are never made."""
    step = 180 / (n + 1)
    low = max(1, math.floor((south + 90) / step))
    high = min(n, math.ceil((north + 90) / step))
    rows = reuter_rows(spark, n, low, high).where(F.col("lat").between(south, north))
    nodes = rows.select("l", "lat", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("m"))
    nodes = nodes.withColumn("lon", wrap_longitude(F.col("m") * 360e0 / F.col("count"))).where(F.col("lon").between(west, east))
    return nodes.select((F.col("l") * (4 * (n + 1)) + F.col("m")).alias("node_id"), "l", "m", "lat", "lon")


def pixel_centres(spark: SparkSession, south: float, north: float, west: float, east: float, step: float) -> DataFrame:
    """pixel_id, row, col, lat, lon: centres of round(extent / step) cells."""
    rows, cols = round((north - south) / step), round((east - west) / step)
    grid = spark.range(rows * cols).select(F.col("id").alias("pixel_id"), F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return grid.select("pixel_id", "row", "col", (F.lit(south) + (F.col("row") + 0.5) * step).alias("lat"), (F.lit(west) + (F.col("col") + 0.5) * step).alias("lon"))


def integer_axis(spark: SparkSession, low: float, high: float, unit: float, descending: bool = False) -> DataFrame:
    """An axis on whole numbers of a unit, so that equal places are equal numbers: i (bigint) and its value."""
    first, last = round(low / unit), round(high / unit)
    axis = spark.range(first, last + 1).select(F.col("id").alias("i"), (F.col("id") * unit).alias("value"))
    return axis.orderBy(F.desc("i")) if descending else axis


def tiles_in(spark: SparkSession, south: float, north: float, west: float, east: float, size: int = 5) -> DataFrame:
    """Tiles of `size` degrees that a box meets (touching isn't meeting): lat, lon of the corner and the name."""
    lats, lons = (range(math.floor(a / size) * size, math.ceil(b / size) * size, size) for a, b in ((south, north), (west, east)))
    tiles = spark.range(len(lats) * len(lons)).select((F.floor(F.col("id") / max(1, len(lons))) * size + (lats.start)).cast("int").alias("lat"), ((F.col("id") % max(1, len(lons))) * size + lons.start).cast("int").alias("lon"))
    met = (F.col("lat") < north) & (F.col("lat") + size > south) & (F.col("lon") < east) & (F.col("lon") + size > west)
    return tiles.where(met).withColumn("name", tile_name(F.col("lat"), F.col("lon")))


def bilinear(points: DataFrame, grid: DataFrame, key: str, lat0: float, lon0: float, step: float, outside: str = "drop", name: str = "sampled") -> DataFrame:
    """The points with the grid's bilinear value. grid: r, c, value at lat0 + r step, lon0 + c step.

    One equi-join on whole cell numbers serves all four corners. outside: "drop" leaves out points without four corners,
    "zero" gives them 0, "null" NULL. A point on a grid line needs only the corners that weigh.
    """
    u, v = (F.col("lat") - F.lit(lat0)) / F.lit(step), (F.col("lon") - F.lit(lon0)) / F.lit(step)
    base = points.select(key, "lat", "lon").withColumn("u", u).withColumn("v", v).withColumn("r0", F.floor("u").cast("int")).withColumn("c0", F.floor("v").cast("int"))
    fu, fv = F.col("u") - F.col("r0"), F.col("v") - F.col("c0")
    weights = [(0, 0, (1 - fu) * (1 - fv)), (0, 1, (1 - fu) * fv), (1, 0, fu * (1 - fv)), (1, 1, fu * fv)]
    corners = F.explode(F.array(*(F.struct((F.col("r0") + i).alias("r"), (F.col("c0") + j).alias("c"), w.alias("w")) for i, j, w in weights))).alias("x")
    needed = base.select(key, corners).select(key, "x.*").where("w > 0")
    found = needed.join(grid.select("r", "c", F.col("value").alias("z")), ["r", "c"]).groupBy(key).agg(F.sum(F.col("w") * F.col("z")).alias(name), F.sum("w").alias("w"))
    good = found.where((F.col("w") > 1 - 1e-9) & F.col(name).isNotNull()).drop("w")
    if outside == "drop":
        return points.join(good, key)
    joined = points.join(good, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0e0))) if outside == "zero" else joined


def nearest_cell(points: DataFrame, grid: DataFrame, key: str, lat0: float, lon0: float, step: float, name: str = "sampled") -> DataFrame:
    """The points with the value of the nearest grid point, NULL outside."""
    r = F.floor((F.col("lat") - F.lit(lat0)) / F.lit(step) + 0.5).cast("int")
    c = F.floor((F.col("lon") - F.lit(lon0)) / F.lit(step) + 0.5).cast("int")
    return points.withColumn("r", r).withColumn("c", c).join(grid.select("r", "c", F.col("value").alias(name)), ["r", "c"], "left").drop("r", "c")


def raster_axes(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lat, row) from north and (lon, col) from west of the distinct coordinates."""
    rows = points.select("lat").distinct().withColumn("row", (F.dense_rank().over(Window.orderBy(F.desc("lat"))) - 1).cast("int"))
    cols = points.select("lon").distinct().withColumn("col", (F.dense_rank().over(Window.orderBy("lon")) - 1).cast("int"))
    return rows, cols


def raster_index(points: DataFrame) -> DataFrame:
    """row (north first) and col (west first) of each point among the distinct latitudes and longitudes.

    Positions are ranked on the distinct values, whose number is a side of the raster, not its area.
    """
    rows, cols = raster_axes(points)
    return points.join(rows, "lat").join(cols, "lon")


def raster_dedupe(points: DataFrame, value: str = "value", digits: int = 10) -> DataFrame:
    """Coordinates rounded and values of equal ones averaged."""
    return points.groupBy(F.bround("lat", digits).alias("lat"), F.bround("lon", digits).alias("lon")).agg(F.avg(value).alias(value), F.count("*").alias("n"))


def full_raster(points: DataFrame, value: str = "value", background: float | None = 0.0) -> DataFrame:
    """Every cell of the raster that the points' coordinates span; cells without a point get the background or NULL."""
    rows, cols = raster_axes(points)
    n = cols.count()
    every = points.sparkSession.range(rows.count() * n).select(F.floor(F.col("id") / max(n, 1)).cast("int").alias("row"), (F.col("id") % max(n, 1)).cast("int").alias("col"))
    filled = every.join(rows, "row").join(cols, "col").select("lat", "lon").join(points.select("lat", "lon", value), ["lat", "lon"], "left")
    return filled if background is None else filled.withColumn(value, F.coalesce(value, F.lit(background)))


def raster_step(points: DataFrame) -> DataFrame:
    """Steps between the first two latitudes and longitudes."""
    def first_two(axis: str) -> DataFrame:
        two = points.select(axis).distinct().orderBy(axis).limit(2)
        return two.agg((F.max(axis) - F.min(axis)).alias(f"{axis}_step"), F.lit(1).alias("one"))

    return first_two("lat").join(first_two("lon"), "one").drop("one")


def raster_lines(indexed: DataFrame, value: str = "value") -> DataFrame:
    """One row for each line of a raster with its cells in order; lines are the unit of writing."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("col", value))), lambda x: x[value])
    return indexed.groupBy("row").agg(cells.alias("cells"))


def elevation(value: Column, nodata: float) -> Column:
    """Elevations below zero become zero; missing ones stay missing."""
    return F.when(value != nodata, F.greatest(value, F.lit(0e0)))


def mosaic(spark: SparkSession, cells: DataFrame, south: int, north: int, west: int, east: int, unit: int, background: float | None = None) -> DataFrame:
    """A target grid on whole numbers (borders included, every `unit`) filled from tile cells (ilat, ilon, value).

    Cells meet the grid by an equi-join on whole numbers, never on doubles; those outside go before the join. Cells without
    a tile have NULL or the background.
    """
    rows, cols = (north - south) // unit + 1, (east - west) // unit + 1
    grid = spark.range(rows * cols).select((F.lit(north) - F.floor(F.col("id") / cols) * unit).cast("long").alias("ilat"), (F.lit(west) + (F.col("id") % cols) * unit).cast("long").alias("ilon"))
    inside = cells.where(F.col("ilat").between(south, north) & F.col("ilon").between(west, east)).select("ilat", "ilon", "value")
    filled = grid.join(inside, ["ilat", "ilon"], "left")
    return filled if background is None else filled.withColumn("value", F.coalesce("value", F.lit(background)))


def sample_elevation(points: DataFrame, cells: DataFrame, key: str, per_degree: int, method: str = "linear", name: str = "elevation") -> DataFrame:
    """Elevation at points from one-degree tiles read as lat, lon, value; `per_degree` cells to a degree.

    Tiles share their border lines; equal cells of neighbours are averaged first. method: linear or nearest.
    """
    step = 1 / per_degree
    grid = cells.groupBy(F.round((F.col("lat") + 90) * per_degree).cast("int").alias("r"), F.round((F.col("lon") + 180) * per_degree).cast("int").alias("c")).agg(F.avg("value").alias("value"))
    if method == "nearest":
        return nearest_cell(points, grid, key, -90, -180, step, name)
    return bilinear(points, grid, key, -90, -180, step, "null", name)


def raster_points(raster: DataFrame, nodata: float, coordinate_digits: int = 10, value_digits: int = 6) -> DataFrame:
    """Cell centres of a raster as points: rounded half to even, cells without data left out."""
    kept = raster.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != nodata))
    return kept.select(F.bround("lat", coordinate_digits).alias("lat"), F.bround("lon", coordinate_digits).alias("lon"), F.bround("value", value_digits).alias("value"))


def raster_for_maps(raster: DataFrame, factor: float = 1.0) -> DataFrame:
    """South to north, values times a factor (100: metres to centimetres), missing ones kept."""
    return raster.select("lat", "lon", (F.col("value") * F.lit(factor)).alias("value")).orderBy("lat", "lon")
