"""Removing and restoring model signal: residuals, height anomalies, uncertainty, zero-degree term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import gravity as G
from plumbline.operators.grids import bilinear
from plumbline.roles import require_columns


def attach(points: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """Synthesis results joined by key (never by position): each table has key and value, its name becomes the column."""
    for name, frame in tables.items():
        points = points.join(frame.select(key, F.col("value").alias(name)), key, "left")
    return points


def remove_airborne(points: DataFrame, ggm: str = "ggm", topo_high: str = "topo_high", topo_low: str = "topo_low", value: str = "disturbance") -> DataFrame:
    """topo, less_ggm and residual of airborne points."""
    require_columns(points, value, ggm, topo_high, topo_low)
    topo = G.short_wave(F.col(topo_high), F.col(topo_low))
    return points.select("*", topo.alias("topo"), (F.col(value) - F.col(ggm)).alias("less_ggm"), G.residual_airborne(F.col(value), F.col(ggm), topo).alias("residual"))


def remove_terrestrial(points: DataFrame, ertm: str = "ertm", ggm: str = "ggm", topo_high: str = "topo_high", topo_low: str = "topo_low", value: str = "disturbance") -> DataFrame:
    """The same for terrestrial points, also less the residual terrain."""
    require_columns(points, value, ggm, topo_high, topo_low, ertm)
    topo = G.short_wave(F.col(topo_high), F.col(topo_low))
    return points.select("*", topo.alias("topo"), (F.col(value) - F.col(ggm)).alias("less_ggm"), G.residual_terrestrial(F.col(value), F.col(ggm), topo, F.col(ertm)).alias("residual"))


def pixel_heights(pixels: DataFrame, srtm: DataFrame, geoid: DataFrame, lat0: float, lon0: float, step: float) -> DataFrame:
    """Pixels with the elevation, the geoid's undulation and their sum, both sampled bilinearly."""
    sampled = bilinear(pixels, srtm, "pixel_id", lat0, lon0, step, "null", "srtm")
    sampled = bilinear(sampled, geoid, "pixel_id", lat0, lon0, step, "null", "geoid")
    return sampled.withColumn("height", F.col("srtm") + F.col("geoid"))


def restore(pixels: DataFrame, iterations: int = 6) -> DataFrame:
    """gamma_0, gamma_h and zeta: the fixed point of zeta = T / gamma(h - zeta) + terrain.

    Needs lat, height, potential, model, topo (m^2/s^2) and terrain (m). The map contracts by about 1e-10 a step for any
    terrestrial height, so a few unrolled Column steps reach the tolerance of 1e-6 m for every row; the iteration is local
    to a row and needs no global stop.
    """
    require_columns(pixels, "lat", "height", "potential", "model", "topo", "terrain")
    total = F.col("potential") + F.col("model") + F.col("topo")
    frame = pixels.withColumn("gamma_0", G.normal_gravity(F.col("lat"))).withColumn("zeta", G.height_anomaly(total, G.gravity_at_height(F.col("lat"), F.col("height")), F.col("terrain")))
    for _ in range(iterations):
        frame = frame.withColumn("gamma_h", G.gravity_at_height(F.col("lat"), F.col("height") - F.col("zeta"))).withColumn("zeta", G.height_anomaly(total, F.col("gamma_h"), F.col("terrain")))
    return frame


def restore_error(pixels: DataFrame) -> DataFrame:
    """Largest change that one more step of `restore` would make."""
    total = F.col("potential") + F.col("model") + F.col("topo")
    again = G.height_anomaly(total, G.gravity_at_height(F.col("lat"), F.col("height") - F.col("zeta")), F.col("terrain"))
    return pixels.agg(F.max(F.abs(again - F.col("zeta"))).alias("max_change"))


def uncertainty(pixels: DataFrame, single_precision: bool = False) -> DataFrame:
    """normal_height, gamma and std_zeta of pixels with srtm, height, zeta and std_potential.

    single_precision: the potential's deviation passes through 32 bits first, as in the pipeline this follows.
    """
    normal = G.pixel_normal_height(F.col("srtm"), F.col("height"), F.col("zeta"))
    std = F.col("std_potential").cast("float").cast("double") if single_precision else F.col("std_potential")
    return pixels.withColumn("normal_height", normal).withColumn("gamma", G.gravity_at_height(F.col("lat"), F.col("normal_height"))).withColumn("std_zeta", G.std_height_anomaly(std, F.col("gamma")))


def zero_degree(pixels: DataFrame) -> DataFrame:
    """zeta_0 and zeta_final beside the uncorrected zeta: two surfaces, neither overwrites the other."""
    zeta0 = G.zero_degree(F.col("gamma"))
    return pixels.withColumn("zeta_0", zeta0).withColumn("zeta_final", F.col("zeta") - zeta0)
