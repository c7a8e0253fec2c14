"""Distances, latitudes, kernels' arguments and the map projection as Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import constants as C


def clamp(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL (`least` and `greatest` would skip it)."""
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = C.LINE_RADIUS_M) -> Column:
    """Great-circle distance in the radius' unit."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2e0), F.lit(2e0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2e0), F.lit(2e0))
    return F.lit(2e0 * radius) * F.asin(F.sqrt(F.when(a > 1, F.lit(1e0)).otherwise(a)))


def cos_distance(sin1: Column, cos1: Column, sin2: Column, cos2: Column, dlon: Column) -> Column:
    """Cosine of the spherical distance, within [-1, 1]; dlon in radians."""
    return clamp(sin1 * sin2 + cos1 * cos2 * F.cos(dlon), -1, 1)


def gaussian_b(half_width_km: float, radius_km: float = C.FILTER_RADIUS_KM) -> float:
    """Exponent of the line filter for a half width at half maximum."""
    sigma = half_width_km / math.sqrt(2 * math.log(2))
    return (radius_km / sigma) ** 2


def gaussian_weight(cos_psi: Column, b: float) -> Column:
    return F.exp(F.lit(-b) * (F.lit(1e0) - cos_psi))


def geocentric_latitude(lat: Column) -> Column:
    """Degrees, from geodetic degrees."""
    f = (C.AXIS_A - C.KERNEL_AXIS_B) / C.AXIS_A
    return F.degrees(F.atan(F.lit((1 - f) ** 2) * F.tan(F.radians(lat))))


def observation_radius(lat: Column, h: Column) -> Column:
    """Radius of the ellipsoid, taken at the geodetic latitude, plus height."""
    a, b = C.AXIS_A, C.KERNEL_AXIS_B
    return F.lit(a * b) / F.sqrt(F.pow(F.lit(a) * F.sin(F.radians(lat)), F.lit(2e0)) + F.pow(F.lit(b) * F.cos(F.radians(lat)), F.lit(2e0))) + h


def band_filter(name: str, n_max: int) -> np.ndarray:
    """Weights of degrees 0 to n_max: "Cup" falls off as a cubic polynomial, every other name (Shannon) is one."""
    if name != "Cup":
        return np.ones(n_max + 1)
    x = np.arange(n_max + 1) / (n_max + 1)
    return (1 - x) ** 2 * (1 + 2 * x)


def wrap_longitude(lon: Column) -> Column:
    """Above 180 degrees less 360."""
    return F.when(lon > 180, lon - 360e0).otherwise(lon)


def _kruger() -> tuple[float, list[float]]:
    """Rectifying radius and the coefficients of the forward series to the sixth order of the third flattening."""
    n = C.TM_FLATTENING / (2 - C.TM_FLATTENING)
    radius = C.AXIS_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    series = (
        (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
        (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
        (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
        (49561 / 161280, -179 / 168, 6601661 / 7257600),
        (34729 / 80640, -3418889 / 1995840),
        (212378941 / 319334400,),
    )
    return radius, [sum(c * n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(series, 1)]


def with_projection(frame: DataFrame, east: str = "x", north: str = "y") -> DataFrame:
    """The frame with transverse Mercator coordinates (m) of lat and lon on GRS80, in the zone of `constants`.

    Conformal latitude, spherical coordinates and series are steps of their own: each is used many times in the next one,
    and one nested expression would repeat it every time.
    """
    radius, alpha = _kruger()
    e = math.sqrt(C.TM_FLATTENING * (2 - C.TM_FLATTENING))
    tau, sigma, d, xi, eta = (F.col(f"__{n}") for n in ("tau", "sigma", "d", "xi", "eta"))
    root = F.sqrt(F.lit(1e0) + tau * tau)
    step = frame.withColumn("__tau", F.tan(F.radians("lat"))).withColumn("__d", F.radians(F.col("lon") - F.lit(C.TM_LON0)))
    step = step.withColumn("__sigma", F.sinh(F.lit(e) * F.atanh(F.lit(e) * tau / root)))
    step = step.withColumn("__tau", tau * F.sqrt(F.lit(1e0) + sigma * sigma) - sigma * root)
    step = step.withColumn("__xi", F.atan2(tau, F.cos(d))).withColumn("__eta", F.asinh(F.sin(d) / F.sqrt(tau * tau + F.cos(d) * F.cos(d))))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        y = y + F.lit(a) * F.sin(xi * F.lit(2e0 * j)) * F.cosh(eta * F.lit(2e0 * j))
        x = x + F.lit(a) * F.cos(xi * F.lit(2e0 * j)) * F.sinh(eta * F.lit(2e0 * j))
    origin = C.TM_NORTH - C.TM_SCALE * _meridian(C.TM_LAT0)
    placed = step.withColumn(east, F.lit(C.TM_EAST) + F.lit(C.TM_SCALE * radius) * x).withColumn(north, F.lit(origin) + F.lit(C.TM_SCALE * radius) * y)
    return placed.drop("__tau", "__d", "__sigma", "__xi", "__eta")


def _meridian(lat: float) -> float:
    """Meridian arc from the equator, m."""
    radius, alpha = _kruger()
    e = math.sqrt(C.TM_FLATTENING * (2 - C.TM_FLATTENING))
    tau = math.tan(math.radians(lat))
    sigma = math.sinh(e * math.atanh(e * tau / math.sqrt(1 + tau * tau)))
    xi = math.atan(tau * math.sqrt(1 + sigma**2) - sigma * math.sqrt(1 + tau**2))
    return radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(alpha, 1)))


def transverse_mercator_sql(lat: str, lon: str) -> tuple[str, str]:
    """The same as SQL text over column names, for checks in another engine."""
    radius, alpha = _kruger()
    e = math.sqrt(C.TM_FLATTENING * (2 - C.TM_FLATTENING))
    t = f"tan(radians({lat}))"
    s = f"sinh({e!r} * atanh({e!r} * {t} / sqrt(1e0 + {t} * {t})))"
    tau = f"({t} * sqrt(1e0 + {s} * {s}) - {s} * sqrt(1e0 + {t} * {t}))"
    d = f"radians({lon} - ({C.TM_LON0!r}))"
    xi0, eta0 = f"atan2({tau}, cos({d}))", f"asinh(sin({d}) / sqrt({tau} * {tau} + cos({d}) * cos({d})))"
    xi = " + ".join([xi0, *(f"({a!r}) * sin({2 * j} * {xi0}) * cosh({2 * j} * {eta0})" for j, a in enumerate(alpha, 1))])
    eta = " + ".join([eta0, *(f"({a!r}) * cos({2 * j} * {xi0}) * sinh({2 * j} * {eta0})" for j, a in enumerate(alpha, 1))])
    return f"({C.TM_EAST!r} + {C.TM_SCALE * radius!r} * ({eta}))", f"({C.TM_NORTH - C.TM_SCALE * _meridian(C.TM_LAT0)!r} + {C.TM_SCALE * radius!r} * ({xi}))"
