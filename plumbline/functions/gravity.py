"""Normal gravity, disturbances, residuals and height anomalies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import constants as C


def normal_gravity(lat: Column) -> Column:
    """Somigliana's normal gravity on the ellipsoid, mGal; lat in degrees."""
    sin2 = F.pow(F.sin(F.radians(lat)), F.lit(2e0))
    cos2 = F.pow(F.cos(F.radians(lat)), F.lit(2e0))
    top = F.lit(C.AXIS_A * C.GAMMA_EQUATOR) * cos2 + F.lit(C.AXIS_B * C.GAMMA_POLE) * sin2
    return top / F.sqrt(F.lit(C.AXIS_A**2) * cos2 + F.lit(C.AXIS_B**2) * sin2)


def gravity_at_height(lat: Column, h: Column) -> Column:
    """Normal gravity continued upward to height h, mGal."""
    sin2 = F.pow(F.sin(F.radians(lat)), F.lit(2e0))
    first = F.lit(2e0 / C.AXIS_A) * (F.lit(1e0 + C.FLATTENING + C.CENTRIFUGAL) - F.lit(2e0 * C.FLATTENING) * sin2) * h
    return normal_gravity(lat) * (F.lit(1e0) - first + F.lit(3e0) * h * h / F.lit(C.AXIS_A**2))


def disturbance(g: Column, lat: Column, h: Column) -> Column:
    """Observed gravity less normal gravity at the point."""
    return g - gravity_at_height(lat, h)


def disturbance_by_height_type(g: Column, lat: Column, h: Column, separation: Column, height_type: Column) -> Column:
    """Where the height type is 1 the geoid separation is added to the height first."""
    return disturbance(g, lat, F.when(height_type == 1, h + separation).otherwise(h))


def height_type(difference: Column) -> Column:
    """1 where |difference| <= 2 m, 0 above, NULL where unknown."""
    return F.when(F.abs(difference) <= 2, F.lit(1e0)).when(F.abs(difference) > 2, F.lit(0e0))


def atmospheric_correction(h: Column) -> Column:
    """mGal; off in the standard pipeline."""
    return F.lit(0.874) - F.lit(9.9e-5) * h + F.lit(3.56e-9) * h * h


def short_wave(topo_high: Column, topo_low: Column) -> Column:
    """What topography adds beyond the model's degrees."""
    return topo_high - topo_low


def residual_airborne(value: Column, ggm: Column, topo: Column) -> Column:
    return value - ggm - topo


def residual_terrestrial(value: Column, ggm: Column, topo: Column, terrain: Column) -> Column:
    return value - ggm - topo - terrain


def satop_difference(value: Column, model: Column, terrain: Column) -> Column:
    return value - model - terrain


def height_anomaly(potential: Column, gamma: Column, extra: Column | None = None) -> Column:
    """Bruns: potential in m^2/s^2 over gravity in mGal, m."""
    zeta = potential / (gamma / F.lit(C.MGAL_PER_SI))
    return zeta if extra is None else zeta + extra


def std_height_anomaly(std_potential: Column, gamma: Column) -> Column:
    return std_potential / (gamma / F.lit(C.MGAL_PER_SI))


def zero_degree(gamma: Column) -> Column:
    """The zero-degree term of the height anomaly."""
    return F.lit(C.W0 - C.U0) / (gamma / F.lit(C.MGAL_PER_SI))


def pixel_normal_height(elevation: Column, height: Column, anomaly: Column) -> Column:
    """At sea (elevation 0) minus the anomaly, on land the ellipsoidal height less it; NULL elevation stays NULL."""
    return F.when(elevation == 0, -anomaly).when(elevation.isNotNull(), height - anomaly)


def t_statistic(parameter: Column, variance: Column) -> Column:
    return F.abs(parameter) / F.sqrt(variance)


def regularisation(sigma2_first: Column, sigma2_mu: Column) -> Column:
    return sigma2_first / sigma2_mu
