"""Names, switches and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_name(lat: Column, lon: Column) -> Column:
    """N05W075: hemisphere letters and padded whole degrees (towards zero) of a tile's south-west corner."""
    north = F.when(lat >= 0, "N").otherwise("S")
    east = F.when(lon >= 0, "E").otherwise("W")
    return F.concat(north, F.lpad(F.abs(lat.cast("int")).cast("string"), 2, "0"), east, F.lpad(F.abs(lon.cast("int")).cast("string"), 3, "0"))


def safe_filename(name: Column) -> Column:
    """Characters that file systems refuse, and blanks, become underscores."""
    return F.translate(F.trim(name), '/\\:*?"<>| ', "__________")


def is_true(text: Column) -> Column:
    """1, true, yes, si, sí, on in any case."""
    return F.lower(F.trim(text)).isin("1", "true", "yes", "si", "sí", "on")


def prefix_match(a: Column, b: Column) -> Column:
    """Either text begins the other."""
    return a.startswith(b) | b.startswith(a)


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def metres_to_centimetres(x: Column) -> Column:
    return x * F.lit(100e0)
