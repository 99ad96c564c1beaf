"""Projections and pixel arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

# Sphere radius of the sinusoidal land-product grid, in metres (fixed value).
SINUSOIDAL_RADIUS = 6371007.181


def sinusoidal_x(lon: Column | str, lat: Column | str) -> Column:
    return F.lit(SINUSOIDAL_RADIUS) * F.radians(as_col(lon)) * F.cos(F.radians(as_col(lat)))


def sinusoidal_y(lat: Column | str) -> Column:
    return F.lit(SINUSOIDAL_RADIUS) * F.radians(as_col(lat))


# GRS80 ellipsoid and the zone-32 transverse Mercator grid (fixed values).
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0


def utm_xy(lon: Column | str, lat: Column | str, central: float = 9.0) -> Column:
    """``struct(x, y)`` on a northern UTM grid; series of Snyder (1987), eq. 8-9 to 8-15."""
    e2 = GRS80_F * (2 - GRS80_F)
    ep2 = e2 / (1 - e2)
    phi = F.radians(as_col(lat))
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(GRS80_A) / F.sqrt(1 - e2 * sin * sin)
    t = tan * tan
    c = ep2 * cos * cos
    a = (as_col(lon) - central) * (math.pi / 180) * cos
    m = GRS80_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = UTM_FALSE_EASTING + UTM_SCALE * n * (
        a + (1 - t + c) * F.pow(a, 3) / 6
        + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120
    )
    y = UTM_SCALE * (
        m + n * tan * (
            a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24
            + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720
        )
    )
    return F.struct(x.alias("x"), y.alias("y"))


def pixel_centre(index: Column | str, step: float, origin: float) -> Column:
    """Map coordinate of a pixel centre on one axis."""
    return F.lit(step) * (as_col(index) + F.lit(0.5)) + F.lit(origin)
