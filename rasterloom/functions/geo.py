"""Georeferencing as column arithmetic: pixel -> map -> longitude/latitude, distances."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0

# WGS84 and the transverse Mercator frame of the UTM zones (fixed values).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0


@dataclass(frozen=True)
class GeoRef:
    """North-up affine frame in one UTM zone of the northern hemisphere."""

    left: float
    top: float
    res: float
    zone: int

    @property
    def crs(self) -> str:
        return f"EPSG:{32600 + self.zone}"

    def x(self, col: Column) -> Column:
        """Easting of the pixel centre."""
        return F.lit(self.left) + (col + F.lit(0.5)) * F.lit(self.res)

    def y(self, row: Column) -> Column:
        """Northing of the pixel centre."""
        return F.lit(self.top) - (row + F.lit(0.5)) * F.lit(self.res)


#: Frame of the published 3730 x 3292 raster (fixed values).
SURVEY_GEO = GeoRef(left=243350.0, top=4508550.0, res=100.0, zone=11)


def utm_to_lonlat(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Inverse UTM (north) by the Krueger series to third order in n.

    All series coefficients are folded to literals on the driver; what runs per
    row is a handful of JVM trigonometric calls.
    """
    n = WGS84_F / (2 - WGS84_F)
    rectifying = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
            n**2 / 48 + n**3 / 15,
            17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3,
             7 * n**2 / 3 - 8 * n**3 / 5,
             56 * n**3 / 15]
    xi = y / F.lit(UTM_SCALE * rectifying)
    eta = (x - F.lit(UTM_FALSE_EASTING)) / F.lit(UTM_SCALE * rectifying)
    xi_c, eta_c = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_c = xi_c - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_c = eta_c - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_c) / F.cosh(eta_c))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    lon = F.lit(math.radians(zone * 6 - 183)) + F.atan2(F.sinh(eta_c), F.cos(xi_c))
    return F.degrees(lon), F.degrees(lat)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = (F.sin(half_lat) * F.sin(half_lat)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.sin(half_lon) * F.sin(half_lon))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def destination(lon: Column, lat: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """Point reached from (lon, lat) along ``bearing`` radians after ``km``."""
    angle = km / F.lit(EARTH_RADIUS_KM)
    lat0, lon0 = F.radians(lat), F.radians(lon)
    lat1 = F.asin(F.sin(lat0) * F.cos(angle)
                  + F.cos(lat0) * F.sin(angle) * F.cos(bearing))
    lon1 = lon0 + F.atan2(F.sin(bearing) * F.sin(angle) * F.cos(lat0),
                          F.cos(angle) - F.sin(lat0) * F.sin(lat1))
    return F.degrees(lon1), F.degrees(lat1)
