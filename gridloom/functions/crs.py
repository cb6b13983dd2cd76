"""Reprojection between WGS 84 and its UTM zones by Krueger's series (accurate to about a millimetre inside a zone)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS 84 ellipsoid, UTM scale and false easting.
A_M, FLATTENING, SCALE, EASTING, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = A_M / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
EXCENTRICITY = 2 * math.sqrt(N) / (1 + N)


def _zone(crs: str) -> tuple[int, bool]:
    code = int(crs.upper().removeprefix("EPSG:"))
    if not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"{crs} is not supported: only EPSG:4326 and UTM zones on WGS 84 are")
    return code % 100, code < 32700


def utm_to_lonlat(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    zone, north = _zone(crs)
    xi = (y - (0.0 if north else SOUTH)) / (SCALE * RADIUS)
    eta = (x - EASTING) / (SCALE * RADIUS)
    xi1 = xi - sum((b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(BETA)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(BETA)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(DELTA)), F.lit(0.0))
    return F.degrees(F.atan(F.sinh(eta1) / F.cos(xi1))) + (zone * 6 - 183), F.degrees(lat)


def lonlat_to_utm(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    zone, north = _zone(crs)
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - EXCENTRICITY * F.atanh(EXCENTRICITY * F.sin(phi)))
    xi, eta = F.atan(t / F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x = EASTING + SCALE * RADIUS * (eta + sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)), F.lit(0.0)))
    y = (0.0 if north else SOUTH) + SCALE * RADIUS * (xi + sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA)), F.lit(0.0)))
    return x, y


def to_crs(df: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """Coordinates in another system; the same system is left alone, other than UTM and EPSG:4326 is refused."""
    if source.upper() == target.upper():
        return df
    lon, lat = (F.col(x), F.col(y)) if source.upper() == "EPSG:4326" else utm_to_lonlat(F.col(x), F.col(y), source)
    if target.upper() != "EPSG:4326":
        lon, lat = lonlat_to_utm(lon, lat, target)
    return df.withColumns({x: lon, y: lat})
