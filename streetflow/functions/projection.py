"""Lambert conformal conic with two standard parallels (Snyder 1987, ch. 15) as Catalyst math.

The parameters are the public definition of EPSG:26986. The datum shift between NAD83 and WGS84 is
taken as identity, so the inverse gives EPSG:4326 degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid and EPSG:26986.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
PARALLEL_1 = math.radians(41 + 43 / 60)
PARALLEL_2 = math.radians(42 + 41 / 60)
ORIGIN_LAT = math.radians(41.0)
ORIGIN_LON = math.radians(-71.5)
FALSE_EASTING = 200000.0
FALSE_NORTHING = 750000.0

ECC = math.sqrt(2 * FLATTENING - FLATTENING**2)


def _scale(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (ECC * math.sin(phi)) ** 2)


def _isometric(phi: float) -> float:
    es = ECC * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (ECC / 2)


CONE = (math.log(_scale(PARALLEL_1)) - math.log(_scale(PARALLEL_2))) / (
    math.log(_isometric(PARALLEL_1)) - math.log(_isometric(PARALLEL_2)))
SCALE_F = _scale(PARALLEL_1) / (CONE * _isometric(PARALLEL_1) ** CONE)
RHO_0 = SEMI_MAJOR * SCALE_F * _isometric(ORIGIN_LAT) ** CONE


def to_metric(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres of a lon/lat in degrees."""
    phi = F.radians(lat)
    es = ECC * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(ECC / 2))
    rho = SEMI_MAJOR * SCALE_F * F.pow(t, F.lit(CONE))
    theta = CONE * (F.radians(lon) - ORIGIN_LON)
    return F.struct(
        (FALSE_EASTING + rho * F.sin(theta)).alias("x"),
        (FALSE_NORTHING + RHO_0 - rho * F.cos(theta)).alias("y"),
    )


def to_lonlat(x: Column, y: Column) -> Column:
    """struct(x=lon, y=lat) in degrees of a metric point; six fixed-point steps reach double precision."""
    dx, dy = x - FALSE_EASTING, RHO_0 - (y - FALSE_NORTHING)
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / (SEMI_MAJOR * SCALE_F), F.lit(1 / CONE))
    lon = F.atan2(dx, dy) / CONE + ORIGIN_LON

    def step(phi, _):
        es = ECC * F.sin(phi)
        return F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - es) / (1 + es), F.lit(ECC / 2)))

    lat = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit(math.pi / 2) - 2 * F.atan(t), step)
    return F.struct(F.degrees(lon).alias("x"), F.degrees(lat).alias("y"))


def line_to_metric(line: Column) -> Column:
    return F.transform(line, lambda p: to_metric(p["x"], p["y"]))


def line_to_lonlat(line: Column) -> Column:
    return F.transform(line, lambda p: to_lonlat(p["x"], p["y"]))


def rings_to_metric(rings: Column) -> Column:
    return F.transform(rings, line_to_metric)


def rings_to_lonlat(rings: Column) -> Column:
    return F.transform(rings, line_to_lonlat)
