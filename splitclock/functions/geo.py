"""Geometry on latitude/longitude and on planar metres, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0

# Fixed values of the projection: semi-major axis, eccentricity, scale, central meridian of zone 36.
UTM_A = 6378137.0
UTM_E = 0.081819191
UTM_K0 = 0.9996
UTM_LON0 = 33.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sin(dl) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return (F.degrees(F.atan2(x, y)) + 360) % 360


def turn_angle(bearing_in: Column, bearing_out: Column) -> Column:
    """Change of direction folded into 0..180 degrees."""
    d = F.abs(bearing_out - bearing_in)
    return F.when(d > 180, 360 - d).otherwise(d)


def local_x(lat0: Column, lon0: Column, lon: Column) -> Column:
    """Metres east of the origin, along its parallel."""
    return F.when(lon < lon0, -1.0).otherwise(1.0) * haversine_m(lat0, lon0, lat0, lon)


def local_y(lat0: Column, lon0: Column, lat: Column) -> Column:
    """Metres north of the origin, along its meridian."""
    return F.when(lat < lat0, -1.0).otherwise(1.0) * haversine_m(lat0, lon0, lat, lon0)


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def curvature_3pt(x1: Column, y1: Column, x3: Column, y3: Column) -> Column:
    """Curvature of the circle through (x1,y1), the origin and (x3,y3); 0 for a degenerate triangle."""
    product = hypot(x1, y1) * hypot(x3, y3) * hypot(x3 - x1, y3 - y1)
    cross = F.abs(x1 * y3 - x3 * y1)
    return F.when(product < 0.001, 0.0).otherwise(2 * cross / product)


def circumradius(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Radius of the circle through three points (Heron); infinite when they are in line."""
    a, b, c = hypot(bx - cx, by - cy), hypot(ax - cx, ay - cy), hypot(ax - bx, ay - by)
    s = (a + b + c) / 2
    area = F.sqrt(F.greatest(F.lit(0.0), s * (s - a) * (s - b) * (s - c)))
    return F.when(area > 1e-9, a * b * c / (4 * area)).otherwise(F.lit(float("inf")))


def wrap_pi(angle: Column) -> Column:
    """An angle difference in radians folded into -pi..pi."""
    two_pi = 2 * math.pi
    return F.when(angle > math.pi, angle - two_pi).when(angle < -math.pi, angle + two_pi).otherwise(angle)


def utm36_xy(lat: Column, lon: Column, long_series: bool = True) -> tuple[Column, Column]:
    """Easting and northing in UTM zone 36N; the short series drops the highest-order terms."""
    e2 = UTM_E * UTM_E
    e4, e6 = e2 * e2, e2 * e2 * e2
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = UTM_A / F.sqrt(1 - e2 * sin * sin)
    t = tan * tan
    c = ep2 * cos * cos
    a = (F.radians(lon) - math.radians(UTM_LON0)) * cos
    a2, a3, a4, a5, a6 = a * a, a * a * a, a * a * a * a, a * a * a * a * a, a * a * a * a * a * a
    if long_series:
        m = UTM_A * (
            (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
            - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
            + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
            - (35 * e6 / 3072) * F.sin(6 * phi)
        )
        x = a + (1 - t + c) * a3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a5 / 120
        y = a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a6 / 720
    else:
        m = UTM_A * (
            (1 - e2 / 4 - 3 * e4 / 64) * phi - (3 * e2 / 8 + 3 * e4 / 32) * F.sin(2 * phi) + (15 * e4 / 256) * F.sin(4 * phi)
        )
        x = a + (1 - t + c) * a3 / 6 + (5 - 18 * t + t * t + 72 * c) * a5 / 120
        y = a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a4 / 24
    return UTM_K0 * n * x + 500000.0, UTM_K0 * (m + n * tan * y)
