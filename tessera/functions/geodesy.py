"""Great-circle distances on a sphere, and the boxes that cover a radius."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import Box, number

# Fixed value: mean Earth radius in metres.
EARTH_RADIUS = 6_371_008.8


def _column(v) -> Column:
    return v if isinstance(v, Column) else number(v)


def haversine(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS) -> Column:
    """Distance of two points given in degrees."""
    lon1, lat1, lon2, lat2 = map(_column, (lon1, lat1, lon2, lat2))
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return number(2 * radius) * F.asin(F.least(number(1), F.sqrt(h)))


def haversine_to_box(lon, lat, b: Box, radius: float = EARTH_RADIUS) -> Column:
    """Distance from a point to its nearest place in the box by clamping each
    coordinate; 0 inside."""
    lon, lat = _column(lon), _column(lat)
    near = [F.least(F.greatest(p, low), high) for p, low, high in zip((lon, lat), b.low, b.high)]
    return haversine(lon, lat, near[0], near[1], radius)


def normalise_longitude(lon) -> Column:
    """Degrees in [-180, 180]; what lies there stays as it is."""
    lon = _column(lon)
    return F.when(lon.between(-180.0, 180.0), lon).otherwise(F.pmod(lon + 180.0, number(360)) - 180.0)


def radius_boxes(lon: float, lat: float, metres: float, radius: float = EARTH_RADIUS) -> list[tuple[float, float, float, float]]:
    """One or two boxes that hold every point within a distance: two where the
    circle crosses the antimeridian, a band around a pole it reaches."""
    if not (math.isfinite(lon) and math.isfinite(lat) and math.isfinite(metres)) or metres < 0 or abs(lat) > 90:
        raise ValueError("a radius query needs finite degrees and a distance of 0 or more")
    angle = metres / radius
    if angle >= math.pi:
        return [(-180.0, -90.0, 180.0, 90.0)]
    if not -180 <= lon <= 180:
        lon = (lon + 180) % 360 - 180
    slack = 1e-9
    south, north = lat - math.degrees(angle) - slack, lat + math.degrees(angle) + slack
    if south <= -90 or north >= 90:
        return [(-180.0, max(south, -90.0), 180.0, min(north, 90.0))]
    reach = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) + slack
    west, east = lon - reach, lon + reach
    if west < -180:
        return [(west + 360, south, 180.0, north), (-180.0, south, east, north)]
    if east > 180:
        return [(west, south, 180.0, north), (-180.0, south, east - 360, north)]
    return [(west, south, east, north)]
