"""Geodesy and plane geometry as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius in metres, and the constants of the walking-speed curve.
EARTH_M = 6378137.0
SPEED_TOP = 6000.0
SPEED_BASE = 2.71828
SPEED_DECAY = 3.5
SPEED_SHIFT = 0.05
SPEED_FLOOR = 500.0


def walking_speed(rise: Column, run: Column) -> Column:
    """Metres an hour on a slope; null where there is no run."""
    slope = F.when(run != 0, rise / run)
    return F.greatest(F.lit(SPEED_TOP) * F.pow(F.lit(SPEED_BASE), -SPEED_DECAY * F.abs(slope + SPEED_SHIFT)), F.lit(SPEED_FLOOR))


def hours(rise: Column, run: Column) -> Column:
    """Walking time of a segment; a segment without length takes none."""
    return F.when(run > 0, run / walking_speed(rise, run)).otherwise(F.lit(0.0))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    u, v = F.sin((b - a) / 2), F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    return 2 * EARTH_M * F.asin(F.sqrt(u * u + F.cos(a) * F.cos(b) * v * v))


def mercator_x(lng: Column) -> Column:
    return EARTH_M * F.radians(lng)


def mercator_y(lat: Column) -> Column:
    return EARTH_M * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def longitude(x: Column) -> Column:
    return F.degrees(x / EARTH_M)


def latitude(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / EARTH_M)) - F.lit(1.5707963267948966))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def position(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Share of a segment at which the closest point to (px, py) lies, in [0, 1]."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    return F.when(square > 0, F.least(F.greatest(((px - x1) * dx + (py - y1) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def tile_name(lat: Column, lng: Column) -> Column:
    """Name of the elevation tile by its south-west corner, as N39W110."""
    a, b = F.floor(lat), F.floor(lng)
    return F.concat(
        F.when(a >= 0, "N").otherwise("S"), F.lpad(F.abs(a).cast("string"), 2, "0"), F.when(b >= 0, "E").otherwise("W"), F.lpad(F.abs(b).cast("string"), 3, "0")
    )


def slippy_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """Longitude and latitude of the north-west corner of a web map tile."""
    n = float(1 << zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * y / n))))


def as_lat_lng(points: Column) -> Column:
    """Vertices as [lat, lng] pairs: two dimensions, axes swapped."""
    return F.transform(points, lambda p: F.array(p["lat"], p["lng"]))


def geojson(points: Column) -> Column:
    """A LineString with elevation as GeoJSON text."""
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lng"], p["lat"], p["ele"])).alias("coordinates")))


def from_geojson(text: Column) -> Column:
    """Vertices (lat, lng, ele) of GeoJSON text."""
    parsed = F.from_json(text, "struct<type:string,coordinates:array<array<double>>>")
    return F.transform(parsed["coordinates"], lambda c: F.struct(c[1].alias("lat"), c[0].alias("lng"), F.get(c, F.lit(2)).alias("ele")))
