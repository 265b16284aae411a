"""Coordinate boxes and the point rules built on them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in degrees: (west, south, east, north).
STATE_BOX = (140.0, -38.0, 160.0, -27.0)
COUNTRY_BOX = (112.0, -45.0, 160.0, -9.0)
METRO_BOX = (149.9, -34.4, 151.7, -32.9)
METRO_BOUNDS_LIMIT = (149.5, -34.5, 152.0, -32.5)


def point_in_box(lon: Column, lat: Column, box: tuple) -> Column:
    """Strictly inside the box; missing coordinates are outside."""
    west, south, east, north = box
    return F.coalesce((lon > west) & (lon < east) & (lat > south) & (lat < north), F.lit(False))


def bounds_in_box(minx: Column, miny: Column, maxx: Column, maxy: Column, box: tuple) -> Column:
    west, south, east, north = box
    return (minx > west) & (maxx < east) & (miny > south) & (maxy < north)


def bounds_meet_box(minx: Column, miny: Column, maxx: Column, maxy: Column, box: tuple) -> Column:
    """The pushed-down part of a feature scan: plain comparisons that Parquet row-group statistics can answer."""
    west, south, east, north = box
    return (minx <= east) & (maxx >= west) & (miny <= north) & (maxy >= south)


def usable_point(lon: Column, lat: Column, box: tuple | None = None) -> Column:
    """Both coordinates present and non-zero, and (if given) strictly inside a box."""
    placed = F.coalesce((lon != 0) & (lat != 0), F.lit(False))
    return placed & point_in_box(lon, lat, box) if box else placed
