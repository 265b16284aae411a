"""Transverse Mercator (GDA2020 / MGA zone 56 by default) as Column arithmetic: the Kruger series to fourth order."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Zone:
    # The GRS80 ellipsoid and the grid's origin.
    radius: float = 6378137.0
    flattening: float = 1 / 298.257222101
    meridian: float = 153.0
    scale: float = 0.9996
    false_easting: float = 500000.0
    false_northing: float = 10000000.0

    @property
    def third(self) -> float:
        return self.flattening / (2 - self.flattening)

    @property
    def reach(self) -> float:
        n = self.third
        return self.scale * self.radius / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)


MGA56 = Zone()


def _forward_terms(n: float) -> list[float]:
    return [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
            13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
            61 * n ** 3 / 240 - 103 * n ** 4 / 140,
            49561 * n ** 4 / 161280]


def _inverse_terms(n: float) -> list[float]:
    return [n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360,
            n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440,
            17 * n ** 3 / 480 - 37 * n ** 4 / 840,
            4397 * n ** 4 / 161280]


def _latitude_terms(n: float) -> list[float]:
    return [2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45,
            7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45,
            56 * n ** 3 / 15 - 136 * n ** 4 / 35,
            4279 * n ** 4 / 630]


def to_metres(lon: Column, lat: Column, zone: Zone = MGA56) -> Column:
    """Longitude and latitude in degrees to a struct<x,y> of easting and northing in metres."""
    n = zone.third
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * e) * e)
    away = F.radians(lon - zone.meridian)
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(t * t + 1))
    north, east = xi, eta
    for j, a in enumerate(_forward_terms(n), start=1):
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
    return F.struct((east * zone.reach + zone.false_easting).alias("x"),
                    (north * zone.reach + zone.false_northing).alias("y"))


def to_degrees(x: Column, y: Column, zone: Zone = MGA56) -> Column:
    """Easting and northing in metres to a struct<x,y> of longitude and latitude in degrees."""
    n = zone.third
    xi, eta = (y - zone.false_northing) / zone.reach, (x - zone.false_easting) / zone.reach
    u, v = xi, eta
    for j, b in enumerate(_inverse_terms(n), start=1):
        u = u - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        v = v - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_latitude_terms(n), start=1):
        lat = lat + F.sin(chi * (2 * j)) * d
    lon = F.atan2(F.sinh(v), F.cos(u))
    return F.struct((F.degrees(lon) + zone.meridian).alias("x"), F.degrees(lat).alias("y"))
