"""Cells of the earth as 52 bits: 26 of longitude and 26 of latitude, interleaved, longitude first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
LON_MAX, LAT_MAX = 180.0, 85.05112878
EARTH_RADIUS = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "ft": 0.3048}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
STEPS = 26


SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
SQUASH = ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF))


def _fold(x: Column, steps: tuple[tuple[int, int], ...], shift: str) -> Column:
    """Shift, merge and mask step by step; a fold, so that x stands in the expression once and not thirty-two times."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(mask).alias("mask")) for n, mask in steps])
    return F.aggregate(each, x.cast("bigint"), lambda acc, s: F.call_function(shift, acc, s["n"]).bitwiseOR(acc).bitwiseAND(s["mask"]))


def _spread(x: Column) -> Column:
    """The low 26 bits of x on the even places of a long."""
    return _fold(x, SPREAD, "shiftleft")


def _squash(x: Column) -> Column:
    """The even places' bits together again."""
    return _fold(x.bitwiseAND(F.lit(0x5555555555555555)), SQUASH, "shiftright")


def _index(value: Column, limit: float) -> Column:
    place = F.floor((value + limit) / (2 * limit) * float(1 << STEPS)).cast("bigint")
    return F.least(F.greatest(place, F.lit(0)), F.lit((1 << STEPS) - 1))


def encode(lon: Column, lat: Column, lat_max: float = LAT_MAX) -> Column:
    """Cell of a position, a long below 2**52; null outside the valid range."""
    fine = lon.between(-LON_MAX, LON_MAX) & lat.between(-lat_max, lat_max)
    return F.when(fine, F.shiftleft(_spread(_index(lon, LON_MAX)), 1).bitwiseOR(_spread(_index(lat, lat_max))))


def decode_lon(cell: Column) -> Column:
    """Longitude of a cell's centre."""
    return (_squash(F.shiftright(cell, 1)) + 0.5) / float(1 << STEPS) * (2 * LON_MAX) - LON_MAX


def decode_lat(cell: Column) -> Column:
    return (_squash(cell) + 0.5) / float(1 << STEPS) * (2 * LAT_MAX) - LAT_MAX


def geohash_text(cell: Column) -> Column:
    """The standard 11-character text of a cell (latitude over 90 degrees); its last character is always 0."""
    standard = encode(decode_lon(cell), decode_lat(cell), 90.0)
    letters = [F.substring(F.lit(ALPHABET), (F.shiftright(standard, 52 - 5 * (k + 1)).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(10)]
    return F.concat(*letters, F.lit("0"))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two positions, by the haversine formula."""
    r = math.pi / 180
    u, v = F.sin((lat2 - lat1) * r / 2), F.sin((lon2 - lon1) * r / 2)
    a = u * u + F.cos(lat1 * r) * F.cos(lat2 * r) * v * v
    return 2.0 * EARTH_RADIUS * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))
