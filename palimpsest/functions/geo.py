"""Geographic column functions: great-circle distance and geohash cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mean earth radius in metres and the geohash alphabet.
EARTH_RADIUS = 6_371_000.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance in metres; null if a coordinate is null."""
    half_lat, half_lon = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * F.lit(EARTH_RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Base-32 cell of ``precision`` characters, by bit arithmetic inside code generation (no Python)."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * float(1 << lon_bits)), F.lit((1 << lon_bits) - 1)).cast("long")
    y = F.least(F.floor((lat + 90.0) / 180.0 * float(1 << lat_bits)), F.lit((1 << lat_bits) - 1)).cast("long")
    out = []
    for k in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            n = 5 * k + j  # even bits are longitude
            source, place = (x, lon_bits - 1 - n // 2) if n % 2 == 0 else (y, lat_bits - 1 - n // 2)
            value = value + F.shiftleft(F.shiftright(source, place).bitwiseAND(F.lit(1)), 4 - j)
        out.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*out))


def geohash_decode(text: str) -> tuple[float, float]:
    """Centre (lat, lon) of a cell."""
    low, high = [-90.0, -180.0], [90.0, 180.0]
    even = True
    for c in text:
        for j in range(4, -1, -1):
            k = 1 if even else 0
            middle = (low[k] + high[k]) / 2
            if BASE32.index(c) >> j & 1:
                low[k] = middle
            else:
                high[k] = middle
            even = not even
    return (low[0] + high[0]) / 2, (low[1] + high[1]) / 2


def covering_precision(radius_metres: float) -> int:
    """Longest cell length whose cells are at least as wide and high as the radius, so that nine cells cover the circle."""
    metres_per_degree = 3.141592653589793 * EARTH_RADIUS / 180
    for precision in range(9, 0, -1):
        bits = 5 * precision
        height, width = 180.0 / (1 << bits // 2) * metres_per_degree, 360.0 / (1 << (bits + 1) // 2) * metres_per_degree
        if min(height, width * 0.5) >= radius_metres:  # half: cells narrow towards the poles; see covering_cells
            return precision
    return 1


def covering_cells(lat: float, lon: float, radius_metres: float) -> list[str]:
    """Cells that cover the circle (a prefilter; the exact distance decides)."""
    import math

    precision = covering_precision(radius_metres)
    bits = 5 * precision
    d_lat, d_lon = 180.0 / (1 << bits // 2), 360.0 / (1 << (bits + 1) // 2)
    reach_lat = radius_metres / (math.pi * EARTH_RADIUS / 180)
    reach_lon = min(180.0, reach_lat / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + reach_lat)))))
    rows = range(math.floor((lat - reach_lat + 90.0) / d_lat - 1e-6), math.floor((lat + reach_lat + 90.0) / d_lat + 1e-6) + 1)
    columns = range(math.floor((lon - reach_lon + 180.0) / d_lon - 1e-6), math.floor((lon + reach_lon + 180.0) / d_lon + 1e-6) + 1)
    across = 1 << (bits + 1) // 2
    down = range(max(0, rows[0]), min((1 << bits // 2) - 1, rows[-1]) + 1)
    return sorted({_encode((y + 0.5) * d_lat - 90.0, (x % across + 0.5) * d_lon - 180.0, precision) for y in down for x in columns})


def _encode(lat: float, lon: float, precision: int) -> str:
    low, high, point = [-90.0, -180.0], [90.0, 180.0], (lat, lon)
    even, value, count, out = True, 0, 0, ""
    while len(out) < precision:
        k = 1 if even else 0
        middle = (low[k] + high[k]) / 2
        value = value << 1 | (point[k] >= middle)
        if point[k] >= middle:
            low[k] = middle
        else:
            high[k] = middle
        even, count = not even, count + 1
        if count == 5:
            out, value, count = out + BASE32[value], 0, 0
    return out
