"""Coordinates, boxes, distances, projections and curves; columns where they can be, numpy where they iterate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1e7
# Radii in metres, and of the named ellipsoids the semi-major axis in metres and the inverse flattening.
EARTH_RADIUS = 6372797.0
MERCATOR_RADIUS = 6378137.0
ELLIPSOIDS = {
    "AIRY": (6377563.396, 299.3249646),
    "AIRY-MODIFIED": (6377340.189, 299.3249646),
    "AUSTRALIAN": (6378160.0, 298.25),
    "BESSEL-1841": (6377397.155, 299.1528128),
    "BESSEL-1841-NAMIBIA": (6377483.865, 299.152813),
    "CLARKE-1866": (6378206.4, 294.978698),
    "CLARKE-1880": (6378249.145, 293.465),
    "EVEREST-1830": (6377276.345, 300.8017),
    "EVEREST-1948": (6377304.063, 300.8017),
    "EVEREST-SABAH-SARAWAK": (6377298.556, 300.8017),
    "EVEREST-1956": (6377301.243, 300.8017),
    "EVEREST-1969": (6377295.664, 300.8017),
    "FISHER-1960": (6378166.0, 298.3),
    "FISCHER-1960-MODIFIED": (6378155.0, 298.3),
    "FISHER-1968": (6378150.0, 298.3),
    "GRS80": (6378137.0, 298.25722210088),
    "HELMERT-1906": (6378200.0, 298.3),
    "HOUGH-1956": (6378270.0, 297.0),
    "HAYFORD": (6378388.0, 297.0),
    "IAU76": (6378140.0, 298.257),
    "INTERNATIONAL": (6378388.0, 297.0),
    "KRASSOVSKY-1938": (6378245.0, 298.3),
    "NAD27": (6378206.4, 294.9786982138),
    "NWL-9D": (6378145.0, 298.25),
    "SGS85": (6378136.0, 298.257),
    "SOUTHAMERICAN-1969": (6378160.0, 298.25),
    "SOVIET-1985": (6378136.0, 298.257),
    "WGS60": (6378165.0, 298.3),
    "WGS66": (6378145.0, 298.25),
    "WGS72": (6378135.0, 298.26),
    "WGS84": (6378137.0, 298.257223563),
}
UNITS = {"m": 1.0, "ft": 0.3048, "km": 1000.0, "mi": 1609.344, "nm": 1852.0}


def encode(degrees: Column) -> Column:
    """Fixed point, 1e-7 degrees; halves go up, of negatives too."""
    return F.floor(degrees * SCALE + 0.5).cast("bigint")


def decode(fixed: Column) -> Column:
    return fixed / SCALE


def delta_lng(a: Column, b: Column, full: float = 360.0) -> Column:
    d = F.abs(a - b)
    return F.least(d, full - d)


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on the sphere by the equirectangular rule, across the date line too."""
    return _metres(F.abs(lat1 - lat2), delta_lng(lng1, lng2), lat1 + lat2)


def fixed_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """``distance`` of fixed-point positions: differences are taken before they are scaled, so they lose no bits."""
    return _metres(F.abs(lat1 - lat2) / SCALE, delta_lng(lng1, lng2, 360 * 10**7) / SCALE, (lat1 + lat2) / SCALE)


def _metres(lat: Column, lng: Column, lats: Column) -> Column:
    dlat, dlng = F.radians(lat), F.radians(lng)
    return EARTH_RADIUS * F.sqrt(dlat * dlat + (1 + F.cos(F.radians(lats))) / 2 * (dlng * dlng))


def text(lat: Column, lng: Column) -> Column:
    return F.format_string("(%.7f, %.7f)", lat, lng)


def in_box(lat: Column, lng: Column, box: str) -> Column:
    """Whether a point lies in a box of columns min_lat, min_lng, max_lat, max_lng, edges included."""
    return lat.between(F.col(f"{box}.min_lat"), F.col(f"{box}.max_lat")) & lng.between(F.col(f"{box}.min_lng"), F.col(f"{box}.max_lng"))


def mercator(lat: Column, lng: Column) -> tuple[Column, Column]:
    # in this order, as in SQL: places at the edge of a pixel hang on the last bit
    return lng * np.pi * MERCATOR_RADIUS / 180.0, F.log(F.tan((90.0 + lat) * np.pi / 360.0)) * MERCATOR_RADIUS


def orientation(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column]) -> Column:
    """The turn at q on the way from p to r."""
    s = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return F.when(F.abs(s) < 1e-9, "Continue straightforward").when(s > 0, "Turn right").otherwise("Turn left")


def hilbert_key(lat: Column, lng: Column) -> Column:
    """Place of a fixed-point coordinate on a Hilbert curve of 32 levels, by a fold over the levels.

    At each level the quadrant makes two bits of the key (south-west 0, south-east 1, north-east 2, north-west 3); in the
    eastern ones the axes are swapped for the next level, in the south-eastern one mirrored too. The unsigned key has 64 bits;
    it is moved by half its range, so that longs compare as the keys do.
    """
    x0, y0 = lat.cast("bigint") + 900_000_000, lng.cast("bigint") + 1_800_000_000
    start = F.struct(x0.alias("x"), y0.alias("y"), F.lit(0).cast("bigint").alias("k"))
    full = (1 << 32) - 1

    def step(s: Column, m: Column) -> Column:
        rx, ry = s["x"].bitwiseAND(m) > 0, s["y"].bitwiseAND(m) > 0
        q = F.when(rx & ry, 2).when(rx, 3).when(ry, 1).otherwise(0).cast("bigint")
        mirror = F.when(ry & ~rx, F.lit(full)).otherwise(F.lit(0)).cast("bigint")
        x, y = s["x"].bitwiseXOR(mirror), s["y"].bitwiseXOR(mirror)
        return F.struct(F.when(ry, y).otherwise(x).alias("x"), F.when(ry, x).otherwise(y).alias("y"), F.shiftleft(s["k"], 2).bitwiseOR(q).alias("k"))

    masks = F.array(*[F.lit(1 << k).cast("bigint") for k in range(31, -1, -1)])
    return F.aggregate(masks, start, step)["k"].bitwiseXOR(F.lit(-(1 << 63)))


def inverse(lat1, lng1, lat2, lng2, *, ellipsoid: str = "WGS84", unit: str = "m") -> tuple[np.ndarray, np.ndarray]:
    """Distance and initial bearing (degrees) between points, by Vincenty's iteration on arrays."""
    a, inv = ELLIPSOIDS[ellipsoid]
    f = 1 / inv
    b = a * (1 - f)
    p1, p2, dl = np.radians(lat1), np.radians(lat2), np.radians(np.asarray(lng2, float) - lng1)
    dl = (dl + np.pi) % (2 * np.pi) - np.pi
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = dl.copy()
    for _ in range(40):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cs = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.divide(c1 * c2 * sl, ss, out=np.zeros_like(ss), where=ss > 0)
        ca2 = 1 - sa * sa
        cm = cs - np.divide(2 * s1 * s2, ca2, out=np.zeros_like(ss), where=ca2 > 1e-15)
        cc = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        new = dl + (1 - cc) * f * sa * (sigma + cc * ss * (cm + cc * cs * (2 * cm * cm - 1)))
        done = np.abs(new - lam) < 1e-13
        lam = new
        if done.all():
            break
    k2 = ca2 * (a * a - b * b) / (b * b)
    big_a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
    big_b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
    ds = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    bearing = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)))
    return np.where(ss > 0, b * big_a * (sigma - ds), 0.0) / UNITS[unit], np.where(ss > 0, bearing, 0.0)


def direct(lat, lng, metres, bearing, *, ellipsoid: str = "WGS84") -> tuple[np.ndarray, np.ndarray]:
    """The point at a distance and bearing of another."""
    a, inv = ELLIPSOIDS[ellipsoid]
    f = 1 / inv
    b = a * (1 - f)
    al, s = np.radians(bearing), np.asarray(metres, float)
    tu = (1 - f) * np.tan(np.radians(lat))
    cu = 1 / np.sqrt(1 + tu * tu)
    su = tu * cu
    sigma1 = np.arctan2(tu, np.cos(al))
    sa = cu * np.sin(al)
    ca2 = 1 - sa * sa
    k2 = ca2 * (a * a - b * b) / (b * b)
    big_a = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
    big_b = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
    sigma = s / (b * big_a)
    for _ in range(40):
        cm, ss, cs = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
        new = s / (b * big_a) + big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        done = np.abs(new - sigma) < 1e-14
        sigma = new
        if np.all(done):
            break
    cm, ss, cs = np.cos(2 * sigma1 + sigma), np.sin(sigma), np.cos(sigma)
    low = su * ss - cu * cs * np.cos(al)
    lat2 = np.arctan2(su * cs + cu * ss * np.cos(al), (1 - f) * np.hypot(sa, low))
    lam = np.arctan2(ss * np.sin(al), cu * cs - su * ss * np.cos(al))
    cc = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
    dl = lam - (1 - cc) * f * sa * (sigma + cc * ss * (cm + cc * cs * (2 * cm * cm - 1)))
    return np.degrees(lat2), (np.asarray(lng) + np.degrees(dl) + 180) % 360 - 180


def intermediate(lat1: float, lng1: float, lat2: float, lng2: float, parts: int, *, ellipsoid: str = "WGS84") -> tuple[np.ndarray, np.ndarray]:
    """The ends and the points between them that cut the geodesic into equal ``parts``."""
    metres, bearing = inverse(np.array([lat1], float), np.array([lng1], float), np.array([lat2], float), np.array([lng2], float), ellipsoid=ellipsoid)
    return direct(np.full(parts + 1, float(lat1)), np.full(parts + 1, float(lng1)), metres[0] * np.arange(parts + 1) / parts, np.full(parts + 1, bearing[0]), ellipsoid=ellipsoid)


@F.pandas_udf(T.DoubleType())
def line_length(lats: pd.Series, lngs: pd.Series) -> pd.Series:
    """Metres on WGS84 along lines, given as arrays of degrees; 0 for lines of one point."""
    sizes = np.fromiter(map(len, lats), np.int64, len(lats))
    lat, lng = (np.concatenate([np.asarray(x, float) for x in s] or [np.zeros(0)]) for s in (lats, lngs))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    metres = inverse(lat[pair], lng[pair], lat[pair + 1], lng[pair + 1])[0] if len(pair) else np.zeros(0)
    return pd.Series(np.bincount(owner[pair], metres, len(sizes)) if len(pair) else np.zeros(len(sizes)))


def encode_steps(start: tuple[int, int], steps: list[tuple[int, int]]) -> bytes:
    """Steps (fixed point) after a start as zigzag numbers of seven bits a byte, each the way from the step before."""
    out = bytearray()
    at = start
    for step in steps:
        for a, b in zip(at, step, strict=True):
            value = (b - a) << 1 if b >= a else ((a - b) << 1) - 1
            while value > 127:
                out.append(value & 127 | 128)
                value >>= 7
            out.append(value)
        at = step
    return bytes(out)


def decode_steps(start: tuple[int, int], data: bytes) -> list[tuple[int, int]]:
    """The steps of ``encode_steps``."""
    numbers, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            numbers.append((value >> 1) ^ -(value & 1))
            value = shift = 0
    if shift or len(numbers) % 2:
        raise ValueError("the steps are cut off")
    out = []
    at = start
    for dlat, dlng in zip(numbers[::2], numbers[1::2], strict=True):
        at = at[0] + dlat, at[1] + dlng
        out.append(at)
    return out


@F.pandas_udf(T.DoubleType())
def ellipsoidal(lat1: pd.Series, lng1: pd.Series, lat2: pd.Series, lng2: pd.Series) -> pd.Series:
    """Metres between points on WGS84."""
    return pd.Series(inverse(lat1.to_numpy(float), lng1.to_numpy(float), lat2.to_numpy(float), lng2.to_numpy(float))[0])


def to_ecef(lat: Column, lng: Column, height: Column, ellipsoid: str = "WGS84") -> list[Column]:
    a, inv = ELLIPSOIDS[ellipsoid]
    e2 = (2 - 1 / inv) / inv
    p, q = F.radians(lat), F.radians(lng)
    n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    return [(n + height) * F.cos(p) * F.cos(q), (n + height) * F.cos(p) * F.sin(q), (n * (1 - e2) + height) * F.sin(p)]


def from_ecef(x: Column, y: Column, z: Column, ellipsoid: str = "WGS84") -> list[Column]:
    """Latitude, longitude and height, in closed form."""
    a, inv = ELLIPSOIDS[ellipsoid]
    b = a * (1 - 1 / inv)
    e2, ep2 = 1 - b * b / (a * a), a * a / (b * b) - 1
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(t), 3), p - e2 * a * F.pow(F.cos(t), 3))
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return [F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n]


def finite(x: Column) -> Column:
    """Whether a number is neither NaN nor infinite; null is not."""
    d = x.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def to_half(values: np.ndarray) -> np.ndarray:
    """16-bit floats of 32-bit ones: halves of the last place go up, what is too small is zero, too large infinite."""
    bits = np.asarray(values, np.float32).view(np.uint32)
    sign, exponent, mantissa = (bits >> 16) & 0x8000, (bits >> 23) & 0xFF, bits & 0x7FFFFF
    rounded = (((exponent.astype(np.int64) - 112) << 10) | (mantissa >> 13)) + ((mantissa >> 12) & 1)
    out = np.where(exponent < 113, 0, np.where(exponent > 142, np.where((exponent == 255) & (mantissa > 0), 0x7E00, 0x7C00), rounded))
    return (sign | out.astype(np.uint32)).astype(np.uint16)


def from_half(half: np.ndarray) -> np.ndarray:
    h = np.asarray(half).astype(np.uint32)
    sign, exponent, mantissa = (h & 0x8000) << 16, (h >> 10) & 0x1F, h & 0x3FF
    bits = np.where(exponent == 0, 0, np.where(exponent == 31, 0x7F800000 | mantissa << 13, (exponent + 112) << 23 | mantissa << 13))
    return (sign | bits).astype(np.uint32).view(np.float32)


@F.pandas_udf(T.FloatType())
def half_rounded(x: pd.Series) -> pd.Series:
    """A length as a 16-bit float keeps it: infinite ones are the greatest finite, zero the least normal."""
    v = from_half(to_half(x.to_numpy(np.float32)))
    return pd.Series(np.where(np.isinf(v), np.float32(65504), np.where(v == 0, np.float32(2.0**-14), v)))
