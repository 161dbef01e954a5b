"""Scalar expressions: column in, column out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low=None, high=None) -> Column:
    """``x`` within bounds, each a number or a column; null stays null, as ``greatest`` and ``least`` skip nulls."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def no_nan(x: Column) -> Column:
    """Null for NaN."""
    return F.nanvl(x, F.lit(None).cast("double"))


def ratio(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """a / (b + eps)."""
    return a / (b + F.lit(eps))


def magnitude(*parts: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def rise(d: Column) -> Column:
    return clip(d, low=0.0)


def fall(d: Column) -> Column:
    return clip(-d, low=0.0)


def binned(x: Column, edges: list[float], right: bool = True, labels: list | None = None) -> Column:
    """The number (or label) of the interval between edges that holds ``x``; closed right or left; null outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = ((x > lo) & (x <= hi)) if right else ((x >= lo) & (x < hi))
        value = F.lit(labels[i] if labels else i)
        out = F.when(inside, value) if out is None else out.when(inside, value)
    return out


def grid_cell(x: Column, y: Column, size: float = 50.0, stride: int = 1_000_000) -> Column:
    """One number for a square cell of the plane."""
    return (F.floor(x / size) * stride + F.floor(y / size)).cast("long")


def slug(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def calendar(d: Column) -> dict[str, Column]:
    """Calendar features of a date; Monday is day 0."""
    return {"dow": F.weekday(d), "iso_week": F.weekofyear(d), "day": F.dayofmonth(d), "month": F.month(d), "is_weekend": (F.weekday(d) >= 5).cast("int")}


def acceleration(v: Column, before: Column, dt: Column) -> Column:
    """Change of speed (km/h) a second, in m/s2; 0 where no time passed."""
    return F.when(dt > 0, (v - before) / F.lit(3.6) / dt).otherwise(F.lit(0.0))


def local_plane(lat: Column, lon: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north on a plane that touches at latitude ``lat0``."""
    return lon * F.lit(111320.0) * F.cos(F.radians(lat0)), lat * F.lit(110540.0)


def from_local_plane(east: Column, north: Column, lat0: Column) -> tuple[Column, Column]:
    """Latitude and longitude of places on the plane of ``local_plane``."""
    return north / F.lit(110540.0), east / (F.lit(111320.0) * F.cos(F.radians(lat0)))


def utm(lat: Column, lon: Column, meridian: float = 87.0, k0: float = 0.9996, easting: float = 500000.0) -> tuple[Column, Column]:
    """Easting and northing (north of the equator) in a transverse Mercator zone of WGS84, by Krueger's series to n^3."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(meridian))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(easting) + k0 * radius * east, k0 * radius * north
