"""Scalar functions of mosaics as Spark columns: sky projection, weights, stretch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def horner(n: int, terms: list[Column], x: Column, y: Column) -> Column:
    """Polynomial of 1, 3 or 6 terms (1, x, y, x², xy, y²)."""
    basis = [F.lit(1.0), x, y, x * x, x * y, y * y][:n]
    out = terms[0] * basis[0]
    for t, b in zip(terms[1:n], basis[1:]):
        out = out + t * b
    return out


def basis(n: int, x: Column, y: Column) -> list[Column]:
    return [F.lit(1.0), x, y, x * x, x * y, y * y][:n]


def tan_deproject(ra0: Column, dec0: Column, xi: Column, eta: Column) -> tuple[Column, Column]:
    """Sky position (degrees) of tangent-plane coordinates (degrees)."""
    x, e, d0 = F.radians(xi), F.radians(eta), F.radians(dec0)
    den = F.cos(d0) - e * F.sin(d0)
    ra = ra0 + F.degrees(F.atan2(x, den))
    return ra - 360 * F.floor(ra / 360), F.degrees(F.atan((F.sin(d0) + e * F.cos(d0)) / F.hypot(x, den)))


def tan_project(ra0: Column, dec0: Column, ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """Tangent-plane coordinates (degrees) of a sky position, and the cosine that must stay above 1e-9 for it to be on this side of the sky."""
    d0, d, da = F.radians(dec0), F.radians(dec), F.radians(ra - ra0)
    den = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(da)
    xi = F.cos(d) * F.sin(da) / den
    eta = (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da)) / den
    return F.degrees(xi), F.degrees(eta), den


def feather_weight(distance_px: Column, feather: float, least: float = 1e-4) -> Column:
    return F.greatest(F.least(F.greatest(distance_px / feather, F.lit(0.0)), F.lit(1.0)), F.lit(least))


def mtf(m: Column, x: Column) -> Column:
    """Midtones transfer, with the ends clamped."""
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def lanczos3(t: Column) -> Column:
    a = F.pi() * t
    return F.when(F.abs(t) < 1e-12, 1.0).when(F.abs(t) >= 3, 0.0).otherwise(3 * F.sin(a) * F.sin(a / 3) / (a * a))


def catmull_rom(t: Column) -> list[Column]:
    """Weights of the four nodes around a position t in [0, 1) past the second."""
    t2, t3 = t * t, t * t * t
    return [(-t3 + 2 * t2 - t) / 2, (3 * t3 - 5 * t2 + 2) / 2, (-3 * t3 + 4 * t2 + t) / 2, (t3 - t2) / 2]


def upper_median(v: Column) -> Column:
    """Aggregate: element n div 2 of the sorted values. Collects a group's values; for groups of bounded size."""
    return F.element_at(F.array_sort(F.collect_list(v)), (F.floor(F.count(v) / 2) + 1).cast("int"))


def levels_for_feather(feather: float) -> int:
    import math

    return min(max(math.ceil(math.log2(max(feather, 1e-9) / 8)), 2), 6)


def sanitize(v: Column) -> Column:
    """Non-finite values become 0, then values are clamped to [0, 1]."""
    clean = F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    return F.greatest(F.least(clean, F.lit(1.0)), F.lit(0.0))
