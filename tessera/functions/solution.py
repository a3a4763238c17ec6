"""Astrometric solutions from file properties: linear terms, lookup grids, and checks that refuse what can't be right.

Properties are rows (panel_id, id, str, f64, i64, f64s, rows, cols); a panel has a few dozen, and the first of one id counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .astrometry import PROJECTIONS, Grid, LinearWcs

PREFIX = "PCL:AstrometricSolution:"
SPLINE = PREFIX + "SplineWorldTransformation:"
NEEDED = ("ReferenceCelestialCoordinates", "ReferenceImageCoordinates", "LinearTransformationMatrix")
#: Most differences that a lookup grid may have from the linear terms: at the reference point and corners (degrees), and round trip (pixels).
AT_REFERENCE, AT_CORNERS, ROUND_TRIP = 0.01, 0.05, 5.0


def lookup(properties: DataFrame, ids: list[str]) -> DataFrame:
    """panel_id and a column of numbers for each id, from the first property of that name in each panel."""
    first = properties.where(F.col("id").isin(ids)).withColumn("n", F.row_number().over(Window.partitionBy("panel_id", "id").orderBy("ord"))).where("n = 1")
    value = F.coalesce("f64s", F.array(F.coalesce("f64", F.col("i64").cast("double"))))
    return first.groupBy("panel_id").agg(*(F.first(F.when(F.col("id") == i, value), True).alias(i.rpartition(":")[2]) for i in ids))


def unsolved(panels: DataFrame, properties: DataFrame) -> DataFrame:
    """panel_id, missing: panels that lack parts of a solution, all at once, and what they lack."""
    want = panels.select("panel_id").distinct().withColumn("id", F.explode(F.array(*(F.lit(PREFIX + n) for n in NEEDED))))
    return want.join(properties.select("panel_id", "id"), ["panel_id", "id"], "left_anti").groupBy("panel_id").agg(F.array_sort(F.collect_list("id")).alias("missing"))


def classify(stats: DataFrame, geometries: list[tuple[int, int, int]], most: float = 0.5) -> str:
    """aligned: two panels or more on one grid, none of which covers most of it; otherwise solved. stats: n_covered by panel (read only if geometries leave it open)."""
    if len(geometries) < 2 or len(set(geometries)) > 1:
        return "solved"
    width, height, _ = geometries[0]
    largest = stats.agg(F.max("n_covered")).first()[0] or 0
    return "solved" if largest / (width * height) >= most else "aligned"


def linear(values: dict[str, list[float] | str]) -> LinearWcs | None:
    """The linear solution of a panel's properties (by last part of their names); None if parts are missing or the projection is not known."""
    if any(values.get(n) is None for n in NEEDED):
        return None
    code = PROJECTIONS.get(values.get("ProjectionSystem") or "Gnomonic")
    if code is None:
        return None
    sky, ref, m = (values[n] for n in NEEDED)
    if len(sky) != 2 or len(ref) != 2 or len(m) != 4 or m[0] * m[3] == m[1] * m[2]:
        return None
    return LinearWcs((sky[0], sky[1]), (ref[0] + 0.5, ref[1] + 0.5), ((m[0], m[1]), (m[2], m[3])), code, values.get("ReferenceSystem") or "ICRS")


@dataclass
class Model:
    """A linear solution, and grids of native coordinates (degrees) over the image and of image coordinates over them."""

    wcs: LinearWcs
    width: int
    height: int
    to_native: tuple[Grid, Grid] | None = None
    from_native: tuple[Grid, Grid] | None = None
    rect: tuple[float, float, float, float] = field(default=(0, 0, 0, 0))

    def to_sky(self, x, y):
        if self.to_native is None:
            return self.wcs.to_sky(x, y)
        from .astrometry import deproject

        x, y = np.asarray(x, float), np.asarray(y, float)
        d = self.to_native[0].delta
        inside = (x >= -d) & (x <= self.width + d) & (y >= -d) & (y <= self.height + d)
        ra, dec = deproject(self.wcs.crval, self.to_native[0](x, y), self.to_native[1](x, y))
        return np.where(inside, ra, np.nan), np.where(inside, dec, np.nan)

    def to_pixel(self, ra, dec):
        if self.from_native is None:
            return self.wcs.to_pixel(ra, dec)
        from .astrometry import project

        xi, eta = project(self.wcs.crval, ra, dec)
        d, (x0, y0, x1, y1) = self.from_native[0].delta, self.rect
        inside = (xi >= x0 - d) & (xi <= x1 + d) & (eta >= y0 - d) & (eta <= y1 + d)
        return np.where(inside, self.from_native[0](xi, eta), np.nan), np.where(inside, self.from_native[1](xi, eta), np.nan)


def nodes(extent: float, delta: float) -> int:
    """Nodes that a grid over an extent must have; an extent that is a multiple of the step up to rounding counts as one."""
    if not (np.isfinite(extent) and np.isfinite(delta)) or delta <= 0 or extent < 0:
        raise ValueError("extent or step of a grid")
    return 1 + int(np.ceil(extent / delta - 1e-6))


def _grids(values: dict[str, dict], way: str) -> tuple[Grid, Grid, tuple[float, float, float, float]]:
    """The two lookup grids of one direction, and their rectangle, from a panel's properties by name."""
    part = lambda name: values.get(f"{SPLINE}PointGridInterpolation:{way}:{name}") or {}
    rect, delta, gx, gy = part("Rect").get("f64s"), part("Delta").get("f64"), part("GridX"), part("GridY")
    if rect is None or len(rect) != 4 or delta is None:
        raise ValueError(f"the grid {way} lacks its rectangle or step")
    shape = nodes(rect[3] - rect[1], delta), nodes(rect[2] - rect[0], delta)
    for g in (gx, gy):
        if g.get("f64s") is None or (g.get("rows"), g.get("cols")) != shape or min(shape) < 2:
            raise ValueError(f"the grid {way} has not the nodes that its rectangle and step ask for")
    x, y = (Grid(np.array(g["f64s"], float).reshape(shape), rect[0], rect[1], delta) for g in (gx, gy))
    return x, y, tuple(rect)


def from_properties(properties: list[dict], width: int, height: int) -> Model | None:
    """A panel's solution from its properties (dicts with id, str, f64, i64, f64s, rows, cols; the first of a name counts).

    None where parts of the linear solution are missing; ValueError where a solution with lookup grids is not sound: it is never
    replaced by its linear part.
    """
    values: dict[str, dict] = {}
    for p in properties:
        values.setdefault(p["id"], p)
    plain = {k.removeprefix(PREFIX): v.get("str") or v.get("f64s") for k, v in values.items() if k.startswith(PREFIX)}
    wcs = linear(plain)
    if wcs is None:
        return None
    if not any(k.startswith(SPLINE) for k in values):
        return Model(wcs, width, height)
    for name, usual in (("ReferenceNativeCoordinates", (0.0, 90.0)), ("CelestialPoleNativeCoordinates", (180.0, 90.0))):
        own = plain.get(name)
        if own is not None and not (len(own) == 2 and np.allclose(own, usual, rtol=0, atol=1e-9)):
            raise ValueError(f"{name} {own}")
    *there, image_rect = _grids(values, "ImageToNative")
    *back, rect = _grids(values, "NativeToImage")
    if not np.allclose(image_rect, (0, 0, width, height), rtol=0, atol=1):
        raise ValueError("the grid does not cover the image")
    return checked(Model(wcs, width, height, tuple(there), tuple(back), rect))


def checked(model: Model) -> Model:
    """The model, or ValueError if its grids disagree with its linear terms or with each other."""
    if model.wcs.code != "TAN":
        raise ValueError(f"projection {model.wcs.code}")
    if model.to_native is None:
        return model
    w = model.wcs
    ref = w.crpix[0] - 0.5, w.crpix[1] - 0.5
    if np.hypot(model.to_native[0](*ref), model.to_native[1](*ref)) >= AT_REFERENCE:
        raise ValueError("the grid is off at the reference point")
    (a, b), (c, d) = w.cd
    for x, y in ((0, 0), (model.width, 0), (0, model.height), (model.width, model.height)):
        dx, dy = x - ref[0], y - ref[1]
        if np.hypot(model.to_native[0](x, y) - (a * dx + b * dy), model.to_native[1](x, y) - (c * dx + d * dy)) >= AT_CORNERS:
            raise ValueError("the grid is off at a corner")
    if model.from_native is not None:
        back = model.to_pixel(*model.to_sky(*ref))
        if not np.hypot(back[0] - ref[0], back[1] - ref[1]) < ROUND_TRIP:
            raise ValueError("the grids do not invert each other")
    return model
