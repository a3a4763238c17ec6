"""World coordinates: tangent-plane solutions, lookup grids, cards, and the mosaic's frame.

Solutions are a few numbers a panel; they are handled as rows and small numpy arrays, pixels are not.
Image coordinates: pixel k spans [k, k + 1]; FITS counts from 0.5 later. The output pixel (i, j) carries the solution's coordinate (i, j).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Names of projections and their FITS codes.
PROJECTIONS = {"Gnomonic": "TAN", "Stereographic": "STG", "Orthographic": "SIN", "ZenithalEqualArea": "ZEA", "Mercator": "MER", "PlateCarree": "CAR", "HammerAitoff": "AIT"}
EDGE_SAMPLES, MARGIN = 16, 16


@dataclass(frozen=True)
class LinearWcs:
    """crval (degrees), crpix (FITS), cd (degrees a pixel)."""

    crval: tuple[float, float]
    crpix: tuple[float, float]
    cd: tuple[tuple[float, float], tuple[float, float]]
    code: str = "TAN"
    radesys: str = "ICRS"

    def to_sky(self, x, y):
        """Sky of image coordinates."""
        dx, dy = np.asarray(x, float) + 0.5 - self.crpix[0], np.asarray(y, float) + 0.5 - self.crpix[1]
        (a, b), (c, d) = self.cd
        return deproject(self.crval, a * dx + b * dy, c * dx + d * dy)

    def to_pixel(self, ra, dec):
        """Image coordinates of a sky position; NaN on the other side of the sky."""
        xi, eta = project(self.crval, ra, dec)
        (a, b), (c, d) = self.cd
        det = a * d - b * c
        return (d * xi - b * eta) / det + self.crpix[0] - 0.5, (a * eta - c * xi) / det + self.crpix[1] - 0.5


def deproject(crval, xi, eta):
    x, e, d0 = np.radians(xi), np.radians(eta), np.radians(crval[1])
    den = np.cos(d0) - e * np.sin(d0)
    return (crval[0] + np.degrees(np.arctan2(x, den))) % 360, np.degrees(np.arctan((np.sin(d0) + e * np.cos(d0)) / np.hypot(x, den)))


def project(crval, ra, dec):
    d0, d, da = np.radians(crval[1]), np.radians(dec), np.radians(np.asarray(ra) - crval[0])
    den = np.sin(d0) * np.sin(d) + np.cos(d0) * np.cos(d) * np.cos(da)
    den = np.where(den > 1e-9, den, np.nan)
    return np.degrees(np.cos(d) * np.sin(da) / den), np.degrees((np.cos(d0) * np.sin(d) - np.sin(d0) * np.cos(d) * np.cos(da)) / den)


class Grid:
    """Bicubic lookup on nodes that start at (x0, y0), delta apart; inputs are clamped to the rectangle, nodes beyond it continue linearly."""

    def __init__(self, values: np.ndarray, x0: float, y0: float, delta: float):
        ends = np.concatenate([[2 * values[0] - values[min(1, len(values) - 1)]], values, [2 * values[-1] - values[max(len(values) - 2, 0)]]])
        self.nodes = np.concatenate([2 * ends[:, :1] - ends[:, 1:2], ends, 2 * ends[:, -1:] - ends[:, -2:-1]], 1)
        self.x0, self.y0, self.delta = x0, y0, delta
        self.rows, self.cols = values.shape

    def __call__(self, x, y):
        gx = np.clip((np.asarray(x, float) - self.x0) / self.delta, 0, self.cols - 1)
        gy = np.clip((np.asarray(y, float) - self.y0) / self.delta, 0, self.rows - 1)
        cx, cy = np.minimum(gx.astype(int), max(self.cols - 2, 0)), np.minimum(gy.astype(int), max(self.rows - 2, 0))
        wx, wy = cubic(gx - cx), cubic(gy - cy)
        out = 0.0
        for j in range(4):
            for i in range(4):
                out = out + wy[j] * wx[i] * self.nodes[np.minimum(cy + j, self.nodes.shape[0] - 1), np.minimum(cx + i, self.nodes.shape[1] - 1)]
        return out


def cubic(t):
    return [(-(t**3) + 2 * t**2 - t) / 2, (3 * t**3 - 5 * t**2 + 2) / 2, (-3 * t**3 + 4 * t**2 + t) / 2, (t**3 - t**2) / 2]


def cards(w: LinearWcs, crop: tuple[int, int] = (0, 0), height: int | None = None) -> list[tuple[str, object]]:
    """FITS cards as they are (rows top-down); with `height` for flipped rows."""
    (a, b), (c, d) = w.cd
    x, y = w.crpix[0] - crop[0], w.crpix[1] - crop[1]
    if height is not None:
        y, b, d = height + 1 - y, 0.0 - b, 0.0 - d
    return [("CTYPE1", f"RA---{w.code}"), ("CTYPE2", f"DEC--{w.code}"), ("CRVAL1", w.crval[0]), ("CRVAL2", w.crval[1]), ("CRPIX1", x), ("CRPIX2", y), ("CD1_1", a), ("CD1_2", b), ("CD2_1", c), ("CD2_2", d), ("RADESYS", w.radesys)]


@dataclass(frozen=True)
class Frame:
    """The mosaic's grid: centre, degrees a pixel, size, rotation (degrees)."""

    crval: tuple[float, float]
    scale: float
    width: int
    height: int
    rotation: float = 0.0

    def wcs(self) -> LinearWcs:
        s, r = self.scale, np.radians(-self.rotation)
        cd = ((-s, 0.0), (0.0, s)) if self.rotation == 0 else ((-s * np.cos(r), s * np.sin(r)), (s * np.sin(r), s * np.cos(r)))
        return LinearWcs(self.crval, (self.width / 2 + 0.5, self.height / 2 + 0.5), cd)


def boundary(width: float, height: float) -> np.ndarray:
    t = np.linspace(0, 1, EDGE_SAMPLES + 1)
    return np.concatenate([np.stack([t * width, 0 * t], 1), np.stack([t * width, 0 * t + height], 1), np.stack([0 * t, t * height], 1), np.stack([0 * t + width, t * height], 1)])


def choose_frame(models: list[tuple[LinearWcs, int, int]]) -> Frame:
    """The frame of solved panels: axial mean of rotations, mean centre on the sphere, median scale, union of footprints with a margin."""
    turn, centre, scales = 0j, np.zeros(3), []
    for w, width, height in models:
        (a, b), (c, d) = w.cd
        turn += np.exp(2j * np.arctan2(c - b, -a - d) if a * d - b * c > 0 else 2j * np.arctan2(-c - b, d - a) * -1)
        ra, dec = (np.radians(v) for v in w.to_sky(width / 2, height / 2))
        centre += [np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)]
        scales.append(np.sqrt(abs(a * d - b * c)))
    crval = float(np.degrees(np.arctan2(centre[1], centre[0])) % 360), float(np.degrees(np.arctan2(centre[2], np.hypot(centre[0], centre[1]))))
    rotation = float(np.degrees(np.angle(turn)) / 2)
    rotation = 0.0 if abs(rotation) < 1e-9 else rotation
    frame = Frame(crval, float(np.median(scales)), 0, 0, rotation)
    flat = frame.wcs()
    points = np.concatenate([np.stack(flat.to_pixel(*w.to_sky(*boundary(width, height).T)), 1) for w, width, height in models])
    if not np.isfinite(points).all():
        raise ValueError("panels span more than a hemisphere")
    lo, hi = points.min(0), points.max(0)
    mid = (lo + hi) / 2
    size = np.ceil(hi - lo + 2 * MARGIN).astype(int)
    crval = tuple(float(v) for v in flat.to_sky(mid[0], mid[1]))
    return Frame(crval, frame.scale, int(size[0]), int(size[1]), rotation)
