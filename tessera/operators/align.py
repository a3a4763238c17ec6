"""Reprojection of solved panels to the mosaic's frame with Lanczos-3.

Output strips are the unit: a strip needs the source bands that its footprint maps to, so bands are sent to the strips
that may use them and each group resamples one strip of one panel, all channels together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.astrometry import Frame, LinearWcs, boundary
from .summary import band_arrays

PAD, TAPS = 3, 6


def lanczos3(t: np.ndarray) -> np.ndarray:
    a = np.pi * t
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 3 * np.sin(a) * np.sin(a / 3) / (a * a)
    return np.where(np.abs(t) < 1e-12, 1.0, np.where(np.abs(t) >= 3, 0.0, out))


def resample(plane: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples of a plane at array positions; 0 where the 6 x 6 taps are not all inside, or the result is not finite."""
    h, w = plane.shape
    x0, y0 = np.floor(x).astype(int) - 2, np.floor(y).astype(int) - 2
    ok = np.isfinite(x) & np.isfinite(y) & (x0 >= 0) & (y0 >= 0) & (x0 + TAPS <= w) & (y0 + TAPS <= h)
    out = np.zeros(x.shape)
    xs, ys, x0, y0 = x[ok], y[ok], x0[ok], y0[ok]
    wx = np.stack([lanczos3(xs - (x0 + i)) for i in range(TAPS)])
    wy = np.stack([lanczos3(ys - (y0 + i)) for i in range(TAPS)])
    wx, wy = wx / wx.sum(0), wy / wy.sum(0)
    total = np.zeros(len(xs))
    for j in range(TAPS):
        total += wy[j] * sum(wx[i] * plane[y0 + j, x0 + i] for i in range(TAPS))
    out[ok] = np.where(np.isfinite(total), total, 0.0)
    return out


def footprint(model: LinearWcs, width: int, height: int, frame: Frame) -> tuple[int, int, int, int]:
    """The panel's box in the frame (exclusive), padded; ValueError if it misses the frame."""
    px = np.stack(frame.wcs().to_pixel(*model.to_sky(*boundary(width, height).T)), 1)
    lo = np.maximum(np.floor(px.min(0)).astype(int) - PAD, 0)
    hi = np.minimum(np.ceil(px.max(0)).astype(int) + PAD, (frame.width, frame.height))
    if (lo >= hi).any():
        raise ValueError("a panel lies outside the frame")
    return int(lo[0]), int(lo[1]), int(hi[0]), int(hi[1])


def reproject(bands: DataFrame, models: dict[int, tuple[LinearWcs, int, int]], frame: Frame, rows: int = 64) -> DataFrame:
    """Bands (panel_id, y, x0, vals) in the frame's grid. models: solution, width and height of each panel (a few numbers a panel)."""
    spark = bands.sparkSession
    need = []
    for p, (model, width, height) in models.items():
        x0, y0, x1, y1 = footprint(model, width, height, frame)
        for s in range(y0 // rows, (y1 - 1) // rows + 1):
            edge = np.stack(np.meshgrid(np.linspace(x0, x1, 33), np.linspace(s * rows, s * rows + rows, 9)), -1).reshape(-1, 2)
            sy = model.to_pixel(*frame.wcs().to_sky(*edge.T))[1]
            need.append((p, s, int(np.floor(np.nanmin(sy))) - 4, int(np.ceil(np.nanmax(sy))) + 5))
    ranges = spark.createDataFrame(need, "panel_id long, strip long, lo long, hi long")  # a row for each output strip of a panel
    sent = bands.join(F.broadcast(ranges), (bands.panel_id == ranges.panel_id) & (bands.y >= ranges.lo) & (bands.y < ranges.hi)).select(bands.panel_id, "strip", "y", "x0", "vals")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        p, s = int(key[0].as_py()), int(key[1].as_py())
        model, width, height = models[p]
        x0, y0, x1, y1 = footprint(model, width, height, frame)
        lo, hi = max(y0, s * rows), min(y1, (s + 1) * rows)
        t = t.combine_chunks()
        y, parts = t["y"].to_numpy(), list(band_arrays(t["x0"].chunk(0), t["vals"].chunk(0)))
        if lo >= hi or not parts:
            return pa.table({"panel_id": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "x0": pa.array([], pa.int64()), "vals": pa.array([], pa.list_(pa.list_(pa.float64())))})
        yy, xx = np.mgrid[lo:hi, x0:x1]
        # the output pixel (i, j) carries the coordinate (i, j); the source is sampled half a pixel before it
        sx, sy = model.to_pixel(*frame.wcs().to_sky(xx, yy))
        top = int(y.min())
        planes = np.zeros((max(v.shape[1] for _, _, v in parts), int(y.max()) - top + 1, width))
        for at, x, v in parts:
            planes[: v.shape[1], y[at] - top, x : x + v.shape[2]] = np.moveaxis(v, 0, 1)
        out = np.stack([resample(plane, sx - 0.5, sy - 0.5 - top) for plane in planes])
        out[:, ~np.isfinite(out).all(0)] = 0.0
        c, n, w = out.shape
        inner = pa.ListArray.from_arrays(pa.array(np.arange(n * c + 1) * w, pa.int32()), pa.array(np.moveaxis(out, 1, 0).ravel()))
        return pa.table({"panel_id": np.full(n, p), "y": np.arange(lo, hi), "x0": np.full(n, x0), "vals": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * c, pa.int32()), inner)})

    return sent.groupBy("panel_id", "strip").applyInArrow(run, "panel_id long, y long, x0 long, vals array<array<double>>")
