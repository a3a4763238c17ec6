"""Masked Laplacian pyramids over planes of cells: smoothing, decimation, building, blending and collapsing."""

from __future__ import annotations

import numpy as np

EPS, SUPPORT = 1e-6, 1e-3
KERNEL = np.array([1, 4, 6, 4, 1]) / 16.0


def smooth(plane: np.ndarray) -> np.ndarray:
    """Five-tap Gaussian in both directions; borders repeat."""
    for axis in (1, 0):
        wide = np.pad(plane, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = plane.shape[axis]
        plane = sum(k * np.take(wide, range(i, i + n), axis) for i, k in enumerate(KERNEL))
    return plane


def down(plane: np.ndarray) -> np.ndarray:
    return smooth(plane)[::2, ::2]


def up(coarse: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear: coarse cell j lies at fine cell 2j."""
    for axis, n in ((0, h), (1, w)):
        at = np.arange(n)
        lo = np.minimum(at // 2, coarse.shape[axis] - 1)
        hi = np.minimum(lo + 1, coarse.shape[axis] - 1)
        t = np.expand_dims((at % 2) / 2.0, 1 - axis)
        coarse = np.take(coarse, lo, axis) * (1 - t) + np.take(coarse, hi, axis) * t
    return coarse


def build(plane: np.ndarray, valid: np.ndarray, levels: int) -> list[np.ndarray]:
    """`levels` Laplacian levels of the valid part, what each has beyond its coarser one, and what remains."""
    chain = []
    a, v = plane * valid, valid.astype(float)
    for i in range(levels + 1):
        chain.append(np.where(v > EPS, a / np.where(v > EPS, v, 1), 0.0))
        if i < levels:
            a, v = down(a), down(v)
    return [g - up(c, *g.shape) for g, c in zip(chain, chain[1:])] + chain[-1:]


def mask_levels(mask: np.ndarray, valid: np.ndarray, levels: int) -> list[np.ndarray]:
    """Gaussian chain of a mask, a plane for each of build()'s: smoothed once more, 0 where there is hardly valid data (in the chain too)."""
    out = []
    m, v = mask.astype(float), valid.astype(float)
    for i in range(levels + 1):
        m = np.where(v < SUPPORT, 0.0, m)
        out.append(np.where(v < SUPPORT, 0.0, smooth(m)))
        if i < levels:
            m, v = down(m), down(v)
    return out


def blend(data: list[list[np.ndarray]], masks: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(plane, defined): per level the mask-weighted mean over panels, collapsed from the coarsest; a cell is defined where every level's nearest cell is."""
    n = len(data[0])
    levels, known = [], []
    for i in range(n):
        w = sum(m[i] for m in masks)
        s = sum(m[i] * d[i] for m, d in zip(masks, data))
        known.append(w > EPS)
        levels.append(np.where(w > EPS, s / np.where(w > EPS, w, 1), 0.0))
    out, defined = levels[-1], known[-1]
    for i in range(n - 2, -1, -1):
        h, w = levels[i].shape
        out = levels[i] + up(out, h, w)
        near = defined[np.minimum((np.arange(h) + 1) // 2, defined.shape[0] - 1)][:, np.minimum((np.arange(w) + 1) // 2, defined.shape[1] - 1)]
        defined = known[i] & near
    return out, defined
