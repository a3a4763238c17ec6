"""A synthetic sky cut into perturbed panels, with its truth, for tests."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Spec:
    width: int = 512
    height: int = 384
    channels: int = 1
    grid: tuple[int, int] = (2, 2)
    overlap: float = 0.25
    stars: int = 40
    noise: float = 0.002
    gain: tuple[float, float] = (0.7, 1.4)
    offset: tuple[float, float] = (-0.01, 0.02)
    gradient: float = 0.0
    #: Turn (radians) of the brightest stars' four spikes in each panel; the truth's are upright. Empty: no spikes.
    spikes: tuple[float, ...] = ()
    #: Faint blobs of a few cells' size.
    blobs: int = 0
    #: A bright textured core: x, y, radius, amplitude.
    core: tuple[float, float, float, float] | None = None
    #: Bright horizontal segments in one panel each: panel, x, y, length, amplitude.
    defects: tuple[tuple[int, int, int, int, float], ...] = ()
    seed: int = 42


def windows(s: Spec) -> list[tuple[int, int, int, int]]:
    """Panels' boxes (exclusive) on a grid, neighbours sharing `overlap` of their size."""

    def cuts(size: int, n: int) -> list[tuple[int, int]]:
        span = size / (n - (n - 1) * s.overlap)
        return [(round(i * span * (1 - s.overlap)), min(size, round(i * span * (1 - s.overlap) + span))) for i in range(n)]

    return [(x0, y0, x1, y1) for y0, y1 in cuts(s.height, s.grid[1]) for x0, x1 in cuts(s.width, s.grid[0])]


SPIKE_LEAST, BLOB_SIGMA, BLOB_AMPLITUDE = 0.3, 24.0, (0.01, 0.03)


def spot(plane: np.ndarray, cx: float, cy: float, amp: float, sigma: float) -> None:
    """Adds a Gaussian to all channels, out to five deviations."""
    reach, (h, w) = int(5 * sigma) + 2, plane.shape[1:]
    x0, x1, y0, y1 = max(int(cx) - reach, 0), min(int(cx) + reach + 1, w), max(int(cy) - reach, 0), min(int(cy) + reach + 1, h)
    yy, xx = np.mgrid[y0:y1, x0:x1]
    plane[:, y0:y1, x0:x1] += amp * np.exp(-((xx - cx) ** 2 + (yy - cy) ** 2) / (2 * sigma**2))


def add_spikes(plane: np.ndarray, stars: list[tuple], turn: float) -> None:
    """Four arms, one pixel wide and as long as a star is bright, on stars of at least SPIKE_LEAST."""
    h, w = plane.shape[1:]
    for cx, cy, amp, _ in stars:
        if amp >= SPIKE_LEAST:
            r = np.arange(2, int(60 * amp))
            for arm in range(4):
                x, y = (np.rint(c + r * f(turn + arm * np.pi / 2)).astype(int) for c, f in ((cx, np.cos), (cy, np.sin)))
                ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
                plane[:, y[ok], x[ok]] += 0.3 * amp * (1 - r[ok] / (60 * amp))


def generate(s: Spec) -> tuple[np.ndarray, list[np.ndarray], list[dict]]:
    """(truth, panels, what was done to each): channels x height x width; panels are on the whole canvas and 0 outside their boxes."""
    rng = np.random.default_rng(s.seed)
    y, x = np.mgrid[: s.height, : s.width] / max(s.width, s.height)
    truth = np.stack([0.1 + 0.02 * c + 0.05 * np.sin(3 * x + c) * np.cos(4 * y) for c in range(s.channels)])
    stars = [(rng.uniform(0, s.width), rng.uniform(0, s.height), rng.uniform(0.05, 0.6), rng.uniform(1.0, 2.5)) for _ in range(s.stars)]
    for star in stars:
        spot(truth, *star)
    more = np.random.default_rng([s.seed, 1])  # a stream of its own: what it adds changes nothing else
    for _ in range(s.blobs):
        spot(truth, more.uniform(0, s.width), more.uniform(0, s.height), more.uniform(*BLOB_AMPLITUDE), BLOB_SIGMA)
    if s.core:
        cx, cy, radius, amp = s.core
        spot(truth, cx, cy, amp / 2, radius / 2)
        step = radius / 8
        for i in np.arange(-radius, radius + 1, step):
            for j in np.arange(-radius, radius + 1, step):
                if i * i + j * j <= radius * radius:
                    spot(truth, cx + i, cy + j, amp / 2 * (int(round((i + j) / step)) % 2), step / 2)
    plain = truth.copy()
    if s.spikes:
        add_spikes(truth, stars, 0.0)
    panels, done = [], []
    for at, (x0, y0, x1, y1) in enumerate(windows(s)):
        sky = truth
        if s.spikes:
            sky = plain.copy()
            add_spikes(sky, stars, s.spikes[at])
        g, o = rng.uniform(*s.gain), rng.uniform(*s.offset)
        slope = rng.uniform(-s.gradient, s.gradient, 2)
        p = np.zeros_like(truth)
        field = slope[0] * x[y0:y1, x0:x1] + slope[1] * y[y0:y1, x0:x1]
        p[:, y0:y1, x0:x1] = np.maximum(g * (sky[:, y0:y1, x0:x1] + field) + o + rng.normal(0, s.noise, (s.channels, y1 - y0, x1 - x0)), 1e-6)
        for panel, dx, dy, length, amp in s.defects:
            if panel == at and y0 <= dy < y1:
                p[:, dy, max(dx, x0) : max(min(dx + length, x1), x0)] += amp
        panels.append(p)
        done.append({"gain": g, "offset": o, "slope": slope, "box": (x0, y0, x1, y1)})
    return truth, panels, done
