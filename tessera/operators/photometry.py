"""Photometric matching: robust line fits on overlaps, then global gains and offsets.

Edge fits run one group an edge and channel (its shared cells). The global solves couple the panels of a component through a few
numbers an edge: one task solves a component's channel by elimination in blocks of neighbouring panels, or by conjugate gradients where
these are too wide, in memory that grows with its edges and panels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .overlap import cell_pairs, component_table, gauge_panels

CLIP, ROUNDS, FLOOR, LEAST_R, RIDGE, IRLS_ROUNDS, L1_FLOOR = 2.5, 3, 1e-7, 0.5, 1e-6, 60, 1e-4
#: Numbers of a matrix in blocks; larger ones are solved by conjugate gradients.
MOST_NUMBERS = 1 << 23


def solve_dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a x = b by elimination with partial pivoting; ArithmeticError where a pivot is not finite or below 1e-13 of the largest entry."""
    a, b = np.array(a, float), np.array(b, float)
    n, least = len(b), np.abs(a).max(initial=0.0) * 1e-13
    for k in range(n):
        p = k + int(np.abs(a[k:, k]).argmax())
        if not np.isfinite(a[p, k]) or abs(a[p, k]) < least or a[p, k] == 0:
            raise ArithmeticError("singular system")
        if p != k:
            a[[k, p]], b[[k, p]] = a[[p, k]], b[[p, k]]
        f = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k:] -= np.outer(f, a[k, k:])
        b[k + 1 :] -= f * b[k]
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - a[k, k + 1 :] @ x[k + 1 :]) / a[k, k]
    return x


def solve_sparse(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, precondition: Callable[[np.ndarray], np.ndarray], free: np.ndarray) -> np.ndarray:
    """Solution of a symmetric positive system by preconditioned conjugate gradients; entries that are not free stay 0."""
    x, r = np.zeros_like(b), np.where(free, b, 0.0)
    z = np.where(free, precondition(r), 0.0)
    p, rz, goal = z, (r * z).sum(), 1e-28 * (b * precondition(b)).sum()
    for _ in range(20 * b.size + 1000):
        if not rz > goal:
            break
        q = np.where(free, times(p), 0.0)
        step = rz / (p * q).sum()
        x, r = x + step * p, r - step * q
        z = np.where(free, precondition(r), 0.0)
        rz, before = (r * z).sum(), rz
        p = z + rz / before * p
    if not np.isfinite(x).all():
        raise ArithmeticError("singular system")
    return x


class Blocks:
    """Nodes of a graph in blocks, each linked with itself and the blocks beside it only: levels of a breadth-first walk from an end of the graph."""

    def __init__(self, n: int, ia: np.ndarray, ib: np.ndarray, least: int = 16):
        """ia, ib: links. least: nodes of a block; levels are put together until they have as many."""
        self.n, self.ia, self.ib = n, ia, ib
        a, b = np.concatenate([ia, ib]), np.concatenate([ib, ia])
        order = np.argsort(a, kind="stable")
        to, start = b[order], np.searchsorted(a[order], np.arange(n + 1))
        seen, blocks = np.zeros(n, bool), []

        def levels(node: int) -> list[np.ndarray]:
            found = [np.array([node])]
            seen[node] = True
            while len(now := found[-1]):
                size = start[now + 1] - start[now]
                new = np.unique(to[np.repeat(start[now] + size - np.cumsum(size), size) + np.arange(size.sum())])
                found.append(new[~seen[new]])
                seen[found[-1]] = True
            return found[:-1]

        for node in range(n):
            if seen[node]:
                continue
            for _ in range(2):
                walk = levels(node)
                seen[np.concatenate(walk)] = False
                node = int(walk[-1][0])
            for level in levels(node):
                if blocks and len(blocks[-1]) < least:
                    blocks[-1] = np.concatenate([blocks[-1], level])
                else:
                    blocks.append(level)
        self.size = np.array([len(b) for b in blocks], np.int64)
        self.block, self.place = np.zeros((2, n), np.int64)
        for i, b in enumerate(blocks):
            self.block[b], self.place[b] = i, np.arange(len(b))
        self.nodes = blocks

    def fit(self, k: int) -> bool:
        """Whether a matrix of k numbers a node is small enough."""
        s = self.size * k
        return int((s * s).sum() + (s[:-1] * s[1:]).sum()) <= MOST_NUMBERS

    def solve(self, own: np.ndarray, off: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Solution of the symmetric system with the nodes' blocks `own` (n x k x k) on the diagonal and -off (by link, k x k) beside it."""
        k = own.shape[-1]
        s = self.size * k
        first = lambda x: np.concatenate([[0], np.cumsum(x)])
        at, beside = first(s * s), first(s[:-1] * s[1:])
        d, e = np.zeros(at[-1]), np.zeros(beside[-1])

        def put(out: np.ndarray, base: np.ndarray, width: np.ndarray, p: np.ndarray, q: np.ndarray, v: np.ndarray) -> None:
            row, col = (self.place[x][:, None] * k + np.arange(k) for x in (p, q))
            np.add.at(out, base[:, None, None] + row[:, :, None] * width[:, None, None] + col[:, None, :], v)

        every = np.arange(self.n)
        put(d, at[self.block], s[self.block], every, every, own)
        turned = self.block[self.ia] > self.block[self.ib]
        lo, hi = np.where(turned, self.ib, self.ia), np.where(turned, self.ia, self.ib)
        v = -np.where(turned[:, None, None], off.swapaxes(1, 2), off)
        same = self.block[lo] == self.block[hi]
        p, q, w = lo[same], hi[same], v[same]
        put(d, at[self.block[p]], s[self.block[p]], p, q, w)
        put(d, at[self.block[p]], s[self.block[p]], q, p, w.swapaxes(1, 2))
        p, q, w = lo[~same], hi[~same], v[~same]
        put(e, beside[self.block[p]], s[self.block[q]], p, q, w)
        done, left = [], None
        for i, nodes in enumerate(self.nodes):
            m, r = d[at[i] : at[i + 1]].reshape(s[i], s[i]), right[nodes].reshape(-1, 1)
            if left is not None:
                m, r = m - left.T @ done[-1][:, :-1], r - left.T @ done[-1][:, -1:]
            left = e[beside[i] : beside[i + 1]].reshape(s[i], s[i + 1]) if i + 1 < len(s) else np.zeros((s[i], 0))
            try:
                done.append(np.linalg.solve(m, np.concatenate([left, r], 1)))
            except np.linalg.LinAlgError:
                raise ArithmeticError("singular system") from None
        x, after = np.zeros(right.shape), np.zeros(0)
        for nodes, part in zip(reversed(self.nodes), reversed(done)):
            after = part[:, -1] - part[:, :-1] @ after
            x[nodes] = after.reshape(-1, k)
        if not np.isfinite(x).all():
            raise ArithmeticError("singular system")
        return x


def solve_differences(n: int, ia: np.ndarray, ib: np.ndarray, w: np.ndarray, diff: np.ndarray, fixed: list[int], blocks: Blocks | None = None) -> np.ndarray:
    """x of least weighted squares of x[ia] - x[ib] - diff with a small ridge; fixed entries are 0. blocks: those of the links, if they are there."""
    free = np.ones(n, bool)
    free[fixed] = False
    sums = lambda e: np.bincount(ia, e, n) - np.bincount(ib, e, n)
    diagonal = RIDGE + np.bincount(ia, w, n) + np.bincount(ib, w, n)
    times = lambda x: RIDGE * x + sums(w * (x[ia] - x[ib]))
    blocks = Blocks(n, ia, ib) if blocks is None else blocks
    if not blocks.fit(1):
        return solve_sparse(times, sums(w * diff), lambda r: r / diagonal, free)
    return blocks.solve(np.where(free, diagonal, 1.0)[:, None, None], (w * free[ia] * free[ib])[:, None, None], np.where(free, sums(w * diff), 0.0)[:, None])[:, 0]


def edge_pairs(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Shared cells of each edge, with u, v: their place in the edge's box, from 0 to 1."""
    p = cell_pairs(cells).join(edges.select("a", "b", "x0", "y0", "x1", "y1"), ["a", "b"])
    place = lambda c, lo, hi: (F.col(c) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1))
    return p.select("a", "b", "ch", "x8", "y8", F.col("mean_a").alias("x"), F.col("mean_b").alias("y"), place("x8", "x0", "x1").alias("u"), place("y8", "y0", "y1").alias("v"))


def edge_sums(pairs: DataFrame) -> DataFrame:
    """Sums of a first fit of y on x, and slope and intercept of that line (slope 1 where x doesn't vary)."""
    g = pairs.groupBy("a", "b", "ch").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(den > F.col("n") * F.col("sxx") * 1e-12, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / den).otherwise(1.0)
    return g.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))


def fit_line(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> dict:
    """Robust fit of an edge's means: least squares with clipping, then a line for errors in both, on what is left after taking planes off."""
    keep = np.ones(len(x), bool)
    slope, icpt, stats = 1.0, 0.0, np.zeros(6)
    for i in range(ROUNDS):
        n = keep.sum()
        if n < 2:
            break
        a, b = x[keep], y[keep]
        stats = np.array([n, a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()])
        den = n * stats[3] - stats[1] ** 2
        slope = (n * stats[5] - stats[1] * stats[2]) / den if den > n * stats[3] * 1e-12 else 1.0
        icpt = (stats[2] - slope * stats[1]) / n
        if i < ROUNDS - 1:
            r = y - slope * x - icpt
            keep = np.abs(r) <= max(CLIP * np.sqrt((r[keep] ** 2).mean()), FLOOR)
    n = int(stats[0])
    if n == 0:
        return {"gain": 1.0, "offset": 0.0, "n": 0, "rms": 0.0, "stats": stats.tolist(), "identifiable": False}
    a, b = x[keep], y[keep]
    flat_a, flat_b = a - a.mean(), b - b.mean()
    if len(a) >= 8:
        plane = np.stack([np.ones(len(a)), u[keep], v[keep]], 1)
        try:
            normal = plane.T @ plane
            flat_a, flat_b = (z - plane @ solve_dense(normal, plane.T @ z) for z in (a, b))
        except ArithmeticError:
            pass
    vxx, vyy, vxy = (flat_a**2).mean(), (flat_b**2).mean(), (flat_a * flat_b).mean()
    known = bool(vxx > stats[3] / n * 1e-12 and vyy > 0 and vxy**2 / (vxx * vyy) >= LEAST_R**2)
    if known:
        d = vyy - vxx
        gain = (d + np.sqrt(d * d + 4 * vxy**2)) / (2 * vxy)
    else:
        gain = 1.0
    offset = stats[2] / n - gain * stats[1] / n
    return {"gain": float(gain), "offset": float(offset), "n": n, "rms": float(np.sqrt(((b - gain * a - offset) ** 2).mean())), "stats": stats.tolist(), "identifiable": known}


FIT_DDL = "a long, b long, ch long, gain double, offset double, n long, rms double, stats array<double>, identifiable boolean"


def fit_edges(pairs: DataFrame) -> DataFrame:
    """A robust line fit for each edge and channel. One group is one overlap's cells."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y8", "x8"])
        fit = fit_line(*(pdf[c].to_numpy(float) for c in "xyuv"))
        return pd.DataFrame([{"a": key[0], "b": key[1], "ch": key[2], **fit}])

    return pairs.groupBy("a", "b", "ch").applyInPandas(run, FIT_DDL)


def global_gains(fits: list, gauges: set[int], panels: list[int]) -> dict[int, float]:
    """Gains of one channel from its edge fits (a, b, gain, n, identifiable): iteratively reweighted least squares on log gains, gauge panels at 1."""
    at = {p: i for i, p in enumerate(panels)}
    counted = [f.n for f in fits if f.n > 0]
    mean_n = sum(counted) / len(counted) if counted else 1.0
    use = [f for f in fits if f.identifiable and np.isfinite(f.gain) and f.gain > 0]
    if not use:
        return dict.fromkeys(panels, 1.0)
    ia, ib = (np.array([at[getattr(f, s)] for f in use]) for s in "ab")
    rhs, base = np.log([f.gain for f in use]), np.array([f.n / mean_n for f in use])
    robust = np.ones(len(use))
    fixed = [at[g] for g in gauges]
    blocks = Blocks(len(panels), ia, ib)
    for _ in range(IRLS_ROUNDS):
        log_gain = solve_differences(len(panels), ia, ib, base * robust, rhs, fixed, blocks)
        new = L1_FLOOR / np.maximum(np.abs(log_gain[ia] - log_gain[ib] - rhs), L1_FLOOR)
        new /= new.max()
        moved = np.abs(new - robust) / np.maximum(robust, 1e-300)
        robust = new
        if moved.max() <= 1e-3:
            break
    return {p: 1.0 if p in gauges else float(np.exp(log_gain[at[p]])) for p in panels}


def global_offsets(fits: list, gauges: set[int], panels: list[int], gains: dict[int, float]) -> dict[int, float]:
    """Offsets of one channel by least squares over all edges with cells; gauge panels at 0."""
    at = {p: i for i, p in enumerate(panels)}
    use = [f for f in fits if f.n > 0]
    ia, ib = (np.array([at[getattr(f, s)] for f in use], int) for s in "ab")
    diff = np.array([gains[f.b] * f.stats[2] / f.stats[0] - gains[f.a] * f.stats[1] / f.stats[0] for f in use])
    x = solve_differences(len(panels), ia, ib, np.ones(len(use)), diff, [at[g] for g in gauges])
    return {p: 0.0 if p in gauges else float(x[at[p]]) for p in panels}


def solve(cells: DataFrame, edges: DataFrame, fits: DataFrame, unity: bool = False) -> DataFrame:
    """panel_id, ch, gain, offset. One group is a component of the overlap graph and a channel: a row a panel and an edge; nothing is collected."""
    table = component_table(cells, edges)
    gauges = gauge_panels(cells, edges, table).select("panel_id").withColumn("gauge", F.lit(True))
    panels = cells.select("panel_id", "ch").distinct().join(table, "panel_id").join(gauges, "panel_id", "left").select("component", "ch", "panel_id", F.coalesce("gauge", F.lit(False)).alias("gauge"))
    own = fits.join(table.select(F.col("panel_id").alias("a"), F.col("component").alias("part")), "a").select("part", "ch", "a", "b", "gain", "n", "stats", "identifiable")

    def run(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame({"panel_id": [], "ch": [], "gain": [], "offset": []})
        ids = sorted(nodes["panel_id"].tolist())
        fixed = set(nodes.loc[nodes["gauge"], "panel_id"].tolist())
        rows = list(links.sort_values(["a", "b"]).itertuples(index=False))
        gains = dict.fromkeys(ids, 1.0) if unity else global_gains(rows, fixed, ids)
        offsets = global_offsets(rows, fixed, ids, gains)
        return pd.DataFrame({"panel_id": ids, "ch": key[1], "gain": [gains[p] for p in ids], "offset": [offsets[p] for p in ids]})

    return graph.kept(panels.groupBy("component", "ch").cogroup(own.groupBy("part", "ch")).applyInPandas(run, "panel_id long, ch long, gain double, offset double"))


def corrected(cells: DataFrame, corrections: DataFrame, surfaces: DataFrame | None = None, width: int = 1, height: int = 1) -> DataFrame:
    """Cells with `value`: gain * mean + offset + surface at the cell's centre; missing gains are 1, offsets and surfaces 0."""
    c = cells.join(corrections.select("panel_id", "ch", "gain", "offset"), ["panel_id", "ch"], "left")
    value = F.coalesce("gain", F.lit(1.0)) * F.col("mean") + F.coalesce("offset", F.lit(0.0))
    if surfaces is not None:
        c = c.join(surfaces.select("panel_id", "ch", "coef"), ["panel_id", "ch"], "left")
        x, y = (F.col("x8") + 0.5) * 8 / width, (F.col("y8") + 0.5) * 8 / height
        terms = [F.lit(1.0), x, y, x * x, x * y, y * y]
        value = value + sum((F.coalesce(F.get("coef", F.lit(i)), F.lit(0.0)) * t for i, t in enumerate(terms)), F.lit(0.0))
    return c.withColumn("value", value).drop("coef")
