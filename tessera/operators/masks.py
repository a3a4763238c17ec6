"""Star masks and planes of cells: flood fill, component split, dilation, hole fill, transitions.

Functions of planes are numpy and take time in proportion to the cells; mask_table() labels tiles and joins their labels in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .graph import joined
from .overlap import chamfer
from .summary import upper_medians

SEED, GROW, AREA, DIM, THIN = 3.0, 1.5, 40, 12, 6
AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
DIAMOND = [(0, -1), (-1, 0), (1, 0), (0, 1)]


def upper_median(v: np.ndarray) -> float:
    return float(np.sort(v)[len(v) // 2])


def shifted(plane: np.ndarray, dx: int, dy: int, fill=False) -> np.ndarray:
    """plane at (x - dx, y - dy)."""
    out = np.full_like(plane, fill)
    h, w = plane.shape
    out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = plane[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def dilate(plane: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        plane = np.logical_or.reduce([plane, *(shifted(plane, dx, dy) for dx, dy in AROUND)])
    return plane


def flood(seeds: np.ndarray, open_: np.ndarray, steps=AROUND) -> np.ndarray:
    """Cells that are reached from the seeds through open ones: the components that hold a seed."""
    numbers, n = label(seeds | open_, len(steps) > 4)
    hit = np.zeros(n + 1, bool)
    hit[numbers[seeds]] = True
    hit[0] = False
    return hit[numbers]


def star_mask(coverage: np.ndarray, detail: np.ndarray) -> np.ndarray:
    """Cells of much detail, and those joined to them of somewhat less. detail: greatest over channels."""
    full = coverage >= 1
    if not full.any():
        return np.zeros(coverage.shape, bool)
    m = upper_median(detail[full])
    some = coverage > 0
    return flood(some & (detail > SEED * m), some & (detail > GROW * m))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of true cells along rows, in order."""
    h, w = mask.shape
    wide = np.zeros((h, w + 2), np.int8)
    wide[:, 1:-1] = mask
    change = np.diff(wide, axis=1)
    row, start = np.nonzero(change == 1)
    return row, start, np.nonzero(change == -1)[1]


def labelled_runs(mask: np.ndarray, diagonal: bool = True) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, int]:
    """(runs, the number of each run's component, components), from 0 in the order of their first cells. Time follows the cells."""
    row, start, end = found = runs(mask)
    wide, d = mask.shape[1] + 2, int(diagonal)
    lo = np.searchsorted(row * wide + end, (row + 1) * wide + start + 1 - d)  # first run of the next row that ends late enough
    hi = np.searchsorted(row * wide + start, (row + 1) * wide + end - 1 + d, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    _, number = np.unique(joined(len(row), a, b), return_inverse=True)
    return found, number, int(number.max(initial=-1)) + 1


def label(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """8-connected components (4-connected without diagonals), numbered from 1 in the order of their first cells."""
    (_, start, end), number, n = labelled_runs(mask, diagonal)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(number + 1, end - start)
    return out, n


def is_compact(area, longest):
    """Whether components are small, short or thin; of numbers, arrays or columns."""
    return (area <= AREA) | (longest <= DIM) | (area <= THIN * longest)


def split(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(compact, structure) cells."""
    (row, start, end), number, n = labelled_runs(mask)
    area = np.bincount(number, end - start, n)
    low, high = np.full((2, n), np.iinfo(np.int64).max), np.full((2, n), -1)
    for axis, (first, last) in enumerate(((row, row), (start, end - 1))):
        np.minimum.at(low[axis], number, first)
        np.maximum.at(high[axis], number, last)
    compact = np.zeros(mask.shape, bool)
    compact[mask] = np.repeat(is_compact(area, (high - low).max(0) + 1)[number], end - start)
    return compact, mask & ~compact


def fill_holes(plane: np.ndarray) -> np.ndarray:
    """Closed-off false cells become true."""
    border = np.zeros(plane.shape, bool)
    border[[0, -1], :] = border[:, [0, -1]] = True
    return ~flood(border & ~plane, ~plane, DIAMOND)


def base_reach(coverage: np.ndarray) -> np.ndarray:
    return dilate(coverage > 0, 2)


def detail_reference(masks: np.ndarray, feather: float) -> np.ndarray:
    """1 deep inside large masked areas, falling to 0 over a halo. masks: union of the panels' masks."""
    depth = chamfer(dilate(masks, 2))
    deep = fill_holes(np.isfinite(depth) & (depth > 10))
    away = chamfer(~deep)
    halo = min(max(feather / 8, 4), 32)
    return np.clip(1 - away / halo, 0, 1) if deep.any() else np.zeros(masks.shape)


def transitions(owner: np.ndarray, compact: dict[int, np.ndarray], structure: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """(ramps, hard). ramps: each owning panel's weight across its seams; hard: cells around compact masks on a seam, where only the owner counts."""
    hard, wide = np.zeros(owner.shape, bool), np.zeros(owner.shape, bool)
    for dx, dy in ((1, 0), (0, 1)):
        other = shifted(owner, -dx, -dy, -1)
        seam = (owner >= 0) & (other >= 0) & (owner != other)
        for masks, out in ((compact, hard), (structure, wide)):
            hit = np.zeros(owner.shape, bool)
            for p, mask in masks.items():
                either = mask | shifted(mask, -dx, -dy)
                hit |= seam & either & ((owner == p) | (other == p))
            out |= hit | shifted(hit, dx, dy)
    hard, wide = dilate(hard, 2), dilate(wide, 4)
    half = np.where(wide, 4.0, 2.0)
    ramps = {}
    for p in np.unique(owner[owner >= 0]).tolist():
        own = owner == p
        d_in, d_out = (np.minimum(chamfer(o), 1e6) for o in (own, ~own))
        ramps[p] = np.clip(0.5 + (d_in - d_out) / (2 * half), 0, 1)
    return ramps, hard


def plane_of(pdf: pd.DataFrame, column: str, w8: int, h8: int, fill=0.0) -> np.ndarray:
    out = np.full((h8, w8), fill, float)
    out[pdf["y8"], pdf["x8"]] = pdf[column]
    return out


def thresholds(cells: DataFrame) -> DataFrame:
    """panel_id, m: each panel's upper median of detail over its fully covered cells (x8, y8, coverage, detail: the greatest over channels)."""
    return upper_medians(cells.where("coverage >= 1").select("panel_id", F.col("detail").alias("value")), "panel_id")


def mask_table(cells: DataFrame, side: int = 512) -> DataFrame:
    """panel_id, x8, y8, compact: masked cells of every panel and whether their component is compact.

    Cells of enough detail are labelled in tiles (`side` cells); labels that touch across a border of tiles are links, whose components
    join them. A component is masked if one of its cells has the greater detail. So no group is larger than a tile.
    """
    c = cells.groupBy("panel_id", "x8", "y8").agg(F.max("coverage").alias("coverage"), F.max("detail").alias("detail"))
    grow = c.join(graph.kept(thresholds(c)), "panel_id").where((F.col("coverage") > 0) & (F.col("detail") > GROW * F.col("m"))).select("panel_id", "x8", "y8", (F.col("detail") > SEED * F.col("m")).alias("seed"))
    tile = lambda axis: F.floor(F.col(axis) / side)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(key[2]) * side, int(key[1]) * side
        x, y = pdf["x8"].to_numpy() - x0, pdf["y8"].to_numpy() - y0
        plane = np.zeros((side, side), bool)
        plane[y, x] = True
        numbers, n = label(plane)
        ys, xs = np.nonzero(plane)
        _, first = np.unique(numbers[ys, xs], return_index=True)
        name = (np.int64(key[0]) << 44) + ((ys[first] + y0).astype(np.int64) << 22) + xs[first] + x0  # a label's first cell names it
        out = pdf[["panel_id", "x8", "y8", "seed"]].copy()
        out["part"] = name[numbers[y, x] - 1]
        out["border"] = (x == 0) | (y == 0) | (x == side - 1) | (y == side - 1)
        return out

    parts = grow.groupBy("panel_id", tile("y8").alias("ty"), tile("x8").alias("tx")).applyInPandas(run, "panel_id long, x8 long, y8 long, seed boolean, part long, border boolean").persist()
    rim = parts.where("border").select("panel_id", "x8", "y8", "part")
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)))))
    moved = rim.withColumn("d", steps).select("panel_id", (F.col("x8") + F.col("d.dx")).alias("x8"), (F.col("y8") + F.col("d.dy")).alias("y8"), F.col("part").alias("other"))
    links = rim.join(moved, ["panel_id", "x8", "y8"]).select(F.col("part").alias("a"), F.col("other").alias("b"))
    found = graph.components(links)
    whole = parts.join(found, F.col("part") == F.col("node"), "left").select("panel_id", "x8", "y8", "seed", F.coalesce("label", "part").alias("part"))
    longest = F.greatest(F.max("x8") - F.min("x8"), F.max("y8") - F.min("y8")) + 1
    kinds = whole.groupBy("part").agg(F.count("*").alias("area"), longest.alias("longest"), F.max("seed").alias("seed")).where("seed").select("part", is_compact(F.col("area"), F.col("longest")).alias("compact"))
    return whole.join(kinds, "part").select("panel_id", "x8", "y8", "compact")
