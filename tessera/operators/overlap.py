"""Overlap graph of panels, its components and gauge panels, and distance maps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .summary import full_cells

MIN_EDGE_CELLS = 16


def cell_pairs(cells: DataFrame) -> DataFrame:
    """a, b, ch, x8, y8 and both panels' means and details, for cells that are fully covered in both (a < b): an equi join on the cell."""
    f = full_cells(cells).select("panel_id", "ch", "x8", "y8", "mean", "detail")
    side = lambda s: f.select(F.col("panel_id").alias(s), "ch", "x8", "y8", F.col("mean").alias(f"mean_{s}"), F.col("detail").alias(f"detail_{s}"))
    return side("a").join(side("b"), ["ch", "x8", "y8"]).where("a < b")


def overlap_edges(cells: DataFrame, least: int = MIN_EDGE_CELLS) -> DataFrame:
    """a, b, x0, y0, x1, y1 (cells, exclusive), n_cells of panel pairs that share at least `least` fully covered cells."""
    p = cell_pairs(cells.where("ch = 0"))
    g = p.groupBy("a", "b").agg(F.min("x8").alias("x0"), F.min("y8").alias("y0"), (F.max("x8") + 1).alias("x1"), (F.max("y8") + 1).alias("y1"), F.count("*").alias("n_cells"))
    return g.where(F.col("n_cells") >= least)


def component_table(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """panel_id, component (its smallest panel)."""
    panels = cells.select("panel_id").distinct()
    found = graph.components(edges).select(F.col("node").alias("panel_id"), "label")
    return panels.join(found, "panel_id", "left").select("panel_id", F.coalesce("label", "panel_id").alias("component"))


def full_counts(cells: DataFrame) -> DataFrame:
    """panel_id, n_full: its fully covered cells."""
    return full_cells(cells.where("ch = 0")).groupBy("panel_id").agg(F.count("*").alias("n_full"))


def gauge_panels(cells: DataFrame, edges: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """component, panel_id: in each component the panel of most fully covered cells, ties to the lowest id. table: component_table(), if it is there."""
    counts = (component_table(cells, edges) if table is None else table).join(full_counts(cells), "panel_id", "left").fillna(0, ["n_full"])
    w = Window.partitionBy("component").orderBy(F.desc("n_full"), "panel_id")
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("component", "panel_id", "n_full")


def chamfer(open_: np.ndarray) -> np.ndarray:
    """Distance in cells (steps of 1 and √2) of each cell to the nearest that is not open; infinite without any. Cells outside the grid don't count.

    Steps cost the same everywhere, so the distance to a set is the least over it of max + (√2 - 1) min of the offsets;
    rows are relaxed downwards and upwards, and along a row by running minima.
    """
    h, w = open_.shape
    d = np.where(open_, np.inf, 0.0)
    diag, at = math.sqrt(2.0), np.arange(w, dtype=float)

    def along(row: np.ndarray) -> np.ndarray:
        right = np.minimum.accumulate(row - at) + at
        left = np.minimum.accumulate((row + at)[::-1])[::-1] - at
        return np.minimum(np.minimum(row, right), left)

    for order in (range(h), range(h - 1, -1, -1)):
        before = None
        for y in order:
            if before is not None:
                side = np.full(w, np.inf)
                side[1:] = before[:-1] + diag
                side[:-1] = np.minimum(side[:-1], before[1:] + diag)
                d[y] = np.minimum(d[y], np.minimum(before + 1.0, side))
            d[y] = along(d[y])
            before = d[y]
    return d


def distance_map(cells: DataFrame, w8: int, h8: int) -> DataFrame:
    """panel_id, x8, y8, d: distance of each covered cell to the nearest cell that is not fully covered, in cells; 1e30 without any.

    One group a panel: a panel's cells are a small plane. Only its bounding box and one cell around it are laid out.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x8"].to_numpy(), pdf["y8"].to_numpy()
        x0, y0 = max(x.min() - 1, 0), max(y.min() - 1, 0)
        x1, y1 = min(x.max() + 2, w8), min(y.max() + 2, h8)
        full = np.zeros((y1 - y0, x1 - x0), bool)
        full[y - y0, x - x0] = pdf["n"].to_numpy() == pdf["area"].to_numpy()
        d = chamfer(full)
        d[np.isinf(d)] = 1e30
        return pd.DataFrame({"panel_id": pdf["panel_id"], "x8": x, "y8": y, "d": np.round(d[y - y0, x - x0], 9)})

    return cells.where("ch = 0").select("panel_id", "x8", "y8", "n", "area").groupBy("panel_id").applyInPandas(run, "panel_id long, x8 long, y8 long, d double")
