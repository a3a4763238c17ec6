"""Which panel owns each cell: nearest centre first, then seams moved along least difference by dynamic programming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import feather_weight
from .summary import full_cells

BETA, MASK_COST, LEAST_LONG, UNSHARED = 4.0, 100.0, 64, 1e12


def voronoi_owner(distance: DataFrame, feather: float) -> DataFrame:
    """x8, y8, owner, d: per cell the panel of most feather weight, ties to the larger distance, then the lower id. distance: covered cells only."""
    w = feather_weight(8 * F.col("d"), feather)
    best = F.max_by(F.struct("panel_id", "d"), F.struct(w.alias("w"), F.col("d"), (-F.col("panel_id")).alias("p")))
    return distance.groupBy("x8", "y8").agg(best.alias("b")).select("x8", "y8", F.col("b.panel_id").alias("owner"), F.col("b.d").alias("d"))


def seam_path(cost: np.ndarray) -> np.ndarray:
    """Boundary position (0..S) for each step along the long axis (cost: T x S); a boundary costs the cells on its two sides."""
    t, s = cost.shape
    pad = np.zeros((t, 1))
    side = np.concatenate([pad, cost], 1) + np.concatenate([cost, pad], 1)
    best, came = side[0].copy(), np.zeros((t, s + 1), np.int8)
    for i in range(1, t):
        step, move = best.copy(), np.zeros(s + 1, np.int8)
        for d in (-1, 1):
            other = np.full(s + 1, np.inf)
            if d < 0:
                other[1:] = best[:-1]
            else:
                other[:-1] = best[1:]
            less = other < step
            step[less], move[less] = other[less], d
        best, came[i] = step + side[i], move
    path = np.empty(t, np.int64)
    path[-1] = int(best.argmin())
    for i in range(t - 1, 0, -1):
        path[i - 1] = path[i] + came[i, path[i]]
    return path


def edge_relabels(cells: DataFrame, edges: DataFrame, distance: DataFrame, masks: DataFrame, least: int = LEAST_LONG) -> DataFrame:
    """a, b, x8, y8, owner: who owns the shared, fully covered cells of each edge whose box is `least` cells long or more. cells: with `value` and `gain`.

    One group is the rows of one edge's box: both panels' cells there.
    """
    long = edges.where((F.col("x1") - F.col("x0") >= least) | (F.col("y1") - F.col("y0") >= least))
    c = full_cells(cells).groupBy("panel_id", "x8", "y8").agg(F.array_sort(F.collect_list(F.struct("ch", "value"))).alias("v"), F.max(F.col("detail") * F.coalesce("gain", F.lit(1.0))).alias("detail"))
    c = c.join(distance.select("panel_id", "x8", "y8", "d"), ["panel_id", "x8", "y8"])
    c = c.join(masks.select("panel_id", "x8", "y8", F.lit(1).alias("star")), ["panel_id", "x8", "y8"], "left")
    side = lambda s: c.select(F.col("panel_id").alias(s), "x8", "y8", F.transform("v", lambda e: e["value"]).alias(f"v{s}"), F.col("detail").alias(f"det{s}"), F.col("d").alias(f"d{s}"), F.coalesce("star", F.lit(0)).alias(f"star{s}"))
    both = side("a").join(side("b"), ["x8", "y8"]).join(long.select("a", "b", "x0", "y0", "x1", "y1"), ["a", "b"])
    diff = F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x - y)))
    rows = both.select("a", "b", "x0", "y0", "x1", "y1", "x8", "y8", (diff + BETA * F.greatest("deta", "detb")).alias("cost"), (F.col("da") - F.col("db")).alias("dd"), (F.col("stara") + F.col("starb") > 0).alias("star"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.iloc[0]
        w, h = int(f.x1 - f.x0), int(f.y1 - f.y0)
        x, y = pdf["x8"].to_numpy() - f.x0, pdf["y8"].to_numpy() - f.y0
        cost, dd, shared = np.full((h, w), UNSHARED), np.zeros((h, w)), np.zeros((h, w), bool)
        value = pdf["cost"].to_numpy()
        masked = np.sort(value)[len(value) // 2] * MASK_COST
        cost[y, x] = value + np.where(pdf["star"], masked, 0)
        dd[y, x], shared[y, x] = pdf["dd"], True
        along_x = w >= h
        if along_x:
            cost, dd, shared = cost.T, dd.T, shared.T
        path = seam_path(cost)
        low_a = dd[:, 0].sum() >= 0
        low = np.arange(cost.shape[1])[None, :] < path[:, None]
        owner = np.where(low == low_a, int(f.a), int(f.b))
        t, s = np.nonzero(shared)
        cy, cx = (s, t) if along_x else (t, s)
        return pd.DataFrame({"a": int(f.a), "b": int(f.b), "x8": cx + int(f.x0), "y8": cy + int(f.y0), "owner": owner[t, s]})

    return rows.groupBy("a", "b").applyInPandas(run, "a long, b long, x8 long, y8 long, owner long")


def owner_map(cells: DataFrame, edges: DataFrame, distance: DataFrame, masks: DataFrame, feather: float, least: int = LEAST_LONG) -> DataFrame:
    """x8, y8, owner: the first owners, overwritten by edges in their order; a later edge wins."""
    new = edge_relabels(cells, edges, distance, masks, least).groupBy("x8", "y8").agg(F.max_by("owner", F.struct("a", "b")).alias("new"))
    return voronoi_owner(distance, feather).join(new, ["x8", "y8"], "left").select("x8", "y8", F.coalesce("new", "owner").alias("owner"))


def boundary_cells(owner: DataFrame) -> DataFrame:
    """x8, y8, owner, other: each cell with every different owner among its 4 neighbours."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    moved = owner.withColumn("s", F.explode(steps)).select((F.col("x8") + F.col("s.dx")).alias("x8"), (F.col("y8") + F.col("s.dy")).alias("y8"), F.col("owner").alias("other"))
    return owner.join(moved, ["x8", "y8"]).where("owner <> other").distinct()


def seam_deltas(boundary: DataFrame, values: DataFrame) -> DataFrame:
    """a, b, n_cells, delta: per pair the mean, over boundary cells that both cover fully, of the largest difference in any channel."""
    f = full_cells(values).groupBy("panel_id", "x8", "y8").agg(F.array_sort(F.collect_list(F.struct("ch", "value"))).alias("v"))
    v = lambda p, name: f.select(F.col("panel_id").alias(p), "x8", "y8", F.transform("v", lambda e: e["value"]).alias(name))
    j = boundary.join(v("owner", "v1"), ["owner", "x8", "y8"]).join(v("other", "v2"), ["other", "x8", "y8"])
    d = F.array_max(F.zip_with("v1", "v2", lambda x, y: F.abs(x - y)))
    return j.groupBy(F.least("owner", "other").alias("a"), F.greatest("owner", "other").alias("b")).agg(F.count("*").alias("n_cells"), F.avg(d).alias("delta"))


def region_centroids(owner: DataFrame) -> DataFrame:
    return owner.groupBy("owner").agg(F.expr("sum(x8) div count(*)").alias("cx"), F.expr("sum(y8) div count(*)").alias("cy"), F.count("*").alias("n_cells"))


def edge_flags(deltas: DataFrame) -> DataFrame:
    """Pairs whose delta is over three times the upper median of all."""
    n = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("delta", "a", "b")) - 1  # a row an edge
    middle = F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("delta"))).over(n)
    return deltas.withColumn("n", F.count("*").over(n)).withColumn("r", rank).withColumn("flag", F.col("delta") > 3 * middle).select("a", "b", "n_cells", "delta", "flag")
