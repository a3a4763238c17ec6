"""Low-order residual surfaces per panel, and one global background polynomial."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .overlap import component_table, gauge_panels
from .photometry import Blocks, solve_dense, solve_sparse
from .summary import by_channel, exact_medians, full_cells

BG_K, CLIP, ROUNDS, FLOOR, RIDGE, STABLE, WARN = 3.0, 2.5, 2, 1e-7, 1e-3, 1e-9, 5.0
FLATTEN_K, LEAST_BACKGROUND = 3.0, 0.2


def n_terms(order: int) -> int:
    return {0: 1, 1: 3, 2: 6}[order]


def basis(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.ones_like(x), x, y, x * x, x * y, y * y][:n], 1)


def thresholds(values: DataFrame) -> DataFrame:
    """panel_id, ch, med, mad, limit (median + 3 MAD) of `value` over fully covered cells."""
    f = full_cells(values)
    med = f.groupBy("panel_id", "ch").agg(F.median("value").alias("med"))
    mad = f.join(med, ["panel_id", "ch"]).groupBy("panel_id", "ch", "med").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    return mad.withColumn("limit", F.col("med") + BG_K * F.col("mad"))


def background_residuals(values: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, ch, x8, y8, r: corrected differences on shared, fully covered cells that are background in both panels."""
    f = full_cells(values).join(thresholds(values).select("panel_id", "ch", "limit"), ["panel_id", "ch"]).where("value <= limit")
    side = lambda s: f.select(F.col("panel_id").alias(s), "ch", "x8", "y8", F.col("value").alias(f"v{s}"))
    return side("a").join(side("b"), ["ch", "x8", "y8"]).join(edges.select("a", "b"), ["a", "b"]).select("a", "b", "ch", "x8", "y8", (F.col("va") - F.col("vb")).alias("r"))


def solve_panels(own: np.ndarray, pp: np.ndarray, pr: np.ndarray, ia: np.ndarray, ib: np.ndarray, gauge: np.ndarray) -> np.ndarray:
    """Terms of a component's panels from the panels' own matrices and the edges' sums; gauge panels' constants are 0. By elimination in blocks of neighbouring panels; where these are too wide, by conjugate gradients with a block a panel."""
    n = own.shape[-1]
    blocks = own.copy()  # the diagonal blocks of the whole matrix
    np.add.at(blocks, ia, pp)
    np.add.at(blocks, ib, pp)
    stable = STABLE * (1 + np.einsum("pii->pi", blocks))
    np.einsum("pii->pi", blocks)[...] += stable
    free = np.ones((len(own), n), bool)
    free[gauge, 0] = False
    right = np.zeros((len(own), n))
    np.add.at(right, ia, -pr)
    np.add.at(right, ib, pr)

    def times(x: np.ndarray) -> np.ndarray:
        y = np.einsum("pij,pj->pi", own, x) + stable * x
        e = np.einsum("eij,ej->ei", pp, x[ia] - x[ib])
        np.add.at(y, ia, e)
        np.add.at(y, ib, -e)
        return y

    # a fixed term is left out of its panel's block
    kept = np.where(free[:, :, None] & free[:, None, :], blocks, np.eye(n))
    near = Blocks(len(own), ia, ib, 4)
    if near.fit(n):
        off, one = pp * (free[ia][:, :, None] & free[ib][:, None, :]), np.where(free, right, 0.0)
        x = near.solve(kept, off, one)
        return x + near.solve(kept, off, np.where(free, one - times(x), 0.0))  # what rounding left
    inverse = np.stack([np.stack([solve_dense(k, unit) for unit in np.eye(n)], 1) for k in kept])
    return solve_sparse(times, right, lambda r: np.einsum("pij,pj->pi", inverse, r), free)


def fit_surfaces(values: DataFrame, edges: DataFrame, width: int, height: int, order: int = 2) -> DataFrame:
    """panel_id, ch, coef, max_abs_s, bg_mad.

    Each edge's clipped residuals and each panel's cells become sums over basis functions; one task solves a component's channel
    from a matrix of (terms of a panel)² numbers for each edge and panel. Nothing is collected.
    """
    n = n_terms(order)

    def edge_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf["r"].to_numpy()
        keep = np.ones(len(r), bool)
        for _ in range(ROUNDS):
            if keep.sum() < 2:
                break
            mean = r[keep].mean()
            keep = np.abs(r - mean) <= max(CLIP * r[keep].std(), FLOOR)
        if not keep.any():
            keep[:] = True
        phi = basis((pdf["x8"].to_numpy()[keep] + 0.5) * 8 / width, (pdf["y8"].to_numpy()[keep] + 0.5) * 8 / height, n)
        m = keep.sum()
        return pd.DataFrame([{"a": key[0], "b": key[1], "ch": key[2], "pp": (phi.T @ phi / m).ravel().tolist(), "pr": (phi.T @ r[keep] / m).tolist()}])

    sums = background_residuals(values, edges).groupBy("a", "b", "ch").applyInPandas(edge_sums, "a long, b long, ch long, pp array<double>, pr array<double>")
    x, y = (F.col("x8") + 0.5) * 8 / width, (F.col("y8") + 0.5) * 8 / height
    phi = [F.lit(1.0), x, y, x * x, x * y, y * y][:n]
    full = full_cells(values)
    table = component_table(values, edges)
    gauges = gauge_panels(values, edges, table).select("panel_id").withColumn("gauge", F.lit(True))
    norm = full.groupBy("panel_id", "ch").agg(F.array(*(F.avg(phi[i] * phi[j]) for i in range(n) for j in range(n))).alias("own"))
    panels = norm.join(table, "panel_id").join(gauges, "panel_id", "left").select("component", "ch", "panel_id", "own", F.coalesce("gauge", F.lit(False)).alias("gauge"))
    links = sums.join(table.select(F.col("panel_id").alias("a"), F.col("component").alias("part")), "a").select("part", "ch", "a", "b", "pp", "pr")

    def run(key: tuple, nodes: pd.DataFrame, use: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty:
            return pd.DataFrame({"panel_id": [], "ch": [], "coef": []})
        nodes, use = nodes.sort_values("panel_id"), use.sort_values(["a", "b"])
        ids = nodes["panel_id"].tolist()
        at = {p: i for i, p in enumerate(ids)}
        use = use[use["a"].isin(at) & use["b"].isin(at)]
        ia, ib = (np.array([at[p] for p in use[s]], int) for s in "ab")
        pp, pr = (np.array(use[c].tolist(), float).reshape(-1, *shape) for c, shape in (("pp", (n, n)), ("pr", (n,))))
        own = RIDGE * np.array(nodes["own"].tolist(), float).reshape(-1, n, n)
        coef = solve_panels(own, pp, pr, ia, ib, nodes["gauge"].to_numpy())
        return pd.DataFrame({"panel_id": ids, "ch": key[1], "coef": coef.tolist()})

    surf = graph.kept(panels.groupBy("component", "ch").cogroup(links.groupBy("part", "ch")).applyInPandas(run, "panel_id long, ch long, coef array<double>"))
    s = sum((F.element_at("coef", i + 1) * phi[i] for i in range(1, n)), F.element_at("coef", 1) * phi[0])
    largest = full.join(surf, ["panel_id", "ch"]).groupBy("panel_id", "ch").agg(F.max(F.abs(s)).alias("max_abs_s"))
    return surf.join(largest, ["panel_id", "ch"]).join(thresholds(values).select("panel_id", "ch", F.col("mad").alias("bg_mad")), ["panel_id", "ch"]).withColumn("warn", F.col("max_abs_s") > WARN * F.col("bg_mad"))


def merged_background(values: DataFrame, distance: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """x8, y8, ch, value: distance-weighted mean over the panels that cover a cell fully; cells masked in any of them are dropped."""
    f = full_cells(values).join(distance, ["panel_id", "x8", "y8"])
    if masked is not None:
        f = f.join(masked.select("panel_id", "x8", "y8", F.lit(True).alias("star")), ["panel_id", "x8", "y8"], "left")
    else:
        f = f.withColumn("star", F.lit(None).cast("boolean"))
    w = F.greatest("d", F.lit(1.0))
    return f.groupBy("x8", "y8", "ch").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"), F.bool_or(F.coalesce("star", F.lit(False))).alias("star")).where("not star").drop("star")


def fit_flatten(background: DataFrame, width: int, height: int, order: int = 1) -> DataFrame:
    """ch, coef of one polynomial a channel over background cells (at most median + 3 MAD in every channel); ValueError if these are under a fifth."""
    n = n_terms(order)
    counts = background.groupBy("ch", "value").agg(F.count("*").alias("n")).persist()
    med = exact_medians(counts)
    if not med:
        raise ValueError("no cells are background")
    mad = exact_medians(counts.groupBy("ch", F.abs(F.col("value") - by_channel(med)).alias("value")).agg(F.sum("n").alias("n")))
    counts.unpersist()
    limit = by_channel({c: med[c] + FLATTEN_K * mad[c] for c in med})
    dark = background.groupBy("x8", "y8").agg(F.bool_and(F.col("value") <= limit).alias("dark"))
    share = dark.agg(F.avg(F.col("dark").cast("double"))).first()[0] or 0.0
    if share < LEAST_BACKGROUND:
        raise ValueError(f"only {share:.2f} of the cells are background")
    x, y = (F.col("x8") + 0.5) * 8 / width, (F.col("y8") + 0.5) * 8 / height
    phi = [F.lit(1.0), x, y, x * x, x * y, y * y][:n]
    sums = background.join(dark.where("dark"), ["x8", "y8"]).groupBy("ch").agg(*(F.sum(phi[i] * phi[j]).alias(f"p{i}_{j}") for i in range(n) for j in range(n)), *(F.sum(phi[i] * F.col("value")).alias(f"r{i}") for i in range(n))).collect()
    out = [(r.ch, solve_dense(np.array([[r[f"p{i}_{j}"] for j in range(n)] for i in range(n)]), np.array([r[f"r{i}"] for i in range(n)])).tolist()) for r in sums]
    return background.sparkSession.createDataFrame(out, "ch long, coef array<double>")


def fold_flatten(surfaces: DataFrame, flatten: DataFrame) -> DataFrame:
    """Surfaces with the background polynomial, less its value at the centre, taken off every panel's terms."""
    f = flatten.select("ch", F.col("coef").alias("f"))
    term = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    centre = sum((term("f", i) * w for i, w in ((1, 0.5), (2, 0.5), (3, 0.25), (4, 0.25), (5, 0.25))), term("f", 0))
    new = F.array(term("coef", 0) - term("f", 0) + centre, *(term("coef", i) - term("f", i) for i in range(1, 6)))
    return surfaces.join(F.broadcast(f), "ch").withColumn("coef", new).drop("f")
