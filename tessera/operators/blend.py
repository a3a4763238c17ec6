"""Blending panels into a mosaic: previews as plain aggregation, feather, two-band and pyramid over tiles.

Cells are 1/64 of the pixels. Star-free bases, seam ramps, the reference base and the pyramid are made tile by
tile of cells, each with a halo wider than any filling or filter reaches. Pixels travel as bands, cut at the borders of squares, and are
corrected and blended there, with the cells that bilinear taps need; mosaics come out as strips of such squares (y, x0, vals; null
where nothing is covered). No group holds the whole mosaic, or a whole row of it, and no pixel is a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import feather_weight, levels_for_feather
from .graph import kept
from .masks import AROUND, base_reach, detail_reference, dilate, plane_of, transitions, upper_median
from .pyramid import blend as blend_levels
from .pyramid import build, mask_levels
from .summary import band_arrays, tiles, upper_medians

LEAST_WEIGHT, RAMP_PX, ANCHOR_K, LEAST_MAD, LOCAL_LAYERS, FILL_ROUNDS, VETO = 1e-4, 32.0, 20.0, 1e-7, 8, 256, 6.0


def preview(values: DataFrame, distance: DataFrame, feather: float) -> DataFrame:
    """x8, y8, ch, value: feather blend of the means of fully covered cells."""
    f = values.where("n = area").join(distance.select("panel_id", "x8", "y8", "d"), ["panel_id", "x8", "y8"])
    w = feather_weight(8 * F.col("d"), feather)
    return f.groupBy("x8", "y8", "ch").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))


MOSAIC_DDL = "y long, x0 long, vals array<array<double>>"


def with_corrections(bands: DataFrame, corrections: DataFrame, surfaces: DataFrame | None) -> DataFrame:
    """Bands with their panel's gain and offset (arrays by channel) and coefs (surface terms by channel); a row a panel is joined."""
    c = corrections.select("panel_id", "ch", "gain", "offset")
    c = c.join(surfaces.select("panel_id", "ch", "coef"), ["panel_id", "ch"], "left") if surfaces is not None else c.withColumn("coef", F.expr("cast(null as array<double>)"))
    by = c.groupBy("panel_id").agg(F.array_sort(F.collect_list(F.struct("ch", "gain", "offset", F.coalesce("coef", F.expr("cast(array() as array<double>)")).alias("coef")))).alias("fix"))
    return bands.join(by, "panel_id", "left")


class Square:
    """The pixels of a tile: corrected values and coverage of each panel in it."""

    def __init__(self, t: pa.Table, width: int, height: int):
        t = t.combine_chunks()
        panel, y = (t[c].to_numpy() for c in ("panel_id", "y"))
        x0, vals = (t[c].chunk(0) for c in ("x0", "vals"))
        size = pc.list_value_length(pc.list_element(vals, 0)).to_numpy()
        at = x0.to_numpy()
        self.x0, self.y0 = int(at.min()), int(y.min())
        self.shape = (int(y.max()) - self.y0 + 1, int((at + size).max()) - self.x0)
        self.channels = len(vals[0])
        self.panels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        raw = {int(p): np.zeros((self.channels, *self.shape)) for p in np.unique(panel)}
        for rows, x, v in band_arrays(x0, vals):
            for p, line, one in zip(panel[rows].tolist(), (y[rows] - self.y0).tolist(), v):
                raw[p][:, line, x - self.x0 : x - self.x0 + one.shape[1]] = one
        _, first = np.unique(panel, return_index=True)
        fixes = dict(zip(panel[first].tolist(), t["fix"].take(first).to_pylist()))
        self.yy, self.xx = np.mgrid[self.y0 : self.y0 + self.shape[0], self.x0 : self.x0 + self.shape[1]]
        for p, v in sorted(raw.items()):
            covered = (v != 0).all(0)
            for f in fixes[p] or ():
                v[f["ch"]] = f["gain"] * v[f["ch"]] + f["offset"]
                if f["coef"]:
                    x, y = self.xx / width, self.yy / height
                    v[f["ch"]] += sum(k * term for k, term in zip(f["coef"], (1.0, x, y, x * x, x * y, y * y)))
            self.panels[p] = (np.where(covered, v, 0.0), covered)

    def rows(self, values: np.ndarray, some: np.ndarray, box: tuple[int, int, int, int] | None, **more: np.ndarray) -> pa.Table:
        """Strips of the mosaic: values (by channel) are null where `some` is false; only what lies in the box."""
        (h, w), (x0, y0) = self.shape, (self.x0, self.y0)
        lo_x, lo_y, hi_x, hi_y = (max(box[0], x0) - x0, max(box[1], y0) - y0, min(box[2], x0 + w) - x0, min(box[3], y0 + h) - y0) if box else (0, 0, w, h)
        if lo_x >= hi_x or lo_y >= hi_y:
            return _no_strips(*more)
        cut = lambda a: a[..., lo_y:hi_y, lo_x:hi_x]
        v, ok = np.moveaxis(cut(values), 0, 1), cut(some)
        n, c, k = v.shape
        flat = pa.array(v.ravel(), mask=~np.broadcast_to(ok[:, None], v.shape).ravel())
        inner = pa.ListArray.from_arrays(pa.array(np.arange(n * c + 1) * k, pa.int32()), flat)
        cols = {"y": pa.array(np.arange(n) + y0 + lo_y), "x0": pa.array(np.full(n, x0 + lo_x)), "vals": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * c, pa.int32()), inner)}
        for name, a in more.items():
            cols[name] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(cut(a).ravel().astype(np.int32)))
        return pa.table(cols)


def mosaic_pixels(mosaic: DataFrame, *more: str) -> DataFrame:
    """Strips of a mosaic as covered samples: x, y, ch, value, and of columns of arrays by pixel their elements."""
    rows = mosaic.select("y", "x0", F.posexplode("vals").alias("ch", "row"), *more)
    out = rows.select("y", "x0", F.col("ch").cast("long").alias("ch"), F.posexplode("row").alias("i", "value"), *more).where("value is not null")
    return out.select((F.col("x0") + F.col("i")).alias("x"), "y", "ch", "value", *(F.get(m, F.col("i")).cast("long").alias(m) for m in more))


def _near(table: DataFrame, side: int) -> DataFrame:
    """Cells with the squares of pixels (sx, sy) that they or a neighbour touch."""
    near = lambda axis: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.greatest(F.col(axis) + k, F.lit(0)) / (side // 8))))
    return table.withColumn("sy", F.explode(near("y8"))).withColumn("sx", F.explode(near("x8")))


def feather(bands: DataFrame, corrections: DataFrame, surfaces: DataFrame | None, width: int, height: int, distance: DataFrame, feather: float, side: int = 512, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Strips of the mosaic (y, x0, vals, n_panels): weighted mean over covering panels; the weight follows the distance (in cells, bilinear at (x/8, y/8)).

    A tap beyond the panel's cells takes its nearest neighbour's distance. One group is a square of pixels with the cells that touch it.
    """
    fixed = tiles(with_corrections(bands, corrections, surfaces), side)

    def run(pix: pa.Table, cell: pa.Table) -> pa.Table:
        sq = Square(pix, width, height) if pix.num_rows else None
        if sq is None:
            return _no_strips("n_panels")
        g = cell.to_pandas()
        total, weight, count = np.zeros((sq.channels, *sq.shape)), np.zeros(sq.shape), np.zeros(sq.shape, np.int64)
        own = {int(p): c for p, c in g.groupby("panel_id")}
        x8, y8 = sq.xx // 8, sq.yy // 8
        left, top = int(x8.min()), int(y8.min())
        h8, w8 = int(y8.max()) - top + 2, int(x8.max()) - left + 2
        tx, ty = sq.xx / 8 - x8, sq.yy / 8 - y8
        for p, (v, covered) in sq.panels.items():
            if not covered.any():
                continue
            d = np.full((h8, w8), np.nan)
            c = own[p]
            inside = (c["x8"] >= left) & (c["x8"] < left + w8) & (c["y8"] >= top) & (c["y8"] < top + h8)
            d[c["y8"][inside] - top, c["x8"][inside] - left] = c["d"][inside]
            at = lambda dy, dx, d=d: d[y8 - top + dy, x8 - left + dx]
            a, r, b, x = at(0, 0), at(0, 1), at(1, 0), at(1, 1)
            x = np.where(np.isnan(x), np.where(np.isnan(r), np.where(np.isnan(b), a, b), r), x)
            r, b = np.where(np.isnan(r), a, r), np.where(np.isnan(b), a, b)
            dist = (a * (1 - tx) + r * tx) * (1 - ty) + (b * (1 - tx) + x * tx) * ty
            w = np.where(covered, np.maximum(np.clip(8 * dist / feather, 0, 1), LEAST_WEIGHT), 0)
            total += np.where(covered, w * v, 0)
            weight += w
            count += covered
        some = count > 0
        return sq.rows(total / np.where(some, weight, 1), some, box, n_panels=count)

    cells_ = _near(distance.select("panel_id", "x8", "y8", "d"), side)
    return fixed.groupBy("sy", "sx").cogroup(cells_.groupBy("sy", "sx")).applyInArrow(run, MOSAIC_DDL + ", n_panels array<int>")


def _no_strips(*more: str) -> pa.Table:
    return pa.table({"y": pa.array([], pa.int64()), "x0": pa.array([], pa.int64()), "vals": pa.array([], pa.list_(pa.list_(pa.float64()))), **{m: pa.array([], pa.list_(pa.int32())) for m in more}})


def star_free_base(values: np.ndarray, coverage: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, known): cell values (channels first) with masked and partly covered cells filled from outside inwards.

    After LOCAL_LAYERS rounds cells brighter than the background by ANCHOR_K deviations no longer spread.
    """
    source = (coverage >= 1) & ~mask
    if not source.any():
        return values, coverage > 0
    limit = np.empty(len(values))
    for i, v in enumerate(values):
        m = upper_median(v[source])
        limit[i] = m + ANCHOR_K * max(upper_median(np.abs(v[source] - m)), LEAST_MAD)
    return fill(values, source, base_reach(coverage), limit)


def fill(values: np.ndarray, source: np.ndarray, reach: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, known): source cells spread over the reach, a layer a round, each new cell taking the mean of its known neighbours. Only a round's layer is looked at, so time follows the cells."""
    pad = lambda a: np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1), (1, 1)])
    shape = pad(source).shape
    base, known, todo = pad(np.where(source, values, 0.0)).reshape(len(values), -1), pad(source).ravel(), pad(reach & ~source).ravel()
    spreads = known.copy()
    steps = np.array([dy * shape[1] + dx for dx, dy in AROUND])
    now = np.flatnonzero(pad(dilate(source) & reach & ~source).ravel())
    for i in range(FILL_ROUNDS):
        if i == LOCAL_LAYERS:
            spreads &= ~(base > limit[:, None]).any(0)
        near = now[:, None] + steps
        own = spreads[near]
        some = own.any(1)
        now, near, own = now[some], near[some], own[some]
        if not len(now):
            break
        base[:, now] = np.where(own, base[:, near], 0.0).sum(-1) / own.sum(1)
        known[now] = spreads[now] = True
        todo[now] = False
        now = np.unique(near)
        now = now[todo[now]]
    inner = lambda a: a.reshape(*a.shape[:-1], *shape)[..., 1:-1, 1:-1]
    return inner(base), inner(known)


PREP_DDL = "panel_id long, x8 long, y8 long, base array<double>, coverage double, d double, vdet double, masked boolean, compact boolean"


def spread_limits(values: DataFrame, masked: DataFrame) -> DataFrame:
    """panel_id, lim: by channel the brightness from which a panel's cells don't spread, from upper medians over cells that do. Panels without such cells have no row."""
    source = values.where("coverage >= 1").join(masked.select("panel_id", "x8", "y8"), ["panel_id", "x8", "y8"], "left_anti").select("panel_id", "ch", "value")
    m = kept(upper_medians(source, "panel_id", "ch"))
    mad = upper_medians(source.join(m, ["panel_id", "ch"]).select("panel_id", "ch", F.abs(F.col("value") - F.col("m")).alias("value")), "panel_id", "ch")
    limit = m.join(mad.withColumnRenamed("m", "mad"), ["panel_id", "ch"]).select("panel_id", "ch", (F.col("m") + ANCHOR_K * F.greatest(F.col("mad"), F.lit(LEAST_MAD))).alias("limit"))
    return limit.groupBy("panel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "limit"))), lambda e: e["limit"]).alias("lim"))


def panel_prep(values: DataFrame, distance: DataFrame, masked: DataFrame, tile: int = 1024) -> DataFrame:
    """Per panel and cell: star-free base (also two cells beyond its coverage), coverage, distance, detail and masks (masked: of mask_table()).

    Tiles of cells come with a halo of as many cells as a filling can cross, so they don't depend on each other.
    """
    c = values.groupBy("panel_id", "x8", "y8").agg(F.array_sort(F.collect_list(F.struct("ch", "value"))).alias("v"), F.max("coverage").alias("coverage"), F.max(F.col("detail") * F.coalesce("gain", F.lit(1.0))).alias("vdet"))
    c = c.join(distance.select("panel_id", "x8", "y8", "d"), ["panel_id", "x8", "y8"]).join(masked.select("panel_id", "x8", "y8", "compact"), ["panel_id", "x8", "y8"], "left")
    c = c.select("panel_id", "x8", "y8", F.transform("v", lambda e: e["value"]).alias("v"), "coverage", "vdet", "d", F.col("compact").isNotNull().alias("masked"), F.coalesce("compact", F.lit(False)).alias("compact"))
    c = c.join(kept(spread_limits(values, masked)), "panel_id", "left")
    halo = FILL_ROUNDS + 4
    over = lambda axis: F.explode(F.sequence(F.floor((F.col(axis) - halo) / tile), F.floor((F.col(axis) + halo) / tile)))
    tiles_ = c.withColumn("ty", over("y8")).withColumn("tx", over("x8"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf["x8"].min() - 2, pdf["y8"].min() - 2
        own = pdf.assign(x8=pdf["x8"] - x0, y8=pdf["y8"] - y0)
        w, h = own["x8"].max() + 3, own["y8"].max() + 3
        cov, vdet, d, mask, compact = (plane_of(own, k, w, h) for k in ("coverage", "vdet", "d", "masked", "compact"))
        vals = np.stack(own["v"].to_numpy()).astype(float)
        planes = np.zeros((vals.shape[1], h, w))
        planes[:, own["y8"], own["x8"]] = vals.T
        limit = pdf["lim"].iloc[0]
        base, known = fill(planes, (cov >= 1) & (mask == 0), base_reach(cov), np.array(limit)) if limit is not None else (planes, cov > 0)
        inside = lambda n, at, k: (np.arange(n) + at >= max(k * tile, 0)) & (np.arange(n) + at < (k + 1) * tile)
        ys, xs = np.nonzero((known | (cov > 0)) & inside(h, y0, int(key[1]))[:, None] & inside(w, x0, int(key[2])))
        out = pd.DataFrame({"panel_id": int(key[0]), "x8": xs + x0, "y8": ys + y0, "base": None, "coverage": cov[ys, xs], "d": d[ys, xs], "vdet": vdet[ys, xs], "masked": mask[ys, xs] > 0, "compact": compact[ys, xs] > 0})
        out["base"] = pd.Series(list(base[:, ys, xs].T), dtype=object)  # also where there are none
        return out

    return tiles_.groupBy("panel_id", "ty", "tx").applyInPandas(run, PREP_DDL)


TILE_DDL = "panel_id long, x8 long, y8 long, base array<double>, d double, vdet double, masked boolean, ramp double, ref double, hard boolean, owner long, bref array<double>, defined boolean"


def tile_prep(prep: DataFrame, owner: DataFrame, feather: float, use_pyramid: bool = True, tile: int = 512) -> DataFrame:
    """prep with seam ramps, hard cells, the reference weight and the pyramid base. Tiles are squares of cells with a halo."""
    levels = levels_for_feather(feather)
    halo = 8 << levels
    tile = max(tile, halo)
    c = prep.join(owner, ["x8", "y8"], "left").withColumn("owner", F.coalesce("owner", F.lit(-1)))
    tiles = lambda axis: F.array_distinct(F.transform(F.array(F.lit(-halo), F.lit(0), F.lit(halo)), lambda k: F.floor(F.greatest(F.col(axis) + k, F.lit(0)) / tile)))
    c = c.withColumn("tile_y", F.explode(tiles("y8"))).withColumn("tile_x", F.explode(tiles("x8")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        step = 1 << levels
        x0, y0 = pdf["x8"].min() // step * step, pdf["y8"].min() // step * step
        own = pdf.assign(x8=pdf["x8"] - x0, y8=pdf["y8"] - y0)
        w, h = own["x8"].max() + 1, own["y8"].max() + 1
        owners = np.full((h, w), -1, np.int64)
        owners[own["y8"], own["x8"]] = own["owner"]
        nch = len(own["base"].iloc[0])
        panels = {int(p): g for p, g in own.groupby("panel_id")}
        flag = lambda g, k: plane_of(g, k, w, h) > 0
        masked = {p: flag(g, "masked") for p, g in panels.items()}
        compact = {p: flag(g, "compact") for p, g in panels.items()}
        ramps, hard = transitions(owners, compact, {p: masked[p] & ~compact[p] for p in panels})
        ref = detail_reference(np.logical_or.reduce(list(masked.values())), feather)
        base = {}
        for p, g in panels.items():
            base[p] = np.zeros((nch, h, w))
            base[p][:, g["y8"], g["x8"]] = np.stack(g["base"].to_numpy()).T
        bref, defined = np.zeros((nch, h, w)), np.zeros((h, w), bool)
        if use_pyramid:
            owning = [p for p in panels if (owners == p).any()]
            valid = {p: flag(panels[p].assign(one=1.0), "one") for p in owning}
            masks = [mask_levels(owners == p, valid[p], levels) for p in owning]
            for ch in range(nch):
                if owning:
                    bref[ch], defined = blend_levels([build(base[p][ch], valid[p], levels) for p in owning], masks)
        out = []
        in_y, in_x = (np.arange(h) + y0) // tile == key[0], (np.arange(w) + x0) // tile == key[1]
        for p, g in panels.items():
            g = g[in_y[g["y8"]] & in_x[g["x8"]]]
            if g.empty:  # it reaches the halo only
                continue
            y, x = g["y8"].to_numpy(), g["x8"].to_numpy()
            ramp = ramps.get(p, np.zeros((h, w)))
            out.append(pd.DataFrame({"panel_id": p, "x8": x + x0, "y8": y + y0, "base": list(base[p][:, y, x].T), "d": g["d"].to_numpy(), "vdet": g["vdet"].to_numpy(), "masked": masked[p][y, x], "ramp": ramp[y, x], "ref": ref[y, x], "hard": hard[y, x], "owner": owners[y, x], "bref": list(bref[:, y, x].T), "defined": defined[y, x]}))
        return pd.concat(out) if out else pd.DataFrame({f.split()[0]: pd.Series(dtype=object) for f in TILE_DDL.split(", ")})

    return c.groupBy("tile_y", "tile_x").applyInPandas(run, TILE_DDL)


def _taps(plane: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Bilinear samples; positions are clamped to the plane."""
    h, w = plane.shape
    gx, gy = np.clip(gx, 0, w - 1), np.clip(gy, 0, h - 1)
    x, y = np.minimum(gx.astype(int), max(w - 2, 0)), np.minimum(gy.astype(int), max(h - 2, 0))
    tx, ty = gx - x, gy - y
    x1, y1 = np.minimum(x + 1, w - 1), np.minimum(y + 1, h - 1)
    return (plane[y, x] * (1 - tx) + plane[y, x1] * tx) * (1 - ty) + (plane[y1, x] * (1 - tx) + plane[y1, x1] * tx) * ty


def two_band(bands: DataFrame, corrections: DataFrame, surfaces: DataFrame | None, width: int, height: int, tiles_: DataFrame, feather: float, veto: bool = True, side: int = 512, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Strips of the mosaic (y, x0, vals): the reference base plus the owner's detail, mixed across seams only.

    tiles_: of tile_prep(). One group is a square of pixels (`side` is a multiple of 8) with the cells that touch it.
    """
    fixed, cells = tiles(with_corrections(bands, corrections, surfaces), side), _near(tiles_, side)

    def run(pix: pa.Table, near: pa.Table) -> pa.Table:
        if not pix.num_rows or not near.num_rows:
            return _no_strips()
        sq, cell = Square(pix, width, height), near.to_pandas()
        x8, y8 = int(cell["x8"].min()), int(cell["y8"].min())
        (hgt, wid), nch, yy, xx = sq.shape, sq.channels, sq.yy, sq.xx
        h8, w8 = int(cell["y8"].max()) - y8 + 1, int(cell["x8"].max()) - x8 + 1
        cell = cell.assign(x8=cell["x8"] - x8, y8=cell["y8"] - y8)
        gx, gy = (xx + 0.5) / 8 - 0.5 - x8, (yy + 0.5) / 8 - 0.5 - y8
        cy, cx = np.clip(yy // 8 - y8, 0, h8 - 1), np.clip(xx // 8 - x8, 0, w8 - 1)

        def plane(g: pd.DataFrame, k: str, fill=0.0) -> np.ndarray:
            return plane_of(g, k, w8, h8, fill)

        def planes(g: pd.DataFrame, k: str) -> np.ndarray:
            out = np.zeros((nch, h8, w8))
            out[:, g["y8"], g["x8"]] = np.stack(g[k].to_numpy()).T
            return out

        shared = cell.drop_duplicates(["x8", "y8"])
        owner = plane(shared, "owner", -1)[cy, cx].astype(int)
        hard = plane(shared, "hard")[cy, cx] > 0
        defined = plane(shared, "defined")[cy, cx] > 0
        pyramid = np.stack([_taps(p, gx, gy) for p in planes(shared, "bref")])
        ref = _taps(plane(shared, "ref"), gx, gy)
        own_cells = {int(p): g for p, g in cell.groupby("panel_id")}
        got = {}
        wsum, base_sum = np.zeros((hgt, wid)), np.zeros((nch, hgt, wid))
        for p, (v, cov) in sq.panels.items():
            if not cov.any():
                continue
            k = own_cells[p]
            d = 8 * _taps(np.minimum(plane(k, "d"), 1e6), xx / 8 - x8, yy / 8 - y8)
            w = np.where(cov, np.maximum(np.clip(d / feather, 0, 1), LEAST_WEIGHT), 0)
            base = np.stack([_taps(b, gx, gy) for b in planes(k, "base")])
            ramp = _taps(plane(k, "ramp"), gx, gy) * np.clip(d / RAMP_PX, 0, 1)
            got[p] = [v, cov, w, base, ramp, plane(k, "vdet")[cy, cx], plane(k, "masked")[cy, cx] > 0]
            wsum += w
            base_sum += w * base
        some = wsum > 0
        bref = np.where(defined, pyramid, np.where(some, base_sum / np.where(some, wsum, 1), 0))
        first = np.full((hgt, wid), -1)
        best = np.zeros((hgt, wid))
        for p, (_, cov, w, *_) in got.items():  # the last of equal weights
            take = cov & (w >= best)
            first[take], best[take] = p, w[take]
        total, weight = np.zeros((nch, hgt, wid)), np.zeros((hgt, wid))
        detail = {}
        for p, (v, cov, w, base, ramp, _, _) in got.items():
            detail[p] = v - (ref * bref + (1 - ref) * base)
            rv = np.where(cov & (ramp > 1e-6), ramp, 0)
            total += rv * detail[p]
            weight += rv
        owner_covers = np.zeros((hgt, wid), bool)
        for p, (_, cov, *_) in got.items():
            owner_covers |= (owner == p) & cov
        chosen = np.where(owner_covers, owner, first)
        only = np.zeros((nch, hgt, wid))
        for p in got:
            only = np.where(chosen == p, detail[p], only)
        fallback = np.zeros((nch, hgt, wid))
        for p in got:
            fallback = np.where(first == p, detail[p], fallback)
        det = np.where(hard, only, np.where(weight > 0, total / np.where(weight > 0, weight, 1), fallback))
        if veto and len(got) > 1:
            other, best = np.full((hgt, wid), -1), np.zeros((hgt, wid))
            for p, (_, cov, w, *_) in got.items():
                take = cov & (owner != p) & (w >= best)
                other[take], best[take] = p, w[take]
            for p, (_, cov, _, _, _, vdet, masked) in got.items():
                for q in got:
                    at = (owner == p) & cov & (other == q) & ~masked & ~got[q][6]
                    if p != q and at.any():
                        limit = VETO * np.minimum(vdet, got[q][5])
                        swap = at & (np.abs(detail[p] - detail[q]) > limit)
                        det = np.where(swap, np.where(np.abs(detail[q]) < np.abs(detail[p]), detail[q], detail[p]), det)
        return sq.rows(bref + det, some, box)

    return fixed.groupBy("sy", "sx").cogroup(cells.groupBy("sy", "sx")).applyInArrow(run, MOSAIC_DDL)
