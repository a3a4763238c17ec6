"""Per-panel scans: statistics, coverage and the table of 8 x 8 cells that every later step reads.

Pixels come as bands: panel_id, y, x0, vals (for each channel the samples of a piece of a row from x0 on). A pixel is covered if all its
channels are not 0 (NaN counts as covered). scan() sums bands over cells inside the tasks that read them, so what is shuffled is
at most a row for each cell and channel of a task; statistics and cells both come from its table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

BLOCK = 8
#: Samples that numpy works on at a time.
SAMPLES = 1 << 21


def bands_of_pixels(px: DataFrame, span: int = 4096) -> DataFrame:
    """Bands of a table of samples (panel_id, ch, x, y, v); samples that a band lacks are 0."""
    first, last = F.min("x"), F.max("x")
    whole = isinstance(px.schema["v"].dataType, IntegralType)
    rows = px.groupBy("panel_id", "y", F.expr(f"x div {span}").alias("at")).agg(first.alias("x0"), last.alias("x1"), F.max("ch").alias("top"), F.map_from_entries(F.collect_list(F.struct(F.struct("ch", "x"), F.col("v").cast("long" if whole else "double").alias("v")))).alias("m"))
    vals = "transform(sequence(0L, cast(top as bigint)), c -> transform(sequence(x0, x1), i -> coalesce(m[struct(c as ch, i as x)], {})))".format("0L" if whole else "0D")
    return rows.select("panel_id", F.col("y").cast("long").alias("y"), F.col("x0").cast("long").alias("x0"), F.expr(vals).alias("vals"))


def pixels(bands: DataFrame) -> DataFrame:
    """Bands as samples: panel_id, ch, x, y, v."""
    rows = bands.select("panel_id", "y", "x0", F.posexplode("vals").alias("ch", "row"))
    return rows.select("panel_id", F.col("ch").cast("long").alias("ch"), "y", "x0", F.posexplode("row").alias("i", "v")).select("panel_id", "ch", (F.col("x0") + F.col("i")).alias("x"), "y", "v")


def band_arrays(x0: pa.Array, vals: pa.Array) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, x0, samples: rows x channels x pixels) for each run of bands of one place and shape, SAMPLES at a time."""
    at = x0.to_numpy(zero_copy_only=False)
    outer = vals.offsets.to_numpy()
    inner = vals.values.offsets.to_numpy()
    flat = vals.values.values.to_numpy(zero_copy_only=False)
    start = inner[outer[:-1]]
    channels = np.diff(outer)
    size = inner[outer[1:]] - start
    for place, n, c in sorted(set(zip(at.tolist(), size.tolist(), channels.tolist()))):
        if not n:
            continue
        rows = np.flatnonzero((at == place) & (size == n) & (channels == c))
        for lo in range(0, len(rows), step := max(1, SAMPLES // n)):
            part = rows[lo : lo + step]
            yield part, place, flat[start[part][:, None] + np.arange(n)].reshape(len(part), c, n // c)


def _cell_sums(panel: np.ndarray, y: np.ndarray, x0: int, v: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of bands of one place over cells, as columns in the order of SCAN."""
    whole = v.dtype.kind == "i"
    v = v.astype(np.int64 if whole else np.float64)
    low, high = (np.iinfo(np.int64).max, np.iinfo(np.int64).min) if whole else (np.inf, -np.inf)
    x = x0 + np.arange(v.shape[2])
    cut = np.concatenate([[0], np.flatnonzero(np.diff(x // BLOCK)) + 1])
    order = np.lexsort((y, panel))
    panel, y, v = panel[order], y[order], v[order]
    run = np.concatenate([[0], np.flatnonzero((np.diff(panel) != 0) | (np.diff(y // BLOCK) != 0)) + 1])
    some = v != 0
    covered = some.all(1)
    odd = np.zeros(v.shape, bool) if whole else ~np.isfinite(v)

    def over(f: np.ufunc, a: np.ndarray) -> np.ndarray:  # rows x channels x pixels, to runs x channels x cells
        return f.reduceat(f.reduceat(a, cut, -1), run, 0)

    both = covered[:, None]
    n = over(np.add, both.astype(np.int64))
    least = np.minimum if whole else np.fmin  # as in Spark: NaN is larger than all
    out = {
        "n": n, "s": over(np.add, np.where(both, v, 0)), "ss": over(np.add, np.where(both, v, 0).astype(float) ** 2), "lo": over(least, np.where(both, v, low)), "hi": over(np.maximum, np.where(both, v, high)),
        "x0": over(np.minimum, np.where(both, x, np.iinfo(np.int64).max)), "y0": over(np.minimum, np.where(both, y[:, None, None], np.iinfo(np.int64).max)), "x1": over(np.maximum, np.where(both, x + 1, -1)), "y1": over(np.maximum, np.where(both, y[:, None, None] + 1, -1)),
        "n_all": over(np.add, np.ones(both.shape, np.int64)), "n_some": over(np.add, some.astype(np.int64)), "s_some": over(np.add, v), "lo_some": over(least, np.where(some, v, low)), "hi_some": over(np.maximum, np.where(some, v, high)), "n_odd": over(np.add, odd.astype(np.int64)),
    }
    shape = (len(run), v.shape[1], len(cut))
    names = {"panel_id": panel[run][:, None, None], "ch": np.arange(v.shape[1])[None, :, None], "x8": (x[cut] // BLOCK)[None, None, :], "y8": (y[run] // BLOCK)[:, None, None]}
    flat = {k: np.broadcast_to(a, shape).ravel() for k, a in (names | out).items()}
    gone = {"n": ("lo", "hi", "x0", "y0", "x1", "y1"), "n_some": ("lo_some", "hi_some")}
    return {k: (a, next((flat[c] == 0 for c, own in gone.items() if k in own), None)) for k, a in flat.items()}


def _scan_ddl(kind: str) -> str:
    return f"panel_id long, ch long, x8 long, y8 long, n long, s {kind}, ss double, lo {kind}, hi {kind}, x0 long, y0 long, x1 long, y1 long, n_all long, n_some long, s_some {kind}, lo_some {kind}, hi_some {kind}, n_odd long"


def partial_scan(bands: DataFrame) -> DataFrame:
    """Cell sums of each task's bands; merged() adds them up. Samples are whole numbers or floating-point ones."""
    kind = "long" if isinstance(bands.schema["vals"].dataType.elementType.elementType, IntegralType) else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            panel, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, x0, v in band_arrays(batch.column(2), batch.column(3)):
                cols = _cell_sums(panel[rows], y[rows], x0, v)
                yield pa.RecordBatch.from_arrays([pa.array(a, mask=gone) for a, gone in cols.values()], names=list(cols))

    known = bands.where("panel_id is not null and y is not null and x0 is not null and vals is not null")
    return known.select(*(F.col(c).cast("long").alias(c) for c in ("panel_id", "y", "x0")), "vals").mapInArrow(run, _scan_ddl(kind))


def merged(parts: DataFrame) -> DataFrame:
    """One row for each panel, channel and cell, from any number of partial ones."""
    add, low, high = ("n", "s", "ss", "n_all", "n_some", "s_some", "n_odd"), ("lo", "x0", "y0", "lo_some"), ("hi", "x1", "y1", "hi_some")
    f = {c: F.sum(c) for c in add} | {c: F.min(c) for c in low} | {c: F.max(c) for c in high}
    return parts.groupBy("panel_id", "ch", "x8", "y8").agg(*(f[c].alias(c) for c in parts.columns[4:]))


def scan(bands: DataFrame) -> DataFrame:
    """By panel, channel and cell. Over covered pixels: n, s, ss (sums of values and squares), lo, hi, and the box x0, y0, x1, y1 (exclusive); over all: n_all, over samples that are not 0: n_some, s_some, lo_some, hi_some; n_odd: samples that are not finite."""
    return merged(partial_scan(bands))


def scan_stats(scanned: DataFrame) -> DataFrame:
    """Per panel and channel, over samples that are not 0: their number, least, largest and mean."""
    return scanned.groupBy("panel_id", "ch").agg(F.sum("n_all").alias("n"), F.sum("n_some").alias("n_nonzero"), F.min("lo_some").alias("v_min"), F.max("hi_some").alias("v_max"), F.round(F.try_divide(F.sum("s_some"), F.sum("n_some")), 3).alias("v_mean"))


def odd_samples(scanned: DataFrame) -> DataFrame:
    """panel_id, ch, n_odd: samples that are not finite."""
    return scanned.groupBy("panel_id", "ch").agg(F.sum("n_odd").alias("n_odd"))


def cells(scanned: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Cells of scan() that hold covered pixels: panel_id, ch, x8, y8, n, area, coverage, s, ss, mean, detail.

    n: covered pixels; area: pixels of the cell inside the canvas; s, ss: sums of values and squares;
    detail: population deviation.
    """
    side = lambda axis, size: F.least(F.lit(BLOCK), size - F.col(axis) * BLOCK)
    width, height = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    area = (side("x8", width) * side("y8", height)).cast("long")
    mean = F.col("s") / F.col("n")
    return scanned.where("n > 0").select("panel_id", "ch", "x8", "y8", "n", area.alias("area"), (F.col("n") / area).alias("coverage"), "s", "ss", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("detail"))


def panel_stats(scanned: DataFrame) -> DataFrame:
    """Per panel and channel over covered pixels: bounding box (exclusive), number, and least, largest and mean."""
    return scanned.where("n > 0").groupBy("panel_id", "ch").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("n").alias("n_covered"), F.min("lo").alias("ch_min"), F.max("hi").alias("ch_max"), F.round(F.sum("s") / F.sum("n"), 3).alias("ch_mean")
    )


def full_cells(cells_: DataFrame) -> DataFrame:
    """Fully covered cells: compares whole numbers."""
    return cells_.where("n = area")


def union_bbox(stats: DataFrame, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Output box: union of the panels' boxes, cut to the region of interest (exclusive box); no row if that is empty."""
    box = stats.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    if roi:
        box = box.select(F.greatest("x0", F.lit(roi[0])).alias("x0"), F.greatest("y0", F.lit(roi[1])).alias("y0"), F.least("x1", F.lit(roi[2])).alias("x1"), F.least("y1", F.lit(roi[3])).alias("y1"))
    return box.where("x0 < x1 and y0 < y1")


def active_panels(stats: DataFrame, band_rows: int) -> DataFrame:
    """band, panels: which panels' boxes meet each band of output rows."""
    boxes = stats.select("panel_id", "y0", "y1").distinct()
    b = boxes.select("panel_id", F.explode(F.expr(f"sequence(y0 div {band_rows}, (y1 - 1) div {band_rows})")).alias("band"))
    return b.groupBy("band").agg(F.count("*").alias("n_panels"), F.min("panel_id").alias("first_panel"), F.max("panel_id").alias("last_panel"))


def tiles(bands: DataFrame, side: int) -> DataFrame:
    """Bands with the square of pixels that they lie in (sx, sy); those that cross a square's border are cut there."""
    last = F.col("x0") + F.size(F.get("vals", F.lit(0))) - 1
    cut = bands.withColumn("sx", F.explode(F.sequence(F.expr(f"x0 div {side}"), (last / side).cast("long")))).withColumn("from", F.greatest("x0", F.col("sx") * side))
    n = F.least(last + 1, (F.col("sx") + 1) * side) - F.col("from")
    piece = F.transform("vals", lambda r: F.slice(r, (F.col("from") - F.col("x0") + 1).cast("int"), n.cast("int")))
    return cut.withColumn("vals", piece).withColumn("x0", F.col("from")).withColumn("sy", F.expr(f"y div {side}")).drop("from")


def covering_counts(bands: DataFrame, side: int = 512) -> DataFrame:
    """How many canvas pixels are covered by how many panels; counted in squares of pixels."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        panel, y = (t[c].to_numpy() for c in ("panel_id", "y"))
        x0, vals = (t[c].chunk(0) for c in ("x0", "vals"))
        top, left = int(y.min()), min(x0.to_pylist())
        count = np.zeros((int(y.max()) - top + 1, side), np.int64)
        planes = {int(p): np.zeros(count.shape, bool) for p in np.unique(panel)}
        for rows, at, v in band_arrays(x0, vals):
            for p, line, cov in zip(panel[rows].tolist(), (y[rows] - top).tolist(), (v != 0).all(1)):
                planes[p][line, at - left : at - left + len(cov)] |= cov
        for plane in planes.values():
            count += plane
        n, k = np.unique(count[count > 0], return_counts=True)
        return pa.table({"n_panels": n, "n_pixels": k})

    parts = tiles(bands, side).groupBy("sx", "sy").applyInArrow(run, "n_panels long, n_pixels long")
    return parts.groupBy("n_panels").agg(F.sum("n_pixels").alias("n_pixels"))


@F.pandas_udf(LongType())
def _order(value: pd.Series) -> pd.Series:
    """Numbers in the order of the values (doubles): their bits, those of negative ones turned around."""
    bits = value.to_numpy(float).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))


def by_channel(values: dict, key: str = "ch") -> Column:
    """A channel's (or other key's) value as a column."""
    return F.coalesce(*(F.when(F.col(key).eqNullSafe(F.lit(c)), F.lit(v)) for c, v in values.items()))


def values_of_rank(counts: DataFrame, rank: str = "sum(n) div 2 + 1") -> dict[object, float]:
    """Each channel's value of a rank (by default the upper median's), from distinct values and how often each occurs (ch, value, n).

    Exact for any number of values: they are narrowed down by 16 bits of their order at a time, through 65536 sums a channel at most. The driver gets one sum a channel.
    """
    left = counts.select("ch", "value", "n", _order(F.col("value").cast("double")).alias("order"))
    ranks = {r.ch: r.rank for r in left.groupBy("ch").agg(F.expr(rank).alias("rank")).collect()}
    if not ranks:
        return {}
    for shift in (48, 32, 16, 0):
        part = F.shiftright("order", shift)
        sums = left.groupBy("ch", part.alias("part")).agg(F.sum("n").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("ch").orderBy("part"))).withColumn("rank", by_channel(ranks) - F.col("upto") + F.col("n"))
        found = sums.where((F.col("rank") > 0) & (F.col("rank") <= F.col("n"))).collect()
        left = left.where(part == by_channel({r.ch: r.part for r in found}))
        ranks = {r.ch: r.rank for r in found}
    return {r.ch: r.value for r in left.collect()}


def upper_medians(values: DataFrame, *keys: str) -> DataFrame:
    """The keys and m: the upper median of `value` for each of any number of keys (panels). Values are counted, then sorted within their key; nothing is collected."""
    counts = values.groupBy(*keys, "value").agg(F.count("*").alias("times"))
    own = Window.partitionBy(*keys)
    upto = F.sum("times").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto).withColumn("half", F.floor(F.sum("times").over(own) / 2))
    return ranked.where("upto > half and upto - times <= half").select(*keys, F.col("value").alias("m"))


def exact_medians(counts: DataFrame) -> dict[object, float]:
    """Each channel's median (the mean of the two middle values), from (ch, value, n)."""
    low, high = values_of_rank(counts, "(sum(n) + 1) div 2"), values_of_rank(counts)
    return {c: (low[c] + high[c]) / 2 for c in high}
