"""Sessions: the tables of an analysed mosaic in one folder, so that blending never analyses again, and what is written from them.

Pixels are bands (panel_id, y, x0, vals). One scan of them gives statistics and cells. Reprojected panels are stored in tiles, in the order of
the tiles along a Morton curve, so that a region of interest reads few row groups; files are pruned by their data source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import astrometry, solution
from ..functions.scalar import sanitize
from ..operators import align, blend, diag, masks, overlap, photometry, seam, summary, surfaces
from ..sinks import files as sinks
from ..sources import panels, xisf

VERSION = 1
TABLES = ("canvas", "panels", "cells", "edges", "fits", "corrections", "surfaces", "distance", "masks")
#: Tables of a session for people to read, beside the one-row `summary.json`.
REPORTS = ("report_panels", "report_fits", "report_seams", "report_components", "report_samples")
#: Side of a stored tile in pixels.
STORED = 512


@dataclass(frozen=True)
class Options:
    """surface: None or 0-2; gain: fit or unity; feather in pixels; mode: pyramid, twoband or feather; flatten: None, 1 or 2."""

    surface: int | None = 2
    gain: str = "fit"
    feather: float = 256.0
    mode: str = "pyramid"
    veto: bool = True
    flatten: int | None = None
    roi: tuple[int, int, int, int] | None = None
    downsample: int = 1

    def __post_init__(self):
        if self.surface not in (None, 0, 1, 2) or self.gain not in ("fit", "unity") or self.mode not in ("pyramid", "twoband", "feather"):
            raise ValueError("surface is None or 0-2, gain fit or unity, mode pyramid, twoband or feather")
        if not 0 < self.feather < float("inf") or self.downsample not in (1, 8) or self.flatten not in (None, 1, 2):
            raise ValueError("feather is positive, downsample 1 or 8, flatten None, 1 or 2")
        if self.roi and (self.roi[0] >= self.roi[2] or self.roi[1] >= self.roi[3]):
            raise ValueError("roi is x0, y0, x1, y1 with exclusive upper bounds")


def write(df: DataFrame, path: str, name: str) -> DataFrame:
    """The table `name` of a session, read back."""
    df.withColumn("schema_version", F.lit(VERSION)).write.mode("overwrite").parquet(f"{path}/{name}")
    return load(df.sparkSession, path, name)


def write_tiles(bands: DataFrame, path: str, name: str, side: int = STORED) -> DataFrame:
    """Bands, cut into tiles and stored in the order of a Morton curve: a file holds neighbouring tiles, and its row groups' least and largest y and x0 let a region's plan skip them."""
    cut = summary.tiles(bands, side)
    bits = lambda c: [F.shiftright(F.col(c), i).bitwiseAND(F.lit(1)) for i in range(20)]
    key = sum((F.shiftleft(x, 2 * i) + F.shiftleft(y, 2 * i + 1) for i, (x, y) in enumerate(zip(bits("sx"), bits("sy")))), F.lit(0).cast("long"))
    ordered = cut.withColumn("tile", key).repartitionByRange("tile", "panel_id", "y").sortWithinPartitions("tile", "panel_id", "y").drop("tile", "sx", "sy")
    ordered.withColumn("schema_version", F.lit(VERSION)).write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/{name}")
    return load(bands.sparkSession, path, name)


def panel_files(spark: SparkSession, paths: list[str] | str) -> list:
    """A row a file with panel_id (the order of paths), geometry, keywords and properties."""
    rows = sorted(xisf.scan_headers(spark, paths).collect(), key=lambda r: r.path)
    if not rows:
        raise ValueError("no input panels")
    return list(enumerate(rows))


def models_of(files: list) -> dict[int, tuple]:
    """Each panel's (solution, width, height); ValueError that names all files without a sound one."""
    models, wrong = {}, []
    for p, r in files:
        try:
            found = solution.from_properties([x.asDict() for x in r.properties], r.width, r.height)
            if found is None:
                wrong.append(f"{r.path}: no solution")
            else:
                models[p] = (found, r.width, r.height)
        except ValueError as e:
            wrong.append(f"{r.path}: {e}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return models


def probe(spark: SparkSession, paths: list[str] | str, kind: str = "auto") -> tuple[list, astrometry.Frame | None]:
    """Geometries of the panels, and the frame they would be brought to: None for aligned ones, and with `auto` where any has no sound solution."""
    files = panel_files(spark, paths)
    shapes = [(r.width, r.height, r.channels) for _, r in files]
    if kind == "aligned":
        return shapes, None
    try:
        return shapes, astrometry.choose_frame([(m.wcs, w, h) for m, w, h in models_of(files).values()])
    except ValueError:
        if kind == "solved":
            raise
        return shapes, None


def analyze_files(spark: SparkSession, paths: list[str] | str, path: str, options: Options = Options(), kind: str = "auto") -> DataFrame:
    """Panel files to a session's tables; gives the bands that blend_session() takes.

    aligned: all on one grid; solved: brought to a common frame by their solutions, which must be sound for every file. auto: aligned if
    all have one geometry and none covers most of it. Reprojected panels are the session's table `aligned`, the frame is `frame`.
    """
    if kind not in ("auto", "aligned", "solved"):
        raise ValueError("kind is auto, aligned or solved")
    files = panel_files(spark, paths)
    shapes = [(r.width, r.height, r.channels) for _, r in files]
    bands = panels.read_panels(spark, paths)
    scanned = write(summary.scan(bands), path, "scan") if kind != "solved" else None
    if kind == "auto":
        kind = solution.classify(summary.panel_stats(scanned).select("panel_id", "n_covered").distinct(), shapes)
    if kind == "aligned":
        if len(set(shapes)) > 1:
            raise ValueError("aligned panels of different geometries")
        width, height, _ = shapes[0]
    else:
        if len({s[2] for s in shapes}) > 1:
            raise ValueError("panels of different numbers of channels")
        models = models_of(files)
        frame = astrometry.choose_frame([(m.wcs, w, h) for m, w, h in models.values()])
        width, height = frame.width, frame.height
        write(spark.createDataFrame([(*frame.crval, frame.scale, width, height, frame.rotation)], "ra double, dec double, scale double, width long, height long, rotation double"), path, "frame")
        bands = write_tiles(align.reproject(bands, models, frame), path, "aligned")
        scanned = None
    keep_metadata(spark, files[0][1], path, kind == "solved")
    analyze(bands, width, height, path, options, scanned)
    return bands


def keep_metadata(spark: SparkSession, first: object, path: str, solved: bool) -> None:
    """Keywords and solution of the first file, from which the output's header is made (of solved input the frame has the solution)."""
    rows = [(i, k.name or "", k.value or "", k.comment or "") for i, k in enumerate(first.keywords)]
    write(spark.createDataFrame(rows, "ord int, name string, value string, comment string"), path, "keywords")
    try:
        found = None if solved else solution.from_properties([x.asDict() for x in first.properties], first.width, first.height)
    except ValueError:  # an unsound solution is none
        found = None
    w = found.wcs if found else None
    rows = [(*w.crval, *w.crpix, *w.cd[0], *w.cd[1], w.code, w.radesys)] if w else []
    write(spark.createDataFrame(rows, "ra double, dec double, x double, y double, cd11 double, cd12 double, cd21 double, cd22 double, code string, radesys string"), path, "solution")


def analyze(bands: DataFrame, width: int, height: int, path: str, options: Options = Options(), scanned: DataFrame | None = None) -> None:
    """Bands to the session's tables and reports. scanned: their scan(), if it is there already."""
    spark = bands.sparkSession
    keep = lambda name, df: write(df, path, name)
    keep("canvas", spark.createDataFrame([(width, height)], "width long, height long"))
    scanned = keep("scan", summary.scan(bands)) if scanned is None else scanned
    keep("panels", summary.panel_stats(scanned))
    keep("report_samples", summary.odd_samples(scanned))
    cells = keep("cells", summary.cells(scanned, width, height))
    edges = keep("edges", overlap.overlap_edges(cells))
    fits = keep("fits", photometry.fit_edges(photometry.edge_pairs(cells, edges)))
    corrections = keep("corrections", photometry.solve(cells, edges, fits, options.gain == "unity"))
    values = photometry.corrected(cells, corrections)
    if options.surface is None:
        surf = keep("surfaces", corrections.select("panel_id", "ch", F.expr("cast(array() as array<double>)").alias("coef")))
    else:
        surf = keep("surfaces", surfaces.fit_surfaces(values, edges, width, height, options.surface))
    distance = keep("distance", overlap.distance_map(cells, -(-width // 8), -(-height // 8)))
    masked = keep("masks", masks.mask_table(cells))
    values = photometry.corrected(cells, corrections, surf, width, height)
    owner = keep("owner", seam.owner_map(values, edges, distance, masked, options.feather))
    deltas = keep("report_seams", seam.edge_flags(seam.seam_deltas(seam.boundary_cells(owner), values)))
    keep("report_panels", diag.panel_report(cells, corrections).join(surf.drop("coef"), ["panel_id", "ch"], "left"))
    keep("report_fits", diag.fit_flags(fits).drop("stats"))
    keep("report_components", overlap.component_table(cells, edges))
    box = output_box(load(spark, path, "panels"), None)
    w8, h8 = -(-box[2] // 8) - box[0] // 8, -(-box[3] // 8) - box[1] // 8
    one = diag.mosaic_summary(cells, edges, owner, deltas, w8, h8)
    one = one.withColumns({"width": F.lit(box[2] - box[0]), "height": F.lit(box[3] - box[1]), "megapixels": F.lit((box[2] - box[0]) * (box[3] - box[1]) / 1e6)})
    one.coalesce(1).write.mode("overwrite").json(f"{path}/summary.json")


def output_box(panels: DataFrame, roi: tuple[int, int, int, int] | None) -> tuple[int, int, int, int]:
    """Box of the output; ValueError if no panel has content, or none in the region of interest."""
    box = summary.union_bbox(panels, roi).first()
    if box is None:
        raise ValueError("the region of interest meets no panel" if roi else "no panel has content")
    return box.x0, box.y0, box.x1, box.y1


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    found = df.select("schema_version").first()
    if found and found[0] != VERSION:
        raise ValueError(f"{name} has version {found[0]}; analyze again")
    return df.drop("schema_version")


def blend_session(bands: DataFrame, path: str, options: Options = Options()) -> DataFrame:
    """x, y, ch, value of the mosaic (cells x8, y8 with downsample 8), from a session's tables and its bands. Values are clamped to [0, 1], those that are not finite are 0."""
    if options.downsample == 1:
        return blend.mosaic_pixels(mosaic_strips(bands, path, options))
    t, surf, values, box = _prepared(bands, path, options)
    x0, y0, x1, y1 = box
    values = values.where(f"x8 >= {x0 // 8} and x8 < {-(-x1 // 8)} and y8 >= {y0 // 8} and y8 < {-(-y1 // 8)}")
    return blend.preview(values, t["distance"], options.feather).withColumn("value", sanitize(F.col("value")))


def _prepared(bands: DataFrame, path: str, options: Options) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, tuple[int, int, int, int]]:
    """A session's tables, surfaces (with the flattening folded in), corrected cells and the output's box."""
    t = {n: load(bands.sparkSession, path, n) for n in TABLES}
    width, height = t["canvas"].first()
    surf = t["surfaces"]
    values = photometry.corrected(t["cells"], t["corrections"], surf, width, height)
    if options.flatten:
        fit = surfaces.fit_flatten(surfaces.merged_background(values, t["distance"], t["masks"]), width, height, options.flatten)
        surf = surfaces.fold_flatten(surf, fit)
        values = photometry.corrected(t["cells"], t["corrections"], surf, width, height)
    return t, surf, values, output_box(t["panels"], options.roi)


def mosaic_strips(bands: DataFrame, path: str, options: Options = Options()) -> DataFrame:
    """The full-resolution mosaic in strips (y, x0, vals, clamped to [0, 1], null where nothing is covered), cut to the output's box.

    A region reads the bands of the panels that meet it, and of those only what meets it, as far as their source prunes.
    """
    t, surf, values, box = _prepared(bands, path, options)
    width, height = t["canvas"].first()
    if options.roi:
        meet = t["panels"].where(f"x0 < {box[2]} and x1 > {box[0]} and y0 < {box[3]} and y1 > {box[1]}").select("panel_id").distinct()
        bands = panels.in_box(bands, box, sorted(r.panel_id for r in meet.collect()))  # a number a panel
    if options.mode == "feather":
        out = blend.feather(bands, t["corrections"], surf, width, height, t["distance"], options.feather, box=box)
    else:
        owner = seam.owner_map(values, t["edges"], t["distance"], t["masks"], options.feather)
        tiles = blend.tile_prep(blend.panel_prep(values, t["distance"], t["masks"]), owner, options.feather, options.mode == "pyramid")
        out = blend.two_band(bands, t["corrections"], surf, width, height, tiles, options.feather, options.veto, box=box)
    clean = F.transform("vals", lambda r: F.transform(r, lambda v: F.when(v.isNotNull(), sanitize(v))))
    return out.select("y", "x0", clean.alias("vals"))


def header_cards(spark: SparkSession, path: str, options: Options, flipped: bool = False) -> list[tuple[str, object, str]]:
    """The output's keywords: the first panel's, moved with the crop, without those of its own geometry if it was reprojected, and cards of the mosaic's solution (also with rows counted from below) at full resolution."""
    x0, y0, x1, y1 = output_box(load(spark, path, "panels"), options.roi)
    crop = x0 // options.downsample, y0 // options.downsample
    kept = [(r.name, sinks.text_value(r.value), r.comment) for r in load(spark, path, "keywords").orderBy("ord").collect()]
    frame = load(spark, path, "frame").first() if exists(spark, f"{path}/frame") else None
    found = load(spark, path, "solution").first()
    if frame:
        kept = [k for k in kept if not sinks.geometry_card(k[0])]
        wcs = astrometry.Frame((frame.ra, frame.dec), frame.scale, frame.width, frame.height, frame.rotation).wcs()
    elif found:
        wcs = astrometry.LinearWcs((found.ra, found.dec), (found.x, found.y), ((found.cd11, found.cd12), (found.cd21, found.cd22)), code=found.code, radesys=found.radesys)
    else:
        wcs = None
    out = sinks.pass_on(kept, crop)
    if wcs is not None and options.downsample == 1:
        own = astrometry.cards(wcs, (x0, y0), y1 - y0 if flipped else None)
        names = {k for k, _ in own}
        out = [k for k in out if k[0].strip().upper() not in names] + [(k, v, "") for k, v in own]
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_session(bands: DataFrame, path: str, fits: str | None = None, png: str | None = None, options: Options = Options(), flipped: bool = False) -> None:
    """A session's mosaic as FITS and as a stretched picture, made once for both."""
    spark = bands.sparkSession
    boxes = load(spark, path, "panels")
    box = output_box(boxes, options.roi)
    d = options.downsample
    if d == 8:
        cells = blend_session(bands, path, options)
        box = box[0] // 8, box[1] // 8, -(-box[2] // 8), -(-box[3] // 8)
        mosaic = summary.bands_of_pixels(cells.select(F.lit(0).cast("long").alias("panel_id"), "ch", F.col("x8").alias("x"), F.col("y8").alias("y"), F.col("value").alias("v"))).drop("panel_id")
    else:
        mosaic = mosaic_strips(bands, path, options)
    channels = boxes.agg(F.max("ch")).first()[0] + 1
    # rows between panels that no strip has; a number a row of the mosaic at most
    reach = boxes.select((F.col("y0") / d).cast("long").alias("lo"), F.ceil(F.col("y1") / d).alias("hi")).distinct()
    rows = spark.range(box[1], box[3]).select(F.col("id").alias("y"))
    blank = rows if d > 1 else rows.join(F.broadcast(reach), (F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi")), "left_anti")
    mosaic = mosaic.unionByName(blank.select("y", F.lit(box[0]).cast("long").alias("x0"), F.expr(f"array_repeat(cast(array() as array<double>), {channels})").alias("vals")))
    size = box[2] - box[0], box[3] - box[1], channels
    out: list = []
    if fits:
        out.append(sinks.Fits(fits, *size, header_cards(spark, path, options, flipped), box[:2]))
    if png:
        out.append(sinks.Png(png, *size, origin=box[:2]))
    sinks.write(mosaic, *out)
