"""Registered queries on the derived rasters, and the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import blend, masks, overlap, photometry, seam, summary, surfaces
from . import rasters
from .rasters import SCALE, WIDTH

FEATHER = 32.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


class Raster:
    """The derived raster and what is made of it, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.bands = rasters.bands(spark, sf_dir)
        top = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0]
        self.height = 0 if top is None else top + 1
        self._made: dict = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def scan(self) -> DataFrame:
        """Read by several steps of most plans; kept in memory, spilled to disk where that is short."""
        return self._once("scan", lambda: summary.scan(self.bands).persist())

    @property
    def cells(self) -> DataFrame:
        return self._once("cells", lambda: summary.cells(self.scan, WIDTH, self.height))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: overlap.overlap_edges(self.cells))

    @property
    def distance(self) -> DataFrame:
        return self._once("distance", lambda: overlap.distance_map(self.cells, -(-WIDTH // 8), -(-self.height // 8)).persist())

    @property
    def masked(self) -> DataFrame:
        return self._once("masked", lambda: masks.mask_table(self.cells).persist())

    @property
    def corrections(self) -> DataFrame:
        """The inverse of the panels' known gains and offsets."""
        w = rasters.windows(self.spark, self.dir).select("panel_id", F.explode(F.expr(f"sequence(0L, {rasters.CHANNELS - 1}L)")).alias("ch"))
        return w.select("panel_id", "ch", F.expr(f"1 / {rasters.gain_sql()}").alias("gain"), F.expr(f"-{rasters.offset_sql()} * {SCALE} / {rasters.gain_sql()}").alias("offset"))

    @property
    def values(self) -> DataFrame:
        return self._once("values", lambda: photometry.corrected(self.cells, self.corrections))

    @property
    def owner(self) -> DataFrame:
        return seam.voronoi_owner(self.distance, FEATHER).select("x8", "y8", "owner")

    @property
    def solved(self) -> DataFrame:
        """Cells corrected by the fitted photometry."""
        fits = photometry.fit_edges(photometry.edge_pairs(self.cells, self.edges))
        return photometry.corrected(self.cells, photometry.solve(self.cells, self.edges, fits))


GAIN, OFFSET = "(1.0::DOUBLE + ((panel_id * 7) % 5 - 2) * 0.05::DOUBLE)", "(((panel_id * 3) % 7 - 3) * 0.002::DOUBLE)"
WITH = "WITH " + rasters.PX_SQL
CELLS = WITH + f""",
cov AS (SELECT panel_id, x, y FROM px GROUP BY ALL HAVING count(*) FILTER (v = 0) = 0),
cpx AS (SELECT px.* FROM px SEMI JOIN cov USING (panel_id, x, y)),
top AS (SELECT max(vec_id) + 1 AS h FROM embeddings),
cells AS (SELECT panel_id, ch, x // 8 AS x8, y // 8 AS y8, count(*) AS n, any_value(least(8, {WIDTH} - (x // 8) * 8) * least(8, h - (y // 8) * 8)) AS area,
  sum(v)::DOUBLE AS s, sum(v * v)::DOUBLE AS ss, sum(v)::DOUBLE / count(*) AS mean FROM cpx, top GROUP BY panel_id, ch, x // 8, y // 8),
fullc AS (SELECT *, (mean - {OFFSET} * {SCALE}) / {GAIN} AS value FROM cells WHERE n = area)"""
PAIRS = CELLS + """,
pairs AS (SELECT a.panel_id AS a, b.panel_id AS b, a.ch, a.x8, a.y8, a.mean AS ma, b.mean AS mb, a.value AS va, b.value AS vb FROM fullc a JOIN fullc b ON a.ch = b.ch AND a.x8 = b.x8 AND a.y8 = b.y8 AND a.panel_id < b.panel_id),
edges AS (SELECT a, b, min(x8) AS x0, min(y8) AS y0, max(x8) + 1 AS x1, max(y8) + 1 AS y1, count(*) AS n_cells FROM pairs WHERE ch = 0 GROUP BY a, b HAVING count(*) >= 16)"""
DIST = PAIRS + f""",
c0 AS (SELECT * FROM cells WHERE ch = 0),
ring AS (SELECT DISTINCT panel_id, x8 + dx AS x8, y8 + dy AS y8 FROM c0, (VALUES (-1), (0), (1)) d(dx), (VALUES (-1), (0), (1)) e(dy)),
open AS (SELECT r.* FROM ring r, top WHERE r.x8 >= 0 AND r.x8 < {-(-WIDTH // 8)} AND r.y8 >= 0 AND r.y8 < (h + 7) // 8 AND NOT EXISTS (SELECT 1 FROM c0 c WHERE c.panel_id = r.panel_id AND c.x8 = r.x8 AND c.y8 = r.y8 AND c.n = c.area)),
dist AS (SELECT c.panel_id, c.x8, c.y8, round(coalesce(min(greatest(abs(c.x8 - o.x8), abs(c.y8 - o.y8)) + (sqrt(2.0) - 1) * least(abs(c.x8 - o.x8), abs(c.y8 - o.y8))), 1e30), 9) AS d FROM c0 c LEFT JOIN open o ON c.panel_id = o.panel_id GROUP BY ALL),
wts AS (SELECT *, greatest(least(greatest(8 * d / {FEATHER}, 0), 1), 1e-4) AS w FROM dist),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x8, y8 ORDER BY w DESC, d DESC, panel_id) AS r FROM wts),
owner AS (SELECT x8, y8, panel_id AS owner FROM ranked WHERE r = 1),
bound AS (SELECT DISTINCT o.x8, o.y8, o.owner, q.owner AS other FROM owner o JOIN owner q ON abs(o.x8 - q.x8) + abs(o.y8 - q.y8) = 1 WHERE o.owner <> q.owner)"""


@query(WITH + " SELECT panel_id, ch, count(*) AS n, count(*) FILTER (v <> 0) AS n_nonzero, min(v) FILTER (v <> 0) AS v_min, max(v) FILTER (v <> 0) AS v_max, round(avg(v) FILTER (v <> 0), 3) AS v_mean FROM px GROUP BY ALL")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.scan_stats(Raster(spark, sf_dir).scan)


@query(CELLS + ", box AS (SELECT panel_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS n_covered FROM cov GROUP BY 1) SELECT panel_id, ch, x0, y0, x1, y1, n_covered, min(v) AS ch_min, max(v) AS ch_max, round(avg(v), 3) AS ch_mean FROM cpx JOIN box USING (panel_id) GROUP BY ALL")
def panel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.panel_stats(Raster(spark, sf_dir).scan)


@query(CELLS + " SELECT panel_id, ch, x8, y8, n, area, round(n / area, 9) AS coverage, round(mean, 4) AS mean, round(sqrt(greatest(ss / n - mean * mean, 0)), 3) AS detail FROM cells")
def l8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Raster(spark, sf_dir).cells
    return c.select("panel_id", "ch", "x8", "y8", "n", "area", F.round("coverage", 9).alias("coverage"), F.round("mean", 4).alias("mean"), F.round("detail", 3).alias("detail"))


@query(CELLS + " SELECT panel_id, count(*) AS n_full FROM fullc WHERE ch = 0 GROUP BY 1")
def full_cov_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.full_counts(Raster(spark, sf_dir).cells)


@query(PAIRS + " SELECT * FROM edges")
def overlap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Raster(spark, sf_dir).edges


REACH = PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(p, q) AS (SELECT DISTINCT panel_id, panel_id FROM cells UNION SELECT r.p, e.b FROM reach r JOIN sym e ON r.q = e.a),
comp AS (SELECT p AS panel_id, min(q) AS component FROM reach GROUP BY p)"""


@query(REACH + " SELECT * FROM comp")
def panel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return overlap.component_table(r.cells, r.edges)


@query(REACH + ", cnt AS (SELECT comp.panel_id, component, coalesce(n_full, 0) AS n_full FROM comp LEFT JOIN (SELECT panel_id, count(*) AS n_full FROM fullc WHERE ch = 0 GROUP BY 1) USING (panel_id)) SELECT component, panel_id, n_full FROM cnt QUALIFY row_number() OVER (PARTITION BY component ORDER BY n_full DESC, panel_id) = 1")
def gauge_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return overlap.gauge_panels(r.cells, r.edges)


@query(CELLS + " SELECT min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM cov")
def union_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.union_bbox(summary.panel_stats(Raster(spark, sf_dir).scan))


@query(CELLS + " SELECT greatest(min(x), 10) AS x0, greatest(min(y), 100) AS y0, least(max(x) + 1, 50) AS x1, least(max(y) + 1, 1000000) AS y1 FROM cov")
def roi_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.union_bbox(summary.panel_stats(Raster(spark, sf_dir).scan), (10, 100, 50, 1_000_000))


@query(CELLS + ", box AS (SELECT panel_id, min(y) AS y0, max(y) + 1 AS y1 FROM cov GROUP BY 1), b AS (SELECT panel_id, unnest(generate_series(y0 // 64, (y1 - 1) // 64)) AS band FROM box) SELECT band, count(*) AS n_panels, min(panel_id) AS first_panel, max(panel_id) AS last_panel FROM b GROUP BY 1")
def active_panels_per_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.active_panels(summary.panel_stats(Raster(spark, sf_dir).scan), 64)


@query(CELLS + " SELECT n_panels, count(*) AS n_pixels FROM (SELECT x, y, count(*) AS n_panels FROM cov GROUP BY 1, 2) GROUP BY 1")
def covering_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.covering_counts(Raster(spark, sf_dir).bands)


SUMS = PAIRS + ", es AS (SELECT p.a, p.b, p.ch, count(*) AS n, sum(ma) AS sx, sum(mb) AS sy, sum(ma * ma) AS sxx, sum(ma * mb) AS sxy FROM pairs p JOIN edges e ON p.a = e.a AND p.b = e.b GROUP BY ALL), sl AS (SELECT *, CASE WHEN n * sxx - sx * sx > n * sxx * 1e-12 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 1 END AS slope FROM es)"


@query(SUMS + " SELECT a, b, ch, n, round(sx, 2) AS sx, round(sy, 2) AS sy, round(slope, 6) AS slope, round((sy - slope * sx) / n, 2) AS intercept FROM sl")
def edge_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    e = photometry.edge_sums(photometry.edge_pairs(r.cells, r.edges))
    return e.select("a", "b", "ch", "n", F.round("sx", 2).alias("sx"), F.round("sy", 2).alias("sy"), F.round("slope", 6).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query(CELLS + f" SELECT panel_id, ch, x8, y8, round((mean - {OFFSET} * {SCALE}) / {GAIN} + 0.000013, 4) AS value FROM cells")
def corrected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Raster(spark, sf_dir).values.select("panel_id", "ch", "x8", "y8", F.round(F.col("value") + 0.000013, 4).alias("value"))  # shifted off the ties that sums of 64ths make


@query(CELLS + ", m AS (SELECT panel_id, ch, median(value) AS med FROM fullc GROUP BY 1, 2) SELECT panel_id, ch, round(any_value(med), 3) AS med, round(median(abs(value - med)), 3) AS mad, round(any_value(med) + 3 * median(abs(value - med)), 3) AS lim FROM fullc JOIN m USING (panel_id, ch) GROUP BY 1, 2")
def bg_threshold_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = surfaces.thresholds(Raster(spark, sf_dir).values)
    return t.select("panel_id", "ch", F.round("med", 3).alias("med"), F.round("mad", 3).alias("mad"), F.round("limit", 3).alias("lim"))


@query(CELLS + " SELECT panel_id, ch, round(list_sort(list(value))[count(*) // 2 + 1], 3) AS upper_median FROM fullc GROUP BY 1, 2")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = summary.full_cells(Raster(spark, sf_dir).values)
    return f.groupBy("panel_id", "ch").agg(F.round(S.upper_median(F.col("value")), 3).alias("upper_median"))


@query(PAIRS + ", m AS (SELECT panel_id, ch, median(value) AS med FROM fullc GROUP BY 1, 2), t AS (SELECT panel_id, ch, any_value(med) + 3 * median(abs(value - med)) AS lim FROM fullc JOIN m USING (panel_id, ch) GROUP BY 1, 2) SELECT p.a, p.b, p.ch, count(*) AS n, round(avg(va - vb), 3) AS mean_r FROM pairs p JOIN edges e ON p.a = e.a AND p.b = e.b JOIN t ta ON ta.panel_id = p.a AND ta.ch = p.ch JOIN t tb ON tb.panel_id = p.b AND tb.ch = p.ch WHERE va <= ta.lim AND vb <= tb.lim GROUP BY ALL")
def edge_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return surfaces.background_residuals(r.values, r.edges).groupBy("a", "b", "ch").agg(F.count("*").alias("n"), F.round(F.avg("r"), 3).alias("mean_r"))


@query(DIST + " SELECT panel_id, x8, y8, round(d, 6) AS d FROM dist")
def distance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Raster(spark, sf_dir).distance.select("panel_id", "x8", "y8", F.round("d", 6).alias("d"))


@query(DIST + " SELECT * FROM owner")
def voronoi_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Raster(spark, sf_dir).owner


@query(DIST + " SELECT * FROM bound")
def boundary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.boundary_cells(Raster(spark, sf_dir).owner)


DELTA = DIST + ", sd AS (SELECT least(owner, other) AS a, greatest(owner, other) AS b, count(*) AS n_cells, avg(delta) AS delta FROM (SELECT b.owner, b.other, b.x8, b.y8, max(abs(f.value - g.value)) AS delta FROM bound b JOIN fullc f ON f.panel_id = b.owner AND f.x8 = b.x8 AND f.y8 = b.y8 JOIN fullc g ON g.panel_id = b.other AND g.x8 = b.x8 AND g.y8 = b.y8 AND g.ch = f.ch GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"


@query(DELTA + " SELECT a, b, n_cells, round(delta, 2) AS delta FROM sd")
def seam_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return seam.seam_deltas(seam.boundary_cells(r.owner), r.values).select("a", "b", "n_cells", F.round("delta", 2).alias("delta"))


@query(DELTA + ", o AS (SELECT *, row_number() OVER (ORDER BY delta, a, b) - 1 AS r, count(*) OVER () AS n FROM sd), md AS (SELECT max(delta) FILTER (r = n // 2) AS m FROM o) SELECT a, b, n_cells, delta > 3 * m AS flag FROM sd, md")
def edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return seam.edge_flags(seam.seam_deltas(seam.boundary_cells(r.owner), r.values)).drop("delta")


@query(DIST + " SELECT owner, (sum(x8) // count(*))::BIGINT AS cx, (sum(y8) // count(*))::BIGINT AS cy, count(*) AS n_cells FROM owner GROUP BY 1")
def region_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seam.region_centroids(Raster(spark, sf_dir).owner)


@query(DELTA + f", fr AS (SELECT e.n_cells / greatest(least(f.n, g.n), 1) AS f FROM edges e JOIN (SELECT panel_id, count(*) AS n FROM fullc WHERE ch = 0 GROUP BY 1) f ON f.panel_id = e.a JOIN (SELECT panel_id, count(*) AS n FROM fullc WHERE ch = 0 GROUP BY 1) g ON g.panel_id = e.b) SELECT (SELECT count(DISTINCT panel_id) FROM cells) AS n_panels, (SELECT count(*) FROM edges) AS n_edges, round((SELECT count(*) FROM owner) / ({-(-WIDTH // 8)} * (((SELECT h FROM top) + 7) // 8)), 6) AS covered_frac, round((SELECT median(f) FROM fr), 6) AS overlap_frac, round((SELECT median(delta) FROM sd), 2) AS seam_median, round((SELECT max(delta) FROM sd), 2) AS seam_max")
def mosaic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.diag import mosaic_summary as run

    r = Raster(spark, sf_dir)
    return run(r.cells, r.edges, r.owner, seam.seam_deltas(seam.boundary_cells(r.owner), r.values), -(-WIDTH // 8), -(-r.height // 8))


@query(DIST + " SELECT x8, y8, ch, round(sum(w * value) / sum(w) + 0.0013, 2) AS value FROM fullc JOIN wts USING (panel_id, x8, y8) GROUP BY ALL")
def feather_l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return blend.preview(r.values, r.distance, FEATHER).withColumn("value", F.round(F.col("value") + 0.0013, 2))


@query(DIST + f""", t AS (SELECT a.panel_id, a.x8, a.y8, a.d, coalesce(b.d, a.d) AS dr, coalesce(c.d, a.d) AS dd, coalesce(e.d, b.d, c.d, a.d) AS dx FROM dist a LEFT JOIN dist b ON b.panel_id = a.panel_id AND b.x8 = a.x8 + 1 AND b.y8 = a.y8 LEFT JOIN dist c ON c.panel_id = a.panel_id AND c.x8 = a.x8 AND c.y8 = a.y8 + 1 LEFT JOIN dist e ON e.panel_id = a.panel_id AND e.x8 = a.x8 + 1 AND e.y8 = a.y8 + 1),
sw AS (SELECT p.x, p.y, p.ch, (p.v - {OFFSET.replace('panel_id', 'p.panel_id')} * {SCALE}) / {GAIN.replace('panel_id', 'p.panel_id')} AS v, greatest(least(greatest(8 * ((d * (1 - (x / 8 - x8)) + dr * (x / 8 - x8)) * (1 - (y / 8 - y8)) + (dd * (1 - (x / 8 - x8)) + dx * (x / 8 - x8)) * (y / 8 - y8)) / {FEATHER}, 0), 1), 1e-4) AS w FROM cpx p JOIN t ON t.panel_id = p.panel_id AND t.x8 = p.x // 8 AND t.y8 = p.y // 8)
SELECT x, y, ch, round(sum(w * v) / sum(w), 2) AS value, count(*) AS n_panels FROM sw GROUP BY ALL""")
def feather_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    mosaic = blend.feather(r.bands, r.corrections, None, WIDTH, r.height, r.distance, FEATHER)
    return blend.mosaic_pixels(mosaic, "n_panels").withColumn("value", F.round("value", 2))


@query(DIST + " SELECT x8, y8, ch, round(sum(greatest(d, 1) * value) / sum(greatest(d, 1)) + 0.0013, 2) AS value FROM fullc JOIN dist USING (panel_id, x8, y8) GROUP BY ALL")
def merged_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return surfaces.merged_background(r.values, r.distance).withColumn("value", F.round(F.col("value") + 0.0013, 2))


@query(CELLS + """, m AS (SELECT ch, list_sort(list(value))[count(*) // 2 + 1] / 1e6 AS m FROM fullc GROUP BY 1),
d AS (SELECT f.ch, any_value(m) AS m, list_sort(list(abs(value / 1e6 - m)))[count(*) // 2 + 1] AS mad FROM fullc f JOIN m USING (ch) GROUP BY 1), c AS (SELECT *, greatest(least(m - 2.8 * 1.4826 * mad, 0.99), 0) AS clip FROM d)
SELECT ch, round(m, 6) AS m, round(mad, 6) AS mad, round(clip, 6) AS clip, round(CASE WHEN (m - clip) / (1 - clip) <= 0 THEN 0.5 ELSE 0.75 * (m - clip) / (1 - clip) / (0.5 * (m - clip) / (1 - clip) + 0.25) END, 6) AS midtone FROM c""")
def autostretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.files import stretch

    f = summary.full_cells(Raster(spark, sf_dir).values).select("ch", (F.col("value") / SCALE).alias("value"))
    return stretch(f).select("ch", *(F.round(c, 6).alias(c) for c in ("m", "mad", "clip", "midtone")))


@query(WITH + f" SELECT panel_id, ch, count(*) FILTER (v < {SCALE} // 3) AS n_dark, count(*) FILTER (v > {SCALE} // 2) AS n_over, round(sum(least(greatest(v / {SCALE}.0 * 2 - 0.5, 0), 1)), 4) AS total FROM px GROUP BY ALL")
def sanitize_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = rasters.pixels(spark, sf_dir)
    v = S.sanitize(F.col("v") / SCALE * 2 - 0.5)
    return px.groupBy("panel_id", "ch").agg(F.count_if(F.col("v") < SCALE // 3).alias("n_dark"), F.count_if(F.col("v") > SCALE // 2).alias("n_over"), F.round(F.sum(v), 4).alias("total"))


SKYPOS = "sky AS (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS i, unnest(embedding)::DOUBLE AS t FROM embeddings)"


@query(f"WITH {SKYPOS}, p AS (SELECT vec_id, i, radians(t * 5) AS xi, radians(t * 3 + i * 0.01) AS eta, radians(-3.24::DOUBLE) AS d0 FROM sky), q AS (SELECT vec_id, i, 84.2::DOUBLE + degrees(atan2(xi, cos(d0) - eta * sin(d0))) AS ra, degrees(atan((sin(d0) + eta * cos(d0)) / sqrt(xi * xi + (cos(d0) - eta * sin(d0)) * (cos(d0) - eta * sin(d0))))) AS dec FROM p) SELECT vec_id, i, round(ra - 360 * floor(ra / 360), 7) AS ra, round(dec, 7) AS dec FROM q")
def tan_deproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rasters.sky(spark, sf_dir)
    ra, dec = S.tan_deproject(F.lit(84.2), F.lit(-3.24), F.col("t") * 5, F.col("t") * 3 + F.col("x") * 0.01)
    return s.select(F.col("y").alias("vec_id"), F.col("x").alias("i"), F.round(ra, 7).alias("ra"), F.round(dec, 7).alias("dec"))


@query(f"WITH {SKYPOS}, p AS (SELECT vec_id, i, radians(t * 5) AS da, radians(-3.24::DOUBLE + t * 3 + i * 0.01) AS d, radians(-3.24::DOUBLE) AS d0 FROM sky), q AS (SELECT *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(da) AS den FROM p) SELECT vec_id, i, round(degrees(cos(d) * sin(da) / den), 7) AS xi, round(degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(da)) / den), 7) AS eta FROM q WHERE den > 1e-9")
def tan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rasters.sky(spark, sf_dir)
    xi, eta, den = S.tan_project(F.lit(84.2), F.lit(-3.24), 84.2 + F.col("t") * 5, F.lit(-3.24) + F.col("t") * 3 + F.col("x") * 0.01)
    return s.where(den > 1e-9).select(F.col("y").alias("vec_id"), F.col("x").alias("i"), F.round(xi, 7).alias("xi"), F.round(eta, 7).alias("eta"))


@query(f"WITH {SKYPOS}, p AS (SELECT vec_id, i, t * 8 AS t, pi() * t * 8 AS a FROM sky) SELECT vec_id, i, round(CASE WHEN abs(t) < 1e-12 THEN 1 WHEN abs(t) >= 3 THEN 0 ELSE 3 * sin(a) * sin(a / 3) / (a * a) END, 8) AS w FROM p")
def lanczos_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rasters.sky(spark, sf_dir)
    return s.select(F.col("y").alias("vec_id"), F.col("x").alias("i"), F.round(S.lanczos3(F.col("t") * 8), 8).alias("w"))


@query(f"WITH {SKYPOS}, p AS (SELECT vec_id, i, abs(t) AS t FROM sky) SELECT vec_id, i, round((-t*t*t + 2*t*t - t) / 2, 8) AS w0, round((3*t*t*t - 5*t*t + 2) / 2, 8) AS w1, round((-3*t*t*t + 4*t*t + t) / 2, 8) AS w2, round((t*t*t - t*t) / 2, 8) AS w3 FROM p")
def catmull_rom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rasters.sky(spark, sf_dir)
    return s.select(F.col("y").alias("vec_id"), F.col("x").alias("i"), *(F.round(w, 8).alias(f"w{k}") for k, w in enumerate(S.catmull_rom(F.abs("t")))))


@query(f"WITH {SKYPOS}, e AS (SELECT vec_id, i, t, max(i) OVER (PARTITION BY vec_id) AS m FROM sky) SELECT vec_id, i, round((coalesce(lag(t, 2) OVER w, first_value(t) OVER w) + 4 * coalesce(lag(t) OVER w, t) + 6 * t + 4 * coalesce(lead(t) OVER w, t) + coalesce(lead(t, 2) OVER w, last_value(t) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) / 16, 8) AS g FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)")
def gauss5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-tap smoothing along rows; rows are arrays, so no window or shuffle is needed."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("r"))
    last = F.size("r") - 1

    def at(i):
        return F.get("r", F.greatest(F.least(i, last), F.lit(0)))

    g = F.transform(F.sequence(F.lit(0), last), lambda i: (at(i - 2) + 4 * at(i - 1) + 6 * at(i) + 4 * at(i + 1) + at(i + 2)) / 16)
    return e.select("vec_id", F.posexplode(g).alias("i", "g")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("g", 8).alias("g"))


@query(DIST + ", r AS (SELECT DISTINCT panel_id, x8 + dx AS x8, y8 + dy AS y8 FROM c0, (SELECT unnest(generate_series(-2, 2)) AS dx) d, (SELECT unnest(generate_series(-2, 2)) AS dy) e) SELECT panel_id, count(*) AS n FROM r, top WHERE x8 >= 0 AND y8 >= 0 AND x8 < 8 AND y8 < (h + 7) // 8 GROUP BY 1")
def base_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    near = F.sequence(F.lit(-2), F.lit(2))
    c = r.cells.where("ch = 0").select("panel_id", "x8", "y8").withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    c = c.select("panel_id", (F.col("x8") + F.col("dx")).alias("x8"), (F.col("y8") + F.col("dy")).alias("y8")).distinct()
    return c.where((F.col("x8") >= 0) & (F.col("y8") >= 0) & (F.col("x8") < -(-WIDTH // 8)) & (F.col("y8") < -(-r.height // 8))).groupBy("panel_id").agg(F.count("*").alias("n"))


def _fit_round(keep: str, name: str) -> str:
    """SQL: sums and line of a round's least squares over the kept pairs, and what the next round keeps."""
    return f"""
{name}s AS (SELECT a, b, ch, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM {keep} GROUP BY ALL),
{name}l AS (SELECT *, (sy - slope * sx) / n AS icpt FROM (SELECT *, CASE WHEN n * sxx - sx * sx > n * sxx * 1e-12 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 1 END AS slope FROM {name}s)),
{name}m AS (SELECT k.a, k.b, k.ch, any_value(slope) AS slope, any_value(icpt) AS icpt, greatest({photometry.CLIP} * sqrt(avg((y - slope * x - icpt) * (y - slope * x - icpt))), {photometry.FLOOR}) AS lim FROM {keep} k JOIN {name}l USING (a, b, ch) GROUP BY k.a, k.b, k.ch),
{name} AS (SELECT p.* FROM ep p JOIN {name}m m USING (a, b, ch) WHERE abs(y - slope * x - icpt) <= lim)"""


FITS = PAIRS + f""",
ep AS (SELECT p.a, p.b, p.ch, p.ma AS x, p.mb AS y, (p.x8 - x0) / greatest(x1 - x0, 1) AS u, (p.y8 - y0) / greatest(y1 - y0, 1) AS v FROM pairs p JOIN edges e ON p.a = e.a AND p.b = e.b),{_fit_round("ep", "k1")},{_fit_round("k1", "k2")},
me AS (SELECT a, b, ch, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, sum(x * x) AS sxx FROM k2 GROUP BY ALL),
mo AS (SELECT a, b, ch, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(sxx) AS sxx, sum((x - mx) * (x - mx)) AS xx, sum((y - my) * (y - my)) AS yy, sum((x - mx) * (y - my)) AS xy,
  sum((u - mu) * (u - mu)) AS uu, sum((v - mv) * (v - mv)) AS vv, sum((u - mu) * (v - mv)) AS uv, sum((x - mx) * (u - mu)) AS xu, sum((x - mx) * (v - mv)) AS xv, sum((y - my) * (u - mu)) AS yu, sum((y - my) * (v - mv)) AS yv FROM k2 JOIN me USING (a, b, ch) GROUP BY a, b, ch),
pl AS (SELECT *, n >= 8 AND uu * vv - uv * uv > 1e-9 * uu * vv AS plane, uu * vv - uv * uv AS det FROM mo),
fl AS (SELECT *, (xx - if(plane, (xu * (xu * vv - xv * uv) + xv * (xv * uu - xu * uv)) / det, 0)) / n AS vxx, (yy - if(plane, (yu * (yu * vv - yv * uv) + yv * (yv * uu - yu * uv)) / det, 0)) / n AS vyy,
  (xy - if(plane, (yu * (xu * vv - xv * uv) + yv * (xv * uu - xu * uv)) / det, 0)) / n AS vxy FROM pl),
kn AS (SELECT *, vxx > sxx / n * 1e-12 AND vyy > 0 AND vxy * vxy / (vxx * vyy) >= {photometry.LEAST_R**2} AS known FROM fl),
ga AS (SELECT a, b, ch, n, mx, my, known, CASE WHEN known THEN (vyy - vxx + sqrt((vyy - vxx) * (vyy - vxx) + 4 * vxy * vxy)) / (2 * vxy) ELSE 1 END AS gain FROM kn),
fits AS (SELECT k.a, k.b, k.ch, any_value(gain) AS gain, any_value(my - gain * mx) AS off, any_value(n) AS n, sqrt(avg((y - gain * x - (my - gain * mx)) * (y - gain * x - (my - gain * mx)))) AS rms, any_value(known) AS identifiable FROM k2 k JOIN ga USING (a, b, ch) GROUP BY k.a, k.b, k.ch)"""


@query(FITS + " SELECT a, b, ch, round(gain, 6) AS gain, round(off, 1) AS off, n, round(rms, 2) AS rms, identifiable FROM fits")
def edge_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    fits = photometry.fit_edges(photometry.edge_pairs(r.cells, r.edges))
    return fits.select("a", "b", "ch", F.round("gain", 6).alias("gain"), F.round("offset", 1).alias("off"), "n", F.round("rms", 2).alias("rms"), "identifiable")


@query()
def photometry_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return photometry.solve(r.cells, r.edges, photometry.fit_edges(photometry.edge_pairs(r.cells, r.edges)))


@query()
def surfaces_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return surfaces.fit_surfaces(r.solved, r.edges, WIDTH, r.height, 2)


@query(DIST + f""", bg AS (SELECT x8, y8, ch, sum(greatest(d, 1) * value) / sum(greatest(d, 1)) AS value FROM fullc JOIN dist USING (panel_id, x8, y8) GROUP BY ALL),
m AS (SELECT ch, median(value) AS med FROM bg GROUP BY 1), md AS (SELECT ch, any_value(med) AS med, median(abs(value - med)) AS mad FROM bg JOIN m USING (ch) GROUP BY 1),
dark AS (SELECT x8, y8 FROM bg JOIN md USING (ch) GROUP BY 1, 2 HAVING bool_and(value <= med + {surfaces.FLATTEN_K} * mad)),
p AS (SELECT ch, value AS v, (x8 + 0.5) * 8 / {WIDTH} AS x, (y8 + 0.5) * 8 / h AS y FROM bg SEMI JOIN dark USING (x8, y8), top),
c AS (SELECT ch, avg(v) AS mv, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM p GROUP BY 1),
q AS (SELECT *, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS c1, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS c2 FROM c)
SELECT ch, round(mv - c1 * mx - c2 * my, 1) AS c0, round(c1, 1) AS c1, round(c2, 1) AS c2 FROM q""")
def flatten_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    fit = surfaces.fit_flatten(surfaces.merged_background(r.values, r.distance), WIDTH, r.height, 1)
    return fit.select("ch", *(F.round(F.col("coef")[i], 1).alias(f"c{i}") for i in range(3)))


MASK = DIST.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
md AS (SELECT panel_id, x8, y8, max(n / area) AS coverage, max(sqrt(greatest(ss / n - mean * mean, 0))) AS detail FROM cells GROUP BY ALL),
mm AS (SELECT panel_id, list_sort(list(detail))[count(*) // 2 + 1] AS m FROM md WHERE coverage >= 1 GROUP BY 1),
grow AS (SELECT panel_id, x8, y8, detail > {masks.SEED} * m AS seed FROM md JOIN mm USING (panel_id) WHERE detail > {masks.GROW} * m),
mask(panel_id, x8, y8) AS (SELECT panel_id, x8, y8 FROM grow WHERE seed UNION SELECT g.panel_id, g.x8, g.y8 FROM mask k JOIN grow g ON g.panel_id = k.panel_id AND abs(g.x8 - k.x8) <= 1 AND abs(g.y8 - k.y8) <= 1),
joined(panel_id, x8, y8, fx, fy) AS (SELECT panel_id, x8, y8, x8, y8 FROM mask UNION SELECT m.panel_id, m.x8, m.y8, j.fx, j.fy FROM joined j JOIN mask m ON m.panel_id = j.panel_id AND abs(m.x8 - j.x8) <= 1 AND abs(m.y8 - j.y8) <= 1),
named AS (SELECT panel_id, x8, y8, min(fy * 1000000 + fx) AS part FROM joined GROUP BY ALL),
parts AS (SELECT panel_id, part, count(*) AS area, greatest(max(x8) - min(x8), max(y8) - min(y8)) + 1 AS longest FROM named GROUP BY ALL),
stars AS (SELECT panel_id, x8, y8, area <= {masks.AREA} OR longest <= {masks.DIM} OR area <= {masks.THIN} * longest AS compact FROM named JOIN parts USING (panel_id, part))"""


@query(MASK + " SELECT * FROM stars")
def star_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.mask_table(Raster(spark, sf_dir).cells)


#: Cells from which the registered queries move an edge's seam; few of the derived raster's edges are as long as the operator asks for.
SEAM = 8
G = GAIN.replace("panel_id", "f.panel_id")
O = OFFSET.replace("panel_id", "f.panel_id")
SEAMS = MASK + f""",
fc AS (SELECT f.panel_id, f.x8, f.y8, max(sqrt(greatest(ss / n - mean * mean, 0)) * (1 / {G})) AS det, list((1 / {G}) * mean + (-{O} * {SCALE} / {G}) ORDER BY ch) AS v FROM fullc f GROUP BY ALL),
fd AS (SELECT fc.*, d, s.panel_id IS NOT NULL AS star FROM fc JOIN dist USING (panel_id, x8, y8) LEFT JOIN stars s USING (panel_id, x8, y8)),
lo AS (SELECT *, x1 - x0 >= y1 - y0 AS along_x, greatest(x1 - x0, y1 - y0) AS len, least(x1 - x0, y1 - y0) AS wid FROM edges WHERE x1 - x0 >= {SEAM} OR y1 - y0 >= {SEAM}),
sh AS (SELECT e.a, e.b, if(along_x, p.x8 - x0, p.y8 - y0) AS t, if(along_x, p.y8 - y0, p.x8 - x0) AS s, p.x8, p.y8, list_max(list_transform(range(1, len(p.v) + 1), lambda i: abs(p.v[i] - q.v[i]))) + {seam.BETA} * greatest(p.det, q.det) AS cost, p.d - q.d AS dd, p.star OR q.star AS star
  FROM lo e JOIN fd p ON p.panel_id = e.a JOIN fd q ON q.panel_id = e.b AND q.x8 = p.x8 AND q.y8 = p.y8),
um AS (SELECT a, b, list_sort(list(cost))[count(*) // 2 + 1] * {seam.MASK_COST} AS more FROM sh GROUP BY ALL),
grid AS (SELECT a, b, t, s, coalesce(sh.cost + if(sh.star, more, 0), {seam.UNSHARED}) AS cost FROM (SELECT a, b, unnest(range(len)) AS t, wid FROM lo) g JOIN (SELECT a, b, unnest(range(wid)) AS s FROM lo) h USING (a, b) LEFT JOIN sh USING (a, b, t, s) JOIN um USING (a, b)),
costs AS (SELECT a, b, t, list(cost ORDER BY s) AS c FROM grid GROUP BY ALL),
sides AS (SELECT a, b, t, list_transform(range(1, len(c) + 2), lambda p: coalesce(c[p - 1], 0) + coalesce(c[p], 0)) AS c FROM costs),
best(a, b, t, c) AS (SELECT a, b, t, c FROM sides WHERE t = 0 UNION ALL SELECT s.a, s.b, s.t, list_transform(range(1, len(s.c) + 1), lambda p: least(z.c[p], z.c[p - 1], z.c[p + 1]) + s.c[p]) FROM best z JOIN sides s ON s.a = z.a AND s.b = z.b AND s.t = z.t + 1),
path(a, b, t, p) AS (SELECT a, b, t, list_position(c, list_min(c)) FROM best JOIN lo USING (a, b) WHERE t = len - 1
  UNION ALL SELECT k.a, k.b, z.t, CASE WHEN z.c[p + 1] < least(z.c[p], z.c[p - 1]) THEN p + 1 WHEN z.c[p - 1] < z.c[p] THEN p - 1 ELSE p END FROM path k JOIN best z ON z.a = k.a AND z.b = k.b AND z.t = k.t - 1),
low AS (SELECT a, b, coalesce(sum(dd) FILTER (s = 0), 0) >= 0 AS a_low FROM sh GROUP BY ALL),
moved AS (SELECT x8, y8, arg_max(if((s < p - 1) = a_low, a, b), (a, b)) AS new FROM sh JOIN path USING (a, b, t) JOIN low USING (a, b) GROUP BY ALL)"""


@query(SEAMS + " SELECT x8, y8, coalesce(new, owner) AS owner FROM owner LEFT JOIN moved USING (x8, y8)")
def dp_seam_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return seam.owner_map(r.values, r.edges, r.distance, masks.mask_table(r.cells), FEATHER, SEAM)


def _blend(spark: SparkSession, sf_dir: str, pyramid: bool, veto: bool) -> DataFrame:
    r = Raster(spark, sf_dir)
    owner = seam.owner_map(r.values, r.edges, r.distance, r.masked, FEATHER, SEAM)
    tiles = blend.tile_prep(blend.panel_prep(r.values, r.distance, r.masked), owner, FEATHER, pyramid)
    return blend.mosaic_pixels(blend.two_band(r.bands, r.corrections, None, WIDTH, r.height, tiles, FEATHER, veto))


@query()
def blend_two_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blend(spark, sf_dir, False, False)


@query()
def blend_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blend(spark, sf_dir, True, True)


#: How far the reprojected sky lies off its frame, in pixels, and the size of a pixel in degrees.
SHIFT, PIXEL = (0.3, -0.4), 1e-5


@query(f"""WITH taps AS (SELECT i, {SHIFT[0]} + 2 - i AS tx, {SHIFT[1]} + 3 - i AS ty FROM (SELECT unnest(range(6)) AS i)),
lz AS (SELECT i, 3 * sin(pi() * tx) * sin(pi() * tx / 3) / (pi() * tx * pi() * tx) AS wx, 3 * sin(pi() * ty) * sin(pi() * ty / 3) / (pi() * ty * pi() * ty) AS wy FROM taps),
wt AS (SELECT i, wx / sum(wx) OVER () AS wx, wy / sum(wy) OVER () AS wy FROM lz),
sky AS (SELECT vec_id AS y, unnest(generate_series(0, len(embedding) - 1)) AS x, unnest(embedding)::DOUBLE + 0.6 AS v FROM embeddings),
o AS (SELECT s.x + 2 - a.i AS x, s.y + 3 - b.i AS y, sum(a.wx * b.wy * v) AS v FROM sky s, wt a, wt b GROUP BY 1, 2)
SELECT x, y, round(v, 4) AS v FROM o WHERE x >= 2 AND x <= {WIDTH - 4} AND y >= 3 AND y <= (SELECT max(vec_id) - 2 FROM embeddings)""")
def reprojected_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sky as one solved panel, resampled to a frame that lies a fraction of a pixel off."""
    from ..functions.astrometry import Frame, LinearWcs
    from ..operators.align import reproject

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    height = (e.agg(F.max("vec_id")).first()[0] or 0) + 1
    bands = e.select(F.lit(0).cast("long").alias("panel_id"), F.col("vec_id").alias("y"), F.lit(0).cast("long").alias("x0"), F.array(F.transform("embedding", lambda v: v.cast("double") + 0.6)).alias("vals"))
    model = LinearWcs((10.0, 0.0), (WIDTH / 2 + 1 + SHIFT[0], height / 2 + 1 + SHIFT[1]), ((-PIXEL, 0.0), (0.0, PIXEL)))
    out = summary.pixels(reproject(bands, {0: (model, WIDTH, height)}, Frame((10.0, 0.0), PIXEL, WIDTH, height)))
    return out.where("v <> 0").select("x", "y", F.round("v", 4).alias("v"))


@query(FITS + ", fm AS (SELECT ch, median(rms) AS m FROM fits GROUP BY 1) SELECT a, b, ch, n, rms > 3 * m AS flag FROM fits JOIN fm USING (ch)")
def fit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.diag import fit_flags as run

    r = Raster(spark, sf_dir)
    return run(photometry.fit_edges(photometry.edge_pairs(r.cells, r.edges))).select("a", "b", "ch", "n", "flag")


@query(MASK + " SELECT x8, y8, ch, round(sum(greatest(d, 1) * value) / sum(greatest(d, 1)) + 0.0013, 2) AS value FROM fullc f JOIN dist USING (panel_id, x8, y8) LEFT JOIN stars s USING (panel_id, x8, y8) GROUP BY ALL HAVING NOT bool_or(s.compact IS NOT NULL)")
def masked_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    return surfaces.merged_background(r.values, r.distance, masks.mask_table(r.cells)).withColumn("value", F.round(F.col("value") + 0.0013, 2))


@query(DIST + f""", o AS (SELECT x8, y8, ch, sum(w * value) / sum(w) / {SCALE} AS v FROM fullc JOIN wts USING (panel_id, x8, y8) GROUP BY ALL),
m AS (SELECT ch, list_sort(list(v))[count(*) // 2 + 1] AS m FROM o GROUP BY 1), d AS (SELECT ch, any_value(m) AS m, list_sort(list(abs(v - m)))[count(*) // 2 + 1] AS mad FROM o JOIN m USING (ch) GROUP BY 1),
c AS (SELECT ch, m, greatest(least(m - 2.8 * 1.4826 * mad, 0.99), 0) AS clip FROM d), t AS (SELECT ch, clip, CASE WHEN (m - clip) / (1 - clip) <= 0 THEN 0.5 ELSE 0.75 * (m - clip) / (1 - clip) / (0.5 * (m - clip) / (1 - clip) + 0.25) END AS mid FROM c),
s AS (SELECT x8, y8, ch, mid, least(greatest((v - clip) / (1 - clip), 0), 1) AS v FROM o JOIN t USING (ch))
SELECT x8, y8, ch, round(CASE WHEN v <= 0 THEN 0 WHEN v >= 1 THEN 1 ELSE (mid - 1) * v / ((2 * mid - 1) * v - mid) END, 6) AS level FROM s""")
def stretched_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.files import stretch

    r = Raster(spark, sf_dir)
    o = blend.preview(r.values, r.distance, FEATHER).withColumn("value", F.col("value") / SCALE)
    s = o.join(F.broadcast(stretch(o.select("ch", "value"))), "ch")  # a row a channel
    return s.select("x8", "y8", "ch", F.round(S.mtf(F.col("midtone"), (F.col("value") - F.col("clip")) / (1 - F.col("clip"))), 6).alias("level"))


@query(CELLS + f" SELECT CASE WHEN count(*) >= 2 AND max(n)::DOUBLE / ({WIDTH} * any_value(h)) < 0.5 THEN 'aligned' ELSE 'solved' END AS kind, max(n) AS most_covered FROM (SELECT panel_id, count(*) AS n FROM cov GROUP BY 1), top")
def input_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.solution import classify

    r = Raster(spark, sf_dir)
    stats = summary.panel_stats(r.scan).select("panel_id", "n_covered").distinct().persist()
    kind = classify(stats, [(WIDTH, r.height, rasters.CHANNELS)] * stats.count())
    return stats.agg(F.lit(kind).alias("kind"), F.max("n_covered").alias("most_covered"))


BASE = MASK + f""",
cv AS (SELECT f.panel_id, f.x8, f.y8, max(f.n / f.area) AS coverage, list((1 / {G}) * mean + (-{O} * {SCALE} / {G}) ORDER BY ch) AS v FROM cells f GROUP BY ALL),
src AS (SELECT cv.* FROM cv ANTI JOIN stars USING (panel_id, x8, y8) WHERE coverage >= 1),
sv AS (SELECT panel_id, unnest(range(1, len(v) + 1)) AS ch, unnest(v) AS v FROM src), sm AS (SELECT panel_id, ch, list_sort(list(v))[count(*) // 2 + 1] AS m FROM sv GROUP BY ALL),
sl AS (SELECT panel_id, ch, any_value(m) + {blend.ANCHOR_K} * greatest(list_sort(list(abs(v - m)))[count(*) // 2 + 1], {blend.LEAST_MAD}) AS lim FROM sv JOIN sm USING (panel_id, ch) GROUP BY ALL),
li AS (SELECT panel_id, list(lim ORDER BY ch) AS lim FROM sl GROUP BY 1),
around AS (SELECT dx, dy FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE dx <> 0 OR dy <> 0),
reach AS (SELECT DISTINCT panel_id, x8 + dx AS x8, y8 + dy AS y8 FROM cv, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
rim AS (SELECT r.* FROM reach r ANTI JOIN src USING (panel_id, x8, y8) WHERE r.panel_id IN (SELECT panel_id FROM src)),
layer(i, panel_id, x8, y8, v, since) AS (SELECT 0, panel_id, x8, y8, v, 0 FROM src
  UNION ALL SELECT i, panel_id, x8, y8, any_value(v), any_value(since) FROM (
    SELECT i + 1 AS i, panel_id, x8, y8, v, since FROM layer WHERE i < {blend.FILL_ROUNDS} AND i <= (SELECT max(since) FROM layer)
    UNION ALL SELECT f.i + 1, r.panel_id, r.x8, r.y8, [avg(f.v[1]), avg(f.v[2])], f.i + 1 FROM rim r, around a, layer f, li
      WHERE f.panel_id = r.panel_id AND f.x8 = r.x8 + a.dx AND f.y8 = r.y8 + a.dy AND li.panel_id = r.panel_id AND f.i < {blend.FILL_ROUNDS} AND f.i <= (SELECT max(since) FROM layer)
        AND NOT (f.i >= {blend.LOCAL_LAYERS} AND f.since <= {blend.LOCAL_LAYERS} AND (f.v[1] > li.lim[1] OR f.v[2] > li.lim[2]))
        AND NOT EXISTS (SELECT 1 FROM layer g WHERE g.panel_id = r.panel_id AND g.x8 = r.x8 AND g.y8 = r.y8) GROUP BY ALL) GROUP BY i, panel_id, x8, y8),
base AS (SELECT * FROM layer WHERE i = (SELECT max(i) FROM layer) UNION ALL SELECT 0, panel_id, x8, y8, v, 0 FROM cv WHERE panel_id NOT IN (SELECT panel_id FROM src))"""


@query(BASE + """ SELECT panel_id, x8, y8, round(coalesce(b.v, [0, 0])[1], 2) AS base0, round(coalesce(b.v, [0, 0])[2], 2) AS base1, s.compact IS NOT NULL AS masked, coalesce(s.compact, false) AS compact
    FROM base b FULL JOIN (SELECT panel_id, x8, y8 FROM cv) c USING (panel_id, x8, y8) LEFT JOIN stars s USING (panel_id, x8, y8) WHERE x8 >= 0 AND y8 >= 0""")
def star_free_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Raster(spark, sf_dir)
    base = [F.round(F.get("base", F.lit(i)), 2).alias(f"base{i}") for i in (0, 1)]
    return blend.panel_prep(r.values, r.distance, r.masked).select("panel_id", "x8", "y8", *base, "masked", "compact")
