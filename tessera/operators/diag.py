"""Statistics of a whole mosaic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlap import full_counts


def mosaic_summary(cells: DataFrame, edges: DataFrame, owner: DataFrame, deltas: DataFrame, w8: int, h8: int) -> DataFrame:
    """One row: panels, edges, covered share of the cell grid, median overlap share, median and largest seam delta."""
    full = full_counts(cells)
    side = lambda s: full.select(F.col("panel_id").alias(s), F.col("n_full").alias(f"n{s}"))
    share = edges.join(side("a"), "a").join(side("b"), "b").select((F.col("n_cells") / F.greatest(F.least("na", "nb"), F.lit(1))).alias("f"))
    parts = [
        cells.agg(F.count_distinct("panel_id").alias("n_panels")),
        edges.agg(F.count("*").alias("n_edges")),
        owner.agg(F.round(F.count("*") / (w8 * h8), 6).alias("covered_frac")),
        share.agg(F.round(F.median("f"), 6).alias("overlap_frac")),
        deltas.agg(F.round(F.median("delta"), 2).alias("seam_median"), F.round(F.max("delta"), 2).alias("seam_max")),
    ]
    rows = [p.first() for p in parts]  # a row each
    names = [n for r in rows for n in r.__fields__]
    types = {f.name: f.dataType.simpleString() for p in parts for f in p.schema}
    return cells.sparkSession.createDataFrame([tuple(v for r in rows for v in r)], ", ".join(f"{n} {types[n]}" for n in names))


def panel_report(cells: DataFrame, corrections: DataFrame) -> DataFrame:
    """Gains outside [0.5, 2] are flagged."""
    return cells.select("panel_id").distinct().join(corrections, "panel_id").withColumn("flag", (F.col("gain") < 0.5) | (F.col("gain") > 2))


def fit_flags(fits: DataFrame) -> DataFrame:
    """Edges whose residual is over three times their channel's median."""
    return fits.join(fits.groupBy("ch").agg(F.median("rms").alias("m")), "ch").withColumn("flag", F.col("rms") > 3 * F.col("m")).drop("m")
