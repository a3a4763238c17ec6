"""Overlapping panels derived from the table `embeddings`, so that operators have input that grows with the data.

The sky is `embeddings`: pixel (x, y) is component x of vector y. Panels are windows of it: two columns (x in [0, 40) and
[24, 64)) by bands of BAND + OVER rows that start every BAND rows. A panel has its own gain and offset; values are
fixed-point numbers (millionths), so sums are exact in any order. Some pixels are 0, which means no data; some are bright stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summary

BAND, OVER, SCALE, CHANNELS, BLOCK = 300, 120, 1_000_000, 2, 8
COLUMNS = ((0, 40), (24, 64))
WIDTH = 64
#: Which pixels are stars, and how much brighter.
STAR, GLOW = "(x * 37 + y * 101) % 1499 = 0", 4.0


def gain_sql(p: str = "panel_id") -> str:
    return f"(1.0D + (({p} * 7) % 5 - 2) * 0.05D)"


def offset_sql(p: str = "panel_id") -> str:
    return f"((({p} * 3) % 7 - 3) * 0.002D)"


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, t: the sky's pixels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return e.select(F.col("x").cast("long"), F.col("vec_id").alias("y"), F.col("e").cast("double").alias("t"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel_id, y, x0, vals: all panels' rows; samples are fixed-point BIGINTs. A vector is cut and scaled where it is read: no row a pixel."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("y"), "embedding").where("y is not null and embedding is not null")
    bands_ = F.expr(f"filter(array(y div {BAND} - 1, y div {BAND}), b -> b >= 0 and y < b * {BAND} + {BAND + OVER})")
    cols = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(a).cast("long").alias("x0"), F.lit(b - a).alias("n")) for i, (a, b) in enumerate(COLUMNS)))
    p = e.withColumn("band", F.explode(bands_)).withColumn("col", F.explode(cols)).select("y", "embedding", (F.col("band") * 2 + F.col("col.c")).alias("panel_id"), "col.x0", "col.n")
    sample = f"if(({{x}} * 31 + y * 17 + panel_id * 13 + c * 5) % 1009 = 0, 0L, cast(floor(((if(c = 0, t + 0.6D, t * 0.5D + 0.45D) + if({STAR.replace('x *', '{x} *')}, {GLOW}D, 0.0D)) * {gain_sql()} + {offset_sql()}) * {SCALE} + 0.5D) as bigint))".format(x="(x0 + i)")
    vals = f"transform(sequence(0, {CHANNELS - 1}), c -> transform(transform(slice(embedding, cast(x0 as int) + 1, n), t -> cast(t as double)), (t, i) -> {sample}))"
    return p.select("panel_id", "y", "x0", F.expr(vals).alias("vals")).where("size(vals[0]) > 0")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as samples: panel_id, ch, x, y, v."""
    return summary.pixels(bands(spark, sf_dir))


#: The same in DuckDB SQL: the common table expression px.
PX_SQL = f"""
sky AS (SELECT vec_id AS y, unnest(generate_series(0, len(embedding) - 1)) AS x, unnest(embedding)::DOUBLE AS t FROM embeddings),
wins AS (SELECT b.b * 2 + c.c AS panel_id, c.lo, c.hi, b.b * {BAND} AS y0, b.b * {BAND} + {BAND + OVER} AS y1
  FROM (SELECT unnest(generate_series(0, (SELECT max(vec_id) // {BAND} FROM embeddings))) AS b) b, (VALUES (0, {COLUMNS[0][0]}, {COLUMNS[0][1]}), (1, {COLUMNS[1][0]}, {COLUMNS[1][1]})) c(c, lo, hi)),
chans AS (SELECT unnest(generate_series(0, {CHANNELS - 1})) AS ch),
px AS (SELECT panel_id, ch, x, y, CASE WHEN (x * 31 + y * 17 + panel_id * 13 + ch * 5) % 1009 = 0 THEN 0
  ELSE floor(((CASE WHEN ch = 0 THEN t + 0.6 ELSE t * 0.5 + 0.45 END + CASE WHEN {STAR} THEN {GLOW}::DOUBLE ELSE 0 END) * (1.0::DOUBLE + ((panel_id * 7) % 5 - 2) * 0.05::DOUBLE) + ((panel_id * 3) % 7 - 3) * 0.002::DOUBLE) * {SCALE} + 0.5)::BIGINT END AS v
  FROM sky, wins, chans WHERE x >= lo AND x < hi AND y >= y0 AND y < y1)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panel_id, x0, y0, x1, y1: where panels lie, clipped to the sky (exclusive upper bounds)."""
    top = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg((F.max("vec_id") + 1).alias("h"))
    cols = F.array(*(F.struct(F.lit(i).alias("c"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for i, (a, b) in enumerate(COLUMNS)))
    rows = top.where("h is not null").withColumn("b", F.explode(F.expr(f"sequence(0L, (h - 1) div {BAND})"))).withColumn("c", F.explode(cols))
    return rows.select((F.col("b") * 2 + F.col("c.c")).alias("panel_id"), F.col("c.x0").cast("long").alias("x0"), (F.col("b") * BAND).alias("y0"), F.col("c.x1").cast("long").alias("x1"), F.least(F.col("b") * BAND + BAND + OVER, F.col("h")).alias("y1"))
