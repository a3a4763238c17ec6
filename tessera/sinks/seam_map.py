"""A picture of who owns which cell: stretched preview, tinted by owner, darker along boundaries."""

from __future__ import annotations

import colorsys
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINT, EDGE = 0.4, 0.3


def tint(panel: int) -> tuple[float, float, float]:
    """Twelve hues, neighbours in number far apart."""
    return colorsys.hsv_to_rgb((5 * panel % 12) / 12, 1.0, 1.0)


def seam_colours(owner: DataFrame, preview: DataFrame, boundary: DataFrame) -> DataFrame:
    """x8, y8, r, g, b (0 to 1). preview: x8, y8, ch, value; brightness runs from the darkest to the brightest cell."""
    light = preview.groupBy("x8", "y8").agg(F.avg("value").alias("l"))
    lo, hi = light.agg(F.percentile("l", F.lit(0.01)), F.percentile("l", F.lit(0.99))).first()
    level = F.greatest(F.least((F.col("l") - (lo or 0.0)) / (((hi or 0.0) - (lo or 0.0)) or 1.0), F.lit(1.0)), F.lit(0.0))
    hue = F.element_at(F.array(*(F.array(*(F.lit(float(v)) for v in tint(p))) for p in range(12))), (F.col("owner") % 12 + 1).cast("int"))
    edge = boundary.select("x8", "y8").distinct().withColumn("edge", F.lit(EDGE))
    c = owner.join(light, ["x8", "y8"], "left").join(edge, ["x8", "y8"], "left")
    shade = F.coalesce(level, F.lit(0.0))
    return c.select("x8", "y8", *(((shade * (1 - TINT) + shade * TINT * F.element_at(hue, i + 1)) * F.coalesce("edge", F.lit(1.0))).alias(n) for i, n in enumerate("rgb")))


def write_seam_map(colours: DataFrame, path: str, w8: int, h8: int) -> None:
    """One pixel a cell; rows arrive in order and only one is held."""
    z, body, done = zlib.compressobj(6), b"", 0
    for r in colours.groupBy("y8").agg(F.collect_list(F.struct("x8", "r", "g", "b")).alias("c")).orderBy("y8").toLocalIterator():
        body += z.compress(b"\0" * ((1 + 3 * w8) * (r.y8 - done)))
        line = np.zeros((w8, 3), np.uint8)
        for e in r.c:
            line[e.x8] = [round(255 * v) for v in (e.r, e.g, e.b)]
        body += z.compress(b"\0" + line.tobytes())
        done = r.y8 + 1
    body += z.compress(b"\0" * ((1 + 3 * w8) * (h8 - done))) + z.flush()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w8, h8, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b""))
