"""FITS and PNG output of mosaics in strips (y, x0, vals: samples by channel, null where nothing is covered).

FITS: the driver writes the header and sets the file's size, tasks write their strips at their places in it, the commit checks that every row
came. PNG: tasks compress blocks of rows, the driver joins the compressed blocks (64 Mpx at most). So paths must be on a file
system that the driver and all executors share and that can write at any place.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.summary import band_arrays, by_channel, scan, values_of_rank

BLOCK, CARD, MOST_PNG = 2880, 80, 64_000_000
#: Keywords that describe the file itself and are not passed on.
OWN = frozenset("SIMPLE BITPIX EXTEND BSCALE BZERO END ROWORDER".split())
#: Keywords of an earlier geometry, and beginnings of such, dropped when panels were reprojected.
GEOMETRY = frozenset("RA DEC OBJCTRA OBJCTDEC RADESYS EQUINOX EPOCH LONPOLE LATPOLE".split())
GEOMETRY_STARTS = ("CRVAL", "CRPIX", "CDELT", "CROTA", "CTYPE", "CUNIT", "CD1_", "CD2_", "PC1_", "PC2_", "PV1_", "PV2_")


def card(name: str, value: object, comment: str = "") -> bytes:
    """An 80-character card: strings from column 11, numbers right-justified to column 30."""
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{value:>20}"
    elif isinstance(value, float):
        text = f"{(f'{value:.1f}' if value == int(value) else repr(value)):>20}"
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    line = f"{name:<8}= {text}" + (f" / {comment}" if comment else "")
    return "".join(c if 32 <= ord(c) < 127 else " " for c in line)[:CARD].ljust(CARD).encode()


def pass_on(keywords: list[tuple[str, object, str]], crop: tuple[int, int]) -> list[tuple[str, object, str]]:
    """Keywords for the output: those of the old file's form go, reference pixels move with the crop (those that are no numbers stay as they are)."""
    out = []
    for name, value, comment in keywords:
        key = name.strip().upper()
        if key in OWN or key.startswith("NAXIS"):
            continue
        if key in ("CRPIX1", "CRPIX2"):
            try:
                value = float(value) - crop[int(key[-1]) - 1]
            except ValueError:
                pass
        out.append((name, value, comment))
    return out


def geometry_card(name: str) -> bool:
    key = name.strip().upper()
    return key in GEOMETRY or key.startswith(GEOMETRY_STARTS)


def text_value(text: str) -> object:
    """A keyword's text as a card's value: quoted text without its quotes, T and F, numbers; other text as it is."""
    t = text.strip()
    if len(t) > 1 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'").rstrip()
    if t in ("T", "F"):
        return t == "T"
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def fits_header(width: int, height: int, channels: int, keywords: list[tuple[str, object, str]] = ()) -> bytes:
    if min(width, height, channels) < 1:
        raise ValueError("an empty image")
    rows = [card("SIMPLE", True), card("BITPIX", -32), card("NAXIS", 3), card("NAXIS1", width), card("NAXIS2", height), card("NAXIS3", channels), card("ROWORDER", "TOP-DOWN"), *(card(*k) for k in keywords), b"END".ljust(CARD)]
    text = b"".join(rows)
    return text + b" " * (-len(text) % BLOCK)


@dataclass
class Fits:
    """A FITS file to write. origin: the canvas pixel (x, y) that is its first."""

    path: str
    width: int
    height: int
    channels: int
    keywords: list = ()
    origin: tuple[int, int] = (0, 0)

    def write(self, mosaic: DataFrame) -> None:
        """ValueError if a row never came; strips outside the file are an error too."""
        head = fits_header(self.width, self.height, self.channels, self.keywords)
        with open(self.path, "wb") as f:
            f.write(head)
            size = len(head) + 4 * self.width * self.height * self.channels
            f.truncate(size + -size % BLOCK)
        spark = mosaic.sparkSession
        spark.dataSource.register(FitsPlaces)
        strips = mosaic.select(F.col("y").cast("long"), F.col("x0").cast("long"), F.col("vals").cast("array<array<double>>"))
        try:
            strips.write.format("fits_places").mode("append").options(file=self.path, at=len(head), width=self.width, height=self.height, channels=self.channels, x=self.origin[0], y=self.origin[1]).save()
        except Exception as e:
            if missing := [line for line in str(e).splitlines() if "rows are missing" in line]:
                raise ValueError(missing[-1].rpartition("ValueError: ")[2]) from None
            raise


@dataclass
class Rows(WriterCommitMessage):
    """Which rows of the file a task wrote something of."""

    came: bytes


class FitsPlaces(DataSource):
    """Writes strips into a FITS file whose header and size are there."""

    @classmethod
    def name(cls) -> str:
        return "fits_places"

    def writer(self, schema: StructType, overwrite: bool) -> PlaceWriter:
        return PlaceWriter(self.options["file"], *(int(self.options[k]) for k in ("at", "width", "height", "channels", "x", "y")))


class PlaceWriter(DataSourceArrowWriter):
    def __init__(self, file: str, at: int, width: int, height: int, channels: int, x: int, y: int):
        self.file, self.at, self.shape, self.origin = file, at, (channels, height, width), (x, y)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Rows:
        channels, height, width = self.shape
        came = np.zeros(height, bool)
        with open(self.file, "r+b") as f:
            for batch in iterator:
                y = batch.column(0).to_numpy() - self.origin[1]
                came[y] = True
                for rows, x, v in band_arrays(batch.column(1), filled(batch.column(2))):
                    x -= self.origin[0]
                    if v.shape[1] != channels or x < 0 or x + v.shape[2] > width or y[rows].min() < 0:
                        raise ValueError(f"a strip of {v.shape[1]} channels at {x} that the file has no place for")
                    for line, one in zip(y[rows].tolist(), v.astype(">f4")):
                        for c in range(channels):
                            f.seek(self.at + 4 * ((c * height + line) * width + x))
                            f.write(one[c].tobytes())
        return Rows(np.packbits(came).tobytes())

    def commit(self, messages: list[Rows | None]) -> None:
        came = np.zeros(-(-self.shape[1] // 8), np.uint8)
        for m in messages:
            came |= np.frombuffer(m.came, np.uint8) if m else 0
        missing = np.flatnonzero(np.unpackbits(came, count=self.shape[1]) == 0)
        if len(missing):
            raise ValueError(f"{len(missing)} rows are missing, the first is {missing[0]}")

    def abort(self, messages: list[Rows | None]) -> None:
        pass


def filled(vals: pa.ListArray) -> pa.ListArray:
    """Strips' values with 0 for null."""
    inner = vals.values
    flat = inner.values.fill_null(0.0)
    return pa.ListArray.from_arrays(vals.offsets, pa.ListArray.from_arrays(inner.offsets, flat))


@dataclass
class Png:
    """An 8-bit stretched picture; one or three channels and 64 Mpx at most. levels: clip and midtone of each channel; by default those of the mosaic's full blocks, of small mosaics of its pixels."""

    path: str
    width: int
    height: int
    channels: int
    levels: dict[int, tuple[float, float]] | None = None
    origin: tuple[int, int] = (0, 0)

    def __post_init__(self):
        if self.width * self.height > MOST_PNG or self.channels not in (1, 3):
            raise ValueError("too large, or not 1 or 3 channels")

    def write(self, mosaic: DataFrame, lines: int = 64) -> None:
        (x0, y0), width, height, channels = self.origin, self.width, self.height, self.channels
        levels = stretch_levels(mosaic_samples(mosaic)) if self.levels is None else self.levels

        def run(key: tuple, t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            first = int(key[0].as_py()) * lines
            y = t["y"].to_numpy() - y0 - first
            picture = np.zeros((min(lines, height - first), 1 + width * channels), np.uint8)
            pixels = picture[:, 1:].reshape(len(picture), width, channels)
            for rows, x, v in band_arrays(t["x0"].chunk(0), filled(t["vals"].chunk(0))):
                for c in range(channels):
                    clip, m = levels.get(c, (0.0, 0.5))
                    s = np.clip((v[:, c] - clip) / (1 - clip), 0, 1)
                    pixels[y[rows], x - x0 : x - x0 + v.shape[2], c] = np.floor(np.where(s >= 1, 1.0, (m - 1) * s / ((2 * m - 1) * s - m)) * 255 + 0.5)
            packed = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = packed.compress(picture.tobytes()) + packed.flush(zlib.Z_FULL_FLUSH)
            return pa.table({"block": pa.array([first // lines], pa.int64()), "data": pa.array([data], pa.binary()), "sum": pa.array([zlib.adler32(picture.tobytes())], pa.int64()), "size": pa.array([picture.size], pa.int64())})

        blank = mosaic.sparkSession.range(-(-height // lines)).select((F.col("id") * lines + y0).alias("y"), F.lit(x0).cast("long").alias("x0"), F.expr("cast(array() as array<array<double>>)").alias("vals"))
        strips = mosaic.select("y", "x0", F.col("vals").cast("array<array<double>>").alias("vals")).unionByName(blank)
        blocks = strips.groupBy(F.expr(f"(y - {y0}) div {lines}").alias("block")).applyInArrow(run, "block long, data binary, sum long, size long").orderBy("block")
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        total = 1
        with open(self.path, "wb") as f:
            f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c"))
            for r in blocks.toLocalIterator():  # compressed rows of a picture of bounded size
                f.write(chunk(b"IDAT", bytes(r.data)))
                total = joined_sum(total, r.sum, r.size)
            f.write(chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", total)) + chunk(b"IEND", b""))


def joined_sum(one: int, other: int, size: int) -> int:
    """Adler-32 of two pieces of data, from those of each and the second's size."""
    base, a = 65521, one & 0xFFFF
    high = (one >> 16) + (other >> 16) + size * (a - 1)
    return high % base << 16 | (a + (other & 0xFFFF) - 1) % base


def write(mosaic: DataFrame, *sinks: Fits | Png) -> None:
    """A mosaic to all sinks; of several, it is made once. The first error stops all."""
    kept = mosaic.persist(StorageLevel.DISK_ONLY) if len(sinks) > 1 else mosaic
    try:
        for sink in sinks:
            sink.write(kept)
    finally:
        if len(sinks) > 1:
            kept.unpersist()


def mosaic_samples(mosaic: DataFrame) -> DataFrame:
    """ch, value: means over the mosaic's 8 x 8 blocks of covered pixels that are not 0, which a stretch needs instead of all pixels; the pixels where there is no such block."""
    zero = F.transform("vals", lambda r: F.transform(r, lambda v: F.coalesce(v, F.lit(0.0))))
    sums = scan(mosaic.select(F.lit(0).cast("long").alias("panel_id"), "y", "x0", zero.alias("vals")))
    full = sums.where("n = 64").select("ch", (F.col("s") / 64).alias("value"))
    return full if not full.isEmpty() else mosaic.select(F.posexplode("vals").alias("ch", "row")).select(F.col("ch").cast("long").alias("ch"), F.explode("row").alias("value")).where("value is not null")


def stretch(samples: DataFrame) -> DataFrame:
    """ch, m, mad, clip, midtone from covered samples (value): upper medians; midtone maps the background to a quarter."""
    counts = samples.groupBy("ch", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("n")).persist()
    m = values_of_rank(counts)
    rows = []
    if m:
        mad = values_of_rank(counts.groupBy("ch", F.abs(F.col("value") - by_channel(m)).alias("value")).agg(F.sum("n").alias("n")))
        rows = [(c, m[c], mad[c]) for c in m]
    d = samples.sparkSession.createDataFrame(rows, StructType([counts.schema["ch"], StructField("m", DoubleType()), StructField("mad", DoubleType())]))
    counts.unpersist()
    clip = F.greatest(F.least(F.col("m") - 2.8 * 1.4826 * F.col("mad"), F.lit(0.99)), F.lit(0.0))
    x = (F.col("m") - F.col("clip")) / (1 - F.col("clip"))
    # the m' that solves MTF(m', x) = 1/4
    mid = F.when(x <= 0, 0.5).otherwise((x - 0.25 * x) / (x - 2 * 0.25 * x + 0.25))
    return d.withColumn("clip", clip).withColumn("midtone", mid).select("ch", "m", "mad", "clip", "midtone")


def stretch_levels(samples: DataFrame) -> dict[int, tuple[float, float]]:
    return {r.ch: (r.clip, r.midtone) for r in stretch(samples).collect()}  # a row a channel
