"""Image files as a Spark data source of bands (panel_id, y, x0, vals), read by ranges of bytes.

A partition is a block of rows of one panel, all channels together; bands are tiles of its rows, so that neither a file nor a row has
to fit anywhere. Filters on panel_id, y and x0 reach the source: blocks without a matching row are not opened, and of the others
only the rows and columns that match are read. in_box() writes a region as such filters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from . import xisf

#: Rows of a block and columns of a tile; multiples of a cell's side.
ROWS, COLUMNS = 256, 2048
SCHEMA = "panel_id long, y long, x0 long, vals array<array<float>>"


@dataclass
class Block(InputPartition):
    """Rows of a file's image, and the columns of the tiles to read."""

    path: str
    panel: int
    width: int
    height: int
    channels: int
    at: int
    rows: tuple[int, int]
    tiles: tuple[tuple[int, int], ...]


class Range:
    """The whole numbers that a column's filters leave: an interval and perhaps a list."""

    def __init__(self):
        self.low, self.high, self.only = 0, (1 << 62), None

    def add(self, f: Filter) -> bool:
        """Takes a filter into account; False for one that is not understood."""
        match f:
            case EqualTo(_, v):
                self.only = {v} & (self.only if self.only is not None else {v})
            case In(_, vs):
                self.only = set(vs) & (self.only if self.only is not None else set(vs))
            case GreaterThan(_, v):
                self.low = max(self.low, v + 1)
            case GreaterThanOrEqual(_, v):
                self.low = max(self.low, v)
            case LessThan(_, v):
                self.high = min(self.high, v)
            case LessThanOrEqual(_, v):
                self.high = min(self.high, v + 1)
            case IsNotNull(_):
                pass
            case _:
                return False
        return True

    def has(self, v: int) -> bool:
        return self.low <= v < self.high and (self.only is None or v in self.only)

    def within(self, lo: int, hi: int) -> tuple[int, int]:
        """The part of an interval outside which nothing matches."""
        lo, hi = max(lo, self.low), min(hi, self.high)
        if self.only is not None:
            hits = [v for v in self.only if lo <= v < hi]
            lo, hi = (min(hits), max(hits) + 1) if hits else (lo, lo)
        return lo, max(lo, hi)


class Reader(DataSourceReader):
    def __init__(self, files: list[dict], rows: int, columns: int, opener: Callable[[str], BinaryIO]):
        self.files, self.rows, self.columns, self.opener = files, rows, columns, opener
        self.ranges = {c: Range() for c in ("panel_id", "y", "x0")}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) != 1 or column[0] not in self.ranges or not self.ranges[column[0]].add(f):
                yield f

    def partitions(self) -> list[Block]:
        out = []
        for f in self.files:
            if not self.ranges["panel_id"].has(f["panel_id"]) or min(f["width"], f["height"], f["channels"]) < 1:
                continue
            tiles = tuple((x, min(x + self.columns, f["width"])) for x in range(0, f["width"], self.columns) if self.ranges["x0"].has(x))
            lo, hi = self.ranges["y"].within(0, f["height"])
            for y in range(lo // self.rows * self.rows, hi, self.rows):
                rows = max(y, lo), min(y + self.rows, hi)
                if tiles and rows[0] < rows[1]:
                    out.append(Block(f["path"], f["panel_id"], f["width"], f["height"], f["channels"], f["at"], rows, tiles))
        return out or [Block("", 0, 0, 0, 0, 0, (0, 0), ())]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.tiles:
            return
        lo, hi = block.rows
        n = hi - lo
        wanted = np.array([self.ranges["y"].has(y) for y in range(lo, hi)])
        near, far = min(x for x, _ in block.tiles), max(x for _, x in block.tiles)
        planes = np.zeros((block.channels, n, far - near), np.float32)
        with self.opener(block.path) as f:
            for c in range(block.channels):
                place = block.at + 4 * (c * block.height + lo) * block.width
                if 2 * (far - near) >= block.width:  # one read is cheaper than one a row
                    planes[c] = np.frombuffer(xisf.read_range(f, place, 4 * n * block.width), "<f4").reshape(n, block.width)[:, near:far]
                else:
                    for i in np.flatnonzero(wanted).tolist():
                        planes[c, i] = np.frombuffer(xisf.read_range(f, place + 4 * (i * block.width + near), 4 * (far - near)), "<f4")
        y = np.flatnonzero(wanted)
        for x, end in block.tiles:
            v = np.ascontiguousarray(np.moveaxis(planes[:, y, x - near : end - near], 0, 1))
            r, c, w = v.shape
            inner = pa.ListArray.from_arrays(pa.array(np.arange(r * c + 1) * w, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(r, block.panel)), pa.array(y + lo), pa.array(np.full(r, x)), pa.ListArray.from_arrays(pa.array(np.arange(r + 1) * c, pa.int32()), inner)], names=["panel_id", "y", "x0", "vals"])


class Panels(DataSource):
    """Option `files`: JSON of the images' places (a row a file); `rows` and `columns`: size of blocks and tiles."""

    opener: Callable[[str], BinaryIO] = staticmethod(xisf.open_file)

    @classmethod
    def name(cls) -> str:
        return "image_panels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(json.loads(self.options["files"]), int(self.options.get("rows", ROWS)), int(self.options.get("columns", COLUMNS)), type(self).opener)


def places(spark: SparkSession, paths: list[str] | str, open_file: Callable[[str], BinaryIO] = xisf.open_file) -> list[dict]:
    """path, panel_id (files in the order of their paths), width, height, channels and at (where the pixels start) of each file; tasks read the headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"]):
                with open_file(path) as f:
                    rows.append((path, *xisf.image(xisf.header(f), length)[1:]))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "channels", "at"])

    found = xisf.listed(spark, paths).mapInPandas(run, "path string, width long, height long, channels long, at long").collect()
    return [{"panel_id": i, **r.asDict()} for i, r in enumerate(sorted(found, key=lambda r: r.path))]


def read_panels(spark: SparkSession, paths: list[str] | str, open_file: Callable[[str], BinaryIO] = xisf.open_file, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """Bands of all files. Turns the session's pushdown of filters into Python data sources on."""
    if rows % 8 or columns % 8:
        raise ValueError("blocks and tiles are multiples of 8")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(type("PanelsOf", (Panels,), {"opener": staticmethod(open_file)}))
    return spark.read.format("image_panels").option("files", json.dumps(places(spark, paths, open_file))).option("rows", rows).option("columns", columns).load()


def in_box(bands: DataFrame, box: tuple[int, int, int, int], panels: list[int] | None = None, columns: int = COLUMNS) -> DataFrame:
    """Bands that may meet a box (x0, y0, x1, y1, exclusive), by filters that sources and stored tables can use. columns: the widest band."""
    x0, y0, x1, y1 = box
    out = bands.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x0") < x1) & (F.col("x0") > x0 - columns))
    return out if panels is None else out.where(F.col("panel_id").isin(panels))
