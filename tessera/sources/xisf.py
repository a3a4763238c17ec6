"""Monolithic image files (XISF): header, properties and keywords. Their pixels are read by the data source in panels.py.

Spark lists the files; tasks open them and read ranges of bytes: headers without pixels. `open_file` opens a path for that; the default
takes what pyarrow's file systems take. Only uncompressed, planar, little-endian Float32 images are read.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"XISF0100"
HEADERS = "path string, width long, height long, channels long, keywords array<struct<name:string,value:string,comment:string>>, properties array<struct<id:string,type:string,str:string,f64:double,i64:long,f64s:array<double>,rows:int,cols:int>>"


def open_file(path: str) -> BinaryIO:
    """A file of Spark's listing, for reading at any place."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest or path).lstrip("/"))
    store, inner = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    return store.open_input_file(inner)


def read_range(f: BinaryIO, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(size)


def header(f: BinaryIO) -> ET.Element:
    """The header of an open file; nothing behind it is read."""
    start = read_range(f, 0, 16)
    if start[:8] != MAGIC or len(start) < 16:
        raise ValueError("not an XISF file")
    size = struct.unpack_from("<I", start, 8)[0]
    text = f.read(size)
    if len(text) < size:
        raise ValueError("header is cut off")
    return ET.fromstring(text.rstrip(b"\0"))


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def image(root: ET.Element, size: int) -> tuple[ET.Element, int, int, int, int]:
    """(element, width, height, channels, offset) of the first image; ValueError for what is not supported."""
    e = next((x for x in root.iter() if _local(x) == "Image"), None)
    if e is None:
        raise ValueError("no image")
    form = re.fullmatch(r"(\d+):(\d+):(\d+)", e.get("geometry", ""))
    if not form:
        raise ValueError("geometry is not width:height:channels")
    w, h, ch = map(int, form.groups())
    if e.get("sampleFormat") != "Float32":
        raise ValueError(f"sample format {e.get('sampleFormat')}")
    if e.get("compression"):
        raise ValueError("compressed")
    if e.get("pixelStorage", "Planar") != "Planar" or e.get("byteOrder", "little") != "little":
        raise ValueError("not planar, or not little-endian")
    place = re.fullmatch(r"attachment:(\d+):(\d+)", e.get("location", ""))
    if not place:
        raise ValueError("not an attachment")
    at, length = map(int, place.groups())
    if length != w * h * ch * 4 or at % 4 or at + length > size:
        raise ValueError("attachment doesn't fit the geometry or the file")
    return e, w, h, ch, at


def decode_base64(s: str) -> bytes | None:
    try:
        return base64.b64decode(re.sub(r"\s", "", s), validate=True)
    except binascii.Error:
        return None


def decode_hex(s: str) -> bytes | None:
    try:
        return bytes.fromhex(re.sub(r"\s", "", s))
    except ValueError:
        return None


def read_property(e: ET.Element, f: BinaryIO) -> dict:
    """A property's typed value, from the header or from its place in the file; what can't be read has none."""
    kind, text = e.get("type", ""), e.get("value") if e.get("value") is not None else (e.text or "").strip()
    out = dict.fromkeys(("str", "f64", "i64", "f64s", "rows", "cols")) | {"id": e.get("id"), "type": kind}
    if kind in ("F64Vector", "F64Matrix"):
        n = int(e.get("length", 0)) if kind == "F64Vector" else int(e.get("rows", 0)) * int(e.get("columns", 0))
        where = e.get("location", "")
        raw = None
        if where == "inline:base64":
            raw = decode_base64(e.text or "")
        elif where == "inline:hex":
            raw = decode_hex(e.text or "")
        elif m := re.fullmatch(r"attachment:(\d+):(\d+)", where):
            at, size = map(int, m.groups())
            raw = read_range(f, at, size) if size == 8 * n else None
        if raw is not None and len(raw) == 8 * n:
            out["f64s"] = np.frombuffer(raw, "<f8").tolist()
            if kind == "F64Matrix":
                out["rows"], out["cols"] = int(e.get("rows")), int(e.get("columns"))
    elif kind == "Boolean":
        out["i64"] = {"1": 1, "true": 1, "0": 0, "false": 0}.get(text.lower())
    elif re.fullmatch(r"U?Int\d+|Byte|Short|UInt|Int", kind):
        out["i64"] = int(text)
    elif kind in ("Float32", "Float64", "Float", "Double"):
        out["f64"] = float(text)
    else:
        out["str"] = text
    return out


def listed(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, length. Without its column `content` the reader lists files and opens none."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def scan_headers(spark: SparkSession, paths: list[str] | str, open_file: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """A row a file: geometry, keywords and properties of its first image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"]):
                with open_file(path) as f:
                    root = header(f)
                    e, w, h, ch, _ = image(root, length)
                    keys = [{k: x.get(k) for k in ("name", "value", "comment")} for x in e if _local(x) == "FITSKeyword"]
                    rows.append((path, w, h, ch, keys, [read_property(x, f) for x in root.iter() if _local(x) == "Property"]))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "channels", "keywords", "properties"])

    return listed(spark, paths).mapInPandas(run, HEADERS)


def encode(planes: np.ndarray, properties: str = "", keywords: str = "", at: int = 4096) -> bytes:
    """A file's bytes; planes: channels x height x width."""
    ch, h, w = planes.shape
    xml = f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0"><Image geometry="{w}:{h}:{ch}" sampleFormat="Float32" colorSpace="Gray" location="attachment:{at}:{planes.size * 4}">{keywords}{properties}</Image></xisf>'.encode()
    head = MAGIC + struct.pack("<II", len(xml), 0) + xml
    if len(head) > at:
        raise ValueError("header is longer than its place")
    return head + b"\0" * (at - len(head)) + planes.astype("<f4").tobytes()
