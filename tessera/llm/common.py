"""What the operators of this package share: tables, materialised intermediate results, text chunks."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; where that is unset, one of our own: in the warehouse, or, if all of Spark runs in this process, a temporary one."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if _own_dir is None:
        if spark.sparkContext.master.startswith("local"):
            _own_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
        else:
            _own_dir = f"{spark.conf.get('spark.sql.warehouse.dir')}/tessera-{uuid.uuid4().hex}"
    return _own_dir


def materialise(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write df as a table in the shared folder (zstandard at that level) and read it back. The new frame has no lineage, so lost executors cost a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table behind a frame of materialise() that no later step reads."""
    path = getattr(df, "_tessera_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def text_runs(text: pa.Array, most: int = 1_500_000) -> list[tuple[int, int]]:
    """First and last (exclusive) row of runs of texts that have about `most` bytes together."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy()
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if lo < hi]


def map_texts(df: DataFrame, keep: list[str], run: Callable, fields: str, most: int = 1_500_000) -> DataFrame:
    """The columns `keep` of df and new ones that `run` makes from its column text, by Arrow batches.

    run(texts) returns the new columns as lists, or (rows, columns) where rows says which input row each output
    row comes from. It gets runs of rows whose texts have about `most` characters together, so that memory
    follows neither the batch's row count nor that of the partition.
    """
    new = StructType.fromDDL(fields)
    schema = StructType([df.schema[k] for k in keep] + list(new))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in new]
        for batch in batches:
            text = batch.column(len(keep))
            for lo, hi in text_runs(text, most):
                cols = run(text.slice(lo, hi - lo).to_pylist())
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                if isinstance(cols, tuple):
                    rows = pa.array(cols[0], pa.int64())
                    kept, cols = [k.take(rows) for k in kept], cols[1]
                yield pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    return df.select(*keep, "text").mapInArrow(mapped, schema)


def common_subsequence(own: list, other: list) -> list[tuple[int, int]]:
    """(place in own, place in other) of a longest common subsequence: for each element its places in the other from last to first, then a longest increasing run."""
    places: dict = {}
    for j, h in enumerate(other):
        places.setdefault(h, []).append(j)
    tails: list[int] = []
    chain: list[tuple] = []
    for i, h in enumerate(own):
        for j in reversed(places.get(h, ())):
            k = bisect_left(tails, j)
            link = (i, j, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(link)
            else:
                tails[k], chain[k] = j, link
    out, link = [], chain[-1] if chain else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


_UNSAFE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S) ")


def chunks(text: str) -> list[str]:
    """Cut a text at each space that follows a non-space; every chunk but the first stands for itself with that space in front.

    A pre-tokeniser pattern whose matches take white space only as one leading space or as runs of white space
    never has a match that crosses such a cut, so chunks can be encoded on their own.
    """
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


class ChunkCoder:
    """Encodes texts chunk by chunk and remembers the codes of at most `limit` chunks."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 400_000, longest: int = 64):
        self.encode_many, self.limit, self.longest = encode_many, limit, longest
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's code: its chunks' codes, joined."""
        if len(self.later) + len(self.first) > self.limit:
            self.first, self.later = {}, {}
        first, later = self.first, self.later
        cut = [chunks(t) for t in texts]
        heads = list({c[0] for c in cut} - first.keys())
        rest = list(set().union(*(c[1:] for c in cut)) - later.keys())
        codes = self.encode_many(heads + [" " + c for c in rest])
        long: list[str] = []
        first.update(zip(heads, codes))
        later.update(zip(rest, codes[len(heads) :]))
        out = [first[c[0]] + b"".join(map(later.__getitem__, c[1:])) for c in cut]
        for known, new in ((first, heads), (later, rest)):  # long chunks hardly recur and would fill the memory
            long = [c for c in new if len(c) > self.longest]
            for c in long:
                del known[c]
        return out
