"""Connected components of links, by contraction in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links that one task joins at most; more are contracted first.
FEW = 1 << 18


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, from links a, b: the smaller root is handed on and paths are halved, in rounds."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label from links a, b, at most FEW."""
    found = [np.zeros((2, 0), np.int64), *(np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches)]
    node, at = np.unique(np.concatenate(found, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[joined(len(node), a, b)])], names=["node", "label"])


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """node, label (the smallest node reachable) of every node in the links (whole numbers; order and repeats don't matter).

    Each round nodes are put in an order of hashes, another one each time, every node goes to the first of its neighbours and itself, and
    links are contracted to those. In any graph, chains of ascending numbers too, a third or so of the nodes goes in a round, so rounds follow
    the logarithm of the links. What is left of `few` links one task joins. A round's tables go to Spark's checkpoint folder where there is
    one, else they are kept in memory and on disk.
    """
    edges = kept(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct())
    group: DataFrame | None = None
    turn = 0
    while edges.count() > few:
        order = lambda c, k=turn: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = kept(both.groupBy("a").agg(F.min(order("b")).alias("f")).select("a", F.least(order("a"), F.col("f"))["n"].alias("p")))
        pa_, pb = first.select("a", F.col("p").alias("pa")), first.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = kept(edges.join(pa_, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        group = kept(first.select(F.col("a").alias("node"), F.col("p").alias("group")) if group is None else _renamed(group, first.select(F.col("a").alias("group"), F.col("p").alias("new"))))
        turn += 1
    last = edges.coalesce(1).mapInArrow(_join, "node long, label long")
    if group is None:
        return last
    whole = kept(_renamed(group, last.select(F.col("node").alias("group"), F.col("label").alias("new"))))
    least = whole.groupBy("group").agg(F.min("node").alias("label"))  # groups' names are any of their nodes
    return whole.join(least, "group").select("node", "label")


def _renamed(group: DataFrame, names: DataFrame) -> DataFrame:
    return group.join(names, "group", "left").select("node", F.coalesce("new", "group").alias("group"))


def kept(df: DataFrame) -> DataFrame:
    """A small table that many steps read, made once: a checkpoint where Spark has a folder for them, else persisted."""
    context = df.sparkSession.sparkContext
    return df.checkpoint() if context._jsc.sc().getCheckpointDir().isDefined() or context.getConf().get("spark.checkpoint.dir") else df.persist()
