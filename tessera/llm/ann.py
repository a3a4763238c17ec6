"""Approximate nearest neighbours by inner product: NN-descent builds the graph, queries search it greedily.

Vectors are scaled by powers of 16 of the longest one, so that each scale's lengths lie within a factor of 16; graphs are built
within a scale. There vectors get one more component that brings all to one length, which turns largest inner product into
smallest distance. Equal vectors are one node. Random-projection trees, fitted on a bounded sample, deal nodes into leaves
for a first graph; then each round joins every node's neighbours and reverse neighbours with each other
(neighbours of neighbours) and keeps the nearest. Nodes with many reverse neighbours are split into parts, in another
way each round, and all their pairs stay open. Lists are merged in bounded memory, first within tasks, so hubs are no large groups.

A query searches each scale. It starts from some landmarks of it (all its nodes, where these are few) and its own node's
neighbours. Each round expands the nearest nodes of its beam that have not been expanded: a join with the neighbour lists,
which carry half-precision vectors and stay partitioned by node. When no beam changes, the beam's vectors are scored in double
precision on the originals.

Defined cases: vectors that are null, zero or hold null or non-finite components, and null vec_ids, take no part;
vectors of different lengths have no inner product and are searched apart (lengths that few rows have: exactly);
rows with one vec_id are separate candidates and queries; ties go to the smaller vec_id; with fewer candidates than k all
that are found are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table


@dataclass(frozen=True)
class Settings:
    """neighbours kept a node while building, and in the searched lists (with the nearest reverse ones); trees and
    leaf size of the first graph; most rounds of NN-descent, ended earlier when fewer than `settled` of all entries
    change; nodes that a local join takes together; beam of a search and expansions a round; rows of the tree sample and
    landmarks (of a scale both); rows up to which a vector length that is not the most frequent one is searched exactly."""

    build: int = 28
    searched: int = 48
    trees: int = 10
    leaf: int = 256
    rounds: int = 6
    settled: float = 0.02
    together: int = 96
    beam: int = 192
    expand: int = 40
    sample: int = 8192
    landmarks: int = 64
    few: int = 4096
    seed: int = 7


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    e = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0))


def augmented(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 at most with the component that makes it 1."""
    return np.concatenate([x, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))[:, None]], 1)


def _vectors(codes: list[bytes]) -> np.ndarray:
    """Half-precision vectors of one length as single-precision rows."""
    return np.frombuffer(b"".join(codes), np.float16).reshape(len(codes), -1).astype(np.float32)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first `keys` columns; rows come sorted."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _emit(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)
            held = []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)


#: Finds that a task holds before it sends its nodes' best on.
_HELD = 200_000
_LISTS = (["u", "vs", "ss"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32())])
_LISTS_DDL = "u long, vs array<long>, ss array<float>"


class Tree:
    """A random-projection tree over a sample: inner nodes split by the hyperplane midway between two of their points."""

    def __init__(self, sample: np.ndarray, least: int, rng: np.random.Generator):
        self.normals, self.offsets, self.children = [], [], []
        self.leaves = 0
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            sides = None
            if len(own) > least:
                a, b = sample[rng.choice(own, 2, replace=False)]
                normal = a - b
                at = sample[own] @ normal
                offset = np.median(at)
                sides = own[at <= offset], own[at > offset]
            if sides and len(sides[0]) and len(sides[1]):
                me = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append([0, 0])
                todo += [(sides[0], me, 0), (sides[1], me, 1)]
            else:
                me = -1 - self.leaves
                self.leaves += 1
            if parent >= 0:
                self.children[parent][side] = me
        self.normals = np.array(self.normals or np.zeros((0, sample.shape[1])), np.float32)
        self.offsets, self.children = np.array(self.offsets, np.float32), np.array(self.children, np.int64).reshape(-1, 2)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.normals) else np.full(len(x), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            n = at[open_]
            right = np.einsum("ij,ij->i", x[open_], self.normals[n]) > self.offsets[n]
            at[open_] = self.children[n, right.astype(np.int64)]
        return -1 - at


def _local_join(rows: list[tuple], keep: int, size: int) -> Iterator[tuple]:
    """Rows (..., node, fresh, worst, vec): for each node the nearest others it doesn't know to be too far; pairs of two nodes that both met before are left out."""
    for lo in range(0, len(rows), size):
        part = rows[lo : lo + size]
        if len(part) < 2:
            continue
        node = np.array([r[-4] for r in part])
        fresh = np.array([r[-3] for r in part])
        worst = np.array([r[-2] for r in part], np.float32)
        x = augmented(_vectors([r[-1] for r in part]))
        s = x @ x.T
        s[(node[:, None] == node[None, :]) | ~(fresh[:, None] | fresh[None, :])] = -np.inf
        k = min(keep, len(part) - 1)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        val = np.take_along_axis(s, top, 1)
        good = val > worst[:, None]
        for i in np.flatnonzero(good.any(1)).tolist():
            g = good[i]
            yield int(node[i]), node[top[i][g]].tolist(), val[i][g].tolist()


def _merged(lists: DataFrame, keep: int) -> DataFrame:
    """One list a node: the nearest `keep` of all its lists, and which of them are new (from lists with old = false and in none with old = true).

    A node's lists are read one by one, old ones first; no more than a few times `keep` entries are held.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            at, best, known = None, {}, set()

            def ended() -> tuple:
                order = sorted(best, key=lambda v: (-best[v], v))[:keep]
                return at, order, [best[v] for v in order], [v not in known for v in order]

            for b in batches:
                for u, old, vs, ss in zip(*(c.to_pylist() for c in b.columns)):
                    if u != at:
                        if at is not None:
                            yield ended()
                        at, best, known = u, {}, set()
                    best.update(zip(vs, ss))
                    if old:
                        known.update(vs)
                    if len(best) > 8 * keep:
                        best = {v: best[v] for v in sorted(best, key=lambda v: (-best[v], v))[:keep]}
            if at is not None:
                yield ended()

        yield from _emit(rows(), [*_LISTS[0], "fresh"], [*_LISTS[1], pa.list_(pa.bool_())])

    return lists.select("u", "old", "vs", "ss").repartition("u").sortWithinPartitions("u", F.desc("old")).mapInArrow(merge, _LISTS_DDL + ", fresh array<boolean>")


def _combined(finds: Iterator[tuple], keep: int) -> Iterator[pa.RecordBatch]:
    """Lists from finds (u, vs, ss), those of one u together and cut to the nearest `keep` as far as a task's memory goes."""

    def rows() -> Iterator[tuple]:
        held: dict[int, dict[int, float]] = {}
        count = 0
        for u, vs, ss in finds:
            held.setdefault(u, {}).update(zip(vs, ss))
            count += len(vs)
            if count > _HELD:
                yield from _best(held, keep)
                held, count = {}, 0
        yield from _best(held, keep)

    yield from _emit(rows(), *_LISTS)


def first_graph(nodes: DataFrame, scales: list[int], o: Settings) -> DataFrame:
    """Neighbour lists from the leaves of random-projection trees; leaves of more than o.leaf nodes are split at random."""
    rng, fitted = np.random.default_rng(o.seed), {}
    for scale in scales:
        sample = nodes.where(F.col("scale") == scale).orderBy(F.xxhash64("node"), "node").limit(o.sample).select("vec").collect()  # o.sample rows at most
        x = augmented(_vectors([r.vec for r in sample]))
        fitted[scale] = [Tree(x, 24, rng) for _ in range(o.trees)]
    trees = nodes.sparkSession.sparkContext.broadcast(fitted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scale = b.column(1).to_numpy()
            for own in np.unique(scale):
                part = b.take(pa.array(np.flatnonzero(scale == own)))
                v = augmented(_vectors(part.column(2).to_pylist()))
                cells = np.stack([t.leaf(v) + (i << 40) + (int(own) << 48) for i, t in enumerate(trees.value[own])], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells.tolist(), pa.list_(pa.int64()))], names=["node", "cells"])

    dealt = materialise(nodes.select("node", "scale", "vec").mapInArrow(deal, "node long, cells array<long>").select("node", F.explode("cells").alias("cell")), "leaves")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / o.leaf).alias("parts"))
    placed = dealt.join(parts, "cell").select("cell", F.pmod(F.xxhash64("node", "cell"), F.col("parts")).alias("part"), "node")
    rows = placed.join(nodes, "node").select("cell", "part", "node", F.lit(True).alias("fresh"), F.lit(-2.0).cast("float").alias("worst"), "vec")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combined((r for g in _grouped(batches, 2) for r in _local_join(g, o.build, 1 << 30)), o.build)

    lists = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "node").mapInArrow(join, _LISTS_DDL)
    graph = materialise(_merged(lists.withColumn("old", F.lit(False)), o.build), "graph")
    discard(dealt)
    return graph


def descend(nodes: DataFrame, graph: DataFrame, o: Settings, number: int) -> DataFrame:
    """A round of NN-descent: the lists after joining neighbours and reverse neighbours of every node."""
    edges = graph.select("u", F.explode(F.arrays_zip("vs", "fresh")).alias("e")).select("u", F.col("e.vs").alias("v"), F.col("e.fresh").alias("fresh"))
    both = edges.select(F.col("u").alias("pivot"), F.col("v").alias("node"), "fresh").unionByName(edges.select(F.col("v").alias("pivot"), F.col("u").alias("node"), "fresh"))
    both = both.groupBy("pivot", "node").agg(F.max("fresh").alias("fresh"))
    parts = both.groupBy("pivot").agg(F.ceil(F.count("*") / o.together).alias("parts"), F.max("fresh").alias("any")).where("any").drop("any")
    worst = graph.select(F.col("u").alias("node"), F.when(F.size("ss") < o.build, F.lit(-2.0)).otherwise(F.array_min("ss")).cast("float").alias("worst"))
    own = nodes.join(worst, "node", "left").select("node", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"), "vec")
    # nodes of a split pivot may not have met in another part: they stay fresh
    part = F.pmod(F.xxhash64("node", "pivot", F.lit(number)), F.col("parts")).alias("part")
    rows = both.join(parts, "pivot").select("pivot", part, "node", (F.col("fresh") | (F.col("parts") > 1)).alias("fresh")).join(own, "node").select("pivot", "part", "node", "fresh", "worst", "vec")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combined((r for g in _grouped(batches, 2) for r in _local_join(g, o.build, 1 << 30)), o.build)

    found = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "node").mapInArrow(join, _LISTS_DDL)
    lists = graph.select("u", F.lit(True).alias("old"), "vs", "ss").unionByName(found.withColumn("old", F.lit(False)))
    return materialise(_merged(lists, o.build), "graph")


def _best(held: dict[int, dict[int, float]], keep: int) -> Iterator[tuple]:
    for u, own in held.items():
        order = sorted(own, key=lambda v: (-own[v], v))[:keep]
        yield u, order, [own[v] for v in order]


def release(spark: SparkSession) -> None:
    """Let the driver drop what earlier rounds left: plans, and shuffles that have no reader any more, whose files then go before the next round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def search_lists(nodes: DataFrame, graph: DataFrame, o: Settings) -> DataFrame:
    """node, vs, vecs (the neighbours' vectors, joined): each node's neighbours and nearest reverse neighbours."""

    def reverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _combined(((v, (u,), (x,)) for b in batches for u, vs, ss in zip(*(c.to_pylist() for c in b.columns)) for v, x in zip(vs, ss)), o.searched)

    back = graph.select("u", "vs", "ss").mapInArrow(reverse, _LISTS_DDL)
    lists = _merged(graph.select("u", F.lit(True).alias("old"), "vs", "ss").unionByName(back.withColumn("old", F.lit(False))), o.searched)
    rows = lists.select("u", F.explode("vs").alias("node")).join(nodes, "node").select("u", "node", "vec")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((g[0][0], [r[1] for r in g], b"".join(r[2] for r in g)) for g in _grouped(batches, 1))  # o.searched rows a group at most
        yield from _emit(rows, ["u", "vs", "vecs"], [pa.int64(), pa.list_(pa.int64()), pa.binary()], 256)

    return rows.repartition("u").sortWithinPartitions("u", "node").mapInArrow(gather, "u long, vs array<long>, vecs binary")


_STATE = (["q", "scale", "qvec", "vs", "ss", "open"], [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_())])
_STATE_DDL = "q long, scale int, qvec binary, vs array<long>, ss array<float>, open array<boolean>"


def search(queries: DataFrame, nodes: DataFrame, scales: list[int], lists: DataFrame, o: Settings) -> DataFrame:
    """q, scale and the nodes of its beam there (vs) when the search has ended. queries: q (its node), own (its scale), qvec (single precision)."""
    marks = {}
    for scale in scales:
        rows = nodes.where(F.col("scale") == scale).orderBy(F.xxhash64("node", F.lit(1)), "node").limit(o.landmarks).collect()  # o.landmarks rows
        marks[scale] = [r.node for r in rows], _vectors([r.vec for r in rows])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for q, scale, qvec, vs, vecs in zip(*(c.to_pylist() for c in b.columns)):
                    x = np.frombuffer(qvec, np.float32)
                    best = dict(zip(marks[scale][0], (marks[scale][1] @ x).tolist()))
                    if vs:
                        best.update(zip(vs, (np.frombuffer(vecs, np.float16).reshape(len(vs), -1).astype(np.float32) @ x).tolist()))
                    yield _beam(q, scale, qvec, best, set(), o.beam)

        yield from _emit(rows(), *_STATE, 512)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for q, scale, qvec, worst, vs, vecs in zip(*(c.to_pylist() for c in b.columns)):
                    s = np.frombuffer(vecs, np.float16).reshape(len(vs), -1).astype(np.float32) @ np.frombuffer(qvec, np.float32)
                    good = np.flatnonzero(s > worst)
                    if len(good):
                        yield q, scale, None, [vs[i] for i in good], s[good].tolist(), None

        yield from _emit(rows(), *_STATE, 2048)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for group in _grouped(batches, 2):  # o.expand lists a group at most
                best: dict[int, float] = {}
                qvec, done = b"", set()
                for _, _, vec, vs, ss, open_ in group:
                    if vec is not None:
                        qvec = vec
                        opened = [v for v, is_open in zip(vs, open_) if is_open]
                        done = (set(vs) - set(opened)) | set(opened[: o.expand])
                    best.update(zip(vs, ss))
                yield _beam(*group[0][:2], qvec, best, done, o.beam)

        yield from _emit(rows(), *_STATE, 512)

    each = queries.withColumn("scale", F.explode(F.array(*(F.lit(s) for s in scales)))).withColumn("u", F.when(F.col("scale") == F.col("own"), F.col("q")))
    state = materialise(each.join(lists, "u", "left").select("q", "scale", "qvec", "vs", "vecs").mapInArrow(start, _STATE_DDL), "beams")
    opened = F.slice(F.filter(F.arrays_zip("vs", "open"), lambda e: e["open"]), 1, o.expand)
    while not state.where(F.exists("open", lambda x: x)).isEmpty():
        worst = F.when(F.size("ss") < o.beam, F.lit(float("-inf"))).otherwise(F.array_min("ss")).cast("float")
        frontier = state.select("q", "scale", "qvec", worst.alias("worst"), F.explode(opened).alias("e")).select("q", "scale", "qvec", "worst", F.col("e.vs").alias("u"))
        found = frontier.join(lists, "u").select("q", "scale", "qvec", "worst", "vs", "vecs").mapInArrow(expand, _STATE_DDL)
        after = materialise(state.unionByName(found).repartition("q", "scale").sortWithinPartitions("q", "scale").mapInArrow(merge, _STATE_DDL), "beams")
        discard(state)
        state = after
        release(nodes.sparkSession)
    return state.select("q", "scale", "vs")


def _beam(q: int, scale: int, qvec: bytes, best: dict[int, float], done: set[int], size: int) -> tuple:
    order = sorted(best, key=lambda v: (-best[v], v))[:size]
    return q, scale, qvec, order, [best[v] for v in order], [v not in done for v in order]


_FOUND = "query_id long, query_row long, rank int, vec_id long, score double"
_DOT = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, p: a + p)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Callable, k: int = 20, o: Settings = Settings()) -> DataFrame:
    """query_id, query_row, rank, vec_id, score: the k nearest found of every row whose vec_id satisfies is_query, among all other rows.

    query_row tells rows with one vec_id apart (a number without further meaning).
    """
    own = materialise(valid(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors").withColumn("d", F.size("embedding"))
    lengths = own.groupBy("d").agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], _FOUND)
    large = [most.d] + [r.d for r in lengths.where((F.col("n") > o.few) & (F.col("d") != most.d)).orderBy("d").collect()]  # one in o.few rows at most
    out = None
    for d in large:
        one = _nearest(own.where(F.col("d") == d).drop("d"), is_query, k, o)
        out = one if out is None else out.unionByName(one)
    few = own.where(~F.col("d").isin(large))
    if not few.isEmpty():
        asked = few.where(is_query(F.col("vec_id"))).select("d", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("embedding").alias("y"))
        pairs = asked.join(few, "d").where("row <> query_row").select("query_id", "query_row", "vec_id", "row", _DOT("embedding", "y").alias("score"))
        out = out.unionByName(_ranked(pairs, k))
    return out


def _nearest(own: DataFrame, is_query: Callable, k: int, o: Settings) -> DataFrame:
    """nearest() for vectors of one length. own: vec_id, embedding, row."""
    spark = own.sparkSession
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    norm = most * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    classes = own.groupBy("embedding").agg(F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()).withColumn("norm", norm)
    classes = materialise(classes, "vector-classes")
    longest = classes.agg(F.max("norm")).first()[0]
    classes = classes.withColumn("scale", F.floor(F.log2(F.lit(longest) / F.col("norm")) / 4).cast("int"))

    def scaled(dtype: type) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(2).to_pylist(), np.float64) / b.column(3).to_numpy()[:, None]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary())], names=["node", "scale", "vec"])

        return run

    bound = (F.lit(longest) * F.pow(F.lit(16.0), -F.col("scale"))).alias("bound")
    nodes = materialise(classes.select("node", "scale", "embedding", bound).mapInArrow(scaled(np.float16), "node long, scale int, vec binary"), "nodes")
    scales = [r.scale for r in nodes.select("scale").distinct().orderBy("scale").collect()]  # a few: powers of 16
    graph = first_graph(nodes, scales, o)
    release(spark)
    entries = nodes.count() * o.build
    for number in range(o.rounds):
        after = descend(nodes, graph, o, number)
        discard(graph)
        graph = after
        release(spark)
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if changed <= o.settled * entries:
            break

    # members beyond a class's k + 1 smallest ids can be in no answer
    member = own.join(classes.where("copies > 1"), "embedding").select("node", "vec_id", "row")
    member = member.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id", "row"))).where(F.col("n") <= k + 1).select("node", "vec_id", "row")
    member = member.unionByName(own.join(classes.where("copies = 1"), "embedding").select("node", "vec_id", "row"))
    asked = own.where(is_query(F.col("vec_id"))).join(classes, "embedding").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("node").alias("q"))
    queries = asked.select("q").distinct().join(classes, F.col("q") == F.col("node")).select("node", "scale", "embedding", "norm")
    queries = queries.mapInArrow(scaled(np.float32), "node long, scale int, vec binary").select(F.col("node").alias("q"), F.col("scale").alias("own"), F.col("vec").alias("qvec"))

    lists = search_lists(nodes, graph, o).repartition("u").persist()
    found = materialise(search(queries, nodes, scales, lists, o), "found")
    lists.unpersist()
    best = found.select("q", F.explode("vs").alias("node")).unionByName(found.select("q", F.col("q").alias("node"))).distinct()
    to, by = classes.select("node", F.col("embedding").alias("x")), classes.select(F.col("node").alias("q"), F.col("embedding").alias("y"))
    scored = best.join(to, "node").join(by, "q").select("q", "node", _DOT("x", "y").alias("score"))
    pairs = asked.join(scored, "q").join(member, "node").where("row <> query_row")
    return _ranked(pairs.select("query_id", "query_row", "vec_id", "row", "score"), k)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0).select("query_id", "rank", "vec_id", "score")
