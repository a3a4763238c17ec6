"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct k-word shingles. Each permutation gives two signature values, its minimum
and its maximum, so half as many hash evaluations fill a signature; bands of its values make candidate pairs,
which are confirmed on the full sets. Documents with equal sets are one class from the start.

Within a bucket of equal band values only pairs with the bucket's smallest member are confirmed at first. Buckets
whose members are then in several components are gone through again, in blocks: members outside the largest
component are held against all members of other components. So nothing is capped, no pairs but links leave a
task, and a group whose members are linked with its smallest costs its size, not its square.

Links are contracted to components round by round in Spark. Defined cases: a document without words (or null)
has an empty set and is linked with nothing; fewer words than k make one shingle of all of them; repeated rows
are one class; a null doc_id takes no part (component_id null, kept false); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, materialise, table

#: Permutations (each gives two values), values a band, and the seed of the permutations' factors.
PERMUTATIONS, ROWS, SEED = 64, 4, 20240229
BANDS = 2 * PERMUTATIONS // ROWS
#: Signature estimates below threshold - SLACK rule a pair out: five standard deviations of 128 values at 0.8.
SLACK = 0.18


_factors = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words are sums of a random number for each byte times a power of an odd base for its place, so that a text's words are differences of one running sum.
PIECE = 1 << 18
_bytes = np.random.default_rng(SEED + 1).integers(0, 1 << 64, 256, dtype=np.uint64)
_bytes[65:91] = _bytes[97:123]  # A-Z count as a-z
_base = 0x9E3779B97F4A7C15
_powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, _base, np.uint64)]))
_inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, pow(_base, -1, 1 << 64), np.uint64)]))
_space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words (between ASCII white space, A-Z lower-cased) of a text; long texts go by pieces that end with white space."""
    data = np.frombuffer(text, np.uint8)
    out, at = [], 0
    while at < len(data):
        part = data[at : at + PIECE]
        if at + PIECE < len(data):
            gaps = np.flatnonzero(_space[part])
            if not len(gaps):  # a word longer than a piece
                rest = np.flatnonzero(_space[data[at:]])
                end = at + int(rest[0]) if len(rest) else len(data)
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].tobytes().lower())], np.uint64))
                at = end
                continue
            part = part[: gaps[-1] + 1]
        at += len(part)
        word = np.zeros(len(part) + 2, bool)
        np.logical_not(_space[part], out=word[1:-1])
        edges = np.flatnonzero(word[1:] != word[:-1])
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_bytes[part] * _powers[: len(part)], out=sums[1:])
        start, end = edges[::2], edges[1::2]
        out.append((sums[end] - sums[start]) * _inverse[start])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([np.ones(1, bool), values[1:] != values[:-1]])] if len(values) else values


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """64-bit hashes of a text's k-word shingles, with repeats; of all words if there are fewer."""
    h = word_hashes((text or "").encode())
    n = len(h)
    m = max(1, n - k + 1) if n else 0
    out = np.full(m, min(n, k), np.uint64)
    for i in range(min(n, k)):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles."""
    return distinct(shingle_hashes(text, k))


def node_of(kept: np.ndarray) -> int:
    """A set's own number; equal for equal sets."""
    return xxhash.xxh3_64_intdigest(kept.tobytes()) - (1 << 63)


def signature(kept: np.ndarray) -> np.ndarray:
    """Minima, then maxima, under all permutations."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(kept), 2048):
        values = kept[at : at + 2048, None] * _factors[0] + _factors[1]
        low, high = np.minimum(low, values.min(0)), np.maximum(high, values.max(0))
    return np.concatenate([low, high])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, node, bands (array of bucket numbers), low (a byte of each signature value)."""
    mixer = (np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    of_band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)

    def run(texts: list) -> list:
        out = []
        for text in texts:
            kept = shingles(text, k)
            if len(kept):
                s = signature(kept)
                rows = np.concatenate([s[:PERMUTATIONS], np.roll(s[PERMUTATIONS:], 16)]).reshape(ROWS, BANDS).T  # values of different permutations
                mixed = (rows ^ (rows >> np.uint64(31))) * mixer
                keys = (mixed ^ (mixed >> np.uint64(29))).sum(1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + of_band
                out.append((len(kept), node_of(kept), keys.view(np.int64), (s >> np.uint64(40)).astype(np.uint8).tobytes()))
            else:
                out.append((0, None, None, None))
        return list(zip(*out))

    return map_texts(docs, ["doc_id"], run, "n_shingles long, node long, bands array<long>, low binary")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int, group: int = 256) -> DataFrame:
    """Those of the pairs (a, b: nodes) whose full sets reach the threshold. texts: node, doc_id, text of every node in a pair.

    Pairs are grouped by a; groups of more than `group` pairs are split, and a's text goes to each part.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).alias("parts"))
    split = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    rows = split.select("a", "part", F.col("b").alias("node"), F.lit(1).alias("role")).unionByName(
        sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"), F.lit(0).alias("role"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, done = None, None, None
        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            a_out, b_out = [], []
            for i in range(batch.num_rows):
                a, part, role, node = (c[i].as_py() for c in cols)
                kept = shingles(batch.column(4)[i].as_py(), k)
                if node_of(kept) != node:  # another row of the same doc_id
                    continue
                if role == 0:
                    at, first, done = (a, part), kept, set()
                elif at == (a, part) and node not in done:
                    done.add(node)
                    if reaches(first, kept, percent):
                        a_out.append(a)
                        b_out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    joined = rows.join(texts, "node").select("a", "part", "role", "node", "text")
    return joined.repartition("a", "part").sortWithinPartitions("a", "part", "role", "node").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label of every node in the links (a, b), as a table. Each round every node takes its smallest neighbour's number and links are contracted."""
    edges = materialise(links.where("a <> b").select("a", "b"), "links")
    label: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "parents")
        pa_, pb = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        contracted = edges.join(pa_, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        contracted = materialise(contracted, "links")
        discard(edges)
        edges = contracted
        if label is None:
            label = materialise(parent.select(F.col("a").alias("node"), F.col("p").alias("label")), "labels")
        else:
            step = parent.select(F.col("a").alias("label"), "p")
            further = materialise(label.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
            discard(label)
            label = further
        discard(parent)
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def reaches(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Is the similarity of two sets (sorted) at least percent / 100?"""
    both = int((one[np.minimum(np.searchsorted(one, other), len(one) - 1)] == other).sum())
    return 100 * both >= percent * (len(one) + len(other) - both)


def by_signature(low: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """Rows of `low` that may be similar to `own` (a byte of each signature value), likeliest first."""
    estimate = ((low == own).mean(1) * 256 - 1) / 255
    near = np.flatnonzero(estimate >= percent / 100 - SLACK)
    return near[np.argsort(-estimate[near], kind="stable")]


def cross_links(members: DataFrame, texts: DataFrame, k: int, percent: int, block: int = 512, least: int = 3, likely: Callable[[np.ndarray, np.ndarray, int], np.ndarray] = by_signature) -> DataFrame:
    """Links (a, b) between members of different components in a bucket; enough of them to join all components that any such link joins.

    members: key, node, label, low. Buckets of at least `least` members (of two, the pair is known already) with the same members count once. Members outside the bucket's largest
    component (minors) are held against all members of other components, block by block: `likely` names those that a member
    may be linked with, which are compared on their full sets, likeliest first, until they are in one component. Only links
    leave a task.
    """
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h"))
    buckets = sizes.groupBy("key").agg(F.sum("n").alias("m"), F.sum("h").alias("h"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"))
    open_ = buckets.where(f"labels > 1 and m >= {least}").groupBy("m", "h").agg(F.min(F.struct("key", "main", "n_main")).alias("b")).select("b.*", "m")
    own_blocks = F.ceil(F.col("m") / block).cast("int")
    minor_blocks = F.ceil((F.col("m") - F.col("n_main")) / block).cast("int")
    rows = members.join(open_, "key").withColumn("own", own_blocks).withColumn("minors", minor_blocks).withColumn("h", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    placed = rows.select("key", "node", "label", "low", F.lit(0).alias("role"), F.pmod("h", "own").cast("int").alias("part"), every(F.col("minors")).alias("minor_part")).unionByName(
        rows.where("label <> main").select("key", "node", "label", "low", F.lit(1).alias("role"), every(F.col("own")).alias("part"), F.pmod("h", "minors").cast("int").alias("minor_part"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def compare(minors: dict, rows: dict) -> None:
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    x = up
                return x

            nodes = list(rows)
            low = np.frombuffer(b"".join(rows[n][1] for n in nodes), np.uint8).reshape(len(nodes), -1)
            for node, (label, own_low, kept) in minors.items():
                for i in likely(low, np.frombuffer(own_low, np.uint8), percent).tolist():
                    other = rows[nodes[i]]
                    a, b = find(label), find(other[0])
                    if a != b and reaches(kept, other[2], percent):
                        root[max(a, b)] = min(a, b)
                        out.append((node, nodes[i]))

        at, minors, rows = None, {}, {}
        for batch in batches:
            for key, part, minor_part, role, node, label, low, text in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if at != (key, part, minor_part):
                    if minors and rows:
                        compare(minors, rows)
                    at, minors, rows = (key, part, minor_part), {}, {}
                kept = shingles(text, k)
                if node_of(kept) == node:
                    (minors if role == 1 else rows)[node] = (label, low, kept)
            yield _pairs(out)
            out.clear()
        if minors and rows:
            compare(minors, rows)
        yield _pairs(out)

    placed = placed.join(texts.select("node", "text"), "node").select("key", "part", "minor_part", "role", "node", "label", "low", "text")
    return placed.repartition("key", "part", "minor_part").sortWithinPartitions("key", "part", "minor_part", F.desc("role"), "node").mapInArrow(run, "a long, b long")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    sigs = materialise(signatures(docs, k), "signatures")
    with_words = sigs.where("node is not null and doc_id is not null")
    nodes = materialise(with_words.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("low").alias("low")), "classes")

    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("m")).where("m > 1").select("key", "first")
    members = materialise(keys.join(shared, "key"), "buckets")
    of_node = joined_nodes(nodes, members, docs, k, percent)
    out = sigs.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def joined_nodes(nodes: DataFrame, members: DataFrame, docs: DataFrame, k: int, percent: int, likely: Callable = by_signature, allowed: Callable = lambda pairs: pairs, open_: Callable | None = None) -> DataFrame:
    """node, component_id (smallest doc_id of the component) as a table; the tables `nodes` (node, rep, low) and `members` (key, node, first: buckets with their smallest node) go.

    allowed: leaves pairs (a, b) out that can't be links; open_: leaves members (key, node, label, low) out that can't have links beyond their label.
    """
    stars = materialise(allowed(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()), "pairs")
    involved = members.select("node").distinct().join(nodes.select("node", F.col("rep").alias("doc_id")), "node")
    texts = materialise(docs.select("doc_id", "text").join(involved, "doc_id").select("node", "doc_id", "text"), "texts")
    links = materialise(confirm(stars, texts, k, percent), "links")
    label = components(links)
    labelled = members.join(nodes.select("node", "low"), "node").join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "low")
    more = cross_links(open_(labelled), texts, k, percent, least=2, likely=likely) if open_ else cross_links(labelled, texts, k, percent, likely=likely)
    more = materialise(more, "links")
    if not more.isEmpty():
        discard(label)
        label = components(links.unionByName(more))
    grouped = nodes.select("node", "rep").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    out = materialise(grouped.join(smallest, "label").select("node", "component_id"), "components")
    for done in (stars, texts, links, more, label, members, nodes):
        discard(done)
    return out


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
