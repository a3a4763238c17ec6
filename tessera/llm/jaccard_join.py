"""Similarity join of documents' shingle sets (Jaccard), size-aware: subsets for light sets, inverted lists for heavy ones.

Two sets that are similar enough share at least ceil(t m) shingles, m being the size of the larger one (t: the threshold). So

* a light set (fewer than `boundary` shingles) is known by its subsets of the fixed sizes ceil(t n) to n, n being its size:
  two light sets that are similar share a subset of the size that the larger one has as its least;
* a heavy set scans the inverted lists of its n - ceil(t n) + 1 first shingles in one order of all shingles, rarest first; any set
  that is similar is on one of them with its own first ones. Light sets that are large enough for a heavy partner are on the lists too.

The boundary is where the estimated cost of all sets is least: a row for each subset or list entry, and for each entry of a list also
the pairs that it is expected to meet there. How often shingles occur comes from all documents: those that make up more than
1 / FREQUENT of all occurrences are known with counts (so there are FREQUENT at most), the others count as rare.

Members of a list whose sizes and parity bits rule a link with every other member out (an exact bound) leave it before any text is
read. Before a join deals rows by key, a filter of fixed size (FILTER bits) drops most of those without a partner; it lets false ones
through, never right ones out, and the join decides. Those left are compared as the buckets of near-duplicates are: each with the smallest first, then, where that leaves several
components, members across components in blocks. Links are confirmed on full sets.

Defined cases: a document without words (or null) has an empty set and is linked with nothing; fewer words than k make one
shingle of all of them; repeated rows are one set; a null doc_id takes no part (component_id null); an empty table gives an
empty result. Only doc_id and text are looked at. Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, materialise, release, table
from .minhash import distinct, joined_nodes, node_of, shingle_hashes, shingles

#: Most frequent shingles that are told apart; sizes from which sets are always heavy; cost of a pair in rows; one shingle of so many is counted for the estimate of pairs; parity bits, and those of the first pass over the lists; bits of a filter before a join.
FREQUENT, HEAVY, PAIR_COST, ESTIMATE, BITS, THIN, FILTER = 1 << 19, 25, 30.0, 256, 1024, 256, 1 << 26
_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_shared(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with one that is similar."""
    return -(-percent * n // 100)


def subset_rows(n: int, percent: int) -> int:
    return sum(comb(n, d) for d in range(n - least_shared(n, percent) + 1))


def list_rows(n: int, percent: int) -> int:
    return n - least_shared(n, percent) + 1


@lru_cache(512)
def _left_out(n: int, d: int) -> np.ndarray:
    return np.array(list(combinations(range(n), d)), np.intp).reshape(comb(n, d), d)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def subset_keys(kept: np.ndarray, percent: int) -> np.ndarray:
    """Odd numbers of a set's subsets of ceil(t n) to n shingles."""
    n, each = len(kept), _mixed(kept)
    total = each.sum(dtype=np.uint64)
    sums = [total - each[_left_out(n, d)].sum(1, dtype=np.uint64) + np.uint64((n - d) * 0x632BE59BD9B4E019 & (1 << 64) - 1) for d in range(n - least_shared(n, percent) + 1)]
    return _mixed(np.concatenate(sums)) | np.uint64(1)


_slots: tuple[np.ndarray, np.ndarray] | None = None


def _slots_of(frequent: np.ndarray) -> np.ndarray:
    """Which first 24 bits frequent shingles have; of the last array asked for."""
    global _slots
    if _slots is None or _slots[0] is not frequent:
        table = np.zeros(1 << 24, bool)
        table[frequent >> np.uint64(40)] = True
        _slots = frequent, table
    return _slots[1]


def list_keys(kept: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Even numbers of a set's first shingles, rarest first (by count, then by hash). frequent: sorted, with its counts."""
    count = np.zeros(len(kept), np.int64)
    near = np.flatnonzero(_slots_of(frequent)[kept >> np.uint64(40)]) if len(frequent) else np.zeros(0, np.int64)
    if len(near):  # only those whose first bits are a frequent one's are looked up
        at = np.minimum(np.searchsorted(frequent, kept[near]), len(frequent) - 1)
        count[near] = np.where(frequent[at] == kept[near], counts[at], 0)
        kept = kept[np.argsort(count, kind="stable")]
    return _mixed(kept[: list_rows(len(kept), percent)]) & ~np.uint64(1)


def parity(kept: np.ndarray, bits: int = BITS) -> bytes:
    """A set's size (4 bytes), and for each of `bits` classes of shingles whether it holds an odd number of them."""
    odd = np.bincount((_mixed(kept) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.uint32(len(kept)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fine_parity(kept: np.ndarray) -> bytes:
    """Of a set that is large for BITS classes, parities of at least twice as many classes as shingles (a power of two, 2 ** 24 at most); else empty."""
    return parity(kept, 1 << min(2 * len(kept), 1 << 24).bit_length())[4:] if 2 * len(kept) > BITS else b""


def differ_finely(one: bytes, other: bytes) -> int:
    """Shingles by which two sets differ at least, from their fine parities (0 if one has none). The finer one's classes are joined to the other's."""
    if not one or not other:
        return 0
    a, b = (np.frombuffer(x, np.uint8) for x in (one, other))
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), 0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def apart(low: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets (rows of parity()): shingles by which they differ at least (as many as their parities, or sizes), shingles of both together."""
    size = lambda x: np.ascontiguousarray(x[..., :4]).view(np.uint32)[..., 0].astype(np.int64)
    return np.maximum(np.bitwise_count(low[..., 4:] ^ other[..., 4:]).sum(-1, dtype=np.int64), np.abs(size(low) - size(other))), size(low) + size(other)


def allowed(low: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether they can be linked."""
    differ, both = apart(low, other)
    return (100 + percent) * (both - differ) >= 2 * percent * both


def by_parity(low: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """Rows of `low` that are allowed a link with `own`, likeliest first."""
    differ, both = apart(low, own)
    near = np.flatnonzero(allowed(low, own, percent))
    return near[np.argsort(differ[near] / both[near], kind="stable")]


#: Bytes of a mark before the fine parity: label, size, parities.
HEAD = 8 + 4 + BITS // 8


def finely(one: list, other: list, ok: np.ndarray, percent: int) -> np.ndarray:
    """ok, without pairs that their fine parities rule out. Marks: label, size and parity(), fine parity."""
    for i in np.flatnonzero(ok).tolist():
        a, b = one[i], other[i]
        if len(a) > HEAD and len(b) > HEAD:
            both = int.from_bytes(a[8:12], "little") + int.from_bytes(b[8:12], "little")
            ok[i] = (100 + percent) * (both - differ_finely(a[HEAD:], b[HEAD:])) >= 2 * percent * both
    return ok


def heads(marks: list) -> np.ndarray:
    """Marks before their fine parities, a row each; those of a pass are equally long."""
    return np.frombuffer(b"".join(m[:HEAD] for m in marks), np.uint8).reshape(len(marks), min(HEAD, len(marks[0])))


def may_link(one: list, other: list, percent: int) -> np.ndarray:
    """Whether sets, pair by pair, are allowed a link and have different labels."""
    x, y = heads(one), heads(other)
    return finely(one, other, allowed(x[:, 8:], y[:, 8:], percent) & (x[:, :8] != y[:, :8]).any(1), percent)


def marked(members: DataFrame, label: str) -> DataFrame:
    return members.withColumn("mark", F.concat(F.unhex(F.lpad(F.hex(label), 16, "0")), "low", "fine"))


def allowed_pairs(pairs: DataFrame, lows: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are allowed a link. lows: node, low, fine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(may_link(batch.column(2).to_pylist(), batch.column(3).to_pylist(), percent)))

    marks = marked(lows, "node").select("node", "mark")
    both = pairs.join(marks.toDF("a", "ma"), "a").join(marks.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")
    return both.mapInArrow(run, "a long, b long")


def filter_of(values: DataFrame) -> Broadcast:
    """A filter of FILTER bits in which the values (one column of long) have theirs; at most FILTER / 64 rows reach the driver."""
    value = F.col(values.columns[0])
    place = value.bitwiseXOR(F.shiftrightunsigned(value, 26)).bitwiseXOR(F.shiftrightunsigned(value, 52)).bitwiseAND(F.lit(FILTER - 1))
    words = values.select(place.alias("at")).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, CAST(at & 63 AS INT)) AS one")
    found = words.groupBy("word").agg(F.bit_or("one").alias("bits")).toArrow()
    bits = np.zeros(FILTER // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return values.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values may be in the filter; all that are in it."""
    v = values.view(np.uint64)
    at = (v ^ (v >> np.uint64(26)) ^ (v >> np.uint64(52))) & np.uint64(FILTER - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def filtered(df: DataFrame, known: Broadcast, inside: bool = True) -> DataFrame:
    """Rows of df whose first column (long, no null) may be in the filter, or (inside=False) those that are not in it for sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(known.value, batch.column(0).to_numpy()) == inside))

    return df.mapInArrow(run, df.schema)


def by_list(dealt: DataFrame, at: int, schema: str, found: Callable) -> DataFrame:
    """key, node that found(key, rows) names for each stretch of rows with the same first `at` columns, the first one being the key. dealt: sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys, nodes = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if now != row[:at]:
                    if held:
                        got = found(held)
                        keys += [now[0]] * len(got)
                        nodes += got
                    now, held = row[:at], []
                held.append(row[at:])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], names=["key", "node"])
        if held:
            got = found(held)
            yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(got), pa.int64()), pa.array(got, pa.int64())], names=["key", "node"])

    return dealt.mapInArrow(run, schema)


def finding(nodes: list, marks: list, own: list, percent: int, rows: int = 64) -> list:
    """Of the members `own` (node, mark), those that may be linked with one of the others."""
    head, number, keep = heads(marks), np.array(nodes, np.int64), []
    for lo in range(0, len(own), rows):
        some = own[lo : lo + rows]
        one = heads([m for _, m in some])[:, None]
        ok = allowed(head[None, :, 8:], one[:, :, 8:], percent) & (head[None, :, :8] != one[:, :, :8]).any(2) & (number[None] != np.array([n for n, _ in some], np.int64)[:, None])
        for (n, m), near in zip(some, ok):
            if any(len(m) <= HEAD or finely([marks[i]], [m], np.ones(1, bool), percent)[0] for i in np.flatnonzero(near).tolist()):
                keep.append(n)
    return keep


def plausible(members: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """key, node of list members (key, node, mark) that another member of the list may be linked with, as a table.

    Each is held against the smallest first; those that it doesn't allow against all others. A list of up to `block` members is dealt
    whole to one task, which does both, so that marks are dealt once; longer ones go by blocks.
    """
    members = materialise(members, "marked")
    long = materialise(members.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > block).select("key"), "long")
    none = long.isEmpty()

    def found(rows: list) -> list:
        if len(rows) < 2:
            return []
        rows.sort(key=lambda r: r[0])
        (first, mark), rest = rows[0], rows[1:]
        ok = may_link([m for _, m in rest], [mark] * len(rest), percent)
        near = [n for (n, _), x in zip(rest, ok) if x]
        own = [r for r, x in zip(rest, ok) if not x]
        return ([first, *near] if near else []) + (finding([n for n, _ in rest], [m for _, m in rest], own, percent) if own and len(rest) > 1 else [])

    short = members if none else members.join(long, "key", "left_anti")
    dealt = short.select("key", "node", "mark").repartition("key").sortWithinPartitions("key")
    good = by_list(dealt, 1, "key long, node long", found)
    near = None
    if not none:
        near, others = plausible_in_blocks(members.join(long, "key").select("key", "node", "mark"), percent, block)
        good = good.unionByName(others.distinct())
    out = materialise(good, "plausible")
    for done in (members, long, near):
        discard(done)
    return out


def plausible_in_blocks(members: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """A table to be discarded afterwards; key, node (with repeats) as of plausible(), for long lists."""
    first = members.groupBy("key").agg(F.min("node").alias("first"))
    firsts = members.join(first, "key").where("node = first").select("key", "first", F.col("mark").alias("first_mark"))

    def with_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = may_link(batch.column(3).to_pylist(), batch.column(4).to_pylist(), percent)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ok)], names=["key", "node", "first", "mark", "ok"])

    both = members.join(firsts, "key").where("node <> first").select("key", "node", "first", "mark", "first_mark")
    near = materialise(both.mapInArrow(with_first, "key long, node long, first long, mark binary, ok boolean"), "near")
    sizes = near.groupBy("key").agg(F.count("*").alias("m"), F.count_if(~F.col("ok")).alias("apart")).where("apart > 0 and m > 1")
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    rows = near.join(sizes, "key").withColumns({"h": F.xxhash64("node"), "own": parts("m"), "others": parts("apart")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = rows.select("key", "node", "mark", F.lit(0).alias("role"), F.pmod("h", "own").cast("int").alias("part"), every("others").alias("apart_part")).unionByName(
        rows.where("not ok").select("key", "node", "mark", F.lit(1).alias("role"), every("own").alias("part"), F.pmod("h", "others").cast("int").alias("apart_part"))
    )

    def found(rows: list) -> list:
        others, own = ([r[1:] for r in rows if r[0] == role] for role in (0, 1))
        return finding([n for n, _ in others], [m for _, m in others], own, percent) if others and own else []

    dealt = placed.select("key", "part", "apart_part", "role", "node", "mark").repartition("key", "part", "apart_part").sortWithinPartitions("key", "part", "apart_part")
    # of two that may be linked each is in: for the first one's sake, or because it finds the other
    stand = near.where("ok")
    return near, stand.select("key", "node").unionByName(stand.select("key", F.col("first").alias("node"))).unionByName(by_list(dealt, 3, "key long, node long", found))


def occurrences(docs: DataFrame, k: int, limit: int = 4_000_000) -> DataFrame:
    """kind, key, n, added up over tasks. 0: shingles that are frequent in a stretch of `limit` occurrences; 1: all shingles whose hash is one of ESTIMATE; 2: sets by size (under HEAVY); 3: occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def through() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often, some = n >= max(2, size / FREQUENT), found % np.uint64(ESTIMATE) == 0
            sizes, sets = np.unique(np.array([len(x) for x in held if len(x) < HEAVY], np.int64), return_counts=True)
            keys = [found[often].view(np.int64), found[some].view(np.int64), sizes.astype(np.int64), np.zeros(1, np.int64)]
            values = [n[often], n[some], sets, np.array([size])]
            kinds = np.repeat(np.arange(4), [len(x) for x in keys])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(values), pa.int64())], names=["kind", "key", "n"])

        for batch in batches:
            for text in batch.column(0):
                found = shingle_hashes(text.as_py(), k)  # repeats in a text may count
                if len(found):
                    held.append(found if len(found) >= 4 * HEAVY else distinct(found))
                    size += len(found)
                if size > limit:
                    yield through()
                    size = 0
        if held:
            yield through()

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def boundary_of(sizes: dict[int, int], partners: float, percent: int) -> int:
    """The size from which sets are heavy, by cost. sizes: how many sets of each size under HEAVY; partners: sets that an entry meets on an average list."""

    def cost(x: int) -> float:
        light = sum(c * (subset_rows(n, percent) + (list_rows(n, percent) if n >= least_shared(x, percent) else 0)) for n, c in sizes.items() if n < x)
        return light + sum(c * list_rows(n, percent) * (1 + PAIR_COST * partners) for n, c in sizes.items() if n >= x)

    return min(range(1, HEAVY + 1), key=cost)


def keyed(docs: DataFrame, k: int, percent: int, boundary: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, node, keys (subsets odd, lists even), low (size and parities), fine, thin (low of fewer bits)."""
    known = docs.sparkSession.sparkContext.broadcast((frequent, counts))  # FREQUENT at most

    def run(texts: list) -> list:
        out = []
        for text in texts:
            kept = shingles(text, k)
            if not len(kept):
                out.append((0, None, None, None, None, None))
                continue
            keys = [subset_keys(kept, percent)] if len(kept) < boundary else []
            if len(kept) >= least_shared(boundary, percent):
                keys.append(list_keys(kept, percent, *known.value))
            out.append((len(kept), node_of(kept), np.concatenate(keys).view(np.int64), parity(kept), fine_parity(kept), parity(kept, THIN)))
        return list(zip(*out))

    return map_texts(docs, ["doc_id"], run, "n_shingles long, node long, keys array<long>, low binary, fine binary, thin binary")


def across(labelled: DataFrame, lows: DataFrame, percent: int) -> DataFrame:
    """Members (key, node, label, low) that may be linked with a member of another label."""
    labelled = materialise(labelled, "labelled")
    members = marked(labelled.select("key", "node", "label").join(lows, "node"), "label").select("key", "node", "mark")
    return labelled.join(plausible(members, percent), ["key", "node"], "left_semi")


def classes_of(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables: doc_id, n_shingles, node of every row; node, rep (smallest doc_id), n, keys, low, fine, thin of every set. sets: of keyed(). Only rows whose set others may have too are dealt by it."""
    every = materialise(sets, "keyed")
    sigs = materialise(every.select("doc_id", "n_shingles", "node"), "sets")
    again = filter_of(sigs.where("node is not null and doc_id is not null").groupBy("node").agg(F.count("*").alias("m")).where("m > 1").select("node"))
    parts = ("keys", "low", "fine", "thin")
    rows = every.where("node is not null and doc_id is not null").select("node", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), *parts)
    one = filtered(rows, again).groupBy("node").agg(F.min("rep").alias("rep"), *(F.first(c).alias(c) for c in ("n", *parts)))
    nodes = materialise(filtered(rows, again, inside=False).unionByName(one), "classes")
    again.destroy()
    discard(every)
    return sigs, nodes


def shared_lists(nodes: DataFrame, boundary: int) -> DataFrame:
    """key, node of subsets and lists that several sets are on, lists with a heavy one only; of those with the same sets one. As a table."""
    keys = nodes.select("node", (F.col("n") >= boundary).alias("heavy"), F.explode("keys").alias("key"))
    found = keys.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("node").alias("h"), F.max("heavy").alias("heavy"))
    shared = materialise(found.where((F.col("m") > 1) & ((F.col("key") % 2 != 0) | F.col("heavy"))).groupBy("m", "h").agg(F.min("key").alias("key")).select("key"), "shared")
    release(nodes.sparkSession)
    known = filter_of(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy()
            ok = in_filter(known.value, values)
            of = np.repeat(batch.column(0).to_numpy(), pc.list_value_length(lists).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(of[ok]), pa.array(values[ok])], names=["node", "key"])

    out = materialise(nodes.select("node", "keys").mapInArrow(run, "node long, key long").join(shared, "key").select("key", "node"), "lists")
    known.destroy()
    discard(shared)
    return out


def marks_of(members: DataFrame, lows: DataFrame) -> DataFrame:
    """As a table, the rows of lows (its first column is the node) of members, and few others."""
    known = filter_of(members.select("node").distinct())
    out = materialise(filtered(lows, known), "lows")
    known.destroy()
    return out


def likely_members(lists: DataFrame, lows: DataFrame, percent: int) -> DataFrame:
    """key, node, first (the smallest) of list members that may be linked with another one, as a table: by their thin parities, which most members don't pass and all are dealt with, then by the coarse, then by the fine ones. The lists go. lows: node, low, fine, thin."""
    left, fine, some = lists, F.lit(b"").alias("fine"), None
    for marks in ([F.col("thin").alias("low"), fine], ["low", fine], ["low", "fine"]):
        fewer = plausible(marked(left.select("key", "node").join((lows if some is None else some).select("node", *marks), "node"), "node").select("key", "node", "mark"), percent)
        discard(left)
        left = fewer
        release(lows.sparkSession)
        some = marks_of(left, lows.select("node", "low", "fine")) if some is None else some
    out = materialise(left.join(left.groupBy("key").agg(F.min("node").alias("first")), "key"), "members")
    discard(left)
    discard(some)
    return out


def once(members: DataFrame) -> DataFrame:
    """Members (key, node, first), of lists with the same ones one, as a table. The others go."""
    same = members.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("node").alias("h"), F.min("first").alias("first"))
    out = materialise(members.join(same.groupBy("m", "h", "first").agg(F.min("key").alias("key")).select("key"), "key").select("key", "node", "first"), "members")
    discard(members)
    return out


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of a similarity of percent / 100 or more)."""
    docs = docs.select("doc_id", "text")
    seen = materialise(occurrences(docs, k), "occurrences")
    total = seen.where("kind = 3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(2, total / FREQUENT)
    known = seen.where((F.col("kind") == 0) & (F.col("n") >= least)).select("key", "n").toArrow()  # FREQUENT rows at most
    frequent, counts = known.column(0).to_numpy().view(np.uint64), known.column(1).to_numpy()
    order = np.argsort(frequent)
    partners = seen.where("kind = 1").agg(F.avg(F.col("n") - 1)).first()[0] or 0.0
    boundary = boundary_of({r.key: r.n for r in seen.where("kind = 2").collect()}, partners, percent)  # HEAVY rows at most
    discard(seen)

    sigs, nodes = classes_of(keyed(docs, k, percent, boundary, frequent[order], counts[order]))
    release(docs.sparkSession)
    members = once(likely_members(shared_lists(nodes, boundary), nodes.select("node", "low", "fine", "thin"), percent))
    some = marks_of(members, nodes.select("node", "rep", "low", "fine"))
    lows = some.select("node", "low", "fine")
    classes = materialise(nodes.select("node", "rep", "low"), "classes")
    discard(nodes)
    compared = filter_of(some.select(F.xxhash64("rep").alias("id")))
    texts = filtered(docs.select(F.xxhash64("doc_id").alias("id"), "doc_id", "text"), compared)  # few others
    release(docs.sparkSession)
    of_node = joined_nodes(classes, members, texts, k, percent, by_parity, lambda pairs: allowed_pairs(pairs, lows, percent), lambda members: across(members, lows, percent))
    compared.destroy()
    discard(some)
    out = sigs.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), k=5, percent=80)
