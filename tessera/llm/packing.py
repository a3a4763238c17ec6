"""Packing documents into fixed-length token sequences as a cutting-stock problem.

A document is its ids and an end id. It gives full sequences and a tail of fewer tokens than a sequence. Only the
histogram of tail lengths (at most length - 1 numbers) goes to the driver: column generation solves the linear
program over patterns (multisets of tail lengths that fit into a sequence), a knapsack dynamic program prices
columns, the patterns' counts are rounded, and what rounding leaves over is put into patterns longest first.
Documents are ranked within their tail length (rank in their partition plus the counts of earlier partitions) and
rank and length alone say which pattern, copy and slot a tail gets. Sequences of the emptiest patterns are taken
back: their tails form a stream that is cut to fill the gaps that all other patterns leave; what is left of it fills
whole sequences and, at its end, powers of two. So there is no padding, and only the stream's documents are cut.

Ids cross the network once, in a join on (partition, tail length). No task needs all rows of a length.
A null text counts as an empty one (its sequence part is the end id alone); repeated doc_ids stay separate
documents; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table, text_runs
from .token_counts import default_tokenizer, encode_all


def knapsack(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: largest value of items of total weight c at most, items used any number of times; pick[c]: the item taken last, -1 for none."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(weights, kind="stable")
    w, v = weights[order], values[order]
    for c in range(1, capacity + 1):
        k = np.searchsorted(w, c, side="right")
        best[c], pick[c] = best[c - 1], -1
        if k:
            total = best[c - w[:k]] + v[:k]
            i = int(total.argmax())
            if total[i] > best[c] + 1e-12:
                best[c], pick[c] = total[i], order[i]
    return best, pick


def _unpack(pick: np.ndarray, weights: np.ndarray, c: int, into: np.ndarray) -> np.ndarray:
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            into[pick[c]] += 1
            c -= weights[pick[c]]
    return into


def _first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A feasible basis, its counts and its inverse: the longest tail left is topped up with the longest that fit; each pattern is used until a length runs out.

    A pattern has no length that ran out before, so the basis is triangular in the order in which lengths run out.
    """
    n = len(lengths)
    left, columns, x, used_up, order = demand.astype(float), np.zeros((n, n)), np.zeros(n), np.zeros(n, bool), []
    for k in range(n):
        open_ = np.flatnonzero(~used_up)
        room, i = capacity, open_[-1]
        while True:
            uses = room // lengths[i] if i != open_[-1] else 1
            columns[i, k] += uses
            room -= uses * lengths[i]
            fit = open_[: np.searchsorted(lengths[open_], room, side="right")]
            if not len(fit):
                break
            i = fit[-1]
        on = np.flatnonzero(columns[:, k])
        copies = left[on] / columns[on, k]
        x[k] = copies.min()
        left[on] -= x[k] * columns[on, k]
        order.append(on[copies.argmin()])
        used_up[order[-1]] = True
    inverse = np.zeros((n, n))
    for k, i in enumerate(order):
        inverse[k, i] = 1.0
        for j in np.flatnonzero(columns[i, :k]):
            inverse[k] -= columns[i, j] * inverse[j]
        inverse[k] /= columns[i, k]
    return columns, x, inverse


def cutting_stock(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 40, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: uses of each length) and their fractional counts, by column generation.

    Ends when no pattern prices above 1 + gap or the sequences are within that gap of all tokens over the capacity
    (both bound the distance from the optimum), or after `rounds` knapsacks; the counts meet the demand exactly at any time.
    The inverse is updated row by row and products are taken over a pattern's few lengths, so no step needs a threaded matrix library.
    """
    n = len(lengths)
    columns, x, inverse = _first_basis(lengths, demand, capacity)
    dual = inverse.sum(0)
    for _ in range(rounds):
        best, pick = knapsack(lengths, dual, capacity)
        if best[capacity] <= 1 + gap or x.sum() <= (1 + gap) * int((lengths * demand).sum()) / capacity:
            break
        value = dual + best[capacity - lengths]
        entered = False
        for first in np.argsort(-value, kind="stable")[: max(8, n // 16)]:
            column = np.zeros(n)
            column[first] += 1
            column = _unpack(pick, lengths, capacity - lengths[first], column)
            on = np.flatnonzero(column)
            priced = (dual[on] * column[on]).sum()
            if priced <= 1 + gap:  # duals have changed since
                continue
            way = (inverse[:, on] * column[on]).sum(1)
            up = way > 1e-9
            if not up.any():
                continue
            ratio = np.where(up, x / np.where(up, way, 1), np.inf)
            out = int(ratio.argmin())
            x = np.maximum(x - ratio[out] * way, 0)
            x[out] = ratio[out]
            row = inverse[out] / way[out]
            moved = np.flatnonzero(way)
            inverse[moved] -= way[moved, None] * row
            inverse[out] = row
            dual = dual - (priced - 1) * row
            columns[:, out] = column
            entered = True
        if not entered:
            break
        dual = inverse.sum(0)
    return columns.T.round().astype(np.int64), x


def rounded_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int], int]]:
    """(copies, {length: uses}, gap) of whole patterns, in the order of their gaps; the tails in none of them have at least as many tokens as all gaps together.

    Counts are rounded down, then up where the demand allows it; the tails left go longest first into patterns that
    they fill greedily. Copies with the largest gaps are taken back until the tails that they free can fill all others.
    """
    if not len(lengths):
        return []
    patterns, counts = cutting_stock(lengths, demand, capacity)
    left = demand.copy()
    whole: dict[tuple, int] = {}

    def place(uses: np.ndarray, most: int) -> None:
        on = np.flatnonzero(uses)
        copies = min(most, int((left[on] // uses[on]).min()))
        if copies > 0:
            left[on] -= copies * uses[on]
            key = tuple(zip(lengths[on].tolist(), uses[on].tolist()))
            whole[key] = whole.get(key, 0) + copies

    down = np.floor(counts + 1e-6).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        place(patterns[i], int(down[i]))
    for i in np.argsort(down - counts, kind="stable"):
        if counts[i] > down[i]:
            place(patterns[i], 1)
    while left.any():
        uses, room = np.zeros(len(lengths), np.int64), capacity
        while True:
            fit = np.flatnonzero((left > uses) & (lengths <= room))
            if not len(fit):
                break
            i = fit[-1]
            more = min(int(left[i] - uses[i]), int(room // lengths[i]))
            uses[i] += more
            room -= more * int(lengths[i])
        place(uses, int(left.max()))
    kept = sorted((capacity - sum(t * k for t, k in key), key, copies) for key, copies in whole.items())
    gaps, free = sum(g * c for g, _, c in kept), 0
    while gaps > free:
        g, key, copies = kept.pop()
        back = min(copies, -(-(gaps - free) // capacity))
        gaps, free = gaps - back * g, free + back * (capacity - g)
        if back < copies:
            kept.append((g, key, copies - back))
    return [(copies, dict(key), g) for g, key, copies in kept]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """Each document's ids with its rank among its partition's documents: part, tail, in_tail (rank among equal tails), in_full (full sequences before it)."""

    def encode(texts: list) -> tuple[list[int], list[bytes]]:
        codes = [c + end_id.to_bytes(4, "little") for c in encode_all(tokenizer, [t or "" for t in texts])]
        n = [len(c) // 4 for c in codes]
        if all(int(np.frombuffer(c, "<u4").max()) < 1 << 16 for c in codes):
            return n, [b"\x02" + np.frombuffer(c, "<u4").astype("<u2").tobytes() for c in codes]
        return n, [b"\x04" + c for c in codes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, full, part = np.zeros(length, np.int64), 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi in text_runs(batch.column(1)):
                n, ids = encode(batch.column(1).slice(lo, hi - lo).to_pylist())
                tail, whole = np.array(n) % length, np.array(n) // length
                rank = np.empty(len(n), np.int64)
                for i, t in enumerate(tail.tolist()):
                    rank[i] = seen[t]
                    seen[t] += 1
                before = full + np.cumsum(whole) - whole
                full += int(whole.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), *map(pa.array, (np.full(len(n), part, np.int64), tail, rank, before))], names=["doc_id", "n", "ids", "part", "tail", "in_tail", "in_full"])

    # The first byte of ids says how many bytes an id takes. Encoding and ranking share a worker process, and so its memory.
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, ids binary, part long, tail long, in_tail long, in_full long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary: one byte, 2 or 4, for the width of an id, then little-endian ids), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = materialise(tokenized(docs, tokenizer, end_id, length), "tokens")

    counts = tokens.groupBy("part", "tail").agg(F.count("*").alias("docs"), F.sum(F.expr(f"n div {length}")).alias("full"))
    counts = materialise(counts, "tail-counts")
    histogram = {r.tail: r.docs for r in counts.groupBy("tail").agg(F.sum("docs").alias("docs")).collect() if r.tail}  # length - 1 rows at most
    n_full = counts.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[t] for t in lengths.tolist()], np.int64)

    # Where the tails of each length go, by rank: runs of ranks that belong to one pattern, then the stream.
    runs: dict[int, list] = {int(t): [] for t in lengths}
    used = dict.fromkeys(runs, 0)
    next_sequence, upto = n_full, 0
    segments = []  # of the stream: (at, size, copies, sequence, offset): so many equal parts, one in each of consecutive sequences
    for copies, uses, gap in rounded_patterns(lengths, demand, length):
        at = 0
        for t, k in uses.items():
            runs[t].append((used[t], used[t] + copies * k, k, next_sequence, at))
            used[t] += copies * k
            at += t * k
        if gap:
            segments.append((upto, gap, copies, next_sequence, at))
            upto += gap * copies
        next_sequence += copies
    stream_at, stream = {}, 0
    for t in runs:
        stream_at[t] = stream
        stream += (histogram[t] - used[t]) * t
    rest = stream - upto
    sizes = [(length, rest // length)] + [(1 << i, 1) for i in range(length.bit_length() - 1, -1, -1) if rest % length >> i & 1]
    for size, copies in sizes:
        if copies:
            segments.append((upto, size, copies, next_sequence, 0))
            upto, next_sequence = upto + size * copies, next_sequence + copies
    rows = []
    for t in runs:
        lo, hi = stream_at[t], stream_at[t] + (histogram[t] - used[t]) * t
        rows.append((t, runs[t], used[t], lo, [g for g in segments if g[0] < hi and g[0] + g[1] * g[2] > lo]))

    slots = spark.createDataFrame(rows, "tail long, runs array<struct<lo:long,hi:long,uses:long,sequence:long,at:long>>, in_runs long, stream_at long, segments array<struct<at:long,size:long,copies:long,sequence:long,offset:long>>")
    earlier = lambda key: Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("full").alias("full")).withColumn("group", F.expr("part div 4096"))
    groups = parts.groupBy("group").agg(F.sum("full").alias("full"))
    groups = groups.select("group", F.coalesce(F.sum("full").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_group"))  # a row for 4096 partitions
    parts = parts.join(groups, "group").select("part", (F.coalesce(F.sum("full").over(earlier("group")), F.lit(0)) + F.col("before_group")).alias("part_full"))
    ranks = counts.select("part", "tail", F.coalesce(F.sum("docs").over(earlier("tail")), F.lit(0)).alias("part_tail")).join(parts, "part")

    placed = tokens.join(ranks, ["part", "tail"]).join(F.broadcast(slots), "tail", "left")  # slots: a row for each tail length
    placed = placed.withColumn("rank", F.col("in_tail") + F.col("part_tail"))
    placed = placed.withColumn("run", F.expr("get(filter(runs, r -> rank >= r.lo and rank < r.hi), 0)"))
    full = F.expr(
        f"transform(if(n < {length}, cast(array() as array<bigint>), sequence(0L, n div {length} - 1)), k -> named_struct('start', k * {length}, 'length', {length}L, 'sequence_id', part_full + in_full + k, 'offset', 0L))"
    )
    in_run = F.expr(
        "array(named_struct('start', n - tail, 'length', tail, 'sequence_id', run.sequence + (rank - run.lo) div run.uses, 'offset', run.at + tail * ((rank - run.lo) % run.uses)))"
    )
    placed = placed.withColumn("s", F.expr("stream_at + (rank - in_runs) * tail"))
    # The parts of the stream's segments that [s, s + tail) meets.
    in_stream = F.expr(
        """flatten(transform(filter(segments, g -> g.at < s + tail and g.at + g.size * g.copies > s), g -> transform(
            sequence(greatest(s - g.at, 0L) div g.size, (least(s + tail, g.at + g.size * g.copies) - g.at - 1) div g.size),
            j -> named_struct(
                'start', n - tail + greatest(g.at + j * g.size, s) - s, 'length', least(g.at + (j + 1) * g.size, s + tail) - greatest(g.at + j * g.size, s),
                'sequence_id', g.sequence + j, 'offset', g.offset + greatest(s - g.at - j * g.size, 0L)))))"""
    )
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>)")
    pieces = F.concat(full, F.when(F.col("tail") == 0, none).when(F.col("run").isNotNull(), in_run).otherwise(in_stream))
    return placed.select("doc_id", F.col("n").alias("doc_tokens"), "ids", F.explode(pieces).alias("p")).select(
        "doc_id",
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.expr("concat(substring(ids, 1, 1), substring(ids, cast(2 + p.start * conv(hex(substring(ids, 1, 1)), 16, 10) as int), cast(p.length * conv(hex(substring(ids, 1, 1)), 16, 10) as int)))").alias("ids"),
        "doc_tokens",
        F.col("p.sequence_id").alias("sequence_id"),
        F.col("p.offset").alias("offset"),
    )


def piece_ids(code: bytes) -> np.ndarray:
    """The ids of a piece's binary form."""
    return np.frombuffer(code, "<u2" if code[0] == 2 else "<u4", offset=1).astype("<u4")


def digest_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32 in place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [zlib.crc32(piece_ids(c).tobytes()) for c in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(crc, pa.int64()), *(b.column(i) for i in range(4, 7))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
