"""Ranked lexical search: the best documents of every item, by a trie of documents with bounds.

Documents become vectors restricted to the items' terms. Tasks put blocks of them into tries: a document's terms stand
from the most frequent to the least, so documents share the paths of their frequent terms; chains without branches are one
edge and small siblings share a leaf. Each node knows the largest tf of every term below it and the smallest m. As scores
rise with tf and fall with m, these give every item a bound of what it can find there. The search goes depth first, likeliest
child first, and leaves a subtree as soon as no item's bound reaches the score of its 50th document so far; what
it comes to is scored exactly. Floors of those scores are first found on one document of 16, which leaves the result as it is.

Items come in blocks of at most PAIRS (item, term) pairs, each of which is held against all documents.

Defined cases: null and empty texts have no term; repeated rows of documents are ranked each; a null doc_id comes after
others of its score; rows of one item_id are one item, those with a null item_id or without terms find nothing; without documents
or items the result is empty. Columns other than doc_id and text, item_id and text are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, materialise, table

#: (item, term) pairs of a block of items; documents of a leaf; documents times terms of a trie; one document of so many gives floors.
PAIRS, LEAF, CELLS, FLOOR = 65_536, 8, 1 << 24, 16
#: Bytes between terms become spaces, A-Z become a-z. Terms are runs of 0-9, a-z, A-Z and whatever is not ASCII.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def gain(tf, m):
    """What a term gives for each unit of its weight; rises with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (int32 each, in order of the terms' numbers) of documents with a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(texts: list) -> list:
        numbers, out = known.value, []
        for text in texts:
            words = terms_of(text)
            counts = Counter(words)
            found = sorted((numbers[t], counts[t]) for t in numbers.keys() & counts.keys())
            both = np.array(found, np.int32).reshape(-1, 2)
            out.append((len(words), both[:, 0].tobytes(), both[:, 1].tobytes()))
        return list(zip(*out))

    return map_texts(docs, ["doc_id"], run, "n long, terms binary, tfs binary").where("n > 0")


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Of each of `size` terms, the number of documents that hold it; sums of each task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in batch.column(0):
                counts[np.frombuffer(part.as_py(), np.int32)] += 1  # a document has a term once
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # PAIRS rows at most
        out[r.term] = r.df
    return out


class Items:
    """Items as runs of (term, weight); terms by rank of frequency. Every item has a term."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray):
        self.size, self.vocabulary = np.array([len(t) for t in terms]), len(weights)
        self.terms = np.concatenate([np.array(t, np.int64) for t in terms])
        self.weights = weights[self.terms]

    def of(self, gains: np.ndarray, active: np.ndarray | None = None) -> np.ndarray:
        """Sums of weight times gain for each (active) item; gains by term along the last axis."""
        terms, weights, size = self.terms, self.weights, self.size
        if active is not None:
            keep = np.repeat(active, size)
            terms, weights, size = terms[keep], weights[keep], size[active]
        return np.add.reduceat(gains[..., terms] * weights, np.cumsum(size) - size, axis=-1)


class Trie:
    """A trie of documents: runs of ranks (ascending), tfs and m of each."""

    def __init__(self, ranks: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, vocabulary: int, leaf: int = LEAF):
        keys = [r.astype(">u4").tobytes() for r in ranks]
        self.order = sorted(range(len(ranks)), key=keys.__getitem__)
        self.ranks, self.tfs, self.m = [ranks[i] for i in self.order], [tfs[i] for i in self.order], m[self.order]
        self.spans: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        parent: list[int] = []
        todo = [(0, len(ranks), 0, -1)]
        while todo:
            lo, hi, depth, up = todo.pop()
            me = len(self.spans)
            self.spans.append((lo, hi))
            self.children.append([])
            parent.append(up)
            if up >= 0:
                self.children[up].append(me)
            a, b = self.ranks[lo], self.ranks[hi - 1]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:k] != b[depth:k])
            depth = depth + int(differ[0]) if len(differ) else k
            if hi - lo <= leaf or not len(differ) and len(a) == len(b):  # the latter: the same terms in all
                continue
            todo += [(x, y, depth, me) for x, y in self._runs(lo, hi, depth, leaf)]
        leaves = [v for v in range(len(self.spans)) if not self.children[v]]
        self.most, self.least = np.zeros((len(self.spans), vocabulary), np.int32), np.full(len(self.spans), np.iinfo(np.int64).max)
        for v in leaves:
            lo, hi = self.spans[v]
            for i in range(lo, hi):
                row = self.most[v]
                row[self.ranks[i]] = np.maximum(row[self.ranks[i]], self.tfs[i])
            self.least[v] = self.m[lo:hi].min()
        for v in range(len(parent) - 1, 0, -1):  # children stand behind their parent
            np.maximum(self.most[parent[v]], self.most[v], out=self.most[parent[v]])
            self.least[parent[v]] = min(self.least[parent[v]], self.least[v])

    def _runs(self, lo: int, hi: int, depth: int, leaf: int) -> list[tuple[int, int]]:
        """Spans of the children: a next term each, small neighbours together."""
        after = np.array([r[depth] if len(r) > depth else -1 for r in self.ranks[lo:hi]])
        cuts = [lo, *(np.flatnonzero(np.diff(after)) + 1 + lo).tolist(), hi]
        out: list[tuple[int, int]] = []
        for x, y in zip(cuts, cuts[1:]):
            if out and y - out[-1][0] <= leaf:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
        return out

    def gains(self, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((hi - lo, self.most.shape[1]), np.int64)
        for k in range(lo, hi):
            out[k - lo, self.ranks[k]] = gain(self.tfs[k].astype(np.int64), self.m[k])
        return out


class Best:
    """The k best (score, document) of each item: higher scores first, then smaller ids, null last."""

    def __init__(self, items: int, k: int, floors: np.ndarray):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.maximum(floors, 1)
        self.visited = self.passed = 0

    def add(self, item: int, score: int, doc: int | None) -> None:
        heap, entry = self.heaps[item], (score, doc is not None, -(doc or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        else:
            heapq.heappushpop(heap, entry)
        if len(heap) == self.k:
            self.least[item] = max(self.least[item], heap[0][0])

    def search(self, trie: Trie, ids: list, items: Items) -> None:
        """Depth first through a trie. ids: of its documents, as they were given."""
        bound = lambda v: items.of(gain(trie.most[v].astype(np.int64), trie.least[v]))
        todo = [(0, bound(0))]
        while todo:
            v, bounds = todo.pop()
            active = bounds >= self.least
            if not active.any():
                self.passed += 1
                continue
            self.visited += 1
            if trie.children[v]:
                todo += sorted(((c, bound(c)) for c in trie.children[v]), key=lambda x: int(x[1].max()))
                continue
            which = np.flatnonzero(active)
            for lo in range(*trie.spans[v], LEAF):  # a leaf of equal term sets may be large
                hi = min(lo + LEAF, trie.spans[v][1])
                scores = items.of(trie.gains(lo, hi), active)
                for row, i in zip(*np.nonzero(scores >= self.least[which])):
                    if scores[row, i] >= self.least[which[i]]:
                        self.add(int(which[i]), int(scores[row, i]), ids[trie.order[lo + row]])


def best_of(vectors: DataFrame, items: Items, rank_of: np.ndarray, n_docs: int, n_terms: int, k: int, floors: np.ndarray) -> DataFrame:
    """item (number), doc_id, score: what each task found, k of each item at most."""
    kind = vectors.schema["doc_id"].dataType.simpleString()
    rows = max(64, min(8192, CELLS // items.vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.size), k, floors)
        held: list[tuple] = []

        def through() -> None:
            if held:
                ranks, tfs = [], []
                for _, _, terms, times in held:
                    r = rank_of[np.frombuffer(terms, np.int32)]
                    at = np.argsort(r)
                    ranks.append(r[at])
                    tfs.append(np.frombuffer(times, np.int32)[at])
                m = np.array([50 + 50 * n * n_docs // n_terms for _, n, _, _ in held], np.int64)
                best.search(Trie(ranks, tfs, m, items.vocabulary), [h[0] for h in held], items)
                held.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                held += zip(*(c.to_pylist() for c in batch.slice(lo, rows).columns))
                if len(held) >= rows:
                    through()
        through()
        out = [(i, -e[2] if e[1] else None, e[0]) for i, heap in enumerate(best.heaps) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    found = vectors.where("length(terms) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each item with their rank."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of (item_id, terms) with at most so many terms together (a larger item is a block of its own)."""
    words = map_texts(items.where("item_id is not null"), ["item_id"], lambda texts: [[sorted(set(terms_of(t))) for t in texts]], "terms array<binary>")
    each = words.select("item_id", F.explode("terms").alias("term")).distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for r in each.orderBy("item_id").toLocalIterator():
        if block and size + len(r.terms) > most:
            yield block
            block, size = [], 0
        block.append((r.item_id, [bytes(t) for t in r.terms]))
        size += len(r.terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k highest-scoring documents of each item. docs: doc_id, text; items: item_id, text."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(items.select("item_id", "text"), pairs):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        vectors = materialise(restricted(docs.select("doc_id", "text"), vocabulary), "vectors")
        n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = document_frequencies(vectors, len(vocabulary))
        by_frequency = np.lexsort((np.arange(len(df)), -df))
        rank_of = np.empty(len(df), np.int64)
        rank_of[by_frequency] = np.arange(len(df))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df[by_frequency].tolist()], np.int64)
        own = Items([rank_of[[vocabulary[t] for t in terms]].tolist() for _, terms in block], weights)
        find = lambda rows, floors, own=own, rank_of=rank_of, n=n_docs, size=n_terms: ranked(best_of(rows, own, rank_of, n, size, k, floors), k)
        floors = np.ones(len(block), np.int64)
        for r in find(vectors.where(F.pmod(F.xxhash64("doc_id", "terms"), F.lit(FLOOR)) == 0), floors).where(F.col("rank") == k).select("item", "score").collect():  # a row an item
            floors[r.item] = r.score
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = materialise(find(vectors, floors).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "hits")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)
