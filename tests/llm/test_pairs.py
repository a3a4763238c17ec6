"""Near-duplicates, nearest neighbours and the pipeline against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, minhash


def brute_components(rows, k, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    places, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            places[x].append(i)
    for own in places.values():
        both.update((min(a, b), max(a, b)) for n, a in enumerate(own) for b in own[:n])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    rng = np.random.default_rng(8)
    base = [f"w{n}" for n in rng.integers(0, 5000, 60)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for i in range(150):  # copies with some words changed: many pairs are near 0.8
        w = list(base)
        for j in rng.choice(60, rng.integers(0, 4), replace=False):
            w[j] = f"x{rng.integers(0, 10**6)}"
        rows.append((10_000 + i, " ".join(w).upper() if i % 3 else "  ".join(w)))
    rows += [(20_000, None), (20_001, " \t\n"), (20_002, "one two"), (20_003, "One  TWO"), (20_004, "one two three")]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, node long, bands string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, k=4).collect()}
    want = brute_components(rows, 4)
    assert len(got) == len(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_edge_tables(spark):
    ddl = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], ddl)).count() == 0
    rows = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (1, "other words in this one row here")], ddl)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in rows if r.doc_id) == [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)]


def test_cross_links_join_what_stars_leave_apart(spark):
    """A bucket whose smallest member is linked with none of the others, which are linked with each other."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    core = words(100)
    texts = [words(40) + " " + core] + [core + " " + words(5) for _ in range(30)]
    nodes = [(minhash.node_of(minhash.shingles(t, 4)), i, t) for i, t in enumerate(texts)]
    members = spark.createDataFrame([(1, n, n, (minhash.signature(minhash.shingles(t, 4)) >> np.uint64(40)).astype(np.uint8).tobytes()) for n, _, t in nodes], "key long, node long, label long, low binary")
    links = minhash.cross_links(members, spark.createDataFrame(nodes, "node long, doc_id long, text string"), 4, 80, block=8)
    labels = {r.node: r.label for r in minhash.components(links).collect()}
    assert len({labels[n] for n, i, _ in nodes if i}) == 1 and nodes[0][0] not in labels


def test_components_of_a_long_chain(spark):
    ids = np.random.default_rng(1).permutation(200).tolist()
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.label for r in minhash.components(links).collect()}
    assert len({got[i] for i in ids}) == 1 and got[1001] == got[1000] != got[0]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    x[500:900] = x[500] + 0.05 * rng.normal(size=(400, 24))  # a tight group
    x[900:1000] = x[900]  # equal vectors
    return (x * rng.uniform(0.5, 2, (1500, 1))).astype(np.float32)


def recall_of(got, x, ids, queries, k=20):
    """Checks ranks and scores of the answers (query: [(rank, vec_id, score)]); gives the share of the true nearest that were found."""
    hits = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:k]
        own = sorted(got[ids[q]])
        assert [r for r, _, _ in own] == list(range(1, k + 1)) and all(abs(s[np.flatnonzero(ids == v)[0]] - score) < 1e-9 * max(1, abs(score)) for _, v, score in own)
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(own, own[1:]))
        hits += len(set(ids[want].tolist()) & {v for _, v, _ in own})
    assert set(got) == {ids[q] for q in queries}
    return hits / (k * len(queries))


def answers(df, **more):
    got = defaultdict(list)
    for r in ann.nearest(df, lambda i: i % 20 == 0, **more).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return got


def test_nearest_neighbours_recall(spark, vectors):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    bad = [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [float("nan")] + [1.0] * 23, 1), (5003, [None] + [1.0] * 23, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, node int")
    assert recall_of(answers(df), vectors.astype(float), np.arange(1500), range(0, 1500, 20)) >= 0.9


def test_nearest_neighbours_of_very_different_lengths(spark):
    """One vector is ten thousand times longer than most, a fifth of them are a thousand times shorter."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1200, 16)) * rng.uniform(0.5, 2, (1200, 1))
    x[:240] *= 1e-3
    x[777] *= 1e4
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert recall_of(answers(df), x.astype(float), np.arange(1200), range(0, 1200, 20)) >= 0.9


def test_nearest_neighbours_of_repeated_ids_and_mixed_sizes(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (3, [2.0, 0.0, 0.0]), (20, [1.0, 1.0, 0.0]), (5, [3.0, 3.0]), (7, [0.0, 2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, lambda i: i % 20 == 0).orderBy("query_id", "query_row", "rank").collect():
        got[r.query_id, r.query_row].append((r.vec_id, r.score))
    zero = [(5, 3.0), (1, 0.5), (1, 0.5), (0, 0.0)]
    assert [v for (q, _), v in got.items() if q == 0] == [zero, zero]
    assert [v for (q, _), v in got.items() if q == 20] == [[(3, 2.0), (7, 2.0)]]


def test_nearest_neighbours_of_few(spark):
    ddl = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], ddl), lambda i: i % 20 == 0).count() == 0
    rows = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0]), (3, [2.0, 0.0])], ddl), lambda i: i % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 2, 2.0), (0, 2, 3, 2.0), (0, 3, 1, 0.5)]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edge = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    spoken = p.language(spark, docs.unionByName(edge).withColumn("rejected", F.lit(1)), sf_dir)
    assert spoken.columns == list(p.COLUMNS) and sorted(r.doc_id for r in spoken.collect()) == sorted(r.doc_id for r in docs.collect())
    kept = p.near_duplicate(spark, docs.unionByName(docs.limit(5)), sf_dir)
    want = {c for _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    clean = p.secrets(spark, kept, sf_dir)
    assert clean.count() == len(want) and clean.columns == list(p.COLUMNS)
    out = p.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == want
    assert out.agg(F.sum("length")).first()[0] == out.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    none = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
