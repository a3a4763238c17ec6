"""Collocations, lexical search and the similarity join against brute force, and their defined cases."""

import math
import os
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations, jaccard_join, lexical_search, minhash

from .test_pairs import brute_components


def brute_collocations(rows, least, first):
    f, total = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {p: n for p, n in f.items() if len(p) > 2 and n >= least}
    inside = defaultdict(int)
    for (lang, *w), n in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[(lang, *w[i : i + k])] = max(inside[(lang, *w[i : i + k])], n)
    out = []
    for (lang, *w), a in found.items():
        if 100 * inside[(lang, *w)] >= 80 * a:
            continue
        s, _, left, right = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out.append((lang, -s, -a, " ".join(w).encode(), left, right))
    ranks, result = Counter(), []
    for lang, s, a, p, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= first:
            result.append((lang, ranks[lang], p.decode(), -a, left, right, total[lang], -s))
    return sorted(result)


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["ÄÖ", "İx", "a b", "\x00", "\x1c"]
    rows = []
    for i in range(400):
        w = [words[j] for j in np.minimum(rng.zipf(1.4, 60) - 1, len(words) - 1)]
        w[10:14], w[30:32] = ["New", "york", "City", "hall"], ["Red", "tape"]
        ends = rng.choice(["", "", "", "", ",", ".", "!\n", "\t", ";"], 60)
        rows.append((["en", "de", None, "e\x00n"][i % 4], " ".join(x + e for x, e in zip(w, ends))))
    return rows + [("en", None), ("en", ""), ("xx", "one word"), rows[0], rows[0], ("en", "tick tock " * 5000)]


def test_collocations_hold_little_in_workers_and_free_their_tries(spark, prose, monkeypatch):
    from pyspark import SparkContext

    made, put = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append((put(self, value), type(value))) or made[-1][0])
    assert collocations.collocations(spark.createDataFrame(prose, "lang string, text string"), 30, 50, size=200).count()
    tries = [b for b, kind in made if kind is collocations.DoubleArray]
    assert tries and not any(os.path.exists(b._path) for b in tries)
    blobs = spark.range(0, 40, 1, 1).selectExpr("cast(repeat('x', 1000000) as binary) as words")
    sizes = lambda: [r.n for r in blobs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long").collect()]
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with collocations.small_batches(spark):
        assert max(sizes()) <= 10
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before and sum(sizes()) == 40


def test_collocations_equal_brute_force(spark, prose):
    df = spark.createDataFrame([(i, lang, text, 1, "q") for i, (lang, text) in enumerate(prose)], "doc_id long, lang string, text string, h long, word string")
    got = collocations.collocations(df, 30, 50, size=200)  # several tries a length
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(prose, 30, 50)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("lang = 'xx'")).count() == 0


def test_double_array_finds_all_phrases_and_no_others():
    rng = np.random.default_rng(1)
    for words, length, n in ((300, 3, 5000), (70_000, 2, 30_000), (5, 4, 200), (1, 2, 1)):
        phrases = np.unique(rng.integers(1, words + 1, (n, length)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), axis=0)
        trie = collocations.DoubleArray(phrases)
        assert len(trie.check) < 8 * phrases.size * trie.bytes + 8192
        names = np.append(np.append(np.zeros(1, np.uint64), np.unique(phrases)), np.uint64(12345))
        names[1:] = np.sort(names[1:])
        codes = rng.integers(0, len(names), 20_000).astype(np.int32)
        planted = phrases[rng.integers(0, len(phrases), 700)].ravel()
        codes[: len(planted)] = np.searchsorted(names[1:], planted) + 1
        h = names[codes]
        want = Counter(map(tuple, np.stack([h[i : len(h) - length + 1 + i] for i in range(length)], 1).tolist()))
        known = set(map(tuple, phrases.tolist()))
        got = Counter(trie.accepted(names, np.concatenate([codes, np.zeros(collocations.LONGEST, np.int32)])).tolist())
        assert {tuple(trie.phrases[i].tolist()): c for i, c in got.items()} == {p: c for p, c in want.items() if p in known} and got


def brute_search(docs, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for item, t in items:
        if item is not None:
            wanted[item] |= set(terms(t))
    out = []
    for item, own in wanted.items():
        scores = []
        for (i, c), n in zip(counts, sizes):
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own & c.keys())
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_lexical_search_equals_brute_force(spark, sf_dir):
    rng = np.random.default_rng(4)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    words = [f"t{i}" for i in range(40)]
    docs += [(1000 + i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(600)]
    docs += [(5000 + i, docs[7][1]) for i in range(120)] + [docs[3], docs[3], (None, docs[3][1]), (None, docs[3][1]), (9000, None), (9001, ".,\n"), (9002, "The Ünï" * 30_000)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(500, " ".join(words[:9])), (501, docs[7][1]), (502, None), (503, "nowhere-to-be-found"), (504, "t1 T1"), (504, "t2"), (None, "t1")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score long, terms string")
    it = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int")
    for k, pairs in ((50, lexical_search.PAIRS), (7, 300)):  # one block, many blocks
        got = lexical_search.search(df, it, k, pairs)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, k)
    assert lexical_search.search(df.limit(0), it).count() == lexical_search.search(df, it.limit(0)).count() == 0


def test_the_trie_passes_over_subtrees():
    """Bounds leave most of the documents alone, once some good ones are known, and don't change what is found."""
    rng = np.random.default_rng(6)
    ranks = [np.unique(rng.zipf(1.3, 30) % 500) for _ in range(4000)]
    tfs = [np.ones(len(r), np.int32) for r in ranks]
    items = lexical_search.Items([[100, 200, 300, 400]], np.arange(500) + 1)
    for i in range(0, 600, 10):
        ranks[i] = np.union1d(ranks[i], [100, 200, 300, 400])
        tfs[i] = np.ones(len(ranks[i]), np.int32)
    trie = lexical_search.Trie(ranks, tfs, np.full(4000, 50), 500)
    assert sorted(trie.order) == list(range(4000)) and all(a < b for a, b in trie.spans)
    own = lexical_search.Best(1, 20, np.ones(1, np.int64))
    own.search(trie, list(range(4000)), items)
    scores = [int(items.of(trie.gains(k, k + 1))[0, 0]) for k in range(4000)]
    best = sorted((-s, trie.order[k]) for k, s in enumerate(scores))[:20]
    assert sorted((-e[0], -e[2]) for e in own.heaps[0]) == best
    assert own.visited < len(trie.spans) / 3 and own.passed > 0


def test_similar_groups_equal_brute_force(spark, sf_dir):
    rng = np.random.default_rng(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for size in (3, 6, 9, 12, 14, 20, 27, 30, 60):  # sets on both sides of any boundary, pairs near 0.8
        base = [f"w{n}" for n in rng.integers(0, 5000, size)]
        for i in range(60):
            w = list(base)
            w[rng.integers(0, 3) * (size - 1) // 2 : 0] = [] if i % 3 else [f"x{rng.integers(0, 10**6)}"]
            w = w[rng.integers(0, 3) :]
            w += [f"y{n}" for n in rng.integers(0, 50, rng.integers(0, 3))]
            rows.append((10_000 + 100 * size + i, " ".join(w).upper() if i % 3 else "  ".join(w)))
    rows += [(90_000, None), (90_001, " \t\n"), (90_002, "one two"), (90_003, "One  TWO"), (90_004, "one two three")]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, node long, keys string")
    for k in (5, 2):
        got = jaccard_join.similar_groups(df, k=k)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
        assert found == brute_components(rows, k)


def test_all_similar_sets_share_a_key():
    """For every boundary: subsets between light sets, lists where one is heavy."""
    rng = np.random.default_rng(2)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = lambda s, x: set(np.concatenate(([jaccard_join.subset_keys(s, 80)] if len(s) < x else []) + ([jaccard_join.list_keys(s, 80, *none)] if len(s) >= jaccard_join.least_shared(x, 80) else [none[0]])).tolist())
    for _ in range(300):
        n = int(rng.integers(1, 30))
        a = np.sort(rng.integers(1, 1 << 63, n).astype(np.uint64))
        cut = a[np.sort(rng.permutation(n)[: rng.integers(max(1, n - 5), n + 1)])]
        b = np.sort(np.concatenate([cut, rng.integers(1, 1 << 63, rng.integers(0, 4)).astype(np.uint64)]))
        if minhash.reaches(a, b, 80):
            for x in (1, 6, 12, 18, 25):
                common = keys(a, x) & keys(b, x)
                assert common and any((k % 2 == 1) == (max(len(a), len(b)) < x) for k in common)
            low = np.frombuffer(jaccard_join.parity(a), np.uint8)[None]
            assert len(jaccard_join.by_parity(low, np.frombuffer(jaccard_join.parity(b), np.uint8), 80)) == 1


def test_links_between_members_that_the_first_of_a_list_has_nothing_to_do_with(spark):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    core, other = words(100), words(90)
    texts = [words(80), core, core + " " + words(3), other, words(4) + " " + other, words(70)]
    sets = [(minhash.shingles(t, 5), t) for t in texts]
    rows = sorted((minhash.node_of(s), i, jaccard_join.parity(s), t) for i, (s, t) in enumerate(sets))
    fine = {n: jaccard_join.fine_parity(sets[i][0]) for n, i, *_ in rows}
    for first in range(len(rows)):  # whichever number is the smallest
        renamed = {n: j for j, (n, *_) in enumerate(rows[first:] + rows[:first])}
        ddl = "node long, rep long, low binary"
        lists = spark.createDataFrame([(1, renamed[n], low, fine[n]) for n, _, low, _ in rows], "key long, node long, low binary, fine binary")
        left = {r.node for r in jaccard_join.plausible(jaccard_join.marked(lists, "node").select("key", "node", "mark"), 80, block=2).collect()}
        assert left == {renamed[n] for n, i, *_ in rows if 1 <= i <= 4}
    lows = spark.createDataFrame([(n, low, fine[n]) for n, _, low, _ in rows], "node long, low binary, fine binary")
    members = spark.createDataFrame([(1, n, rows[0][0]) for n, *_ in rows], "key long, node long, first long")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = minhash.joined_nodes(spark.createDataFrame([r[:3] for r in rows], ddl), members, docs, 5, 80, jaccard_join.by_parity, open_=lambda m: jaccard_join.across(m, lows, 80))
    assert {r.node: r.component_id for r in of.collect()} == {n: {2: 1, 4: 3}.get(i, i) for n, i, *_ in rows}


def test_word_hashes_follow_the_words():
    rng = np.random.default_rng(11)
    for _ in range(30):
        words = [bytes(rng.integers(33, 255, rng.integers(1, 12)).astype(np.uint8)) for _ in range(50)] + [b"AbC", b"abc", b"x" * (minhash.PIECE + 5), b"X" * (minhash.PIECE + 5)]
        gaps = [b" ", b"\t\n", b"\x0b", b"\x0c\r "]
        order = rng.integers(0, len(words), 300)
        text = b"  " + b"".join(words[i] + gaps[rng.integers(0, 4)] for i in order)
        got = minhash.word_hashes(text)
        low = [words[i].lower() for i in order]
        assert text.lower().split() == low and len(got) == 300
        first = {}
        for w, h in zip(low, got.tolist()):
            assert first.setdefault(w, h) == h
        assert len(set(first.values())) == len(first)
    assert len(minhash.word_hashes(b"")) == len(minhash.word_hashes(b" \n")) == 0


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(12)
    for n in (3, 100, 600, 3000, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.05, 0.11, 0.3, 1.0):
            new = rng.integers(0, 1 << 63, int(share * n)).astype(np.uint64)
            b = np.unique(np.concatenate([a[len(new) :], new]))
            both = len(np.intersect1d(a, b))
            assert jaccard_join.differ_finely(jaccard_join.fine_parity(a), jaccard_join.fine_parity(b)) <= len(a) + len(b) - 2 * both
            marks = [[bytes(7) + bytes([i]) + jaccard_join.parity(x) + jaccard_join.fine_parity(x)] for i, x in enumerate((a, b))]
            if minhash.reaches(a, b, 80):
                assert jaccard_join.may_link(*marks, 80)[0]
            elif n >= 600 and share >= 0.3:
                assert not jaccard_join.may_link(*marks, 80)[0]


def test_lists_are_dealt_with_short_marks_first(spark, monkeypatch):
    """All members of all lists travel with THIN parity bits; only those left travel with more."""
    rng = np.random.default_rng(15)
    base = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (40, 90, 200, 201, 330, 2000)] + [base, base[20:], np.concatenate([base[:300], np.arange(600, dtype=np.uint64)])]
    lows = spark.createDataFrame([(i, jaccard_join.parity(x), jaccard_join.fine_parity(x), jaccard_join.parity(x, jaccard_join.THIN)) for i, x in enumerate(map(np.sort, sets))], "node long, low binary, fine binary, thin binary")
    lists = spark.createDataFrame([(key, i) for key in (1, 2) for i in range(len(sets))], "key long, node long")
    passes, plausible = [], jaccard_join.plausible

    def seen(members, percent):
        passes.append((members.count(), max(len(r.mark) for r in members.collect())))
        return plausible(members, percent)

    monkeypatch.setattr(jaccard_join, "plausible", seen)
    got = sorted((r.key, r.node, r.first) for r in jaccard_join.likely_members(lists, lows, 80).collect())
    assert got == [(1, 6, 6), (1, 7, 6), (2, 6, 6), (2, 7, 6)]
    assert passes[0] == (2 * len(sets), 8 + 4 + jaccard_join.THIN // 8) and len(passes) == 3
    assert passes[1][0] < passes[0][0] and passes[1][1] == jaccard_join.HEAD < passes[2][1]


def test_marks_of_short_lists_are_dealt_once(spark):
    """Members whose marks rule out all others of their list: marks are not dealt again for each step."""
    rng = np.random.default_rng(17)
    sets = [np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64)) for _ in range(60)]
    lows = [(i, jaccard_join.parity(x), jaccard_join.fine_parity(x)) for i, x in enumerate(sets)]
    lists = spark.createDataFrame([(key, *lows[i]) for key in range(100) for i in rng.permutation(len(sets))[:8].tolist()], "key long, node long, low binary, fine binary")
    members = jaccard_join.materialise(jaccard_join.marked(lists, "node").select("key", "node", "mark"), "members")
    jvm = spark.sparkContext._jsc.sc()

    def dealt():
        jvm.listenerBus().waitUntilEmpty()
        time.sleep(1)
        return jvm.statusStore().executorSummary("driver").totalShuffleWrite()

    before = dealt()
    assert jaccard_join.plausible(members, 80).count() == 0
    marks = 800 * (jaccard_join.HEAD + len(lows[0][2]))
    assert 0 < dealt() - before < 1.5 * marks


def test_filters_lose_no_value(spark):
    rng = np.random.default_rng(18)
    inside, outside = (rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64) for _ in range(2))
    inside[:4] = -1, 0, 1 << 62, -(1 << 63)
    known = jaccard_join.filter_of(spark.createDataFrame([(int(x),) for x in inside], "v long"))
    assert jaccard_join.in_filter(known.value, inside).all() and jaccard_join.in_filter(known.value, outside).mean() < 0.01
    rows = spark.createDataFrame([(int(x), i) for i, x in enumerate([*inside, *outside])], "v long, i long")
    left = {r.i for r in jaccard_join.filtered(rows, known).collect()}
    assert left >= set(range(5000)) and left.isdisjoint(r.i for r in jaccard_join.filtered(rows, known, inside=False).collect())


def test_thin_parities_never_rule_out_a_link():
    rng = np.random.default_rng(16)
    for n in (3, 100, 600, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for cut in (0, n // 10, n // 5, n // 2):
            marks = [[bytes(7) + bytes([i]) + jaccard_join.parity(x, jaccard_join.THIN)] for i, x in enumerate((a, a[cut:]))]
            ok = jaccard_join.may_link(*marks, 80)[0]
            assert ok if minhash.reaches(a, a[cut:], 80) else n < 100 or not ok


def test_the_boundary_follows_the_cost():
    assert jaccard_join.boundary_of({}, 1.0, 80) == 1
    few, many = jaccard_join.boundary_of({n: 100 for n in range(5, 25)}, 0.01, 80), jaccard_join.boundary_of({n: 100 for n in range(5, 25)}, 50.0, 80)
    assert few < many <= jaccard_join.HEAVY


def test_frequent_shingles_come_last():
    kept = np.arange(10, 110, dtype=np.uint64)
    frequent, counts = np.arange(10, 60, dtype=np.uint64), np.arange(50, 0, -1)
    keys = jaccard_join.list_keys(kept, 80, frequent, counts)
    assert keys.tolist() == (jaccard_join._mixed(kept[50:71]) & ~np.uint64(1)).tolist()


def test_empty_and_null_rows_of_the_join(spark):
    ddl = "doc_id long, text string"
    assert jaccard_join.similar_groups(spark.createDataFrame([], ddl)).count() == 0
    rows = jaccard_join.similar_groups(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, None)], ddl)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 0, 0), (0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
