"""Nulls in any column, very long texts, ties, repeated rows and clashing names in operators and pipeline stages."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, html_extract, lang_id, license_scan, media, minhash, packing, token_counts

LONG = "The password = \"hunter22x\" is here. " + " ".join(f"word{i} and the" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox and the lazy dog ran over the hill", "en", "a", 5),
    (1, "the quick brown fox and the lazy dog ran over the hill", "en", "a", 5),  # a repeated row
    (1, "another text with the id of the first one and no other relation", "en", "a", 5),
    (2, "The quick brown fox and the lazy dog ran over the hill", "en", "a", 5),  # a near copy, by its words equal
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, LONG, "en", "a", None),
    (None, "the text of a document without an id and its token = abcdef123", "en", None, 1),
    (None, "the text of a document without an id and its token = abcdef123", "en", None, 1),
    (-7, "der kurze text mit umlauten äöü und ß", None, "b", 3),
]
MORE = "text_ string, kinds string, part long, node string, rejected boolean, label long, key long, tail long, n long, ids string, lang_pred string, spans string, row long, of long, html string, media string, pcm string"


@pytest.fixture(scope="module")
def docs(spark):
    more = ("x", "y", 1, "z", True, 2, 3, 4, 5, "i", "l", "s", 6, 7, "h", "m", "p")
    return spark.createDataFrame([(*r, *more) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, " + MORE)


def test_pipeline_stages_on_edge_cases(spark, docs, sf_dir):
    import corpus_pipeline as p

    many = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(docs, allowMissingColumns=True)
    spoken = p.language(spark, many, sf_dir)
    assert spoken.columns == list(p.COLUMNS)
    kept = Counter((r.doc_id, r.text) for r in spoken.where("doc_id is null or doc_id < 1000").collect())
    assert all(kept[i, t] in (0, n) for (i, t), n in Counter(r[:2] for r in ROWS).items()) and not any(i in (3, 4) for i, _ in kept)
    one = p.near_duplicate(spark, docs, sf_dir)
    assert one.columns == list(p.COLUMNS)
    got = Counter((r.doc_id, r.text) for r in one.collect())
    # rows of one id are one document to the stage: a copy of any of them goes; rows without an id stay
    assert got == Counter({ROWS[0][:2]: 1, ROWS[2][:2]: 1, (3, None): 1, (4, ""): 1, ROWS[6][:2]: 1, ROWS[7][:2]: 2, ROWS[9][:2]: 1})
    clean = p.secrets(spark, docs, sf_dir)
    assert clean.columns == list(p.COLUMNS) and clean.count() == len(ROWS)
    texts = {r.text for r in clean.collect()}
    assert "the text of a document without an id and its [assign]" in texts and None in texts and any(t and t.startswith("The [assign]\" is here. word0") and len(t) > 800_000 for t in texts)
    pieces = p.packing(spark, docs, sf_dir).collect()
    ids = Counter(r.doc_id for r in pieces if r.start == 0)
    assert ids == Counter(r[0] for r in ROWS)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_operators_on_edge_cases(spark, docs):
    path = token_counts.default_tokenizer()
    lengths = token_counts.length_histogram(token_counts.count_lengths(token_counts.encoded_lengths(docs, path))).collect()
    assert sum(r.n_docs for r in lengths) == len(ROWS) and max(r.n_tokens for r in lengths) > 100_000
    groups = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs, k=4).collect()}
    assert groups[2, 9] == (1, False) and groups[3, 0] == (3, True) and all(c is None and not k for (i, _), (c, k) in groups.items() if i is None)
    models = lang_id.train(docs, per_language=10)
    answers = defaultdict(set)
    for r in lang_id.identify(docs, models, ("doc_id", "text")).collect():
        answers[r.text].add((r.lang_pred, r.score, r.rejected))
    assert all(len(a) == 1 for a in answers.values()) and answers[None] == answers[""] == {("und", 0.0, True)}
    assert license_scan.scan_licenses(docs).count() == 0
    stored = Counter(r.media_sha256 for r in media.digest_media(media.stored_media(docs)).collect())
    assert sorted(stored.values()) == [1, 1, 1, 1, 2, 2, 2]
    assert packing.pack(docs, path).select("doc_id").distinct().count() == 7


def test_html_of_very_long_pages_repeated_rows_and_ties(spark):
    long = "<body><p>Site menu entry</p>" + "".join(f"<p>sentence number {i} of the long page</p>" for i in range(20_000)) + "</body>"
    page = lambda i: f"<body><p>Site menu entry</p><p>{['granite', 'harbour', 'violet'][i]} own words of this page</p></body>"
    rows = [(1, "http://a.b/p/1", page(0)), (2, "http://a.b/p/2", page(1)), (3, "http://a.b/p/3", page(2)), (2, "http://a.b/p/2", page(1)), (4, "http://a.b/q/long", long), (5, "http://a.b/q/long", None), (6, None, page(0)), (None, "http://c.d/p/2", "x < y &amp; <b>z")]
    df = spark.createDataFrame([(*r, 1, "c", [3]) for r in rows], "page_id long, url string, html string, key long, class string, places array<int>")
    got = html_extract.extract(df).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    text = defaultdict(set)
    for r in got:
        text[r.page_id].add(r.text)
    assert text[2] == {"harbour own words of this page"} and text[5] == {""} and text[None] == {"x < y & z"}
    assert text[6] == {"Site menu entry granite own words of this page"}  # no host, no partner
    assert next(iter(text[4])).startswith("sentence number 0 ") and len(next(iter(text[4]))) > 700_000


def test_nearest_neighbours_with_ties(spark):
    """Copies of a vector are one node; of equal scores the smaller ids come first, however many there are."""
    x = np.eye(4)
    rows = [(i, x[i % 4].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, lambda i: i % 100 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 400, 100):
        assert got[q] == [(i, 1.0) for i in range(0, 400, 4) if i != q][:5]
