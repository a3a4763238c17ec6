"""Operators on single texts: exact round trips, brute force, and the defined edge cases."""

import hashlib
import json
import os
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, html_extract, lang_id, license_scan, media, packing, secret_scan, token_counts

EDGE = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, "   \n\t ", None, None, None),
    (4, "The token = \"abc123\" and AKIA" + "Z9" * 10 + " end", "en", "s", 1),
    (4, "The token = \"abc123\" and AKIA" + "Z9" * 10 + " end", "en", "s", 1),
    (None, "secret:token:abcdefgh password=short0 12345", "de", "s", 1),
    (6, "é🙂 " * 3 + "0123456789abcdef0123456789 é api_key='A/b+c=9'", "fr", "s", 1),
    (7, "x" * 3000 + " " + "word " * 2000, "en", "s", 1),
    (8, "Licensed under the Apache License, Version 2.0.\nplain line", "en", "s", 1),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long, text_ string, kinds string, part long, node string"


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in EDGE], DDL)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_bpe_equals_the_rank_library(spark, docs, empty, sf_dir):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    both = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = bpe.digest_bpe(both, path, pattern).collect()
    want = []
    for r in both.collect():
        ids = e.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.digest_bpe(empty, path, pattern).count() == 0
    encoded = bpe.encode_texts(docs, path, pattern)
    texts = {bytes(r.bytes).decode() for r in bpe.decode_ids(encoded, path, pattern).collect()}
    assert texts == {r[1] or "" for r in EDGE}


def test_bpe_appends_and_edits_are_exact():
    coder = bpe.coder(*bpe.default_vocabulary())[0]
    rng = np.random.default_rng(3)
    piece = bpe.EditablePiece(coder)
    for _ in range(60):
        at = int(rng.integers(0, len(piece.piece) + 1))
        end = min(len(piece.piece), at + int(rng.integers(0, 3)))
        more = bytes(rng.choice(list(b"thereandingo "), int(rng.integers(0, 5))).tolist())
        if rng.random() < 0.5:
            piece.append(more)
        else:
            piece.replace(at, end, more)
        assert piece.ids() == (coder.encode(piece.piece) if piece.piece else [])
        assert coder.decode(piece.ids()) == piece.piece


def test_token_counts_match_the_library_and_brute_force(spark, docs, empty, sf_dir):
    from tokenizers import Tokenizer

    path = token_counts.default_tokenizer()
    t = Tokenizer.from_file(path)
    special = spark.createDataFrame([(90, "a <|endoftext|> b<|endoftext|>")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).unionByName(special)
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) for r in both.collect())
    rows = token_counts.length_histogram(token_counts.count_lengths(token_counts.encoded_lengths(both, path)), block=16).orderBy("n_tokens").collect()
    assert sum(r.n_docs for r in rows) == len(want)
    for r in rows:
        assert r.n_docs == want.count(r.n_tokens)
        assert r.docs_upto == sum(w <= r.n_tokens for w in want)
        assert r.tokens_upto == sum(w for w in want if w <= r.n_tokens)
        assert r.docs_over == len(want) - r.docs_upto
        assert r.truncated_total == sum(min(w, r.n_tokens) for w in want)
    assert token_counts.length_histogram(token_counts.count_lengths(token_counts.encoded_lengths(empty, path))).count() == 0


def packed(rows, length=1024):
    """Checks that pieces tile documents and sequences; gives the padding."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    sizes = [sum(n for _, n in parts) for parts in by_seq.values()]
    assert sorted(by_seq) == list(range(len(by_seq)))
    return sum(0 if n & (n - 1) == 0 else length - n for n in sizes)


def test_packing_tiles_documents_and_sequences(spark, docs, empty, sf_dir):
    from tokenizers import Tokenizer

    path = token_counts.default_tokenizer()
    t = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 10**6).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rows = packing.pack(both, path).collect()
    assert packed(rows) == 0
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids.setdefault(r.doc_id, [])
        assert r.start == len(own)
        own.extend(packing.piece_ids(bytes(r.ids)).tolist())
        assert len(packing.piece_ids(bytes(r.ids))) == r.length
    for r in both.collect():
        assert ids[r.doc_id] == t.encode(r.text or "", add_special_tokens=False).ids + [0]
    assert packed(packing.pack(docs, path).collect()) == 0
    assert packing.pack(empty, path).count() == 0


def test_cutting_stock_is_near_its_bound():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 500):
        lengths = np.sort(rng.choice(np.arange(1, 1024), n, replace=False))
        demand = rng.integers(1, 400, n)
        patterns, counts = packing.cutting_stock(lengths, demand, 1024)
        assert (patterns @ lengths <= 1024).all() and np.allclose(counts @ patterns, demand)
        kept = packing.rounded_patterns(lengths, demand, 1024)
        used = np.zeros(1025, int)
        for copies, uses, gap in kept:
            assert copies > 0 and gap >= 0 and sum(k * v for k, v in uses.items()) == 1024 - gap
            for k, v in uses.items():
                used[k] += copies * v
        assert (used[lengths] <= demand).all()
        free = ((demand - used[lengths]) * lengths).sum()
        assert free >= sum(copies * gap for copies, _, gap in kept)
        if n >= 60:
            assert free <= 0.05 * (demand * lengths).sum()
    # thirds and halves: the optimum is known
    patterns, counts = packing.cutting_stock(np.array([342, 512, 682]), np.array([300, 200, 100]), 1024)
    assert counts.sum() <= 100 + 100 + 100 + 1


def test_packing_of_every_tail_length(spark, tmp_path):
    """1023 tail lengths, and more in some partitions than in others; ids are bytes, so that lengths are chosen freely."""
    path = tmp_path / "bytes.json"
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, merges=[]))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(path))
    rng = np.random.default_rng(6)
    sizes = list(range(1023)) * 2 + rng.integers(0, 5000, 400).tolist() + [300] * 500
    rows = spark.createDataFrame([(i, "a" * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(7)
    got = packing.pack(rows, str(path)).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    assert packed(got) == 0
    ends = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0)
        ends[r.doc_id] = r.start + r.length
    assert ends == {i: n + 1 for i, n in enumerate(sizes)}
    pieces = Counter(r.doc_id for r in got)
    assert sum(pieces[i] > -(-(n + 1) // 1024) for i, n in enumerate(sizes)) < 0.05 * len(sizes)  # few tails are cut


def brute_spans(text):
    rules = [("assign", re.compile(secret_scan.BASE[0].regex), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    found = [(m.start(), i, m.end(), kind) for i, (kind, r, g, least) in enumerate(rules) for m in r.finditer(text) if len(m[g]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_secret_spans_equal_brute_force(spark, docs, empty, sf_dir):
    both = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    got = secret_scan.scan(both, secret_scan.BASE).select("text", secret_scan.written(F.col("spans")).alias("s")).collect()
    assert len(got) == both.count()
    assert all(r.s == brute_spans(r.text) for r in got)
    assert any(r.s for r in got)
    assert secret_scan.scan(empty).count() == 0


def test_texts_with_thousands_of_secrets(spark):
    """Spans and redaction across many blocks, overlapping spans and characters beyond one byte or unit."""
    rng = np.random.default_rng(4)
    words = ["token = abc" + "é", "é🙂", "0123456789abcdef" * 2, "AKIA" + "0" * 20, "secret:" + "ab12" * 8, "x", "\n", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".c", "password=eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".cc_dd"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), n)) for n in (1, 5, 127, 128, 129, 700, 9000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secret_scan.scan(df, secret_scan.BASE).select("text", secret_scan.written(F.col("spans")).alias("s")).collect()
    assert all(r.s == brute_spans(r.text) for r in rows) and max(r.s.count(",") for r in rows) > 4000
    spans = {r.doc_id: r.spans for r in secret_scan.scan(df).collect()}
    for r in secret_scan.redact(df).collect():
        text, at, out = texts[r.doc_id], 0, []
        for s in spans[r.doc_id]:
            if s.end > at:
                out += [text[at : max(s.start, at)], f"[{s.kind}]"]
                at = s.end
        assert r.text == "".join(out) + text[at:]


def test_trigram_queries():
    q = secret_scan.trigram_query(secret_scan.BASE[0].regex)
    assert frozenset(("tok", "oke", "ken")) in q and frozenset(("api", "pi_", "i_k", "_ke", "key")) in q and len(q) == 6
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [frozenset(("aki", "kia"))]
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == []
    assert secret_scan.trigram_query("(abc)?x") == []


def test_redaction_keeps_all_else(spark, docs):
    rows = secret_scan.redact(docs).collect()
    assert len(rows) == len(EDGE) and rows[0].__fields__ == docs.columns
    texts = {r.text for r in rows}
    assert "The [assign]\" and [access] end" in texts and None in texts and "" in texts
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows)


def test_media_round_trips(spark, docs, empty):
    rng = np.random.default_rng(5)
    pcm = (np.cumsum(rng.normal(0, 300, 5000))).clip(-30000, 30000).astype(np.int16)
    coded = media.encode_adpcm(pcm)
    flat = media.decode_adpcm(coded, 256)
    slow = []
    for b in range(len(coded) // 256):  # sample by sample
        block = coded[b * 256 : b * 256 + 256]
        value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
        slow.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value + (-d if code & 8 else d)))
                index = max(0, min(88, index + int(media.INDEX_CHANGE[code & 7])))
                slow.append(value)
    assert flat.tolist() == slow
    assert np.abs(flat[: len(pcm)].astype(int) - pcm).mean() < 200
    assert media.MULAW_PCM[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW_PCM[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    for kind in (media.MULAW, media.ALAW):
        assert media.read_wav(media.write_wav(kind, 8000, b"abc"))[3] == b"abc"
    rows = media.digest_media(media.stored_media(docs)).collect()
    for r, (i, text, *_) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(EDGE, key=lambda r: (r[0] is None, r[0] or 0))):
        raw = (text or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) == (i, len(raw), len(want), hashlib.sha256(want).hexdigest())
        codes = np.frombuffer(want, np.uint8)
        pcm = media.resample(media.MULAW_PCM[codes], 16000, 8000)
        assert r.feature == f"pcm:{media.features(pcm, 8000)},alaw:{media.features(media.ALAW_PCM[codes], 16000)},adpcm:{media.features(media.decode_adpcm(want, 64), 16000)}"
    assert media.digest_media(media.stored_media(empty)).count() == 0
    long = spark.createDataFrame([(1, "tone " * 400_000)], "doc_id long, text string")
    assert media.digest_media(media.stored_media(long)).first().payload_bytes == 2_000_000
    stored = media.decode_media(media.store_texts(docs)).collect()
    assert all(media.read_wav(bytes(r.pcm))[1] == 8000 for r in stored)
    assert media.resample(np.arange(10, dtype=np.int16), 8000, 12000).tolist() == [0, 0, 1, 2, 2, 3, 4, 4, 5, 6, 6, 7, 8, 8, 9]
    assert media.resample(np.array([3, 6, 0, 30, 31], np.int16), 12000, 8000).tolist() == [4, 2, 30, 31]
    assert media.resample(np.arange(9, dtype=np.int16), 16000, 8000).tolist() == [0, 2, 4, 6, 8]
    assert media.resample(np.arange(8, dtype=np.int16), 16000, 8000).tolist() == [0, 2, 4, 6]


PAGE = "<html><head><title>t</title></head><body><nav><a>Menu {i}</a></nav><div class='x ad'>buy<div>more</div></div><article><h1>Title {i}</h1><p>One &amp; two&nbsp;three <b>bo</b>ld.<br>Next<p>Shared line</p><script>var a='</p>'</script><!-- c --><div class='comments'><p>no</p></div></article><footer>foot {i}</footer></body></html>"
PLAIN = "<body><p>Welcome to the site</p><p>Own words {i}</p><p>All pages say this</p><div>More of {i}</div></body>"


def test_html_text(spark):
    rows = [(i, f"http://a.b/en/{i}", PAGE.format(i=i)) for i in range(5)] + [(10 + i, f"http://c.d/x/{i}?q=1", PLAIN.format(i=i)) for i in range(5)] + [(20, None, None), (21, "http://a.b/z", ""), (22, "http://[bad", "<p>a <i>b</i>c"), (22, "http://[bad", "<p>a <i>b</i>c"), (None, "http://c.d/x/9", "<nav>never closed<article>Text")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, part long, host string")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    for i in range(5):
        assert text[i] == f"Title {i} One & two three bold. Next Shared line"
        assert text[10 + i] == f"Own words {i} More of {i}"
    assert text[20] == "" and text[21] == "" and text[22] == "a bc" and text[None] == "Text"
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html, want",
    [
        ("<div>Real text</div><section class='comments'><article>Troll</article></section>", "Real text"),
        ("<div>Real text</div><article class='comment'>Troll</article><aside><article>Teaser</article></aside>", "Real text"),
        ("<article>Real text</article><div id=comments><article>Troll</article></div>", "Real text"),
        ("<p class='advert'>Buy<p>Real<p>text", "Real text"),
        ("<ul><li class='share'>Share<li>Real<li>text</ul><p>end", "Real text end"),
        ("<table><tr><td class=ad>Buy<td>Real<tr><td>text</table>", "Real text"),
        ("<div><span class='ad'>Buy<b>now</div><p>Real text", "Real text"),
        ("<div class='ad'><div>Buy<p>now</div>more</div>Real text", "Real text"),
        ("<head><title>t</title><p>Real text", "Real text"),
        ("<div>a<nav>menu<article>Real</article> more</div>", "Real"),
        ("<div class='has sidebar'><h2>x</h2><main>Real text</main></div>", "Real text"),
        ("<div class='has sidebar'><article>Real text</article></div>", "Real text"),
        ("<div class='ad'></span>Buy</p>Buy</div>Real <b>te</b>xt", "Real text"),
        ("<article>Real text</article><section class='comments'><article class='comment'><p>Troll</article></section>", "Real text"),
        ("<article><p>Real text<article class='comment'>Troll", "Real text"),
        ("<aside><article>Teaser</article></aside><header><article>Promo</article></header><article>Real text</article>", "Real text"),
        ("<p>Menu</p><main class='has-comments'><p>Real text that is longer", "Real text that is longer"),
        ("<nav>Home</nav><main class='has-comments'><p>Real text that is longer", "Real text that is longer"),
        ("<nav>Home</nav><article class='post type-post category-search'><p>Real text", "Real text"),
        ("<header>Home</header><article class='post promo'><p>Real text</article><div class='promo'>Buy</div>", "Real text"),
        ("<nav>Home</nav><article id='header-story'><p>Real text</article>", "Real text"),
        ("<p>Real text</p><div class='related'>" + "<p>many other stories that are much longer</p>" * 20 + "</div>", "Real text"),
        ("<p>Real text</p><div class='comments sidebar'>" + "<p>many comments that are much longer</p>" * 20 + "</div>", "Real text"),
        ("<p>Real text</p><div id='post-sidebar'>" + "<p>many links</p>" * 90 + "</div>", "Real text"),
        ("<article><p>Real <p class='footer-note'>text</p><div class='social-share'>Share</div><div class='related-posts'>More</div><div class='ad-300x250'>Buy</div></article>", "Real text"),
        ("<article><p>Real text</p><section id='reader-responses'>Me too</section></article>", "Real text"),
        ("<div class='no-sidebar with-ads'><p>Real text</p></div><div class='ads'>Buy</div>", "Real text"),
        ("<div class='layout has-sidebar'><div class='content'><p>Real text", "Real text"),
        ("<h1>Re</h1><div class='has-sidebar'><p>al text, and much of it<div class='sidebar'>side</div></div>", "Re al text, and much of it"),
        ("<p>Real text</p><div class='comments'><p>A comment that is far longer than the text that it is about</div>", "Real text"),
        ("<div class='page-header'>" * 300 + "<p>Real text", "Real text"),
    ],
)
def test_html_elements_end_as_html_has_it(html, want):
    assert html_extract.main_text(html, None) == want


class Reader(HTMLParser):
    """The text of the article elements by the standard library's parser: an independent extractor for pages whose article is marked."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.out = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag not in html_extract.INLINE:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")
        if tag not in html_extract.INLINE:
            self.out.append("\n")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.out.append(data.replace("\n", " "))


def test_html_text_equals_an_independent_extractor(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html)
        reader.close()
        want[r.page_id] = " ".join(filter(None, (" ".join(x.split()) for x in "".join(reader.out).split("\n"))))
    got = {r.page_id: r.text for r in html_extract.op6_html_text(spark, sf_dir).collect()}
    assert got == want and all(want.values())


def test_differencing_equals_brute_force(spark):
    """Pages without marks: what stays is each page's text less a longest common subsequence with its nearest neighbour's lines."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    line = lambda: " ".join(rng.choice(words, 12))
    menu, rows = [line() for _ in range(6)], []
    for i in range(40):
        own = [line() for _ in range(int(rng.integers(4, 9)))]
        rows.append((i, f"http://h.i/{i // 5:02}/{i % 5}", menu[: int(rng.integers(3, 7))] + own))
    df = spark.createDataFrame([(i, u, "".join(f"<p>{x}</p>" for x in t)) for i, u, t in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for i, url, text in rows:
        sides = [rows[j] for j in (i - 1, i + 1) if 0 <= j < len(rows)]
        other = max(sides, key=lambda r: len(os.path.commonprefix([r[1], url])))[2]
        shared, at = [], 0
        for x in text:  # own lines are unlike, so the common lines stand in the same order in both
            if x in other[at:]:
                shared.append(x)
                at = other.index(x, at) + 1
        assert got[i] == " ".join(x for x in text if x not in shared) and shared


def test_pages_without_a_scheme_or_with_odd_hosts_are_differenced(spark):
    hosts = ["http://a.org", "b.org", "localhost:8080", "http://[c.org", "//d.org", "HTTPS://E.org"]
    own = ["a cat sat upon its mat", "rivers freeze in winter months", "trains depart from platform nine", "bread needs flour yeast salt"]
    pages = [(i * 10 + k, f"{h}/news/{k}", f"<p>Menu of the site</p><p>{own[k]}</p><p>All rights reserved</p>") for i, h in enumerate(hosts) for k in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {p: own[p % 10] for p, *_ in pages}
    assert html_extract._host_path("b.org/x/?q=1#f") == ("b.org", "/x?q=1") and html_extract._host_path("http://h.org/x?y") == ("h.org", "/x?y")
    assert html_extract._host_path(None) == html_extract._host_path("/a/b") == html_extract._host_path("mailto:x") == (None, "")


def test_runs_of_near_copies_are_looked_past_to_their_ends(spark):
    """Small blocks against a search that goes as far as it must, in runs longer than a block and its reach."""
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(400)]
    line = lambda: " ".join(rng.choice(words, 12))
    rows = []
    for host, runs in (("a.b", (1, 30, 1)), ("c.d", (40,)), ("e.f", (1, 1, 9, 25, 1)), ("g.h", (21, 1))):
        menu = [line() for _ in range(5)]
        for run, size in enumerate(runs):
            body = [line() for _ in range(6)]
            rows += [(f"http://{host}/{run}/{i:03}", menu + body + [f"this story was read {100 + i} times so far by all of our friends"] + ([line()] if i % 11 == 3 else [])) for i in range(size)]
    df = spark.createDataFrame([(u, u, "".join(f"<p>{x}</p>" for x in t)) for u, t in rows], "key string, url string, html string")
    want = {}
    for i, (url, text) in enumerate(rows):
        sides = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(rows) and rows[j][0][:10] == url[:10]:
                both = html_extract.shared_lines(text, rows[j][1])
                if not html_extract.near_copy(text, html_extract.sketches(text), rows[j][1], html_extract.sketches(rows[j][1]), both):
                    sides.append((-len(os.path.commonprefix([url, rows[j][0]])), both))
                    break
                j += step
        if sides and (both := min(sides, key=lambda s: s[0])[1]):  # of equal ones the one before
            want[url] = both
    assert len(want) > 60 and not any(u.startswith("http://c.d") and u[-3:] == "000" for u in want)
    for block, reach in ((4, 1), (256, 64)):
        assert {r.key: r.places for r in html_extract.deletions(df, block=block, reach=reach).collect()} == want


def test_plain_copies_are_near_copies():
    rng = np.random.default_rng(14)
    text = [f"line {w} of a page with words {w * 7} and more" for w in range(7)]
    sketch = lambda t: np.array(html_extract.sketches(t), np.int64)
    code = lambda t: np.array([hash(x) for x in t], np.int64)
    pages = [[t if rng.random() < 0.9 else [t + "!", text[int(rng.integers(7))], f"else {rng.random()}"][int(rng.integers(3))] for t in text] for _ in range(300)]
    checked = 0
    for own in pages[:40]:
        got = html_extract.plain_copies(code(own), sketch(own), np.stack([code(p) for p in pages]), np.stack([sketch(p) for p in pages]))
        near = [html_extract.near_copy(own, html_extract.sketches(own), p, html_extract.sketches(p), html_extract.shared_lines(own, p)) for p in pages]
        checked += int(got.sum())
        assert all(n for g, n in zip(got, near) if g)
    assert checked > 1000


def test_html_text_of_copies_and_stubs(spark):
    menu = "".join(f"<p>Menu entry {w}</p>" for w in "home news maps shop jobs help".split())
    words = "granite harbour violet lantern meadow copper orchard thunder saddle river velvet compass".split()
    body = "".join(f"<p>{w} story that only this {w} article tells</p>" for w in words)
    stub = lambda i: f"<p>{words[i]} {words[i + 1]}</p><p>{words[-1 - i]} {words[-2 - i]} {words[i + 3]}</p>"
    rows = [(i, f"http://e.f/a/{i}", menu + body) for i in range(5)]  # equal pages
    rows += [(10 + i, f"http://e.f/b/{i}", menu + body + f"<p>read {i + 117} times so far today</p>") for i in range(5)]  # near copies
    rows += [(20 + i, f"http://e.f/c/{i}", menu + stub(i)) for i in range(4)] + [(30 + i, f"http://g.h/c/{i}", menu + stub(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    plain = lambda html: html_extract.main_text(html, None)
    for i in range(5):
        assert text[i] == plain(body)
        assert text[10 + i] == plain(body) + f" read {i + 117} times so far today"
    for i in range(4):
        assert text[20 + i] == text[30 + i] == plain(stub(i))


def test_lines_align_by_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        got = html_extract.shared_lines(a, b)
        assert len(got) == t[-1, -1] and got == sorted(set(got))
        at = -1
        for i in got:
            at = b.index(a[i], at + 1)


def test_license_blocks(spark, docs, empty):
    rows = [(1, "Some prose. This work is licensed under the GNU General Public License, version 3. More prose follows here."), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "licensed to no one"), (4, "All rights reserved.\nReleased under the MIT License."), (5, None), (6, "Licensed under the Apache Licence, Version 2.0!")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license long")
    got = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(df).collect()}
    assert set(got) == {(1, "GPL-3.0"), (2, "GPL-2.0"), (4, "proprietary"), (4, "MIT")}
    r = got[1, "GPL-3.0"]
    assert rows[0][1][r.start : r.end] == "This work is licensed under the GNU General Public License, version 3" and r.exact
    assert license_scan.scan_licenses(empty).count() == 0 and license_scan.scan_licenses(docs).count() == 1


def test_all_licenses_of_a_block(spark):
    mit = license_scan.NOTICES["MIT-grant"]
    rows = [(1, mit + ".\nThis work is licensed under the GNU General Public License,\nversion 3."), (2, "This work is licensed under the GNU Lesser General Public License, version 3.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in license_scan.scan_licenses(df).collect()} == {(1, "MIT-grant"), (1, "GPL-3.0"), (2, "LGPL-3.0")}
    # variants that compress better do not keep the true one from being tried
    t = {f"V{i}": f"Licensed under the Example Public License with exception {w}, version {i}.5." for i, w in enumerate("alpha beta gamma delta".split())}
    t["true"] = "Example Public License."
    block = "Licensed under the Example Public License with exception omega, version 9."
    assert [m[0] for m in license_scan.Scanner(t).scan(block)] == ["true"]


def test_full_license_texts(spark):
    """Whole texts in comments, wrapped otherwise and with a holder put in; ties and repeated rows; one very long line."""
    texts = license_scan.read_templates()
    wrap = lambda t, w: "\n".join("# " + " ".join(t.split()[i : i + w]) for i in range(0, len(t.split()), w))
    rows, want = [], set()
    for i, (name, text) in enumerate(texts.items()):
        rows += [(i, "Some prose.\n\n" + wrap(text.replace("Copyright (c)", "Copyright (c) 2020 The Holders"), 7) + "\n\ncode()")] * 2
        want.add((i, f"{name}-text"))
    filler = " ".join(f"w{n}" for n in range(200_000))
    rows += [(100, f"{filler} {' '.join(texts['ISC'].split())} {filler}"), (101, "All rights reserved. " * 1000), (102, "All day the rights were reserved.")]
    want |= {(100, "ISC-text"), (101, "proprietary")}
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in found} == want
    by = Counter((r.doc_id, r.license) for r in found)
    assert by[0, want and sorted(w for i, w in want if i == 0)[0]] == 2 and by[101, "proprietary"] == 1000
    isc = next(r for r in found if r.doc_id == 100)
    assert rows[2 * len(texts)][1][isc.start : isc.end].startswith("ISC License") and isc.saved_rank == 1 and isc.exact


def test_licenses_equal_all_templates_on_all_stretches():
    """Random edits of notices in prose: every template on every stretch of words, by the same rule, without index or compression."""
    rng = np.random.default_rng(14)
    names = ["MIT", "Apache-2.0", "GPL-3.0", "CC0-1.0", "proprietary", "BSD-grant"]
    scanner = license_scan.Scanner({n: license_scan.NOTICES[n] for n in names})
    prose = "the of and software license work under version to in copies permitted".split()
    seen = Counter()
    for _ in range(150):
        words = list(rng.choice(prose, rng.integers(0, 12)))
        for n in rng.choice(names, rng.integers(0, 3)):
            own = license_scan.NOTICES[n].rstrip(".").split()
            for _ in range(rng.integers(0, 3)):
                at = int(rng.integers(0, len(own)))
                own[at : at + int(rng.integers(0, 2))] = list(rng.choice(prose, rng.integers(0, 2)))
            words += own + list(rng.choice(prose, rng.integers(0, 6)))
        text = " ".join(words)
        low = license_scan.words_of(text)
        want = set()
        for t, name in enumerate(names):
            m = len(scanner.words[t])
            for lo in range(len(low)):
                if any(scanner.confirm(t, low[lo:hi]) for hi in range(lo + 1, min(lo + m + scanner.put_in(t), len(low)) + 1)):
                    want.add(name)
        got = {r[0] for r in scanner.scan(text)}
        assert got == want, text
        seen.update(got)
    assert len(seen) == len(names) and min(seen.values()) >= 5


def test_language_models(spark, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    edge = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 34 !", "en"), (10**6 + 2, "", None)], "doc_id long, text string, lang string")
    models = lang_id.train(docs, per_language=40)
    rows = {r.doc_id: r for r in lang_id.identify(docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text")), models).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(rows[i].lang_pred == lang for i, lang in truth.items()) >= 0.97 * len(truth)
    assert all(0 <= r.score <= 1 for r in rows.values())
    for i in range(3):
        assert (rows[10**6 + i].lang_pred, rows[10**6 + i].score) == ("und", 0.0)
    assert not any(rows[i].rejected for i in truth)
    noise = "".join(np.random.default_rng(1).choice(list("abcdefghijklmnopqrstuvwxyzéüß "), 2000))
    assert models.predict([noise])[0][2]
    # the sample is that of the smallest hashes, however many rows and equal rows there are
    many = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, F.lit(8)).otherwise(F.col("id")).alias("doc_id"), F.lit("xy").alias("lang")).withColumn("text", F.concat(F.lit("word number "), F.col("doc_id").cast("string")))
    alike = spark.range(3000).select(F.lit(6).cast("long").alias("doc_id"), F.lit("zz").alias("lang"), F.lit("only these words").alias("text"))
    assert lang_id.train(many.drop("id").unionByName(alike), per_language=30).langs == ["xy", "zz"]
    none = lang_id.train(empty)
    assert none.predict(["abc", None]) == [("und", 0.0, True)] * 2


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(4)
    codes = np.concatenate([lang_id.normal("".join(rng.choice(list("abc "), 300)))])
    counts = dict(lang_id.ngrams(codes, 3))
    m = lang_id.Models(["x"], [counts], 3)
    prob, weight = lang_id.kneser_ney(counts, 3)
    chars = sorted({g[0] for g in prob if len(g) == 1})
    unseen = weight[()] / (len(chars) + 1)

    def p(gram):
        return prob[gram] if gram in prob else (weight.get(gram[:-1], 1.0) * p(gram[1:]) if len(gram) > 1 else unseen)

    for context in [(97, 98), (99, 32), (98, 98)]:
        assert sum(p((*context, c)) for c in chars) + weight.get(context, 1.0) * weight.get(context[1:], 1.0) * unseen == pytest.approx(1.0, abs=1e-9)
    doc = lang_id.normal("abca bc")
    want, padded = 0.0, [32, *doc.tolist()]
    for i in range(2, len(padded)):
        want -= np.log(p(tuple(padded[i - 2 : i + 1])))
    assert m.cross_entropy([doc])[0, 0] == pytest.approx(want / (len(doc) - 1))


def test_byte_ranks_rejects_other_files(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"type": "WordPiece"}}))
    assert token_counts.byte_ranks(str(path)) is None
