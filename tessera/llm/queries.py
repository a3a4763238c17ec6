"""The queries of this package, for the registry."""

from __future__ import annotations

from .ann import op2_nearest_neighbours
from .bpe import op5_byte_bpe
from .collocations import op11_collocations
from .html_extract import op6_html_text
from .jaccard_join import op13_jaccard_join
from .lang_id import op8_language_id
from .lexical_search import op12_lexical_search
from .license_scan import op4_license_scan
from .media import op9_media
from .minhash import op10_minhash
from .packing import op3_packing
from .secret_scan import BASE, RULES, op1_secret_scan
from .token_counts import op7_token_counts

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_nearest_neighbours, op3_packing, op4_license_scan, op5_byte_bpe, op6_html_text, op7_token_counts, op8_language_id, op9_media, op10_minhash, op11_collocations, op12_lexical_search, op13_jaccard_join)}
_RULES = "\n UNION ALL ".join(
    f"SELECT doc_id, '{r.kind}' AS kind, {i} AS place, {r.least} AS least, regexp_extract_all(text, {q}, 0) AS m, regexp_extract_all(text, {q}, {r.group}) AS g, string_split_regex(text, {q}) AS p FROM d"
    for i, r in enumerate(RULES)
    for q in ["'" + r.regex.replace("'", "''") + "'"]
)
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), r AS ({_RULES}),
        s AS (SELECT doc_id, kind, place, least, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM r),
        t AS (SELECT doc_id, kind, place, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n FROM s WHERE length(g[i]) >= least),
        c AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
            string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, place, a + n) FILTER (place < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, place, a + n) AS spans FROM t GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (doc_id)""",
    "op10_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        both AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM both JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_n >= 80 * (na.n + nb.n - both_n)),
        sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(p, q) AS (SELECT a, a FROM sym UNION SELECT r.p, s.b FROM reach r JOIN sym s ON r.q = s.a),
        comp AS (SELECT p, min(q) AS c FROM reach GROUP BY p)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.p = doc_id""".replace("both AS", "common AS").replace("FROM both", "FROM common"),
}

# Exact, as the search is on tables small enough for SQL.
ORACLE_SQL["op2_nearest_neighbours"] = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
    k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, n::INTEGER AS rank, vec_id, score FROM k WHERE n <= 20"""
# For pages that mark their article; what else the operator takes off is not in it.
ORACLE_SQL["op6_html_text"] = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(</article>|$)', 1) AS t FROM pages),
    b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '</?(a|b|i|em|strong|span|u|small|code)( [^>]*)?>', '', 'g') AS t FROM a),
    c AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b),
    d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL["op12_lexical_search"] = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents), n AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
    c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n), i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term, n_docs),
    s AS (SELECT item_id, r, n.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n USING (r), c GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50"""

ORACLE_SQL["op11_collocations"] = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
    pc AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pc, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k)),
    f AS (SELECT lang, k, p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30), t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pc GROUP BY lang),
    c AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1),
    i AS (SELECT lang, a, k, w, n, unnest(range(1, k - n + 2)) AS i FROM c, (VALUES (2), (3)) v(n) WHERE n < k),
    m AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS p, max(a) AS longer FROM i GROUP BY ALL),
    o AS (SELECT c.* FROM c LEFT JOIN m USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a),
    cut AS (SELECT o.lang, o.p, a, w, k, unnest(range(1, k)) AS j FROM o),
    b AS (SELECT cut.lang, cut.p, a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.p = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = cut.lang AND y.p = array_to_string(w[j + 1:cut.k], ' ')),
    z AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS best FROM b),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM z WHERE best = 1)
    SELECT lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM k JOIN t USING (lang) WHERE rank <= 2000"""

ORACLE_SQL["op13_jaccard_join"] = ORACLE_SQL["op10_minhash"].replace("w[i:i + 3]", "w[i:i + 4]").replace("len(w) - 2, 2", "len(w) - 3, 2").replace(", doc_id = coalesce(c, doc_id) AS kept", "")
