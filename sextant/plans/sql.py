"""The SQL (DuckDB's dialect) that each query of the catalogue is held against."""

from __future__ import annotations

from .catalogue import ROBOTS, RUN, SAMPLE, STEPS, STOP, WAIT  # noqa: F401

_TOKEN = r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"
_STOP = ", ".join(f"'{w}'" for w in STOP)


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{_TOKEN}')"


def _kept(text: str) -> str:
    return f"list_filter({_tokens(text)}, lambda w: w NOT IN ({_STOP}))"


def _postings(table: str, key: str, tokens) -> str:
    return f"""SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM (SELECT {key} AS doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT {key}, {tokens("text")} AS t FROM {table})) GROUP BY term, doc_id"""


_CORPUS = f"""tok AS MATERIALIZED (SELECT doc_id, unnest({_tokens("text")}) AS term FROM documents),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY term, doc_id),
dl AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS doc_len FROM post GROUP BY doc_id),
ts AS MATERIALIZED (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf FROM post GROUP BY term),
cs AS MATERIALIZED (SELECT count(*) AS n, CAST(sum(doc_len) AS BIGINT) AS c, CAST(sum(doc_len) AS DOUBLE) / count(*) AS a, (SELECT count(*) FROM ts) AS v FROM dl)"""

_ASKED = f"""q AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_tokens("text")}) AS term FROM benchmark) GROUP BY query_id, term)"""

_K = "(tf + 1.2 * tf) / (tf + 1.2 * (0.25 + 0.75 * doc_len / a))"
_OKAPI = "tf / (tf + 0.5 + 1.5 * doc_len / a)"
_QTF = "(qtf + 100.0 * qtf) / (qtf + 100.0)"
_SPARSE = {
    "okapi_tf": _OKAPI,
    "tfidf": f"{_OKAPI} * ln(CAST(n AS DOUBLE) / df)",
    "bm25": f"qtf * ln((n + 0.5) / (df + 0.5)) * {_K}",
    "bm25_k2": f"ln((n + 0.5) / (df + 0.5)) * {_K} * {_QTF}",
    "bm25_literal": f"ln(n + 0.5 / df + 0.5) * {_K} * {_QTF}",
}
_REST = "0.79 * greatest({0}, 0.1) / greatest(c - doc_len, 1)"
_DENSE = {
    "laplace": "ln((coalesce(tf, 0) + 1) / CAST(doc_len + v AS DOUBLE))",
    "laplace_repeated": "qtf * ln((coalesce(tf, 0) + 1) / CAST(doc_len + v AS DOUBLE))",
    "jelinek_mercer": f"ln(0.21 * coalesce(tf, 0) / doc_len + {_REST.format('coalesce(ttf, 0) - coalesce(tf, 0)')})",
}


def _scores(model: str, rounded: bool = False) -> str:
    """CTEs that end in s(query_id, doc_id, score)."""
    weight = (_SPARSE | _DENSE)[model]
    corpus = _CORPUS.replace("CAST(sum(doc_len) AS DOUBLE) / count(*) AS a", "round_even(CAST(sum(doc_len) AS DOUBLE) / count(*), 0) AS a") if rounded else _CORPUS
    if model in _SPARSE:
        rows = "q JOIN post USING (term) JOIN ts USING (term) JOIN dl USING (doc_id), cs"
    else:
        rows = """(SELECT DISTINCT query_id, doc_id FROM q JOIN post USING (term)) AS cand JOIN q USING (query_id)
LEFT JOIN post ON post.doc_id = cand.doc_id AND post.term = q.term LEFT JOIN ts ON ts.term = q.term JOIN dl ON dl.doc_id = cand.doc_id, cs"""
        return f"""{corpus}, {_ASKED}, s AS MATERIALIZED (SELECT cand.query_id AS query_id, cand.doc_id AS doc_id, round(sum({weight}), 6) + 0.0 AS score FROM {rows} GROUP BY cand.query_id, cand.doc_id)"""
    return f"""{corpus}, {_ASKED}, s AS MATERIALIZED (SELECT query_id, doc_id, round(sum({weight}), 6) + 0.0 AS score FROM {rows} GROUP BY query_id, doc_id)"""


def _top(model: str, k: int = 1000, rounded: bool = False) -> str:
    return f"""WITH {_scores(model, rounded)}
SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"""


def _all_models() -> str:
    sparse = ", ".join(f"sum({w}) AS {m}" for m, w in _SPARSE.items())
    dense = ", ".join(f"sum({w}) AS {m}" for m, w in _DENSE.items())
    names = [*_SPARSE, *_DENSE]
    return f"""WITH {_CORPUS}, {_ASKED},
x AS (SELECT query_id, doc_id, {sparse} FROM q JOIN post USING (term) JOIN ts USING (term) JOIN dl USING (doc_id), cs GROUP BY query_id, doc_id),
y AS (SELECT cand.query_id AS query_id, cand.doc_id AS doc_id, {dense} FROM (SELECT DISTINCT query_id, doc_id FROM q JOIN post USING (term)) AS cand JOIN q USING (query_id)
LEFT JOIN post ON post.doc_id = cand.doc_id AND post.term = q.term LEFT JOIN ts ON ts.term = q.term JOIN dl ON dl.doc_id = cand.doc_id, cs GROUP BY cand.query_id, cand.doc_id)
SELECT query_id, doc_id, {", ".join(f"round({m}, 6) + 0.0 AS {m}" for m in names)} FROM x JOIN y USING (query_id, doc_id)"""


def _judged(trec: bool) -> str:
    """CTEs that end in j(query_id, doc_id, rank, rel, num_rel, rel_ret)."""
    return f"""{_scores("bm25")},
r0 AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s),
r AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id {"DESC" if trec else "ASC"}) AS INTEGER) AS rank FROM r0 WHERE r <= {RUN}),
g AS MATERIALIZED (SELECT item_id AS query_id, doc_id, quality * (2 - toxic) AS grade FROM labels JOIN benchmark ON item_id % 10 = doc_id % 10),
t AS (SELECT query_id, CAST(sum(grade) AS DOUBLE) AS num_rel FROM g GROUP BY query_id HAVING sum(grade) <> 0),
j AS MATERIALIZED (SELECT query_id, doc_id, rank, rel, num_rel, sum(rel) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS rel_ret
FROM (SELECT r.query_id, r.doc_id, rank, num_rel, CAST(coalesce(grade, 0) AS DOUBLE) AS rel FROM r JOIN t ON t.query_id = r.query_id LEFT JOIN g ON g.query_id = r.query_id AND g.doc_id = r.doc_id))"""


def _cuts(ks: tuple[int, ...]) -> str:
    return f"c AS (SELECT query_id, k, sum(CASE WHEN rank <= k THEN rel ELSE 0 END) AS got, max(num_rel) AS num_rel FROM j, (SELECT unnest({list(ks)}) AS k) GROUP BY query_id, k)"


_PRF = "got / k AS p, got / num_rel AS rc"
_AP = "sum(CASE WHEN rel > 0 THEN (rel_ret - rel + 1) / rank {0} ELSE 0 END) / max(num_rel)"
_RP = """SELECT query_id, CASE WHEN max(num_rel) > max(rank) THEN sum(rel) / max(num_rel)
ELSE sum(CASE WHEN rank <= num_rel THEN rel ELSE 0 END) / max(num_rel) END AS v FROM j GROUP BY query_id"""
_NDCG = """i AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS place FROM g),
d AS (SELECT query_id, k, sum(CASE WHEN rank <= k THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM j, (SELECT unnest([5, 10, 20, 50, 100]) AS k) GROUP BY query_id, k),
e AS (SELECT query_id, k, sum(CASE WHEN place <= k THEN (pow(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS best FROM i, (SELECT unnest([5, 10, 20, 50, 100]) AS k) GROUP BY query_id, k),
n AS (SELECT query_id, k, CASE WHEN best = 0 THEN 0 ELSE dcg / best END AS ndcg FROM d JOIN e USING (query_id, k))"""

# web


def _host(url: str) -> str:
    return f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://([^/?#]*))?', 1)"


def _canonical(url: str) -> str:
    host = f"regexp_replace(lower({_host(url)}), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '//+', '/', 'g')"
    query = f"regexp_extract({url}, '^[^?#]*(\\?[^#]+)', 1)"
    return f"'http://' || {host} || {path} || {query}"


def _unescape(text: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{a}', '{b}')"
    return text


_A = """'(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a>'"""
_LINKS = f"""a AS (SELECT url AS src, unnest(regexp_extract_all(html, {_A}, 1)) AS href, unnest(regexp_extract_all(html, {_A}, 2)) AS label FROM pages),
l AS MATERIALIZED (SELECT DISTINCT src, regexp_extract(src, '^[a-zA-Z]+://[^/?#]*') || {_unescape("href")} AS url,
regexp_replace({_unescape("regexp_replace(label, '<[^>]*>', '', 'g')")}, '^\\s+|\\s+$', '', 'g') AS anchor FROM a WHERE href NOT LIKE '#%')"""


def _matches(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({text}), '{w}') AS INTEGER)" for w in words) + ")"


_BASE_WORDS = ["sports", "championships", "league", "baseball", "mlb", "wbsc", "pitch", "bat", "base", "run"]
_DOMAINS = "('en.wikipedia.org', 'mlb.com', 'wbsc.org', 'espn.com')"


def _priority(url: str, anchor: str, domain: str, words: list[str]) -> str:
    return f"CAST(1000 - 40 * ({_matches(anchor, words)} + {_matches(url, words)}) - CASE WHEN {domain} IN {_DOMAINS} THEN 100 ELSE 0 END AS BIGINT)"


def _page_text() -> str:
    body = "CASE WHEN regexp_matches(html, '(?i)<body[\\s>]') THEN regexp_extract(html, '(?is)<body(?:\\s[^>]*)?>(.*?)(?:</body>|$)', 1) ELSE html END"
    out = f"regexp_replace({body}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "iframe", "noscript", "footer", "nav", "header"):
        out = f"regexp_replace({out}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    out = _unescape(f"regexp_replace({out}, '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


_TITLE = _unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_CRAWL = f"""o AS (SELECT src, string_agg(u, ' ' ORDER BY u) AS outlinks FROM (SELECT DISTINCT src, {_canonical("url")} AS u FROM l) GROUP BY src)"""

# graph

_GRAPH = """raw AS (SELECT 'p' || l_partkey AS src, 'p' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, 's' || l_suppkey AS b, 'o' || l_orderkey AS c FROM lineitem),
edges AS MATERIALIZED (SELECT src, unnest([a, b, c]) AS dst FROM raw),
vertices AS MATERIALIZED (SELECT 'p' || p_partkey AS url FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier),
clean AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND src IN (SELECT url FROM vertices) AND dst IN (SELECT url FROM vertices)),
outdeg AS MATERIALIZED (SELECT src, count(*) AS deg FROM clean GROUP BY src)"""


def _pagerank(steps: int) -> str:
    """CTEs that end in p<steps>(url, pr)."""
    out = [_GRAPH, "p0 AS MATERIALIZED (SELECT url, 1.0 / (SELECT count(*) FROM vertices) AS pr FROM vertices)"]
    for k in range(1, steps + 1):
        sink = f"(SELECT coalesce(sum(pr), 0) FROM p{k - 1} WHERE url NOT IN (SELECT src FROM outdeg))"
        flow = f"(SELECT dst, sum(pr / deg) AS flow FROM clean JOIN p{k - 1} ON url = src JOIN outdeg USING (src) GROUP BY dst)"
        out.append(f"f{k} AS MATERIALIZED (SELECT url, 0.15 / n + 0.85 * {sink} / n + 0.85 * coalesce(flow, 0) AS pr FROM vertices LEFT JOIN {flow} ON dst = url, (SELECT CAST(count(*) AS DOUBLE) AS n FROM vertices))")
        out.append(f"p{k} AS MATERIALIZED (SELECT url, pr / (SELECT sum(pr) FROM f{k}) AS pr FROM f{k})")
    return ",\n".join(out)


def _hits(steps: int) -> str:
    """CTEs that end in h<steps>(url, hub, authority)."""
    out = [_GRAPH, "h0 AS MATERIALIZED (SELECT url, CAST(1 AS DOUBLE) AS hub, CAST(1 AS DOUBLE) AS authority FROM vertices)"]
    for k in range(1, steps + 1):
        out.append(f"""g{k} AS MATERIALIZED (SELECT url, coalesce(x.hub, 0) AS hub, coalesce(y.authority, 0) AS authority FROM vertices
LEFT JOIN (SELECT src, sum(authority) AS hub FROM clean JOIN h{k - 1} ON url = dst GROUP BY src) AS x ON x.src = url
LEFT JOIN (SELECT dst, sum(hub) AS authority FROM clean JOIN h{k - 1} ON url = src GROUP BY dst) AS y ON y.dst = url)""")
        out.append(f"h{k} AS MATERIALIZED (SELECT url, hub / (SELECT sqrt(sum(hub * hub)) FROM g{k}) AS hub, authority / (SELECT sqrt(sum(authority * authority)) FROM g{k}) AS authority FROM g{k})")
    return ",\n".join(out)


_DEGREES = """SELECT url, coalesce(i, 0) AS inlinks, coalesce(deg, 0) AS outlinks FROM vertices LEFT JOIN (SELECT dst, count(*) AS i FROM clean GROUP BY dst) ON dst = url LEFT JOIN outdeg ON src = url"""
_DOT = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"

SQL: dict[str, str] = {
    "tokens_per_doc": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "doc_lengths": f"SELECT doc_id, len({_kept('text')}) AS doc_len FROM documents",
    "tokenizer_cases": "SELECT CAST(generate_subscripts(t, 1) AS INTEGER) AS position, unnest(t) AS term FROM (SELECT {0} AS t)".format(_tokens("'" + SAMPLE.replace("'", "''") + "'")),
    "query_lines": f"SELECT t[1] AS query_id, array_to_string(t[2:], ' ') AS terms FROM (SELECT {_kept(chr(39).join(['CAST(item_id AS VARCHAR) || ', '.   ', ' || text']))} AS t FROM benchmark)",
    "clean_text": f"SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ') AS cleaned FROM documents",
    "alnum_words": "SELECT doc_id, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: regexp_full_match(w, '[A-Za-z0-9]+')), ' ') AS kept FROM documents",
    "not_blank": "SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE regexp_matches(text, '\\S')",
    "term_stats": f"WITH {_CORPUS} SELECT term, df, ttf FROM ts",
    "corpus_stats": f"WITH {_CORPUS} SELECT n AS docs, v AS vocabulary, c AS tokens, round(a, 6) AS mean_len, CAST(round_even(a, 0) AS BIGINT) AS rounded_len FROM cs",
    "postings": _postings("documents", "doc_id", _kept),
    "postings_lines": f"SELECT term, string_agg(doc_id || ',' || positions, ' ' ORDER BY doc_id) AS line FROM ({_postings('documents', 'doc_id', _tokens)}) GROUP BY term",
    "postings_lines_by_tf": f"SELECT term, string_agg(doc_id || ',' || positions, ' ' ORDER BY tf DESC, doc_id) AS line FROM ({_postings('documents', 'doc_id', _tokens)}) GROUP BY term",
    "postings_parsed": _postings("conversations", "conv_id", _tokens).replace("ORDER BY pos)", "ORDER BY pos)"),
    "vocabulary": f"WITH {_CORPUS} SELECT v AS vocabulary FROM cs",
    "term_dictionary": f"WITH {_CORPUS} SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM ts",
    "merge_partials": f"WITH {_CORPUS} SELECT term, df, ttf FROM ts",
    "merge_overlapping": f"""WITH x AS ({_postings("documents", "doc_id", _tokens)}), y AS ({_postings("conversations", "conv_id", _tokens)})
SELECT coalesce(x.term, y.term) AS term, coalesce(x.doc_id, y.doc_id) AS doc_id, CASE WHEN y.tf IS NULL OR x.tf < y.tf THEN x.tf ELSE y.tf END AS tf,
CASE WHEN y.tf IS NULL OR x.tf < y.tf THEN x.positions ELSE y.positions END AS positions FROM x FULL JOIN y ON x.term = y.term AND x.doc_id = y.doc_id""",
    "written_index": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf, CAST(sum(tf) AS BIGINT) AS places FROM ({_postings('documents', 'doc_id', _kept)}) GROUP BY term",
    "index_lookup": f"SELECT * FROM ({_postings('documents', 'doc_id', _tokens)}) WHERE term IN ('the', 'der', 'que', 'la')",
    "index_search": _top("bm25"),
    "read_corpus": "SELECT 'D' || doc_id AS docno, replace(replace(text, '<', ' '), chr(10), ' ') AS text FROM documents WHERE text IS NOT NULL",
    "read_words": "SELECT DISTINCT unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS word FROM nation",
    "read_doc_list": "SELECT 'D' || doc_id AS doc_id FROM labels WHERE quality <> 0",
    "read_numbered_queries": f"SELECT CAST(item_id AS VARCHAR) AS query_id, array_to_string(list_filter(string_split_regex(lower(regexp_replace(replace(text, chr(10), ' '), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), '\\s+'), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ') AS query_text FROM benchmark",
    "read_query_lines": "SELECT regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS line FROM benchmark",
    "read_qrels": "WITH g AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality * (2 - toxic) AS DOUBLE) AS grade FROM labels JOIN benchmark ON item_id % 10 = doc_id % 10) SELECT query_id, doc_id, grade, sum(grade) OVER (PARTITION BY query_id) AS num_rel FROM g",
    "read_qrels_stream": "WITH g AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality * (2 - toxic) AS DOUBLE) AS grade FROM labels JOIN benchmark ON item_id % 10 = doc_id % 10) SELECT query_id, doc_id, grade, sum(grade) OVER (PARTITION BY query_id) AS num_rel FROM g",
    "first_wins": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1",
    "documents_by_id": "SELECT 'd' || doc_id AS url, text FROM documents WHERE doc_id IN (0, 7, 19)",
    "probed_pages": "SELECT url, page_id % 3 = 0 AS is_html FROM pages",
    "filtered_postings": f"WITH {_CORPUS}, {_ASKED} SELECT DISTINCT post.term, doc_id, tf FROM post JOIN q ON q.term = post.term AND query_id % 10 = doc_id % 10",
    "run_docnos": f"SELECT query_id || ' Q0 D' || doc_id || ' ' || rank || ' ' || CAST(score AS DECIMAL(18, 6)) || ' Exp' AS value FROM ({_top('bm25')})",
    "index_variants": f"WITH t AS (SELECT DISTINCT item_id, term, count(*) OVER (PARTITION BY item_id, term) AS tf FROM (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark)) SELECT codec, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf FROM t, (SELECT unnest(['zstd', 'none']) AS codec) GROUP BY codec, term",
    "read_link_lists": f"WITH {_GRAPH} SELECT dst AS url, string_agg(src, ' ' ORDER BY src) AS inlinks FROM (SELECT DISTINCT src, dst FROM edges WHERE dst NOT LIKE 'o%') GROUP BY dst",
    "read_assessments": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN toxic = 0 THEN CAST(quality AS VARCHAR) ELSE '' END AS grade, '' AS auto_grade FROM labels",
    "read_link_table": f"WITH {_LINKS}, {_CRAWL} SELECT url, 0 AS n_in, coalesce(outlinks, '') AS outlinks FROM pages LEFT JOIN o ON src = url",
    "read_scalars": f"WITH {_CORPUS} SELECT unnest(['DOCS', 'TOKENS', 'VOCABULARY']) AS name, unnest([n, c, v]) AS value FROM cs",
    "bm25_topk": _top("bm25"),
    **{m: _top(m) for m in [*_SPARSE, *_DENSE] if m != "bm25"},
    "tfidf_rounded_mean": _top("tfidf", rounded=True),
    "all_models": _all_models(),
    "run_lines": f"SELECT query_id || ' Q0 ' || doc_id || ' ' || rank || ' ' || CAST(score AS DECIMAL(18, 6)) || ' Exp' AS value FROM ({_top('bm25')})",
    "run_parsed": f"SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS INTEGER) AS rank FROM ({_top('bm25')})",
    "unknown_terms": f"""WITH {_CORPUS}, u AS (SELECT conv_id AS query_id, unnest({_tokens("text")}) AS term FROM conversations)
SELECT query_id, term, count(*) AS qtf FROM u WHERE term NOT IN (SELECT term FROM ts) GROUP BY query_id, term""",
    "candidate_union": f"WITH {_CORPUS}, {_ASKED} SELECT DISTINCT query_id, doc_id FROM q JOIN post USING (term)",
    "term_lookup": f"WITH {_CORPUS}, {_ASKED} SELECT term, doc_id, tf FROM post WHERE term IN (SELECT term FROM q)",
    "summed_hits": f"WITH {_CORPUS}, {_ASKED} SELECT query_id, doc_id, CAST(sum(tf) AS BIGINT) AS score FROM q JOIN post USING (term) GROUP BY query_id, doc_id",
    "eval_precision_recall": f"WITH {_judged(False)}, {_cuts((5, 10, 20, 50, 100))} SELECT query_id, k, round(p, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 9) AS f1 FROM (SELECT *, {_PRF} FROM c)",
    "eval_precision_trec": f"WITH {_judged(True)}, {_cuts((5, 10, 15, 20, 30, 100, 200, 500, 1000))} SELECT query_id, k, round(got / k, 9) AS precision FROM c",
    "eval_average_precision": f"WITH {_judged(False)} SELECT query_id, round({_AP.format('')}, 9) AS average_precision FROM j GROUP BY query_id",
    "eval_average_precision_trec": f"WITH {_judged(True)} SELECT query_id, round({_AP.format('* rel')}, 9) AS average_precision FROM j GROUP BY query_id",
    "eval_r_precision": f"WITH {_judged(False)} SELECT query_id, round(v, 9) AS r_precision FROM ({_RP})",
    "eval_interpolated": f"""WITH {_judged(True)},
b AS (SELECT query_id, rel_ret / num_rel AS recall, max(rel_ret / rank) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM j)
SELECT query_id, CAST(i AS INTEGER) AS tenths, round(coalesce(max(CASE WHEN recall >= i / 10.0 THEN best END), 0), 9) AS precision FROM b, range(0, 11) AS x(i) GROUP BY query_id, i""",
    "eval_ndcg": f"WITH {_judged(False)}, {_NDCG} SELECT query_id, k, round(ndcg, 9) AS ndcg FROM n",
    "eval_macro": f"""WITH {_judged(False)}, {_cuts((5, 10, 20, 50, 100))}, {_NDCG}, m AS (
SELECT 'average_precision' AS metric, -1 AS k, v AS value FROM (SELECT {_AP.format('')} AS v FROM j GROUP BY query_id)
UNION ALL SELECT 'r_precision', -1, v FROM ({_RP})
UNION ALL SELECT 'precision', k, got / k FROM c UNION ALL SELECT 'recall', k, got / num_rel FROM c
UNION ALL SELECT 'f1', k, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END FROM (SELECT *, {_PRF} FROM c)
UNION ALL SELECT 'ndcg', k, ndcg FROM n)
SELECT metric, k, round(avg(value), 9) AS value, count(*) AS queries FROM m GROUP BY metric, k""",
    "eval_counts": f"WITH {_judged(True)} SELECT count(*) AS queries, CAST(sum(a) AS BIGINT) AS retrieved, sum(b) AS relevant, sum(d) AS rel_ret FROM (SELECT count(*) AS a, max(num_rel) AS b, sum(rel) AS d FROM j GROUP BY query_id)",
    "url_canonical": f"SELECT page_id, {_canonical('url')} AS canonical, {_host('url')} AS domain, md5(url) AS hash, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]') AND length(url) <= 512 AS valid FROM pages",
    "url_keywords": "SELECT doc_id, source || ' x|a ' || lang AS found FROM documents",
    "titles": f"SELECT page_id, {_TITLE} AS title, len(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS n_titles FROM pages",
    "page_text": f"SELECT page_id, {_page_text()} AS text FROM pages",
    "links": f"WITH {_LINKS} SELECT src, url, anchor FROM l",
    "topical_filter": f"WITH {_LINKS} SELECT src, url, anchor FROM l WHERE {_matches('anchor', ['he', 'le', 'sch'])} > 0",
    "link_priority": f"WITH {_LINKS} SELECT src, url, anchor, {_priority('url', 'anchor', _host('src'), ['the', 'an', 'ou', 'en'])} AS priority FROM l",
    "frontier_order": f"""WITH {_LINKS},
w0 AS (SELECT DISTINCT {_canonical("url")} AS url FROM pages),
w1 AS (SELECT u AS url, min(p) AS priority FROM (SELECT {_canonical("url")} AS u, {_priority(_canonical("url"), "anchor", _host("src"), _BASE_WORDS)} AS p FROM l) WHERE u NOT IN (SELECT url FROM w0) GROUP BY u),
f AS (SELECT 0 AS wave, {_priority("url", "''", _host("url"), _BASE_WORDS)} AS priority, url FROM w0 UNION ALL SELECT 1, priority, url FROM w1)
SELECT wave, priority, url, row_number() OVER (ORDER BY wave, priority, url) AS place FROM f""",
    "robots_permission": f"""SELECT page_id, contains(h, 'example') AND h NOT LIKE 'm.%' AND regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) NOT LIKE '/en/%' AS allowed,
CASE WHEN contains(h, 'example') AND h NOT LIKE 'm.%' THEN 2.0 ELSE 1.0 END AS delay FROM (SELECT page_id, url, {_host("url")} AS h FROM pages)""",
    "politeness_delay": f"""SELECT event_id, round(CASE WHEN before IS NULL THEN 0 ELSE greatest(0, {WAIT} - date_diff('microsecond', before, ts) / 1e6) END, 6) AS wait
FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)""",
    "crawl_documents": f"""WITH {_LINKS}, {_CRAWL} SELECT url, '<DOC><DOCNO>' || url || '</DOCNO><HEAD>' || {_TITLE} || '</HEAD><TEXT>' || {_page_text()} || '</TEXT></DOC>' AS content, coalesce(outlinks, '') AS outlinks
FROM pages LEFT JOIN o ON src = url""",
    "inlinks_upsert": f"""WITH {_LINKS}, {_CRAWL}, i AS (SELECT url AS dst, string_agg(src, ' ' ORDER BY src) AS inlinks FROM (SELECT DISTINCT src, url FROM l) GROUP BY url)
SELECT coalesce(p.url, dst) AS url, coalesce(inlinks, '') AS inlinks, CASE WHEN p.url IS NULL THEN NULL ELSE coalesce(outlinks, '') END AS outlinks, p.url IS NULL AS stub
FROM pages AS p LEFT JOIN o ON o.src = p.url FULL JOIN i ON dst = p.url""",
    "pages_upsert": """SELECT source AS url, CASE WHEN max(n_chars) > 15000 THEN 'new' ELSE 'old' END AS content,
array_to_string(list_sort(list_distinct(list(lang) || coalesce(list('n' || lang) FILTER (n_chars > 15000), []))), ' ') AS inlinks,
array_to_string(list_sort(list_distinct(list('o' || lang) || coalesce(list(lang) FILTER (n_chars > 15000), []))), ' ') AS outlinks FROM documents GROUP BY source""",
    "last_wins": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "graph_clean": f"WITH {_GRAPH} SELECT src, dst FROM clean",
    "graph_from_inlinks": f"WITH {_GRAPH}, e AS (SELECT DISTINCT src, dst FROM edges WHERE dst IS NOT NULL) SELECT url, 'vertex' AS kind FROM (SELECT src AS url FROM e UNION SELECT dst FROM e) UNION ALL SELECT src || '>' || dst, 'edge' FROM e",
    "graph_degrees": f"WITH {_GRAPH} {_DEGREES}",
    "graph_sinks": f"WITH {_GRAPH} SELECT url FROM vertices WHERE url NOT IN (SELECT src FROM outdeg)",
    "pagerank_steps": f"WITH {_pagerank(STEPS)} SELECT url, round(pr, 9) AS score FROM p{STEPS}",
    "pagerank_top": f"WITH {_pagerank(STEPS)}, dg AS ({_DEGREES}) SELECT url, round(pr, 9) AS score, inlinks, outlinks FROM p{STEPS} JOIN dg USING (url) ORDER BY score DESC, url LIMIT 500",
    "pagerank_perplexity": f"WITH {_pagerank(STEPS)} SELECT round(pow(2, -sum(pr * log2(pr))), 6) AS perplexity FROM p{STEPS}",
    "hits_steps": f"WITH {_hits(STEPS)} SELECT url, round(hub, 9) AS hub, round(authority, 9) AS authority FROM h{STEPS}",
    "hits_top": f"""WITH {_hits(STEPS)}, s AS (SELECT 'hub' AS kind, url, round(hub, 9) AS score FROM h{STEPS} UNION ALL SELECT 'authority', url, round(authority, 9) FROM h{STEPS})
SELECT kind, url, score FROM s QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, url) <= 500""",
    "base_set": f"""WITH {_GRAPH}, root AS (SELECT url FROM vertices WHERE url LIKE 's%'),
i AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY md5(src), src) AS r FROM clean JOIN root ON url = dst),
n AS (SELECT src AS url FROM i WHERE r <= 200 UNION SELECT dst FROM clean JOIN root ON url = src),
a AS (SELECT url, 0 AS step FROM root UNION ALL SELECT url, 1 FROM n WHERE url NOT IN (SELECT url FROM root))
SELECT url FROM a ORDER BY step, url LIMIT 10000""",
    "cosine_search": f"""SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS INTEGER) AS rank
FROM (SELECT q.vec_id AS query_id, e.vec_id AS row_id, round({_DOT.format('q.embedding', 'e.embedding')}, 6) + 0.0 AS similarity FROM embeddings AS q, embeddings AS e WHERE q.vec_id % 20 = 0) QUALIFY rank <= 10""",
    "grade_buckets": f"""SELECT label, vec_id, CASE WHEN s > 0.65 THEN 2 WHEN s > 0.35 THEN 1 ELSE 0 END AS grade FROM (SELECT q.label AS label, a.vec_id AS vec_id,
({_DOT.format('q.query', 'a.embedding')} + {_DOT.format('q.query', 'b.embedding')}) / 2 AS s
FROM (SELECT label, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY label) AS q, embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1)""",
    "wrapped_documents": "SELECT 'd' || doc_id AS docno, lang AS title, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE regexp_matches(text, '\\S') AND lang <> ''",
    "tagged_records": "SELECT 'D' || doc_id AS docno, replace(text, chr(10), ' ') || ' end' AS text FROM documents",
    "assessment_lines": "SELECT 'q1 me ' || doc_id || ' ' || CASE WHEN toxic = 0 THEN CAST(quality AS VARCHAR) ELSE '' END AS value FROM labels",
    "model_grades": "SELECT doc_id, CASE WHEN quality + 2 * toxic <= 2 THEN quality + 2 * toxic END AS grade FROM labels",
    "sampled_documents": "SELECT source AS query_id, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 10",
    "stream_index": f"WITH {_CORPUS} SELECT term, df, ttf FROM ts",
    "stream_politeness": f"""SELECT CAST(user_id AS VARCHAR) AS domain, round(CASE WHEN before IS NULL THEN 0 ELSE greatest(0, {WAIT} - date_diff('microsecond', before, ts) / 1e6) END, 6) AS wait
FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)""",
    "stream_unvisited": "SELECT DISTINCT 'http://' || source AS url FROM documents",
    "stream_upsert": "SELECT source AS url, 'x' AS content, array_to_string(list_sort(list_distinct(list(lang))), ' ') AS inlinks FROM documents GROUP BY source",
}
