"""DuckDB twins of the registered queries (same column names and types).

Views available: region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations.
"""

from __future__ import annotations

# Rank key shared with the Spark side: score rounded to 6 digits (as an
# integer), descending; id ascending.
_KEY = "floor({s} * 1e6 + 0.5)"

_SQL: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    _SQL[name] = text.strip()


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- vectors

sql("vector_topk", f"""
WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS raw
  FROM embeddings q, embeddings c
), r AS (
  SELECT query_id, id, round(raw, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY {_KEY.format(s='raw')} DESC, id) AS rank
  FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM r WHERE rank <= 10
""")

sql("multi_k_search", f"""
WITH q AS (
  SELECT vec_id AS query_id, embedding, 1 + (vec_id % 50) AS k FROM embeddings
), s AS (
  SELECT q.query_id, q.k, c.vec_id AS id,
         list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS raw
  FROM q, embeddings c
  WHERE q.k BETWEEN 1 AND 50
), r AS (
  SELECT query_id, k, id, round(raw, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY {_KEY.format(s='raw')} DESC, id) AS rank
  FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM r WHERE rank <= k
""")


# ---------------------------------------------------------------- html / text
from . import sqlexpr as S  # noqa: E402

sql("vector_top1", f"""
WITH e AS (SELECT unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings),
c AS (SELECT list(m ORDER BY i) AS cv FROM (SELECT i, avg(x) AS m FROM e GROUP BY i)),
s AS (SELECT vec_id AS id, {S.dot('embedding', 'cv')} AS raw FROM embeddings, c)
SELECT id, round(raw, 6) AS score FROM s ORDER BY {S.key('raw')} DESC, id LIMIT 10
""")

sql("remove_tags", f"""
SELECT page_id, {S.remove_tags('html')} AS text, {S.remove_tags_invalid('html')} AS invalid FROM pages
""")

sql("paragraphs", f"""
SELECT page_id, (pos - 1)::INTEGER AS pos, paragraph FROM (
  SELECT page_id, unnest({S.paragraphs('html')}) AS paragraph,
         unnest(range(1, len({S.paragraphs('html')}) + 1)) AS pos FROM pages)
""")

sql("articles", f"""
SELECT page_id, url, {S.article_text('html')} AS article, len({S.paragraphs('html')})::INTEGER AS n_paragraphs,
       {S.word_count(S.article_text('html'))} AS n_words FROM pages
""")

sql("published", f"""
WITH {S.DATED.strip()}
SELECT page_id, status, {S.published('html')} AS published FROM dated
""")

sql("word_counts", f"SELECT doc_id, {S.word_count('text')} AS n_words FROM documents")

sql("length_filter", f"""
SELECT doc_id, {S.word_count('text')} AS n_words FROM documents WHERE {S.word_count('text')} < 1200
""")

sql("sentences", f"""
SELECT doc_id, (pos - 1)::INTEGER AS pos, sentence FROM (
  SELECT doc_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS pos
  FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents))
""")

sql("chunks", f"""
SELECT doc_id, (pos - 1)::INTEGER AS pos, chunk, {S.word_count('chunk')} AS n_words FROM (
  SELECT doc_id, unnest(c) AS chunk, unnest(range(1, len(c) + 1)) AS pos
  FROM (SELECT doc_id, {S.chunks('text', 500, 50)} AS c FROM documents))
""")

sql("encode", f"""
SELECT doc_id, len(v)::INTEGER AS dim, {S.vec_nnz('v')} AS nnz, {S.vec_fp('v')} AS fp
FROM (SELECT doc_id, {S.hash_vec('text')} AS v FROM documents)
""")

sql("encode_sentences", f"""
WITH s AS (
  SELECT doc_id, (pos - 1)::INTEGER AS pos, sentence FROM (
    SELECT doc_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS pos
    FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)))
SELECT doc_id, pos, {S.vec_nnz('v')} AS nnz, {S.vec_fp('v')} AS fp
FROM (SELECT doc_id, pos, {S.hash_vec('sentence')} AS v FROM s)
""")


# ---------------------------------------------------------------- crawl

sql("sitemap_links", f"""
WITH {S.SITEMAPS.strip()}
SELECT smx.doc_url, (row_number() OVER (PARTITION BY hp.host, hp.chunk ORDER BY hp.page_id) - 1)::INTEGER AS pos,
       hp.url
FROM hp JOIN smx USING (host, chunk)
""")

_ENTRIES = f"""
{S.SITEMAPS.strip()},
ent AS (
  SELECT site, (row_number() OVER (PARTITION BY site, floor(first_id / 50000) ORDER BY first_id) - 1)::INTEGER
           AS sitemap_pos, doc_url AS sitemap, host, chunk
  FROM smx
),
kept AS (
  SELECT * FROM ent
  WHERE contains(sitemap, '/post-sitemap') OR contains(sitemap, '/slideshow-sitemap')
     OR contains(sitemap, '/video-sitemap')
)"""

sql("keyword_filter", f"""
WITH {_ENTRIES.strip()}
SELECT site, sitemap_pos, sitemap FROM kept
""")

_CRAWL = f"""
{_ENTRIES.strip()},
crawled AS (
  SELECT kept.site, kept.sitemap_pos, kept.sitemap,
         (row_number() OVER (PARTITION BY hp.host, hp.chunk ORDER BY hp.page_id) - 1)::INTEGER AS link_pos,
         hp.url
  FROM hp JOIN kept USING (host, chunk)
)"""

sql("crawl", f"""
WITH {_CRAWL.strip()}
SELECT site, sitemap_pos, sitemap, link_pos, url FROM crawled
""")

sql("crawl_stats", f"""
WITH {_CRAWL.strip()}
SELECT site, sitemap, count(*) AS n_links, grouping(site, sitemap)::INTEGER AS level
FROM crawled GROUP BY ROLLUP (site, sitemap)
""")


# ---------------------------------------------------------------- ingest

sql("fetch_outcome", f"""
WITH {S.URLS.strip()}, {S.FETCHED.strip()}
SELECT u.source, u.seq, u.url, f.status, f.status IS NOT NULL AS fetched
FROM urls u LEFT JOIN fetched f ON u.url = f.url
""")

sql("route", f"WITH {S.ROUTED.strip()} SELECT source, seq, url, status, n_words, route FROM routed")

sql("rejects", f"""
WITH {S.ROUTED.strip()}
SELECT source, seq, url, route AS reason, status FROM routed WHERE route <> 'accepted'
""")

sql("reject_counts", f"""
WITH {S.ROUTED.strip()}
SELECT source, route AS reason, count(*) AS n, grouping(source, route)::INTEGER AS level
FROM routed WHERE route <> 'accepted' GROUP BY ROLLUP (source, route)
""")

sql("source_progress", f"""
WITH {S.ROUTED.strip()}
SELECT source, count(*) AS n_listed,
       count(*) FILTER (WHERE route = 'accepted') AS n_accepted,
       count(*) FILTER (WHERE route = 'too_long') AS n_too_long,
       count(*) FILTER (WHERE route = 'http_410') AS n_http_410,
       count(*) FILTER (WHERE route <> 'accepted') AS n_rejected,
       count(*) - count(*) FILTER (WHERE route = 'too_long') - count(*) FILTER (WHERE route = 'http_410') AS n_indexable
FROM routed GROUP BY source
""")

_LISTED = f"""
WITH {S.URLS.strip()},
listed AS (SELECT source, seq, url FROM urls UNION ALL SELECT source, seq + 1000000000, url FROM urls WHERE seq % 4 = 0),
done AS (SELECT source, url FROM urls WHERE seq % 3 = 0)
SELECT source, seq, url FROM listed l WHERE %NOT% EXISTS (SELECT 1 FROM done d WHERE d.source = l.source AND d.url = l.url)
"""
sql("pending_urls", _LISTED.replace("%NOT%", "NOT"))
sql("indexed_urls", _LISTED.replace("%NOT%", ""))

_IDS = f"""
{S.ROUTED.strip()},
ids AS (
  SELECT row_number() OVER (ORDER BY source, seq) AS id, source, seq, url, article
  FROM routed WHERE route = 'accepted'
)"""

sql("assign_ids", f"WITH {_IDS.strip()} SELECT id, source, seq, url FROM ids")

sql("batch_plan", f"""
WITH {_IDS.strip()}
SELECT id, floor((id - 1) / 5)::BIGINT AS encode_batch, floor((id - 1) / 100)::BIGINT AS insert_batch FROM ids
""")

sql("points_build", f"""
WITH {_IDS.strip()}
SELECT id, url, len(v)::INTEGER AS dim, {S.vec_nnz('v')} AS nnz, {S.vec_fp('v')} AS fp
FROM (SELECT id, url, {S.hash_vec('article')} AS v FROM ids)
""")

_TWO_RUN = f"""
{S.ROUTED.strip()},
acc AS (SELECT *, seq % 3 = 0 AS first_run FROM routed WHERE route = 'accepted'),
n1 AS (SELECT count(*) AS n FROM acc WHERE first_run),
ids AS (
  SELECT row_number() OVER (ORDER BY source, seq) AS id, url, article FROM acc WHERE first_run
  UNION ALL
  SELECT (SELECT n FROM n1) + row_number() OVER (ORDER BY source, seq) AS id, url, article
  FROM acc WHERE NOT first_run
)"""

sql("ingest", f"""
WITH {_TWO_RUN.strip()}
SELECT id, url, {S.vec_nnz('v')} AS nnz, {S.vec_fp('v')} AS fp
FROM (SELECT id, url, {S.hash_vec('article')} AS v FROM ids)
""")

sql("point_count", f"WITH {_TWO_RUN.strip()} SELECT count(*) AS n_points FROM ids")

sql("points_upsert", f"""
WITH m AS (SELECT max(vec_id) AS mx FROM embeddings),
new AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 20 = 0 THEN list_transform(embedding, lambda x: (x * 2)::FLOAT) ELSE list_reverse(embedding) END AS v
  FROM embeddings WHERE vec_id % 10 = 0
  UNION ALL
  SELECT vec_id + (SELECT mx FROM m) + 1 AS id, embedding AS v FROM embeddings WHERE vec_id % 10 = 5
),
merged AS (
  SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id NOT IN (SELECT id FROM new)
  UNION ALL SELECT id, v FROM new
)
SELECT id, {S.vec_fp('v')} AS fp FROM merged
""")

sql("embedding_dim", """
SELECT min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim, count(*) AS n_points, 64 AS meta_dim
FROM embeddings
""")

sql("ingest_metrics", f"""
WITH {S.ROUTED.strip()}
SELECT count(*) AS n_listed, count(*) FILTER (WHERE route = 'accepted') AS n_accepted,
       count(*) FILTER (WHERE route <> 'accepted') AS n_rejected,
       (sum(n_words) FILTER (WHERE route = 'accepted'))::BIGINT AS n_words_accepted
FROM routed
""")


# ---------------------------------------------------------------- search

_BENCH_Q = "SELECT item_id AS query_id, text FROM benchmark"
_CONV_Q = "SELECT conv_id * 1048576 + turn AS query_id, text FROM conversations WHERE role = 'user'"


def _search_sql(corpus_cte: str, k: int, with_url: bool, queries: str = _BENCH_Q) -> str:
    return f"""
WITH {corpus_cte.strip()},
pts AS (SELECT id, url, article, published, {S.hash_vec('article')} AS v FROM corpus),
qt AS ({queries}),
q AS (SELECT query_id, {S.hash_vec('text')} AS qv FROM qt WHERE text IS NOT NULL AND text <> ''),
s AS (SELECT q.query_id, pts.id, pts.url, pts.published, {S.dot('pts.v', 'q.qv')} AS raw FROM q, pts),
hits AS (
  SELECT query_id, id, url, published, round(raw, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY {S.key('raw')} DESC, id) AS rank
  FROM s QUALIFY rank <= {k}
),
hs AS (
  SELECT query_id, rank, unnest(sents) AS sentence, unnest(range(len(sents))) AS pos
  FROM (SELECT h.query_id, h.rank, {S.sentences('p.article')} AS sents FROM hits h JOIN pts p USING (id))
),
sd AS (
  SELECT hs.query_id, hs.rank, hs.pos, hs.sentence, {S.euclid(S.hash_vec('hs.sentence'), 'q.qv')} AS d
  FROM hs JOIN q USING (query_id)
),
best AS (
  SELECT query_id, rank, sentence, d FROM sd
  QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY {S.key('d')}, pos) = 1
)
SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank,
       {"h.published AS date, h.url," if with_url else "h.id AS doc_id,"} h.score,
       b.sentence, round(b.d, 6) AS sentence_distance
FROM hits h LEFT JOIN best b USING (query_id, rank)
"""


sql("search", _search_sql(f"""
{S.ROUTED.strip()},
corpus AS (
  SELECT row_number() OVER (ORDER BY source, seq) AS id, url, article, published
  FROM routed WHERE route = 'accepted'
)""", 3, True))

sql("doc_search", _search_sql(f"""
corpus AS (
  SELECT doc_id AS id, NULL::VARCHAR AS url, text AS article, NULL::VARCHAR AS published
  FROM documents WHERE {S.word_count('text')} < 1200
)""", 5, False))


# ---------------------------------------------------------------- metrics

sql("metric_compare", f"""
WITH s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id,
         {S.dot('q.embedding', 'c.embedding')} AS d,
         list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS cs,
         -{S.euclid('q.embedding', 'c.embedding')} AS eu
  FROM embeddings q, embeddings c
),
r AS (
  SELECT query_id, id,
         row_number() OVER (PARTITION BY query_id ORDER BY {S.key('d')} DESC, id) AS rd,
         row_number() OVER (PARTITION BY query_id ORDER BY {S.key('cs')} DESC, id) AS rc,
         row_number() OVER (PARTITION BY query_id ORDER BY {S.key('eu')} DESC, id) AS re
  FROM s
),
top AS (SELECT query_id, id FROM r WHERE rd <= 10)
SELECT t.query_id,
       count(*) FILTER (WHERE r.rc <= 10) AS overlap_cosine,
       count(*) FILTER (WHERE r.re <= 10) AS overlap_euclidean
FROM top t JOIN r USING (query_id, id) GROUP BY t.query_id
""")


# ---------------------------------------------------------------- URL files, collection, requests

sql("url_scan", f"WITH {S.URLS.strip()} SELECT source, regexp_replace(url, '\\s+$', '', 'g') AS url FROM urls")
sql("url_sink_roundtrip", f"WITH {S.URLS.strip()} SELECT url FROM urls")
sql("url_slice", f"""
WITH {S.URLS.strip()},
lines AS (SELECT source, seq * 2 AS seq, url FROM urls UNION ALL SELECT source, seq * 2 + 1, '' FROM urls WHERE seq % 97 = 96),
p AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY seq) - 1) AS pos, url FROM lines),
stops AS (SELECT source, min(pos) AS stop FROM p WHERE url = '' AND pos >= 10 GROUP BY source)
SELECT source, pos, url FROM p LEFT JOIN stops USING (source)
WHERE pos >= 10 AND pos < 60 AND (stop IS NULL OR pos < stop)
""")
sql("multi_source_urls", f"""
WITH {S.URLS.strip()}
SELECT source, count(*) AS n_urls, count(DISTINCT url) AS n_distinct FROM urls GROUP BY source
""")
sql("collection_init", f"""
WITH {S.ROUTED.strip()}
SELECT 'pages' AS name, 384 AS dim, 'dot' AS metric, count(*) AS n_points FROM routed WHERE route = 'accepted'
""")
_DECODED = """
WITH landed AS (
  SELECT page_id, html AS text,
         CASE WHEN page_id % 4 = 1 THEN 'UTF-16LE' WHEN page_id % 4 = 2 THEN 'UTF-16BE'
              WHEN page_id % 4 = 3 AND NOT regexp_matches(html, '[^\\x{00}-\\x{FF}]') THEN 'ISO-8859-1'
              WHEN NOT regexp_matches(html, '[^\\x{00}-\\x{7F}]') THEN 'US-ASCII' ELSE 'UTF-8' END AS charset
  FROM pages
),
d AS (
  SELECT * FROM landed
  UNION ALL
  SELECT -page_id - 1, NULL, CASE WHEN page_id % 100 = 0 THEN 'US-ASCII' ELSE 'x-unknown' END FROM pages WHERE page_id % 50 = 0
)
"""
sql("decode_pages", _DECODED + """
SELECT page_id, charset, text IS NOT NULL AS ok, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM d
""")
sql("decode_rejects", _DECODED + "SELECT page_id, charset, 'undecodable' AS reason FROM d WHERE text IS NULL")
sql("request_urls", """
WITH p AS (SELECT page_id, url, split_part(url, '#', 1) AS u, CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#')) ELSE '' END AS frag FROM pages),
e AS (
  SELECT page_id, i, url_decode(replace(split_part(kv, '=', 1), '+', ' ')) AS k, url_decode(replace(substr(kv, strpos(kv, '=') + 1), '+', ' ')) AS v
  FROM (SELECT page_id, unnest(parts) AS kv, generate_subscripts(parts, 1) AS i
        FROM (SELECT page_id, CASE WHEN contains(u, '?') THEN string_split(substr(u, strpos(u, '?') + 1), '&') ELSE [] END AS parts FROM p))
  WHERE strpos(kv, '=') > 0 AND strpos(kv, '=') < length(kv)
  UNION ALL SELECT page_id, 1000000 + n, key, val FROM p, (VALUES (0, 'utm_source', 'pagesift'), (1, 'page', '1')) AS t(n, key, val)
),
one AS (SELECT page_id, k, min(i) AS i, arg_max(v, i) AS v FROM e GROUP BY page_id, k),
q AS (SELECT page_id, string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' ORDER BY i) AS qs FROM one GROUP BY page_id)
SELECT p.page_id, split_part(u, '?', 1) || coalesce('?' || qs, '') || frag AS request_url FROM p LEFT JOIN q USING (page_id)
""")

_PAGES_CORPUS = f"""
{S.ROUTED.strip()},
corpus AS (
  SELECT row_number() OVER (ORDER BY source, seq) AS id, url, article, published
  FROM routed WHERE route = 'accepted'
)"""

sql("stream_search", f"""
SELECT query_id // 1048576 AS conv_id, query_id % 1048576 AS turn, * EXCLUDE (query_id) FROM ({_search_sql(_PAGES_CORPUS, 3, True, _CONV_Q)})
""")

sql("stream_rejects", f"""
WITH {S.ROUTED.strip()}
SELECT source, url, status, CASE WHEN status = 200 AND seq % 37 = 5 THEN 'undecodable' ELSE route END AS reason FROM routed
WHERE route <> 'not_fetched' AND (route <> 'accepted' OR seq % 37 = 5)
""")

sql("stream_progress", f"""
WITH {S.ROUTED.strip()}
SELECT route, count(*) AS n FROM routed WHERE route <> 'not_fetched' GROUP BY route
""")

sql("stream_ingest", f"""
WITH {S.ROUTED.strip()}
SELECT url, {S.vec_nnz('v')} AS nnz, {S.vec_fp('v')} AS fp
FROM (SELECT url, {S.hash_vec('article')} AS v FROM routed WHERE route = 'accepted')
""")


# ---------------------------------------------------------------- sentence-level and sparse search

sql("best_sentence", f"""
WITH s AS (
  SELECT doc_id, (pos - 1)::INTEGER AS pos, sentence FROM (
    SELECT doc_id, unnest(s) AS sentence, unnest(range(1, len(s) + 1)) AS pos
    FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents))
),
sv AS (SELECT doc_id, pos, sentence, {S.hash_vec('sentence')} AS v FROM s),
q AS (SELECT item_id AS query_id, {S.hash_vec('text')} AS qv FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT q.query_id, sv.doc_id, sv.pos, sv.sentence, {S.euclid('sv.v', 'q.qv')} AS dist FROM q, sv)
SELECT query_id, doc_id, pos, sentence, abs(round(-dist, 6)) AS sentence_distance FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {S.key('-dist')} DESC, doc_id, pos) = 1
""")

sql("lexical_topk", f"""
WITH pts AS (SELECT doc_id, {S.hash_vec('text')} AS v FROM documents WHERE {S.word_count('text')} < 1200),
q AS (SELECT item_id AS query_id, {S.hash_vec('text')} AS qv FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT q.query_id, pts.doc_id, {S.dot('pts.v', 'q.qv')} AS raw FROM q, pts)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT query_id, doc_id, round(raw, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY {S.key('raw')} DESC, doc_id) AS rank FROM s)
WHERE rank <= 5
""")


sql("sitemap_files", f"""
WITH {S.SITEMAPS.strip()}
SELECT smx.doc_url, hp.url FROM hp JOIN smx USING (host, chunk)
""")

sql("rejects_sink", f"""
WITH {S.ROUTED.strip()}
SELECT source, url, status, route AS reason FROM routed WHERE route <> 'accepted'
""")


# ---------------------------------------------------------------- approximate search

def _lloyd(parts: int, cells: str, rounds: int = 5) -> str:
    """CTEs c0 ... c<rounds> (part, cell, c): trained centres of the vectors' parts, rounded to 6 digits each round."""
    out = f"""
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS MATERIALIZED (SELECT vec_id, p AS part, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM e, range({parts}) AS t(p)),
c0 AS MATERIALIZED (SELECT part, v AS c, r - 1 AS cell FROM (
  SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY md5(vec_id::VARCHAR), vec_id) AS r FROM x) WHERE r <= {cells})"""
    for k in range(rounds):
        out += f""",
a{k} AS MATERIALIZED (SELECT part, v, cell FROM (SELECT x.vec_id, x.part, x.v, c.cell, row_number() OVER (PARTITION BY x.vec_id, x.part ORDER BY
       floor((list_dot_product(x.v, c.c) - list_dot_product(c.c, c.c) / 2) * 1e6 + 0.5) DESC, c.cell) AS r FROM x JOIN c{k} c USING (part)) WHERE r = 1),
m{k} AS (SELECT part, cell, i, floor(sum(x) / count(*) * 1e6 + 0.5) / 1e6 AS m
       FROM (SELECT part, cell, unnest(range(len(v))) AS i, unnest(v) AS x FROM a{k}) GROUP BY part, cell, i),
c{k + 1} AS MATERIALIZED (SELECT part, cell, coalesce(m, c) AS c FROM c{k}
       LEFT JOIN (SELECT part, cell, list(m ORDER BY i) AS m FROM m{k} GROUP BY part, cell) USING (part, cell))"""
    return out.strip()


_N_CELLS = "(SELECT ceil(2 * sqrt(count(*))) FROM embeddings)"
_ANN_CELLS = f"""
{_lloyd(1, _N_CELLS)},
near AS (SELECT vec_id, v, cell, row_number() OVER (PARTITION BY vec_id ORDER BY
           floor((list_dot_product(v, c) - list_dot_product(c, c) / 2) * 1e6 + 0.5) DESC, cell) AS r FROM e, c5)"""
_ANN_PLANES = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
planes AS (SELECT t, b, list_transform(range(64), lambda j: CASE WHEN md5(t::VARCHAR || '-' || b::VARCHAR || '-' || j::VARCHAR) < '8' THEN 1.0 ELSE -1.0 END::DOUBLE) AS p
           FROM range(18) AS x(t), range(4) AS y(b)),
keys AS (SELECT vec_id, any_value(v) AS v, t,
                sum(CASE WHEN floor(list_dot_product(v, p) * 1e6 + 0.5) >= 0 THEN (1 << b::INTEGER) ELSE 0 END) AS k
         FROM e, planes GROUP BY vec_id, t)"""
_ANN_RANKED = """
ranked AS (SELECT query_id, id, round(raw, 6) AS score,
                  row_number() OVER (PARTITION BY query_id ORDER BY floor(raw * 1e6 + 0.5) DESC, id) AS rank
           FROM (SELECT query_id, id, any_value(list_dot_product(qv, cv)) AS raw FROM cand GROUP BY query_id, id))"""
_IVF = f"""{_ANN_CELLS.strip()},
cand AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.v AS qv, c.v AS cv FROM near q JOIN near c ON q.cell = c.cell
         WHERE q.r <= ceil({_N_CELLS} / 2) AND c.r = 1),
{_ANN_RANKED.strip()}"""
_LSH = f"""{_ANN_PLANES.strip()},
cand AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.v AS qv, c.v AS cv FROM keys q JOIN keys c ON q.t = c.t AND q.k = c.k),
{_ANN_RANKED.strip()}"""

_PQ = f"""{_lloyd(16, "(SELECT greatest(1, least(256, count(*) // 4)) FROM embeddings)")},
code AS MATERIALIZED (SELECT vec_id, part, c FROM (SELECT x.vec_id, x.part, c.c, row_number() OVER (PARTITION BY x.vec_id, x.part ORDER BY
          floor((list_dot_product(x.v, c.c) - list_dot_product(c.c, c.c) / 2) * 1e6 + 0.5) DESC, c.cell) AS r FROM x JOIN c5 c USING (part)) WHERE r = 1),
decoded AS MATERIALIZED (SELECT vec_id, flatten(list(c ORDER BY part)) AS d FROM code GROUP BY vec_id),
short AS (SELECT query_id, id FROM (SELECT q.vec_id AS query_id, d.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
            floor(list_dot_product(q.v, d.d) * 1e6 + 0.5) DESC, d.vec_id) AS r FROM e q, decoded d) WHERE r <= 100),
cand AS (SELECT query_id, id, q.v AS qv, c.v AS cv FROM short JOIN e q ON q.vec_id = query_id JOIN e c ON c.vec_id = id),
{_ANN_RANKED.strip()}"""

for _name, _text in (("ann_ivf", _IVF), ("ann_lsh", _LSH), ("ann_pq", _PQ)):
    sql(_name, f"WITH {_text} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM ranked WHERE rank <= 10")
sql("ann_recall", f"""
WITH exact AS ({_SQL["vector_topk"]}), ivf AS ({_SQL["ann_ivf"]}), lsh AS ({_SQL["ann_lsh"]}), pq AS ({_SQL["ann_pq"]}),
hits AS (SELECT 'ivf' AS method, query_id, count(ivf.id) AS n FROM exact LEFT JOIN ivf USING (query_id, id) GROUP BY query_id
         UNION ALL SELECT 'lsh', query_id, count(lsh.id) FROM exact LEFT JOIN lsh USING (query_id, id) GROUP BY query_id
         UNION ALL SELECT 'pq', query_id, count(pq.id) FROM exact LEFT JOIN pq USING (query_id, id) GROUP BY query_id)
SELECT method, round(avg(n / 10.0), 6) AS recall, count(*) AS n_queries FROM hits GROUP BY method
""")
sql("sitemap_rejects", f"""
WITH {S.SITEMAPS.strip()},
n AS (SELECT host, chunk, count(*) AS n FROM hp GROUP BY host, chunk)
SELECT doc_url, CASE WHEN first_id % 3 = 0 THEN 0 ELSE n END AS n_entries, CASE WHEN first_id % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_without_loc,
       CASE WHEN first_id % 3 = 0 THEN 'malformed' ELSE 'without_loc' END AS reason
FROM smx JOIN n USING (host, chunk) WHERE first_id % 3 < 2
""")

sql("route_bucketed", _SQL["route"])
sql("pending_filtered", _SQL["pending_urls"])
sql("decode_any_pages", r"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'UTF-16LE' WHEN 1 THEN 'UTF-16BE' WHEN 4 THEN 'WINDOWS-1252' ELSE 'UTF-8' END AS charset,
       md5(CASE page_id % 5 WHEN 3 THEN '<meta charset="utf-8">' || html
                WHEN 4 THEN regexp_replace(html, '[^\x00-\x7F\x{A0}-\x{FF}]', '', 'g') || chr(233) || '!' ELSE html END) AS text_md5
FROM pages
""")
sql("sentence_chunks", f"""
WITH RECURSIVE s AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, w) AS i, piece, alone, {S.word_count('piece')} AS n FROM (
    SELECT doc_id, p, alone, unnest(c) AS piece, unnest(range(len(c))) AS w FROM (
      SELECT doc_id, p, {S.word_count('x')} > 120 AS alone, CASE WHEN {S.word_count('x')} > 120 THEN {S.chunks('x', 120, 0)} ELSE [x] END AS c FROM (
        SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS p FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents))))),
c AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(CASE WHEN alone THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS cuts FROM s),
after AS MATERIALIZED (  -- where the chunk that begins at i ends: before the first piece that does not fit, or at a window
  SELECT a.doc_id, a.i, coalesce(min(b.i), (SELECT max(i) + 1 FROM c m WHERE m.doc_id = a.doc_id)) AS nxt
  FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id AND b.i > a.i AND b.i <= a.i + 121 AND (b.upto - a.upto + a.n > 120 OR a.alone OR b.alone)
  GROUP BY a.doc_id, a.i),
chain AS (SELECT doc_id, i, nxt, 0 AS pos FROM after WHERE i = 1
          UNION ALL SELECT n.doc_id, n.i, n.nxt, pos + 1 FROM chain JOIN after n ON n.doc_id = chain.doc_id AND n.i = chain.nxt),
made AS (SELECT chain.doc_id, pos, string_agg(piece, ' ' ORDER BY c.i) AS chunk FROM chain JOIN c ON c.doc_id = chain.doc_id AND c.i >= chain.i AND c.i < chain.nxt
         GROUP BY chain.doc_id, pos)
SELECT doc_id, pos::INTEGER AS pos, chunk, {S.word_count('chunk')} AS n_words FROM made
""")
_PER_QUERY = " UNION ALL ".join(f"SELECT '{m}' AS method, query_id, count({m}.id) / 10.0::DOUBLE AS v FROM exact LEFT JOIN {m} USING (query_id, id) GROUP BY query_id"
                                for m in ("ivf", "lsh", "pq"))
sql("method_differences", f"""
WITH exact AS ({_SQL["vector_topk"]}), ivf AS ({_SQL["ann_ivf"]}), lsh AS ({_SQL["ann_lsh"]}), pq AS ({_SQL["ann_pq"]}),
v AS MATERIALIZED ({_PER_QUERY}),
p AS MATERIALIZED (SELECT a.method AS method_a, b.method AS method_b, query_id, a.v - b.v AS d FROM v a JOIN v b USING (query_id) WHERE a.method < b.method),
cdf AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i, sum(exp(-1) / factorial(i::INTEGER)::DOUBLE) OVER (ORDER BY i) AS c FROM range(8) AS t(i))),
w AS (SELECT query_id, r, len(list_filter((SELECT c FROM cdf), lambda x: ('0x' || substr(md5(query_id::VARCHAR || ':' || r::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= x)) AS w
      FROM (SELECT DISTINCT query_id FROM p), range(200) AS t(r)),
m AS (SELECT method_a, method_b, r, sum(w * d) / sum(w) AS m FROM p JOIN w USING (query_id) GROUP BY method_a, method_b, r HAVING sum(w) > 0)
SELECT * FROM (SELECT method_a, method_b, count(*) AS n_queries, round(avg(d), 6) AS difference FROM p GROUP BY method_a, method_b)
JOIN (SELECT method_a, method_b, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY method_a, method_b) USING (method_a, method_b)
""")
sql("fused_search", f"""
WITH ivf AS ({_SQL["ann_ivf"]}), lsh AS ({_SQL["ann_lsh"]}),
s AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM ivf UNION ALL SELECT query_id, id, rank FROM lsh) GROUP BY query_id, id)
SELECT query_id, rank::INTEGER AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10
""")
