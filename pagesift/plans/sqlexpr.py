"""DuckDB spellings of the column rules, for the oracle twins.

Each function returns SQL text for an expression over the given input
expression. The HTML patterns are written out here, apart from the Spark
side's; DuckDB needs the 'g' flag and ``\\1`` group references.
"""

from __future__ import annotations

from ..sources import fixtures as X

# The sentence and token patterns, written out here so that the twins do not share them with the queries.
SENT_MARK_RE = r"""([.!?]+["')\]}]*\s+)"""
SENT_UNMARK_ELLIPSIS_RE = r"""(\.{2,}["')\]}]*\s+)\x{1e}"""
SENT_UNMARK_INITIAL_RE = r"""((?:^|[\s(\x{1e}])\p{L}\.\s+)\x{1e}(\p{L})"""
SENT_UNMARK_ORDINAL_RE = r"""(\d\.\s+)\x{1e}(\p{Ll})"""
TOKEN_SPLIT_RE = r"[^a-zà-ÿ]+"

MARK = "chr(30)"
TAG = "<[^>]*>"
NOISE = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
P_START = r"(?i)<p(\s[^>]*)?>"
P_END = (r"(?is)</p\s*>.*$|</?(address|article|aside|blockquote|body|caption|center|dd|details|div|dl|dt|fieldset|figcaption|figure|footer"
         r"|form|h1|h2|h3|h4|h5|h6|header|hr|html|li|main|nav|ol|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)[\s>/].*$")
TIME = r"(?is)<time(?:\s[^>]*)?>(.*?)</time\s*>"
# The references that occur in the test pages; "&amp;" last so "&amp;lt;" stays "&lt;".
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
              ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(expr: str, pattern: str, repl: str = "''") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {repl}, 'g')"


def decode_entities(expr: str) -> str:
    out = expr
    for ent, ch in REFERENCES:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return out


def remove_tags(expr: str) -> str:
    p = f"regexp_split_to_array({expr}, {lit(TAG)})"
    tail = f"{p}[len({p})]"
    tail_parts = f"CASE WHEN contains({tail}, '<') THEN [split_part({tail}, '<', 1), {tail}] ELSE [{tail}] END"
    return f"array_to_string(list_filter(list_concat({p}[1:len({p})-1], {tail_parts}), lambda x: x <> ''), ' ')"


def remove_tags_invalid(expr: str) -> str:
    p = f"regexp_split_to_array({expr}, {lit(TAG)})"
    return f"contains({p}[len({p})], '<')"


def strip_noise(expr: str) -> str:
    return rx(expr, NOISE)


def paragraphs(expr: str) -> str:
    marked = rx(strip_noise(expr), P_START, MARK)
    inner = decode_entities(rx(rx("x", P_END), TAG))
    return f"list_transform(string_split({marked}, {MARK})[2:], lambda x: {inner})"


def article_text(expr: str) -> str:
    return f"array_to_string({paragraphs(expr)}, ' ')"


def published(expr: str) -> str:
    m = f"regexp_extract({strip_noise(expr)}, {lit(TIME)}, 0)"
    return f"CASE WHEN {m} <> '' THEN {decode_entities(rx(m, TAG))} END"


def word_count(expr: str) -> str:
    return f"len(string_split({expr}, ' '))::INTEGER"


def sentences(expr: str) -> str:
    m = rx(f"replace({expr}, {MARK}, ' ')", SENT_MARK_RE, f"'\\1' || {MARK}")
    m = rx(m, SENT_UNMARK_ELLIPSIS_RE, "'\\1'")
    m = rx(m, SENT_UNMARK_INITIAL_RE, "'\\1\\2'")
    m = rx(m, SENT_UNMARK_INITIAL_RE, "'\\1\\2'")
    m = rx(m, SENT_UNMARK_ORDINAL_RE, "'\\1\\2'")
    return (f"list_filter(list_transform(string_split({m}, {MARK}), lambda x: {rx('x', r'\s+$')}), "
            f"lambda x: x <> '')")


def chunks(expr: str, size: int, overlap: int) -> str:
    w = f"string_split({expr}, ' ')"
    step = size - overlap
    starts = f"range(0, greatest(len({w}) - {overlap + 1}, 0) + 1, {step})"
    return f"list_transform({starts}, lambda s: array_to_string({w}[s + 1 : s + {size}], ' '))"


def hash_vec(expr: str, dim: int = 384) -> str:
    """Unit-length bucket counts as FLOAT[]."""
    toks = f"list_filter(regexp_split_to_array(lower({expr}), {lit(TOKEN_SPLIT_RE)}), lambda t: t <> '')"
    buckets = f"list_transform({toks}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim})"
    counts = f"list_transform(range({dim}), lambda i: len(list_filter({buckets}, lambda b: b = i))::DOUBLE)"
    return (f"(SELECT CASE WHEN nrm > 0 THEN list_transform(c, lambda v: v / nrm) "
            f"ELSE list_transform(c, lambda v: 0.0::DOUBLE) END::FLOAT[] "
            f"FROM (SELECT c, sqrt(list_sum(list_transform(c, lambda v: v * v))) AS nrm "
            f"FROM (SELECT {counts} AS c)))")


def vec_fp(expr: str) -> str:
    """Fingerprint of a vector: sum of (i+1) * v_i, rounded."""
    return f"round(list_sum(list_transform(range(len({expr})), lambda i: {expr}[i + 1]::DOUBLE * (i + 1))), 6)"


def vec_nnz(expr: str) -> str:
    return f"len(list_filter({expr}, lambda v: v <> 0))::INTEGER"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def euclid(a: str, b: str) -> str:
    return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"


def key(s: str) -> str:
    return f"floor({s} * 1e6 + 0.5)"


# ----------------------------------------------------------- fixture CTEs

HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1)"
SITE = r"regexp_extract(host, '([^.]+\.[^.]+)$', 1)"

DATED = """
dated AS (
  SELECT page_id, url,
         CASE WHEN page_id % 23 = 0 THEN 410 WHEN page_id % 29 = 0 THEN 404 ELSE 200 END AS status,
         CASE WHEN page_id % 23 <> 0 AND page_id % 29 <> 0 THEN
           CASE WHEN page_id % 5 <> 0 THEN replace(html, '<h1>',
                '<time datetime="x"> <b>' || page_id::VARCHAR || '</b> nov. 2024</time><time>z</time><h1>')
                ELSE html END
         END AS html
  FROM pages
)"""
FETCHED = f"{DATED},\nfetched AS (SELECT * FROM dated WHERE page_id % 31 <> 0)"

URLS = f"""
urls AS (
  SELECT 'source' || (page_id % {X.N_SOURCES})::VARCHAR AS source, page_id AS seq, url FROM pages
)"""

ROUTED = f"""
{URLS.strip()},
{FETCHED.strip()},
outcome AS (
  SELECT u.source, u.seq, regexp_replace(u.url, '\\s+$', '', 'g') AS url, f.status, f.html
  FROM urls u LEFT JOIN fetched f ON regexp_replace(u.url, '\\s+$', '', 'g') = f.url
),
arts AS (
  SELECT *, {article_text('html')} AS article, {published('html')} AS published FROM outcome
),
routed AS (
  SELECT source, seq, url, status, article, published, {word_count('article')} AS n_words,
         CASE WHEN status IS NULL THEN 'not_fetched' WHEN status = 410 THEN 'http_410'
              WHEN status <> 200 THEN 'http_error'
              WHEN {word_count('article')} >= 1200 THEN 'too_long' ELSE 'accepted' END AS route
  FROM arts
)"""

SITEMAPS = f"""
hp AS (SELECT page_id, url, {HOST} AS host, floor(page_id / {X.ENTRIES_PER_DOC})::BIGINT AS chunk FROM pages),
sm AS (
  SELECT host, chunk, min(page_id) AS first_id,
         'https://' || host || '/' || (['post','slideshow','video','category'])[(min(page_id) % 4) + 1]
           || '-sitemap' || CASE WHEN chunk = 0 THEN '' ELSE chunk::VARCHAR END || '.xml' AS doc_url
  FROM hp GROUP BY host, chunk
),
smx AS (SELECT *, {SITE} AS site FROM sm)"""
