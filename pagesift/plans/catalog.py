"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (or what Spark derives from them) in
full; result columns are aliased exactly as in ``plans.oracle``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import topk
from ..session import cut_lineage, ensure_checkpoint_dir, ship_package
from ..sources.tables import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        _REGISTRY[name] = run
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    return dict(_REGISTRY)


# ---------------------------------------------------------------- vectors

def _embedding_points(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", "vec_id", "embedding") \
        .select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@register("vector_topk")
def q_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a query against the whole collection, k=10."""
    pts = _embedding_points(spark, sf_dir)
    qs = pts.select(F.col("id").alias("query_id"), "vector")
    return topk.vector_topk(pts, qs, 10)


@register("multi_k_search")
def q_multi_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-query k in 1..50 (k = 1 + vec_id mod 50), rows outside the bound rejected."""
    pts = _embedding_points(spark, sf_dir)
    qs = (pts.select(F.col("id").alias("query_id"), "vector",
                     (F.lit(1) + F.pmod("id", F.lit(50))).alias("k"))
          .where(F.col("k").between(1, 50)))
    return topk.vector_topk(pts, qs, k_col="k")


@register("vector_top1")
def q_vector_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector (the collection centroid) -> top 10 by dot product."""
    pts = _embedding_points(spark, sf_dir)
    centroid = (pts.select(F.posexplode("vector").alias("i", "x"))
                .groupBy("i").agg(F.avg("x").alias("m")).orderBy("i"))
    qv = [r["m"] for r in centroid.collect()]  # one row per dimension: bounded by dim
    return topk.vector_topk_expr(pts, qv, 10)


# ---------------------------------------------------------------- html / text

from ..functions import encoders as E  # noqa: E402
from ..functions import html as H  # noqa: E402
from ..functions import text as T  # noqa: E402
from ..sources import fixtures as X  # noqa: E402

HASH = E.HashEncoder()
CHUNK_WORDS, CHUNK_OVERLAP = 500, 50
SENTENCE_CHUNK_WORDS = 120


def vec_fp(v) -> F.Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.round(F.aggregate(F.transform(c, lambda x, i: x.cast("double") * (i + 1)),
                               F.lit(0.0), lambda s, x: s + x), 6)


def sparse_fp(v: str) -> F.Column:
    """vec_fp of a vector given as (indices, values): the same sum without its zeros."""
    terms = F.zip_with(F.col(v)["indices"], F.col(v)["values"], lambda i, x: x.cast("double") * (i + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 6)


def vec_nnz(v) -> F.Column:
    c = F.col(v) if isinstance(v, str) else v
    return F.size(F.filter(c, lambda x: x != 0)).cast("int")


@register("remove_tags")
def q_remove_tags(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", H.remove_tags("html").alias("text"),
                    H.remove_tags_invalid("html").alias("invalid"))


@register("paragraphs")
def q_paragraphs(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", F.posexplode(H.paragraphs("html")).alias("pos", "paragraph"))


@register("articles")
def q_articles(spark, sf_dir):
    # Through a generator the paragraphs are computed once, however often they are used.
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    p = p.select("page_id", "url", F.explode(F.array(H.paragraphs("html"))).alias("paragraphs"))
    p = p.select("page_id", "url", F.array_join("paragraphs", " ").alias("article"), F.size("paragraphs").alias("n_paragraphs"))
    return p.withColumn("n_words", T.word_count("article"))


@register("published")
def q_published(spark, sf_dir):
    """every page, with the dates that the fixtures put in (pages that answer with an error have none)."""
    f = X.dated_pages(spark, sf_dir)
    return f.select("page_id", "status", H.published("html").alias("published"))


@register("word_counts")
def q_word_counts(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", T.word_count("text").alias("n_words"))


@register("length_filter")
def q_length_filter(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.where(T.under_length("text")).select("doc_id", T.word_count("text").alias("n_words"))


@register("sentences")
def q_sentences(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


@register("chunks")
def q_chunks(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return (d.select("doc_id", F.posexplode(T.chunks("text", CHUNK_WORDS, CHUNK_OVERLAP)).alias("pos", "chunk"))
            .withColumn("n_words", T.word_count("chunk")))


@register("sentence_chunks")
def q_sentence_chunks(spark, sf_dir):
    """documents packed into chunks of whole sentences, at most 120 words."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return (d.select("doc_id", F.posexplode(T.sentence_chunks("text", SENTENCE_CHUNK_WORDS)).alias("pos", "chunk"))
            .withColumn("n_words", T.word_count("chunk")))


@register("encode")
def q_encode(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    v = d.select("doc_id", HASH.column("text").alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), vec_nnz("v").alias("nnz"), vec_fp("v").alias("fp"))


@register("encode_sentences")
def q_encode_sentences(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    s = d.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))
    v = s.select("doc_id", "pos", HASH.sparse("sentence").alias("v"))  # a dozen of 384 entries: zeros change neither number
    return v.select("doc_id", "pos", F.size("v.values").alias("nnz"), sparse_fp("v").alias("fp"))


# ---------------------------------------------------------------- crawl

from ..config import SITEMAP_KEYWORDS  # noqa: E402
from ..operators import crawl as C  # noqa: E402


@register("sitemap_links")
def q_sitemap_links(spark, sf_dir):
    """Every <url><loc> of every sitemap document, in document order."""
    docs = X.sitemap_docs(spark, sf_dir)
    return C.links(docs, "xml", "url", ["doc_url"]).select("doc_url", "pos", F.col("loc").alias("url"))


@register("keyword_filter")
def q_keyword_filter(spark, sf_dir):
    """Sitemap entries of every site index kept by the three keywords."""
    idx = X.sitemap_index_docs(spark, sf_dir)
    return C.sitemap_entries(X.crawl_config(spark, sf_dir, SITEMAP_KEYWORDS, idx), idx)


@register("crawl")
def q_crawl(spark, sf_dir):
    """E5: index -> kept sitemaps -> article URLs."""
    docs = X.sitemap_docs(spark, sf_dir)
    idx = X.sitemap_index_docs(spark, sf_dir)
    return C.crawl(X.crawl_config(spark, sf_dir, SITEMAP_KEYWORDS, idx), idx, docs)


@register("crawl_stats")
def q_crawl_stats(spark, sf_dir):
    """A2: links per sitemap, per site, total."""
    return C.crawl_stats(q_crawl(spark, sf_dir))


# ---------------------------------------------------------------- ingest

import uuid  # noqa: E402

from ..operators import ingest as I  # noqa: E402
from ..sources import bucketed as BK  # noqa: E402


def _urls(spark, sf_dir):
    return X.url_lists(spark, sf_dir)


def _routed(spark, sf_dir, urls=None):
    return I.route(urls if urls is not None else _urls(spark, sf_dir), X.fetched_pages(spark, sf_dir))


def _done(spark, sf_dir):
    """Resume fixture: URLs of page_id % 3 = 0 were handled by an earlier run."""
    return _urls(spark, sf_dir).where(F.pmod("seq", F.lit(3)) == 0)


@register("fetch_outcome")
def q_fetch_outcome(spark, sf_dir):
    f = X.fetched_pages(spark, sf_dir).select("url", "status")
    o = I.fetch_outcome(_urls(spark, sf_dir), f)
    return o.select("source", "seq", "url", "status", F.col("status").isNotNull().alias("fetched"))


@register("route")
def q_route(spark, sf_dir):
    return _routed(spark, sf_dir).select("source", "seq", "url", "status", "n_words", "route")


@register("rejects")
def q_rejects(spark, sf_dir):
    return I.rejects(_routed(spark, sf_dir))


@register("reject_counts")
def q_reject_counts(spark, sf_dir):
    """A3: rejected per source and reason, per source, and in total."""
    return (I.rejects(_routed(spark, sf_dir)).rollup("source", "reason")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")))


@register("source_progress")
def q_source_progress(spark, sf_dir):
    """A4: listed, accepted and rejected per source; net indexable = listed - too_long - 410."""
    r = _routed(spark, sf_dir)
    return (r.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_listed"),
        F.count_if(F.col("route") == I.ACCEPTED).alias("n_accepted"),
        F.count_if(F.col("route") == I.TOO_LONG).alias("n_too_long"),
        F.count_if(F.col("route") == I.HTTP_410).alias("n_http_410"),
        F.count_if(F.col("route") != I.ACCEPTED).alias("n_rejected"))
        .withColumn("n_indexable", F.col("n_listed") - F.col("n_too_long") - F.col("n_http_410")))


def _listed_twice(spark, sf_dir):
    """The URL lists; every fourth URL is listed again further down, with trailing blanks."""
    u = _urls(spark, sf_dir)
    again = u.where(F.col("seq") % 4 == 0).select("source", (F.col("seq") + 1_000_000_000).alias("seq"), F.concat("url", F.lit("  ")).alias("url"))
    return u.select("source", "seq", "url").unionByName(again)


@register("pending_urls")
def q_pending_urls(spark, sf_dir):
    return I.pending_urls(_listed_twice(spark, sf_dir), _done(spark, sf_dir)).select("source", "seq", "url")


@register("pending_filtered")
def q_pending_filtered(spark, sf_dir):
    """J6 with a Bloom filter over the done keys."""
    return I.pending_with_filter(_listed_twice(spark, sf_dir), _done(spark, sf_dir)).select("source", "seq", "url")


@register("route_bucketed")
def q_route_bucketed(spark, sf_dir):
    """J2/P3 over tables bucketed by url: routing without an exchange."""
    names = []
    for kind, df in (("urls", _urls(spark, sf_dir)), ("pages", X.fetched_pages(spark, sf_dir))):
        names.append(f"{kind}_{uuid.uuid4().hex}")
        BK.write_bucketed(df, names[-1], shared_path(spark, names[-1]))
    urls, pages = (BK.read_bucketed(spark, n) for n in names)
    return I.route(urls, pages, stripped=True).select("source", "seq", "url", "status", "n_words", "route")


@register("indexed_urls")
def q_indexed_urls(spark, sf_dir):
    return I.indexed_urls(_listed_twice(spark, sf_dir), _done(spark, sf_dir)).select("source", "seq", "url")


def _with_ids(spark, sf_dir):
    acc = I.accepted(_routed(spark, sf_dir)).select("source", "seq", "url", "article", "published", "n_words")
    return I.assign_ids(acc, 1)


@register("assign_ids")
def q_assign_ids(spark, sf_dir):
    return _with_ids(spark, sf_dir).select("id", "source", "seq", "url")


@register("batch_plan")
def q_batch_plan(spark, sf_dir):
    return I.batch_plan(_with_ids(spark, sf_dir), 1).select("id", "encode_batch", "insert_batch")


@register("points_build")
def q_points_build(spark, sf_dir):
    p = I.build_points(_with_ids(spark, sf_dir), HASH)
    return p.select("id", F.col("payload.url").alias("url"), F.size("vector").alias("dim"),
                    vec_nnz("vector").alias("nnz"), vec_fp("vector").alias("fp"))


def _two_run_ingest(spark, sf_dir):
    """E4 twice: a first run over the page_id % 3 = 0 URLs, then a resumed
    run over the whole lists that skips what the first run handled (J6)."""
    urls, fetched = _urls(spark, sf_dir), X.fetched_pages(spark, sf_dir)
    p1, a1, r1 = I.ingest(urls.where(F.pmod("seq", F.lit(3)) == 0), fetched, HASH)
    done = a1.select("source", "url").unionByName(r1.select("source", "url"))
    p2, a2, r2 = I.ingest(urls, fetched, HASH, existing=p1, done=done)
    return p1.unionByName(p2), a1.unionByName(a2), r1.unionByName(r2)


@register("ingest")
def q_ingest(spark, sf_dir):
    points, _, _ = _two_run_ingest(spark, sf_dir)
    return points.select("id", F.col("payload.url").alias("url"), vec_nnz("vector").alias("nnz"),
                         vec_fp("vector").alias("fp"))


@register("point_count")
def q_point_count(spark, sf_dir):
    """A1: exact count of the collection built by the resumed ingest."""
    points, _, _ = _two_run_ingest(spark, sf_dir)
    return points.agg(F.count(F.lit(1)).alias("n_points"))


@register("points_upsert")
def q_points_upsert(spark, sf_dir):
    """Changed vectors for vec_id % 10 = 0, new ids above the maximum for vec_id % 10 = 5."""
    old = _embedding_points(spark, sf_dir)
    max_id = old.agg(F.max("id")).first()[0]  # one scalar
    changed = old.where(F.pmod("id", F.lit(10)) == 0).select("id", F.reverse("vector").alias("vector"))
    added = old.where(F.pmod("id", F.lit(10)) == 5).select((F.col("id") + F.lit(max_id + 1)).alias("id"), "vector")
    # Some changed ids come a second time, as a later version that wins.
    again = old.where(F.pmod("id", F.lit(20)) == 0).select("id", F.transform("vector", lambda x: x * 2).cast("array<float>").alias("vector"))
    new = changed.unionByName(added).withColumn("version", F.lit(1)).unionByName(again.withColumn("version", F.lit(2)))
    merged = I.upsert(old, new, order="version")
    return merged.select("id", vec_fp("vector").alias("fp"))


@register("embedding_dim")
def q_embedding_dim(spark, sf_dir):
    """Vectors of a stored collection against the dimension of its metadata."""
    e = _embedding_points(spark, sf_dir)
    dim = e.agg(F.max(F.size("vector"))).first()[0]  # one scalar
    root = shared_path(spark, "embeddings-" + uuid.uuid4().hex)
    CO.create_collection(spark, root, "embeddings", dim, COLLECTION_METRIC)
    CO.upsert_points(spark, root, e, dim)
    meta = CO.create_collection(spark, root, "embeddings", dim, COLLECTION_METRIC).select(F.col("dim").alias("meta_dim"))
    found = CO.read_points(spark, root).agg(F.min(F.size("vector")).alias("min_dim"), F.max(F.size("vector")).alias("max_dim"),
                                            F.count(F.lit(1)).alias("n_points"))
    return found.join(meta, (F.col("min_dim") == F.col("meta_dim")) & (F.col("max_dim") == F.col("meta_dim")))


@register("ingest_metrics")
def q_ingest_metrics(spark, sf_dir):
    """The progress counters of one ingest run, as a one-row table."""
    r = _routed(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("n_listed"),
                 F.count_if(F.col("route") == I.ACCEPTED).alias("n_accepted"),
                 F.count_if(F.col("route") != I.ACCEPTED).alias("n_rejected"),
                 F.sum(F.when(F.col("route") == I.ACCEPTED, F.col("n_words"))).alias("n_words_accepted"))


# ---------------------------------------------------------------- search

from ..operators import search as SR  # noqa: E402

SEARCH_K, DOC_SEARCH_K = 3, 5


def pages_collection(spark, sf_dir):
    """One ingest run over both URL lists: (points, articles, rejects)."""
    return I.ingest(_urls(spark, sf_dir), X.fetched_pages(spark, sf_dir), HASH)


def benchmark_queries(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@register("search")
def q_search(spark, sf_dir):
    """T5: benchmark passages against the page collection, k=3, best sentence per hit."""
    points, articles, _ = pages_collection(spark, sf_dir)
    return SR.search(points, articles, benchmark_queries(spark, sf_dir), HASH, SEARCH_K) \
        .select("query_id", "rank", "date", "url", "score", "sentence", "sentence_distance")


def documents_collection(spark, sf_dir):
    """Documents under the length limit as points (id = doc_id) and articles."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text").where(T.under_length("text"))
    arts = d.select(F.col("doc_id").alias("id"), F.col("text").alias("article"))
    pts = arts.select("id", HASH.column("article").alias("vector"))
    return pts, arts


@register("doc_search")
def q_doc_search(spark, sf_dir):
    """T5 over documents: benchmark passages, k=5."""
    pts, arts = documents_collection(spark, sf_dir)
    return SR.search(pts, arts, benchmark_queries(spark, sf_dir), HASH, DOC_SEARCH_K, date_col=None) \
        .select("query_id", "rank", F.col("id").alias("doc_id"), "score", "sentence", "sentence_distance")


def flagship(spark, sf_dir):
    return _REGISTRY["search"](spark, sf_dir)


# ---------------------------------------------------------------- ANN / metrics

from ..operators import ann as A  # noqa: E402
from ..operators import compare as CP  # noqa: E402

ANN_K = 10


def _emb_queries(spark, sf_dir):
    return _embedding_points(spark, sf_dir).select(F.col("id").alias("query_id"), "vector")


@register("metric_compare")
def q_metric_compare(spark, sf_dir):
    """overlap of the top-10 by dot product with cosine and Euclidean."""
    return A.metric_overlap(_embedding_points(spark, sf_dir), _emb_queries(spark, sf_dir), ANN_K)


@register("ann_ivf")
def q_ann_ivf(spark, sf_dir):
    """T3 (b): IVF with trained centres (twice the root of the rows), half of the cells probed, exact ranking in them."""
    pts = _embedding_points(spark, sf_dir)
    centers = A.train_centers(pts)
    return A.ivf_topk(A.build_ivf_index(pts, centers), centers, _emb_queries(spark, sf_dir), ANN_K)


@register("ann_lsh")
def q_ann_lsh(spark, sf_dir):
    """T3 (a): random-hyperplane LSH candidates (18 tables of 4 bits), exact ranking."""
    return A.lsh_topk(_embedding_points(spark, sf_dir), _emb_queries(spark, sf_dir), ANN_K)


@register("ann_pq")
def q_ann_pq(spark, sf_dir):
    """T3 (c): product quantisation, 16 bytes a vector, shortlist of 100 by distance tables, ranked exactly."""
    pts = _embedding_points(spark, sf_dir)
    books = A.train_codebooks(pts)
    return A.pq_topk(A.write_pq_index(pts, books), books, pts, _emb_queries(spark, sf_dir), ANN_K)


@register("ann_recall")
def q_ann_recall(spark, sf_dir):
    """Recall@10 of the approximate plans against the exact top-10."""
    exact = cut_lineage(_REGISTRY["vector_topk"](spark, sf_dir))  # one scan of all pairs for the three methods
    found = [A.recall_at_k(_REGISTRY[f"ann_{m}"](spark, sf_dir), exact, ANN_K).withColumn("method", F.lit(m)) for m in ("ivf", "lsh", "pq")]
    return functools.reduce(DataFrame.unionByName, found).select("method", "recall", "n_queries")


@register("method_differences")
def q_method_differences(spark, sf_dir):
    """difference of recall@10 of each pair of approximate methods, with a paired bootstrap interval."""
    exact = cut_lineage(_REGISTRY["vector_topk"](spark, sf_dir))
    each = [CP.recall_per_query(_REGISTRY[f"ann_{m}"](spark, sf_dir), exact, ANN_K, m) for m in ("ivf", "lsh", "pq")]
    return CP.paired_bootstrap(cut_lineage(functools.reduce(DataFrame.unionByName, each)))


@register("fused_search")
def q_fused_search(spark, sf_dir):
    """the lists of cells and of buckets fused by reciprocal ranks."""
    return CP.fuse([_REGISTRY[f"ann_{m}"](spark, sf_dir) for m in ("ivf", "lsh")], ANN_K)


# ---------------------------------------------------------------- URL files, collection, requests

from ..config import COLLECTION_DIM, COLLECTION_METRIC  # noqa: E402
from ..functions.requests import with_params  # noqa: E402
from ..session import shared_path  # noqa: E402
from ..sources import collection as CO  # noqa: E402
from ..sources import urls as U  # noqa: E402

SLICE_OFFSET, SLICE_NB = 10, 50
# Fixed values for the request-URL query: parameters merged into every page URL.
REQUEST_PARAMS = {"utm_source": "pagesift", "page": "1"}


def _written_lists(spark, sf_dir):
    """The URL lists written as headerless CSV, one folder per source."""
    path = shared_path(spark, "urls-" + uuid.uuid4().hex)
    U.write_url_list(_urls(spark, sf_dir), path, partition_by="source")
    return path


@register("url_scan")
def q_url_scan(spark, sf_dir):
    """S3 + P4: read the written lists back, trailing blanks stripped."""
    return U.strip_trailing(U.read_url_list(spark, _written_lists(spark, sf_dir))).select("source", "url")


@register("url_sink_roundtrip")
def q_url_sink_roundtrip(spark, sf_dir):
    """Overwrite with one source, append the other, read back."""
    path = shared_path(spark, "urls-" + uuid.uuid4().hex)
    u = _urls(spark, sf_dir)
    U.write_url_list(u.where(F.col("source") == "source0"), path, mode="overwrite")
    U.write_url_list(u.where(F.col("source") != "source0"), path, mode="append")
    return U.read_url_list(spark, path).select("url")


@register("url_slice")
def q_url_slice(spark, sf_dir):
    """URLs 10..59 of each written list, in list order; a blank line (after every 97th page) ends it."""
    u = _urls(spark, sf_dir).select("source", (F.col("seq") * 2).alias("seq"), "url")
    blank = u.where(F.col("seq") % 194 == 192).select("source", (F.col("seq") + 1).alias("seq"), F.lit("").alias("url"))
    path = shared_path(spark, "urls-" + uuid.uuid4().hex)
    U.write_url_list(u.unionByName(blank), path, partition_by="source", order="seq")
    pos = U.with_positions(U.read_url_list(spark, path, with_order=True), U.ORDER, group_col="source")
    return U.url_slice(pos, SLICE_OFFSET, SLICE_NB, group_col="source").select("source", "pos", "url")


@register("multi_source_urls")
def q_multi_source_urls(spark, sf_dir):
    """Several lists read as one table, counted per source."""
    df = U.read_url_list(spark, _written_lists(spark, sf_dir))
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n_urls"),
                                    F.count_distinct("url").alias("n_distinct"))


@register("collection_init")
def q_collection_init(spark, sf_dir):
    """S6 + S7 + A1: create the collection, write the ingested points, report."""
    root = shared_path(spark, "collection-" + uuid.uuid4().hex)
    meta = CO.create_collection(spark, root, "pages", COLLECTION_DIM, COLLECTION_METRIC)
    points, _, _ = pages_collection(spark, sf_dir)
    CO.upsert_points(spark, root, points, COLLECTION_DIM)
    n = CO.point_count(CO.read_points(spark, root))
    return meta.join(n.withColumn("name", F.lit("pages")), "name").select("name", "dim", "metric", "n_points")


@register("request_urls")
def q_request_urls(spark, sf_dir):
    """request URL per page with fixed parameters merged into its query."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", with_params("url", REQUEST_PARAMS).alias("request_url"))


def _decoded_pages(spark, sf_dir):
    """Every page landed as bytes in one of five charsets, some damaged, and decoded."""
    p = read_table(spark, sf_dir, "pages", "page_id", "html")
    m = F.pmod("page_id", F.lit(4))
    charset = (F.when(m == 1, F.lit("UTF-16LE")).when(m == 2, F.lit("UTF-16BE"))
               .when((m == 3) & ~F.col("html").rlike(r"[^\x00-\xFF]"), F.lit("ISO-8859-1"))
               .when(~F.col("html").rlike(r"[^\x00-\x7F]"), F.lit("US-ASCII")).otherwise(F.lit("UTF-8")))
    content = F.coalesce(*[F.when(charset == c, F.encode("html", c)) for c in ("UTF-16LE", "UTF-16BE", "ISO-8859-1", "US-ASCII", "UTF-8")])
    landed = p.select("page_id", charset.alias("charset"), content.alias("content"))
    # Every 50th page a second time, cut short or under a charset that it is not in.
    again = landed.where("page_id % 50 = 0").select(
        (-F.col("page_id") - 1).alias("page_id"),
        F.when(F.col("page_id") % 100 == 0, F.lit("US-ASCII")).otherwise(F.lit("x-unknown")).alias("charset"),
        F.concat("content", F.unhex(F.lit("E9"))).alias("content"))
    return landed.unionByName(again).withColumn("text", H.decode_body("content", "charset"))


@register("decode_pages")
def q_decode_pages(spark, sf_dir):
    """landed bytes decoded by their declared charset; undecodable -> NULL."""
    return _decoded_pages(spark, sf_dir).select(
        "page_id", "charset", F.col("text").isNotNull().alias("ok"),
        F.length("text").alias("n_chars"), F.md5(F.col("text")).alias("text_md5"))


@register("decode_any_pages")
def q_decode_any(spark, sf_dir):
    """pages whose charset is missing or wrong, told from their bytes (by page_id: byte order mark, <meta>, UTF-8, Latin)."""
    p = read_table(spark, sf_dir, "pages", "page_id", "html")
    m, mark = F.pmod("page_id", F.lit(5)), lambda h: F.unhex(F.lit(h))
    latin = F.regexp_replace("html", r"[^\x00-\x7F\xA0-\xFF]", "")
    tagged = F.concat(F.lit('<meta charset="utf-8">'), "html")
    kinds = [("UTF-16LE", F.concat(mark("FFFE"), F.encode("html", "UTF-16LE")), "UTF-8"), ("UTF-16BE", F.concat(mark("FEFF"), F.encode("html", "UTF-16BE")), "US-ASCII"),
             ("UTF-8", F.concat(mark("EFBBBF"), F.encode("html", "UTF-8")), None), ("UTF-8", F.encode(tagged, "UTF-8"), "x-unknown"),
             ("any", F.encode(F.concat(latin, F.lit("\u00e9!")), "ISO-8859-1"), "utf-8")]
    content = F.coalesce(*[F.when(m == i, c) for i, (_, c, _) in enumerate(kinds)])
    declared = F.coalesce(*[F.when(m == i, F.lit(d)) for i, (_, _, d) in enumerate(kinds) if d])
    found = p.select("page_id", F.explode(F.array(H.decode_any(content, declared))).alias("found"))
    return found.select("page_id", F.col("found.charset").alias("charset"), F.md5(F.col("found.text")).alias("text_md5"))


@register("decode_rejects")
def q_decode_rejects(spark, sf_dir):
    """Pages whose bytes cannot be decoded, as reject rows."""
    bad = _decoded_pages(spark, sf_dir).where("text IS NULL")
    return bad.select("page_id", "charset", F.lit("undecodable").alias("reason"))


# ---------------------------------------------------------------- streaming

from ..streaming import ingest_stream as RS1  # noqa: E402
from ..streaming import search_stream as RS2  # noqa: E402
from ..operators.ids import dense_index  # noqa: E402


@register("stream_ingest")
def q_stream_ingest(spark, sf_dir):
    """Landed pages streamed in four micro-batches into a fresh collection;
    the final points equal the batch ingest up to id order."""
    work = shared_path(spark, "stream-ingest-" + uuid.uuid4().hex)
    points, _ = RS1.stream_ingest(spark, X.fetched_pages(spark, sf_dir), _urls(spark, sf_dir), work, HASH)
    return points.select(F.col("payload.url").alias("url"), vec_nnz("vector").alias("nnz"),
                         vec_fp("vector").alias("fp"))


@register("stream_rejects")
def q_stream_rejects(spark, sf_dir):
    """Pages streamed as bytes; what the stream rejects (one page in 37 is cut inside a character)."""
    work = shared_path(spark, "stream-rejects-" + uuid.uuid4().hex)
    f = X.fetched_pages(spark, sf_dir)
    cut = F.when(F.col("page_id") % 37 == 5, F.unhex(F.lit("E9"))).otherwise(F.unhex(F.lit("")))
    landed = f.select("page_id", "url", "status", F.concat(F.encode("html", "UTF-8"), cut).alias("content"), F.lit("UTF-8").alias("charset"))
    _, rejects = RS1.stream_ingest(spark, landed, _urls(spark, sf_dir), work, HASH)
    return rejects.select("source", "url", "status", "reason")


@register("stream_progress")
def q_stream_progress(spark, sf_dir):
    """Rows of each route, summed over the micro-batches that a listener saw."""
    work, progress = shared_path(spark, "stream-progress-" + uuid.uuid4().hex), RS1.ProgressTable()
    RS1.stream_ingest(spark, X.fetched_pages(spark, sf_dir), _urls(spark, sf_dir), work, HASH, progress=progress)
    seen = progress.table(spark).where(F.col("counter").isin(list(RS1.ROUTES)))
    return seen.groupBy(F.col("counter").alias("route")).agg(F.sum("value").alias("n")).where("n > 0")


def conversation_queries(spark, sf_dir):
    """User turns of the conversations table as a query stream, numbered in (conv_id, turn) order."""
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where(F.col("role") == "user")
    return dense_index(c.select("conv_id", "turn", F.col("text").alias("query")), ["conv_id", "turn"], start=0, col="query_id")


@register("stream_search")
def q_stream_search(spark, sf_dir):
    """R2: user turns answered per micro-batch against the page collection, k=3."""
    points, articles, _ = pages_collection(spark, sf_dir)
    points, articles = points.persist(), articles.persist()
    work = shared_path(spark, "stream-search-" + uuid.uuid4().hex)
    asked = conversation_queries(spark, sf_dir)
    res = RS2.stream_search(spark, asked, points, articles, HASH, SEARCH_K, work)
    points.unpersist()
    articles.unpersist()
    return res.join(asked.select("query_id", "conv_id", "turn"), "query_id") \
        .select("conv_id", "turn", "rank", "date", "url", "score", "sentence", "sentence_distance")


# ---------------------------------------------------------------- sentence-level and sparse search

@register("best_sentence")
def q_best_sentence(spark, sf_dir):
    """A6/F6 over the whole corpus: per benchmark query, the sentence of any
    document nearest by Euclidean distance (ties: doc_id, then position)."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    s = d.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))
    # Sentences are short: sparse (bucket, weight) vectors move far less data
    # than 384 dense floats; the scorer densifies one Arrow batch at a time.
    # A document's sentences come in order, so of equal ones the first stays.
    s = s.select(F.col("doc_id").alias("id"), "pos", "sentence", HASH.sparse("sentence").alias("vector"))
    q = benchmark_queries(spark, sf_dir).select("query_id", HASH.column("query").alias("vector"))
    best = topk.vector_topk(s, q, 1, metric="euclidean", carry=["sentence", "pos"], dim=HASH.dim, sparse=True)
    return best.select("query_id", F.col("id").alias("doc_id"), F.col("pos").cast("int").alias("pos"), "sentence",
                       F.abs("score").alias("sentence_distance"))


from ..operators import postings as P  # noqa: E402


@register("lexical_topk")
def q_lexical_topk(spark, sf_dir):
    """Documents stored as postings in impact order, top-5 per benchmark
    query with pruning; same ranking as the dense plan."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text").where(T.under_length("text"))
    index = P.build_postings(d.select(F.col("doc_id").alias("id"), HASH.sparse("text").alias("vector")))
    q = benchmark_queries(spark, sf_dir).select("query_id", HASH.column("query").alias("vector"))
    res = P.postings_topk(index, q, DOC_SEARCH_K)
    return res.select("query_id", "rank", F.col("id").alias("doc_id"), "score")


# ---------------------------------------------------------------- sitemap files

from ..sources import sitemaps as SM  # noqa: E402


@register("sitemap_files")
def q_sitemap_files(spark, sf_dir):
    """S1 (files): sitemaps landed as XML files, read back with the XML source (rowTag url)."""
    path = shared_path(spark, "sitemaps-" + uuid.uuid4().hex)
    SM.write_sitemap_files(X.sitemap_docs(spark, sf_dir), path)
    return SM.read_sitemap_files(spark, path).select("doc_url", F.col("loc").alias("url"))


@register("rejects_sink")
def q_rejects_sink(spark, sf_dir):
    """Rejects appended per reason (two appends: one per source), read back."""
    path = shared_path(spark, "rejects-" + uuid.uuid4().hex)
    rej = I.rejects(_routed(spark, sf_dir)).persist()
    CO.write_rejects(rej.where(F.col("source") == "source0"), path)
    CO.write_rejects(rej.where(F.col("source") != "source0"), path)
    rej.unpersist()
    return spark.read.parquet(path).select("source", "url", "status", "reason")


@register("sitemap_rejects")
def q_sitemap_rejects(spark, sf_dir):
    """Sitemaps that lose entries; every third one is cut short, every third one's first entry has no address."""
    d = X.sitemap_docs(spark, sf_dir)
    cut = F.expr("substring(xml, 1, length(xml) - 12)")
    bare = F.regexp_replace("xml", r"^(.*?)<loc>[^<]*</loc>", "$1")
    xml = F.when(F.col("first_id") % 3 == 0, cut).when(F.col("first_id") % 3 == 1, bare).otherwise(F.col("xml"))
    return C.parse_rejects(d.withColumn("xml", xml), "xml", "url", ["doc_url"])
