"""Landed inputs derived from the driver tables (FIXTURES.md §3).

The reference fetches sitemaps and pages over HTTP; here they arrive as
tables. Each derivation is a plain column expression over ``pages`` so the
DuckDB oracle can repeat it, and each scales with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
# Sitemap protocol limit: at most 50,000 entries per document; documents are
# cut by page_id range so none exceeds it whatever a host's size.
ENTRIES_PER_DOC = 50000
# Sitemap kinds by min(page_id) % 4.
KINDS = ["post", "slideshow", "video", "category"]
N_SOURCES = 2


def host_of(url) -> Column:
    u = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1)


def site_of(host) -> Column:
    h = F.col(host) if isinstance(host, str) else host
    return F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)


def source_of(page_id) -> Column:
    return F.concat(F.lit("source"), F.pmod(F.col(page_id), F.lit(N_SOURCES)).cast("string"))


def http_status(page_id) -> Column:
    pid = F.col(page_id)
    return (F.when(F.pmod(pid, F.lit(23)) == 0, F.lit(410))
            .when(F.pmod(pid, F.lit(29)) == 0, F.lit(404))
            .otherwise(F.lit(200)))


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, status, html): what a fetcher landed; page_id % 31 = 0 never fetched."""
    return dated_pages(spark, sf_dir).where(F.pmod("page_id", F.lit(31)) != 0)


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, status, html) of every page.

    status 410 / 404 / 200 by page_id; html only for 200; a publishing date
    injected before <h1> on four pages in five.
    """
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    pid = F.col("page_id")
    status = http_status("page_id")
    time_tag = F.concat(F.lit('<time datetime="x"> <b>'), pid.cast("string"),
                        F.lit("</b> nov. 2024</time><time>z</time><h1>"))
    html = F.when(F.pmod(pid, F.lit(5)) != 0, F.replace(F.col("html"), F.lit("<h1>"), time_tag)) \
        .otherwise(F.col("html"))
    return p.select("page_id", "url", status.alias("status"), F.when(status == 200, html).alias("html"))


def url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, seq, url): the crawled URL files, in page_id order."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    return p.select(source_of("page_id").alias("source"), F.col("page_id").alias("seq"), "url")


def _doc_suffix(chunk: Column) -> Column:
    return F.when(chunk == 0, F.lit("")).otherwise(chunk.cast("string"))


def sitemap_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, doc_url, first_id, xml): one urlset document per host and id range."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    g = (p.withColumn("host", host_of("url"))
         .withColumn("chunk", F.floor(F.col("page_id") / ENTRIES_PER_DOC))
         .groupBy("host", "chunk")
         .agg(F.min("page_id").alias("first_id"),
              F.sort_array(F.collect_list(F.struct("page_id", "url"))).alias("entries")))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.pmod("first_id", F.lit(4)).cast("int") + 1)
    body = F.array_join(F.transform("entries", lambda e: F.concat(
        F.lit("<url><loc>"), F.replace(e["url"], F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), "")
    return g.select(
        site_of("host").alias("site"),
        F.concat(F.lit("https://"), F.col("host"), F.lit("/"), kind, F.lit("-sitemap"),
                 _doc_suffix(F.col("chunk")), F.lit(".xml")).alias("doc_url"),
        "first_id",
        F.concat(F.lit(f'<urlset xmlns="{SITEMAP_NS}">'), body, F.lit("</urlset>")).alias("xml"))


def sitemap_index_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, index_url, xml): one sitemapindex per site and id range of first ids."""
    s = sitemap_docs(spark, sf_dir).select("site", "doc_url", "first_id")
    g = (s.withColumn("chunk", F.floor(F.col("first_id") / ENTRIES_PER_DOC))
         .groupBy("site", "chunk")
         .agg(F.sort_array(F.collect_list(F.struct("first_id", "doc_url"))).alias("entries")))
    body = F.array_join(F.transform("entries", lambda e: F.concat(
        F.lit("<sitemap><loc>"), e["doc_url"], F.lit("</loc></sitemap>"))), "")
    return g.select(
        "site",
        F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap_index"),
                 _doc_suffix(F.col("chunk")), F.lit(".xml")).alias("index_url"),
        F.concat(F.lit(f'<sitemapindex xmlns="{SITEMAP_NS}">'), body, F.lit("</sitemapindex>")).alias("xml"))


def crawl_config(spark: SparkSession, sf_dir: str, keywords: list[str],
                 index_docs: DataFrame | None = None) -> DataFrame:
    """(site, index_url, keywords): one row per site index to crawl."""
    idx = (index_docs if index_docs is not None else sitemap_index_docs(spark, sf_dir)).select("site", "index_url")
    return idx.withColumn("keywords", F.array(*[F.lit(k) for k in keywords]).cast("array<string>"))
