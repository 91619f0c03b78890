"""Crawl: site index -> sitemaps -> article URLs.

XML documents are parsed with ``from_xml`` (PERMISSIVE: a malformed document
yields a NULL array and is a row of ``parse_rejects`` instead of failing the job),
links are exploded with their position, the keyword test is a higher-order
``exists``, and index entries are joined to sitemap documents by URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOC_TAG, SITEMAP_TAG, URL_TAG


def parse_links(xml, tag: str, loc_tag: str = LOC_TAG) -> Column:
    """array<string> of the ``loc_tag`` text of every ``tag`` child of the root.

    Text is trimmed and entities decoded; an element without ``loc_tag``
    gives NULL (dropped by ``links``); a malformed document gives NULL.
    """
    schema = f"`{tag}` ARRAY<STRUCT<`{loc_tag}`: STRING>>"
    parsed = F.from_xml(F.col(xml) if isinstance(xml, str) else xml, schema, {"mode": "PERMISSIVE"})
    return F.transform(parsed[tag], lambda e: e[loc_tag])


def links(docs: DataFrame, xml_col: str, tag: str, keep: list[str], loc_tag: str = LOC_TAG) -> DataFrame:
    """Explode every document into (keep..., pos, loc), document order in ``pos``."""
    return (docs.select(*keep, F.posexplode(parse_links(xml_col, tag, loc_tag)).alias("pos", "loc"))
            .where(F.col("loc").isNotNull()))


def keyword_match(loc, keywords) -> Column:
    """Any keyword is a substring; [""] keeps all, [] keeps none."""
    kw = F.col(keywords) if isinstance(keywords, str) else keywords
    return F.exists(kw, lambda k: F.instr(F.col(loc) if isinstance(loc, str) else loc, k) > 0)


def sitemap_entries(config: DataFrame, index_docs: DataFrame, sitemap_tag: str = SITEMAP_TAG,
                    loc_tag: str = LOC_TAG) -> DataFrame:
    """Index level: (site, sitemap_pos, sitemap) kept by the keyword filter."""
    idx = index_docs.join(config.select("index_url", "keywords"), "index_url")
    ent = links(idx, "xml", sitemap_tag, ["site", "keywords"], loc_tag)
    return (ent.where(keyword_match("loc", "keywords"))
            .select("site", F.col("pos").alias("sitemap_pos"), F.col("loc").alias("sitemap")))


def crawl(config: DataFrame, index_docs: DataFrame, sitemap_docs: DataFrame,
          sitemap_tag: str = SITEMAP_TAG, url_tag: str = URL_TAG, loc_tag: str = LOC_TAG) -> DataFrame:
    """E5: (site, sitemap_pos, sitemap, link_pos, url); duplicates kept."""
    ent = sitemap_entries(config, index_docs, sitemap_tag, loc_tag)
    docs = sitemap_docs.select(F.col("doc_url").alias("sitemap"), "xml")
    joined = ent.join(docs, "sitemap")  # J1
    return (links(joined, "xml", url_tag, ["site", "sitemap_pos", "sitemap"], loc_tag)
            .select("site", "sitemap_pos", "sitemap", F.col("pos").alias("link_pos"), F.col("loc").alias("url")))


def crawl_stats(crawled: DataFrame) -> DataFrame:
    """A2: links per sitemap, per site and in total in one result."""
    return (crawled.rollup("site", "sitemap")
            .agg(F.count(F.lit(1)).alias("n_links"), F.grouping_id().cast("int").alias("level")))


def parse_rejects(docs: DataFrame, xml_col: str, tag: str, keep: list[str], loc_tag: str = LOC_TAG) -> DataFrame:
    """Documents that lose entries: (keep..., reason, n_entries, n_without_loc).

    reason is "malformed" (no entry could be read, counts are 0) or
    "without_loc" (some entries name no address).
    """
    found = docs.select(*keep, F.coalesce(parse_links(xml_col, tag, loc_tag), F.array().cast("array<string>")).alias("_locs"))
    found = found.select(*keep, F.size("_locs").cast("long").alias("n_entries"),
                         F.size(F.filter("_locs", lambda x: x.isNull())).cast("long").alias("n_without_loc"))
    reason = F.when(F.col("n_entries") == 0, "malformed").when(F.col("n_without_loc") > 0, "without_loc")
    return found.withColumn("reason", reason).where("reason IS NOT NULL")
