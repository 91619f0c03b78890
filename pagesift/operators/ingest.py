"""Ingest: URL lists -> fetched pages -> articles -> routed -> points.

A left join to the landed pages (J2), article extraction as column
expressions (F2, F3, A7), a CASE route (P3), anti/semi joins for resume (J6,
J7), distributed dense ids (W1; counting rows per partition runs a job while
the query is built) and a keyed upsert (S7). Nothing is fetched twice: ``articles`` is computed once
and reused by the length test and the encoder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ENCODE_BATCH, INSERT_BATCH, MAX_WORDS
from ..functions import html as H
from ..functions import text as T
from ..functions.encoders import Encoder
from ..session import cut_lineage
from . import bloom as B
from .ids import keyed_index

ACCEPTED = "accepted"
# Reject reasons ("too_long" and "http_410" are the
# reference's two reject files; the other two keep every URL visible).
TOO_LONG, HTTP_410, HTTP_ERROR, NOT_FETCHED = "too_long", "http_410", "http_error", "not_fetched"
UNDECODABLE = "undecodable"


def strip_url(url) -> Column:
    """Trailing whitespace removed."""
    return F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"\s+$", "")


def fetch_outcome(urls: DataFrame, fetched: DataFrame) -> DataFrame:
    """Every listed URL with its fetch result (NULL status = never fetched).

    The fetched side is large (it grows with the crawl), so it is never
    broadcast: sort-merge on url, which becomes shuffle-free when both tables
    are bucketed by url; AQE still splits a skewed url.
    """
    u = urls.select("source", "seq", strip_url("url").alias("url"))
    f = fetched.drop("source", "seq", "page_id").hint("merge")
    return u.join(f, "url", "left")


def with_articles(df: DataFrame) -> DataFrame:
    """F2/F3/A7 once per page: article text, publishing date, word count.

    Comments, scripts and styles are stripped once and shared by the
    paragraph and date rules; the html column is dropped afterwards.
    """
    return (df.withColumn("_clean", H.strip_noise("html"))
            .withColumn("article", H.article_text("_clean", cleaned=True))
            .withColumn("published", H.published("_clean", cleaned=True))
            .drop("_clean", "html")
            .withColumn("n_words", T.word_count("article")))


def decoded(fetched: DataFrame) -> DataFrame:
    """landed bytes (url, status, content, charset) as (url, status, html, undecodable)."""
    html = H.decode_body("content", "charset")
    return fetched.withColumn("html", html).withColumn(
        "undecodable", (F.col("status") == 200) & F.col("content").isNotNull() & F.col("html").isNull()).drop("content", "charset")


def route_col(max_words: int = MAX_WORDS, undecodable: Column | None = None) -> Column:
    """One route per URL."""
    st = F.col("status")
    return (F.when(st.isNull(), F.lit(NOT_FETCHED))
            .when(st == 410, F.lit(HTTP_410))
            .when(st != 200, F.lit(HTTP_ERROR))
            .when(F.lit(False) if undecodable is None else undecodable, F.lit(UNDECODABLE))
            .when(F.col("n_words") >= max_words, F.lit(TOO_LONG))
            .otherwise(F.lit(ACCEPTED)))


def route(urls: DataFrame, fetched: DataFrame, max_words: int = MAX_WORDS,
          join_first: bool = False, stripped: bool = False) -> DataFrame:
    """(source, seq, url, status, article, published, n_words, route).

    By default HTML is reduced to article text where the pages lie and the
    join on url moves article text, not pages. ``join_first`` (the caller's
    choice, for a URL batch that is small beside the pages) joins the pages
    first, so only listed ones are reduced; Spark picks the join by the sizes
    it measures. Never-fetched URLs are the batch's own rows without a page.
    Pages may come as bytes (``content``, ``charset``): those that cannot be
    decoded are rejects. ``stripped``: the URLs are stored without trailing
    blanks, as in tables bucketed by url, which then join without an exchange.
    """
    if "content" in fetched.columns:
        fetched = decoded(fetched)
    else:
        fetched = fetched.withColumn("undecodable", F.lit(False))
    u = urls.select("source", "seq", F.col("url") if stripped else strip_url("url").alias("url"))
    f = fetched.select("url", "status", "html", "undecodable")
    if join_first:
        routed = with_articles(u.join(f, "url", "left"))
    elif stripped:
        routed = u.join(with_articles(f).hint("merge"), "url", "left")
    else:
        routed = fetch_outcome(u, with_articles(f))
    return routed.withColumn("route", route_col(max_words, F.coalesce("undecodable", F.lit(False)))).drop("undecodable")


def rejects(routed: DataFrame) -> DataFrame:
    """S8 rows: (source, url, reason, status)."""
    return (routed.where(F.col("route") != ACCEPTED)
            .select("source", "seq", "url", F.col("route").alias("reason"), "status"))


def accepted(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("route") == ACCEPTED)


def pending_urls(urls: DataFrame, done: DataFrame) -> DataFrame:
    """Listed URLs not yet indexed or rejected, keyed by (source, url).

    No distinct on ``done``: a semi/anti join never multiplies rows, so a
    deduplicating shuffle would be wasted.
    """
    d = done.select("source", strip_url("url").alias("url"))
    return urls.withColumn("url", strip_url("url")).join(d, ["source", "url"], "left_anti")


def pending_with_filter(urls: DataFrame, done: DataFrame, n_done: int | None = None) -> DataFrame:
    """``pending_urls`` with a Bloom filter over the done keys: URLs that are surely new skip the anti join.

    For a resume over mostly new URLs: only what the filter lets through is
    shuffled. ``n_done`` sizes the filter (counted if not given).
    """
    keys = ["source", "url"]
    d = done.select("source", strip_url("url").alias("url"))
    bits = B.size_for(d.count() if n_done is None else n_done)
    marked = B.with_maybe(urls.withColumn("url", strip_url("url")), keys, B.build(d, keys, bits), bits)
    new, maybe = marked.where("not _maybe").drop("_maybe"), marked.where("_maybe").drop("_maybe")
    return new.unionByName(maybe.join(d, keys, "left_anti").select(*new.columns))


def indexed_urls(urls: DataFrame, done: DataFrame) -> DataFrame:
    """Listed URLs already in the collection."""
    d = done.select("source", strip_url("url").alias("url"))
    return urls.withColumn("url", strip_url("url")).join(d, ["source", "url"], "left_semi")


def assign_ids(acc: DataFrame, id_start: int) -> DataFrame:
    """Ids id_start, id_start+1, ... dense over accepted rows in (source, seq) order."""
    return keyed_index(acc, ["source", "seq"], start=id_start, col="id")


def batch_plan(with_ids: DataFrame, id_start: int, encode_batch: int = ENCODE_BATCH,
               insert_batch: int = INSERT_BATCH) -> DataFrame:
    """Encode and insert batch numbers of each accepted article."""
    if not (encode_batch <= insert_batch and insert_batch % encode_batch == 0):
        raise ValueError("the insert batch must be a multiple of the encode batch")
    ordinal = F.col("id") - F.lit(id_start)
    return (with_ids.withColumn("encode_batch", F.floor(ordinal / encode_batch).cast("long"))
            .withColumn("insert_batch", F.floor(ordinal / insert_batch).cast("long")))


def build_points(with_ids: DataFrame, encoder: Encoder) -> DataFrame:
    """P5 + E2 + F8: (id, vector, payload{url})."""
    return with_ids.select("id", encoder.column("article").alias("vector"),
                           F.struct(F.col("url").alias("url")).alias("payload"))


def next_id(points: DataFrame | None) -> int:
    """First free id: count + 1 like the reference, or max + 1 after deletes."""
    if points is None:
        return 1
    row = points.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).first()
    return int(max(row["n"] or 0, row["m"] or 0)) + 1


def progress_metrics() -> list[Column]:
    """Counters of one ingest run (the reference prints them as it goes)."""
    r = F.col("route")
    return [F.count(F.lit(1)).alias("n_listed"),
            F.count_if(r == ACCEPTED).alias("n_accepted"),
            F.count_if(r == TOO_LONG).alias("n_too_long"),
            F.count_if(r == HTTP_410).alias("n_http_410"),
            F.count_if(r == HTTP_ERROR).alias("n_http_error"),
            F.count_if(r == NOT_FETCHED).alias("n_not_fetched")]


def ingest(urls: DataFrame, fetched: DataFrame, encoder: Encoder, existing: DataFrame | None = None,
           done: DataFrame | None = None, max_words: int = MAX_WORDS, observation=None):
    """Returns (points, articles, rejects) DataFrames for one ingest run.

    ``done`` holds (source, url) already indexed or rejected; those are
    skipped (J6). Ids continue after ``existing``. An ``Observation`` passed
    in receives the progress counters as a side effect of the run's first
    action (no extra job).
    """
    todo = pending_urls(urls, done) if done is not None else urls
    routed = route(todo, fetched, max_words)
    if observation is not None:
        routed = routed.observe(observation, *progress_metrics())
    # Routed rows feed both the accepted path and the rejects: computed once, with no cache to release afterwards.
    routed = cut_lineage(routed)
    acc = accepted(routed).select("source", "seq", "url", "article", "published", "n_words")
    with_ids = assign_ids(acc, next_id(existing))
    points = build_points(with_ids, encoder)
    articles = with_ids.select("id", "source", "url", "article", "published", "n_words")
    return points, articles, rejects(routed)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Keyed replacement; rows of ``new`` win, untouched rows kept.

    The result has the columns of ``old``. Of several new rows with one key the one with the greatest ``order``
    stays (without it, the one with the greatest hash of its values).
    """
    last = F.col(order) if order else F.xxhash64(*new.columns)
    one = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), last).alias("row")).select("row.*").select(*old.columns)
    return old.join(one.select(key), key, "left_anti").unionByName(one)
