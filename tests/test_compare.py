"""Bloom filter, bucketed routing, bootstrap and fusion against plain Python."""

import collections
import hashlib
import math
import uuid

import numpy as np
import pytest

from pagesift.functions import html as H
from pagesift.functions import text as T
from pagesift.operators import bloom as B
from pagesift.operators import compare as CP
from pagesift.operators import ingest as I
from pagesift.plans import catalog as C
from pagesift.sources import bucketed as BK
from pagesift.sources import fixtures as X
from places import SF_SMALL


def test_bloom_has_no_false_negatives_and_merges(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE id % 3 END AS s", "concat('u', id) AS url")
    bits = B.size_for(3000)
    parts = [B.build(df.where(f"length(url) % 2 = {i}"), ["s", "url"], bits) for i in (0, 1)]
    whole, merged = ({r.word: r.bits for r in f.collect()} for f in (B.build(df, ["s", "url"], bits), B.merge(*parts)))
    assert whole == merged and len(whole) <= bits // 64
    held = B.with_maybe(df, ["s", "url"], B.merge(*parts), bits)
    assert held.where("NOT _maybe").count() == 0 and held.columns == ["s", "url", "_maybe"]
    others = spark.range(5000).selectExpr("id % 3 AS s", "concat('v', id) AS url")
    assert B.with_maybe(others, ["s", "url"], parts[0], bits).where("_maybe").count() < 250
    assert B.with_maybe(others, ["s", "url"], B.build(df.where("false"), ["s", "url"], 1024), 1024).where("_maybe").count() == 0
    assert B.size_for(1) == 1024 and B.size_for(10 ** 12) == B.MAX_BITS


@pytest.mark.parametrize("n_done", [None, 1])  # 1: a filter far too small lets nearly all through
def test_filtered_resume_is_exact(spark, n_done):
    urls = spark.range(4000).selectExpr("concat('s', id % 2) AS source", "id AS seq", "concat('u', id, ' ') AS url")
    done = urls.where("seq % 7 = 0").union(urls.where("seq % 14 = 0"))
    want, got = (sorted(map(tuple, df.select("source", "seq", "url").collect())) for df in (
        I.pending_urls(urls, done), I.pending_with_filter(urls, done, n_done)))
    assert got == want


def test_shuffled_rows_fall(spark):
    """Of mostly new URLs only what the filter lets through meets the exact join."""
    urls = spark.range(20_000).selectExpr("'s' AS source", "id AS seq", "concat('u', id) AS url")
    done = urls.where("seq < 500").select("source", "url")
    bits = B.size_for(500)
    maybe = B.with_maybe(urls, ["source", "url"], B.build(done, ["source", "url"], bits), bits).where("_maybe").count()
    assert 500 <= maybe < 1200  # of 20,000


def test_bucketed_routing_has_no_exchange(spark, tmp_dir):
    urls, pages = X.url_lists(spark, SF_SMALL), X.fetched_pages(spark, SF_SMALL)
    names = [f"b_{uuid.uuid4().hex}" for _ in range(2)]
    for n, df in zip(names, (urls, pages)):
        BK.write_bucketed(df, n, f"{tmp_dir}/{n}", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    routed = I.route(*(BK.read_bucketed(spark, n) for n in names), stripped=True)
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    key = lambda df: sorted(map(str, df.select("source", "seq", "url", "status", "n_words", "route", "article").collect()))
    assert key(routed) == key(I.route(urls, pages))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == old


def weight(query, r):
    u = int(hashlib.md5(f"{query}:{r}".encode()).hexdigest()[:8], 16) / 2 ** 32
    return sum(u >= sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(8))


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    values = [(m, q, float(rng.random() + (0.3 if m == "a" else 0))) for m in "abc" for q in range(60) if (m, q) != ("c", 3)]
    got = {(r.method_a, r.method_b): r for r in CP.paired_bootstrap(spark.createDataFrame(values, "method string, query_id long, value double")).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    v = {(m, q): x for m, q, x in values}
    for (a, b), r in got.items():
        both = [q for q in range(60) if (a, q) in v and (b, q) in v]
        d = {q: v[a, q] - v[b, q] for q in both}
        means = [sum(weight(q, k) * d[q] for q in both) / sum(weight(q, k) for q in both) for k in range(200)]
        assert r.n_queries == len(both) and r.difference == pytest.approx(np.mean(list(d.values())), abs=2e-6)
        assert (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=2e-6)
    assert got["a", "b"].low > 0 and got["b", "c"].low < 0 < got["b", "c"].high
    assert np.mean([weight(q, 1) for q in range(4000)]) == pytest.approx(1, abs=0.06)


def test_fusion(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 5, 1)], "query_id long, id long, rank int")
    two = spark.createDataFrame([(1, 12, 1), (1, 13, 2), (1, 10, 3)], "query_id long, id long, rank int")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in CP.fuse([one, two], 3).collect()}
    s = lambda *ranks: round(sum(1 / (60 + r) for r in ranks), 6)
    assert got == {(1, 1): (10, s(1, 3)), (1, 2): (12, s(3, 1)), (1, 3): (11, s(2)), (2, 1): (5, s(1))}


def test_charset_from_bytes(spark):
    page = "<p>Ça été — 10 €</p>"
    rows = [(1, b"\xef\xbb\xbf" + page.encode(), "US-ASCII", page, "UTF-8"), (2, b"\xff\xfe" + page.encode("utf-16-le"), None, page, "UTF-16LE"),
            (3, b"\xfe\xff" + page.encode("utf-16-be"), "UTF-8", page, "UTF-16BE"), (4, page.encode(), "UTF-8", page, "UTF-8"),
            (5, page.encode(), "nonsense", page, "UTF-8"), (6, page.encode("cp1252"), "utf-8", page, "WINDOWS-1252"),
            (7, b'<META http-equiv=x content="text/html; charset=windows-1252">' + page.encode("cp1252"), None,
             '<META http-equiv=x content="text/html; charset=windows-1252">' + page, "WINDOWS-1252"),
            (8, b"<meta charset='utf-16'>" + page.encode(), None, "<meta charset='utf-16'>" + page, "UTF-8"), (9, b"\x81\xff", None, "\x81\xff", "ISO-8859-1"),
            (10, None, "UTF-8", None, None), (11, b"", None, "", "UTF-8"), (12, page.encode("latin-1", "ignore"), "iso-8859-1", page.encode("latin-1", "ignore").decode("latin-1"), "ISO-8859-1")]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), c) for i, b, c, _, _ in rows], "i int, content binary, charset string")
    got = {r.i: r.f for r in df.select("i", H.decode_any("content", "charset").alias("f")).collect()}
    for i, _, _, text, charset in rows:
        assert (got[i] and got[i].text, got[i] and got[i].charset) == (text, charset), i


@pytest.mark.parametrize("name", ["decode_pages", "decode_any_pages", "decode_rejects"])
def test_decoding_compiles(spark, name):
    """Bytes and charsets made by long expressions stay within what the JVM compiles (no interpreted plan instead)."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert C.queries()[name](spark, SF_SMALL).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_sentence_chunks(spark):
    long = " ".join(f"w{i}" for i in range(25)) + "."
    texts = ["", None, "One two. Three four five. Six.", "A b c d e f g h. I. J k.", f"Start here. {long} The end.", "no end", "a  b. c", "x " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", T.sentence_chunks("text", 8).alias("c"), T.sentences("text").alias("s")).collect()
    for r in rows:
        if r.s is None:
            assert r.c is None
            continue
        pieces = [(p, len(s.split(" ")) > 8) for s in r.s for p in (
            [s] if len(s.split(" ")) <= 8 else [" ".join(s.split(" ")[i:i + 8]) for i in range(0, len(s.split(" ")), 8)])]
        want, used = [], 9
        for p, alone in pieces:
            n = len(p.split(" "))
            if alone or used + n > 8:
                want.append(p)
            else:
                want[-1] += " " + p
            used = 8 if alone else n if used + n > 8 else used + n
        assert r.c == want
        assert all(len(c.split(" ")) <= 8 for c in r.c)
    with pytest.raises(ValueError):
        T.sentence_chunks("text", 0)


def test_pending_filtered_query(spark):
    qs = C.queries()
    key = lambda n: collections.Counter(map(tuple, qs[n](spark, SF_SMALL).collect()))
    assert key("pending_filtered") == key("pending_urls")


def test_bootstrap_of_one_query(spark):
    """Most replicates of one query weigh it once or more; those that weigh nothing are left out."""
    values = spark.createDataFrame([("a", 1, 0.75), ("b", 1, 0.5), ("c", 2, 0.5)], "method string, query_id long, value double")
    assert [tuple(r) for r in CP.paired_bootstrap(values).collect()] == [("a", "b", 1, 0.25, 0.25, 0.25)]
