"""Dense ids, routing totals, resume, upsert, collection storage, encoder contract."""

import os
import uuid

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from places import SF_MID, SF_SMALL
from pagesift import session
from pagesift.functions.encoders import HashEncoder, ModelEncoder
from pagesift.operators import ingest as I
from pagesift.operators.ids import dense_index
from pagesift.sources import collection as CO
from pagesift.sources import fixtures as X


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(min_value=-10**6, max_value=10**6), min_size=1, max_size=300, unique=True),
       st.integers(min_value=1, max_value=7))
def test_dense_index_is_dense_and_ordered(spark, keys, nparts):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(nparts)
    got = sorted((r.id, r.k) for r in dense_index(df, ["k"], start=5).collect())
    assert [g[0] for g in got] == list(range(5, 5 + len(keys)))
    assert [g[1] for g in got] == sorted(keys)


def test_every_url_routed_once(spark):
    urls, fetched = X.url_lists(spark, SF_MID), X.fetched_pages(spark, SF_MID)
    routed = I.route(urls, fetched)
    counts = {r.route: r["count"] for r in routed.groupBy("route").count().collect()}
    assert sum(counts.values()) == urls.count()
    assert counts == {"accepted": 213, "too_long": 10, "http_410": 10, "http_error": 8, "not_fetched": 9}


def test_resume_skips_done_and_ids_continue(spark):
    urls, fetched = X.url_lists(spark, SF_SMALL), X.fetched_pages(spark, SF_SMALL)
    enc = HashEncoder()
    p1, a1, r1 = I.ingest(urls, fetched, enc)
    done = a1.select("source", "url").unionByName(r1.select("source", "url"))
    p2, a2, r2 = I.ingest(urls, fetched, enc, existing=p1, done=done)
    assert p2.count() == 0 and r2.count() == 0
    n1 = p1.count()
    assert sorted(r.id for r in p1.collect()) == list(range(1, n1 + 1))


def test_ingest_progress_observation(spark):
    from pyspark.sql import Observation
    urls, fetched = X.url_lists(spark, SF_SMALL), X.fetched_pages(spark, SF_SMALL)
    obs = Observation("progress")
    points, _, rejects = I.ingest(urls, fetched, HashEncoder(), observation=obs)
    m = obs.get
    assert m["n_listed"] == urls.count()
    assert m["n_accepted"] == points.count()
    assert m["n_listed"] - m["n_accepted"] == rejects.count()


def test_upsert_is_keyed_and_idempotent(spark):
    old = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, vector array<float>")
    new = spark.createDataFrame([(2, [9.0]), (3, [3.0])], "id long, vector array<float>")
    once = I.upsert(old, new)
    twice = I.upsert(once, new)
    as_set = lambda df: sorted((r.id, tuple(r.vector)) for r in df.collect())
    assert as_set(once) == [(1, (1.0,)), (2, (9.0,)), (3, (3.0,))] == as_set(twice)


def test_collection_upserts(spark, tmp_dir):
    root = os.path.join(tmp_dir, "coll")
    meta = CO.create_collection(spark, root, "c", 2).first()
    assert (meta.name, meta.dim, meta.metric) == ("c", 2, "dot")
    a = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<float>")
    b = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, vector array<float>")
    CO.upsert_points(spark, root, a, 2)
    CO.upsert_points(spark, root, b, 2)
    pts = sorted((r.id, tuple(r.vector)) for r in CO.read_points(spark, root).collect())
    assert pts == [(1, (0.0, 1.0)), (2, (1.0, 1.0))]


def test_hash_encoder_contract(spark):
    enc = HashEncoder(dim=32)
    texts = ["Bonjour le monde", "", None, "a b a", "Élan ÉLAN élan"] * 7
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    v1 = {r.i: r.v for r in df.repartition(1).select("i", enc.column("t").alias("v")).collect()}
    v2 = {r.i: r.v for r in df.repartition(5).select("i", enc.column("t").alias("v")).collect()}
    v3 = {r.i: r.v for r in df.select("i", enc.column_expr("t").alias("v")).collect()}
    assert v1 == v2
    for i, t in enumerate(texts):
        if t is None:
            assert v1[i] is None and v3[i] is None
            continue
        assert len(v1[i]) == 32 and np.allclose(v1[i], v3[i])
        n = np.linalg.norm(v1[i])
        assert (n == 0) if t == "" else abs(n - 1) < 1e-6
    assert v1[4] == v1[9]  # same text, same vector


def test_model_encoder_batches(spark):
    def make():
        def predict(x):
            return np.stack([[len(s), s.count("a")] for s in x]).astype(np.float32)
        return predict
    enc = ModelEncoder(make, dim=2, batch_size=3)
    df = spark.createDataFrame([("aa",), ("b",), ("abca",), ("",)], "t string")
    assert [list(r[0]) for r in df.select(enc.column("t")).collect()] == [[2, 2], [1, 0], [4, 2], [0, 0]]


def test_route_paths_agree(spark):
    """The broadcast path (small URL batch) and the sort-merge path (above the
    bound) route every URL identically."""
    urls, fetched = X.url_lists(spark, SF_SMALL), X.fetched_pages(spark, SF_SMALL)
    cols = ["source", "seq", "url", "status", "article", "published", "n_words", "route"]
    small = sorted(tuple(r) for r in I.route(urls, fetched).select(*cols).collect())
    large = sorted(tuple(r) for r in I.route(urls, fetched, join_first=True).select(*cols).collect())
    assert small == large and len(small) == urls.count()


def test_collection_rejects_wrong_dimension(spark, tmp_dir):
    import pytest
    root = os.path.join(tmp_dir, "coll-dim")
    CO.create_collection(spark, root, "c", 3)
    bad = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<float>")
    with pytest.raises(Exception):
        CO.upsert_points(spark, root, bad, 3)
    assert CO.read_points(spark, root) is None  # nothing half-written is left


def test_bytes_that_cannot_be_decoded_are_rejects(spark):
    urls = spark.createDataFrame([("s", i, f"u{i}") for i in range(5)], "source string, seq long, url string")
    page = "<p>é</p>"
    fetched = spark.createDataFrame([
        ("u0", 200, bytearray(page.encode()), "UTF-8"), ("u1", 200, bytearray(page.encode("utf-16-le")), "UTF-16LE"),
        ("u2", 200, bytearray(b"\xff<p>"), "UTF-8"), ("u3", 404, None, None)], "url string, status int, content binary, charset string")
    for first in (False, True):
        got = {r.url: (r.route, r.article) for r in I.route(urls, fetched, join_first=first).collect()}
        assert got["u0"] == got["u1"] == ("accepted", "é")
        assert [got[f"u{i}"][0] for i in (2, 3, 4)] == ["undecodable", "http_error", "not_fetched"]


def test_upsert_touches_only_its_buckets(spark, tmp_dir):
    import os
    import pytest
    from pagesift.sources import collection as CO
    root = os.path.join(tmp_dir, "c")
    CO.create_collection(spark, root, "c", 2)
    rows = lambda ids, x: spark.createDataFrame([(i, [x, 1.0]) for i in ids], "id long, vector array<float>")
    CO.upsert_points(spark, root, rows(range(500), 0.0), 2)
    files = lambda: set(CO.read_points(spark, root).inputFiles())
    before = files()
    newer = rows([7, 900], 5.0).selectExpr("*", "2 AS version").union(rows([7], 9.0).selectExpr("*", "3 AS version")).union(rows([900], 4.0).selectExpr("*", "1 AS version"))
    CO.upsert_points(spark, root, newer, 2, order="version")
    after = files()
    assert 1 <= len(before - after) <= 2 and 1 <= len(after - before) <= 2
    got = {r.id: r.vector[0] for r in CO.read_points(spark, root).collect()}
    assert len(got) == 501 and got[7] == 9.0 and got[900] == 5.0 and got[8] == 0.0
    with pytest.raises(ValueError):
        CO.create_collection(spark, root, "c", 3)
    with pytest.raises(ValueError):
        CO.upsert_points(spark, root, rows([1], 1.0), 3)


def test_keyed_index_with_repeats_and_nulls(spark):
    from pagesift.operators.ids import keyed_index
    rows = [("a", i % 7, f"x{i}") for i in range(40)] + [(None, 3, "n"), ("b", None, "m"), ("b", None, "m")]
    df = spark.createDataFrame(rows, "source string, seq long, text string").repartition(5)
    got = sorted((r.id, r.source, r.seq, r.text) for r in keyed_index(df, ["source", "seq"], start=10).collect())
    assert [g[0] for g in got] == list(range(10, 10 + len(rows)))
    assert sorted(map(str, (g[1:] for g in got))) == sorted(map(str, rows))
    order = [(g[1] is not None, g[1] or "", g[2] is not None, g[2] or 0) for g in got]
    assert order == sorted(order)


def test_drop_written(spark, monkeypatch, tmp_dir):
    monkeypatch.setattr(session, "_HANDED_OUT", {})
    mine, other = session.shared_path(spark, f"drop-{uuid.uuid4().hex}"), os.path.join(tmp_dir, "kept")
    for path in (mine, other):
        spark.range(10).write.parquet(path)
    session.shared_path(spark, "never-written")
    assert CO._exists(spark, mine)
    assert session.drop_written(spark) == 1 and session.drop_written(spark) == 0
    assert not CO._exists(spark, mine) and spark.read.parquet(other).count() == 10
    assert CO._exists(spark, session.ensure_checkpoint_dir(spark))
