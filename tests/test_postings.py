"""Postings with pruning against the exact scan and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.operators import postings as P
from pagesift.operators.topk import vector_topk
from pagesift.plans import catalog as C
from places import SF_MID

DIM = 40


def table(spark, n, seed, zipf):
    """Sparse rows with few common and many rare buckets; nulls, empty vectors, ties and repeated rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = int(rng.integers(1, 9))
        idx = np.unique(np.minimum(rng.zipf(zipf, size) - 1, DIM - 1))
        rows.append((i, {"indices": idx.tolist(), "values": rng.choice([0.25, 0.5, 1.0, 0.125], len(idx)).tolist()}))
    rows += [(n, None), (n + 1, {"indices": [], "values": []}), (7, rows[7][1])]
    return spark.createDataFrame(rows, "id long, vector struct<indices: array<int>, values: array<float>>").repartition(3), rows


def asked(spark, n, seed):
    rng = np.random.default_rng(seed)
    q = np.where(rng.random((n, DIM)) < 0.2, rng.random((n, DIM)), 0.0)
    q[0] = 0
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "query_id long, vector array<double>"), q


@pytest.mark.parametrize("k,shard_rows,zipf,budget", [(5, 4096, 1.3, 64 << 20), (1, 50, 1.6, 64 << 20), (40, 7, 1.3, 64 << 20), (5, 100, 1.3, 2000)])
def test_equal_to_exact(spark, k, shard_rows, zipf, budget):
    points, rows = table(spark, 900, k, zipf)
    queries, q = asked(spark, 25, k)
    got = {}
    for r in P.postings_topk(P.build_postings(points, shard_rows=shard_rows), queries, k, budget).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert set(got) == set(range(25))
    for i in range(25):
        every = sorted(((sum(q[i][b] * v for b, v in zip(x["indices"], x["values"])), n) for n, x in rows if x is not None),
                       key=lambda s: (-np.floor(s[0] * 1e6 + 0.5), s[1]))[:k]
        assert [n for n, _ in got[i]] == [n for _, n in every]
        assert np.allclose([s for _, s in got[i]], [s for s, _ in every], atol=1e-6)


def test_blocks_are_skipped(spark):
    """One row that holds the whole query and many that hold a little of it: most postings are never read."""
    rows = [(i, {"indices": [i % DIM, (i + 1) % DIM], "values": [0.01, 0.02]}) for i in range(4000)] + [(9000 + j, {"indices": [1, 2, 3], "values": [1.0, 1.0, 1.0]}) for j in range(3)]
    points = spark.createDataFrame(rows, "id long, vector struct<indices: array<int>, values: array<float>>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0 if i in (1, 2, 3) else 0.0 for i in range(DIM)])], "query_id long, vector array<double>")
    index = P.build_postings(points)
    assert [r.id for r in P.postings_topk(index, q, 3).orderBy("rank").collect()] == [9000, 9001, 9002]
    read = P.postings_read(index, q, 3).first()
    assert read.n_postings == 609 and read.n_read < 150


def test_negative_weights_are_refused(spark):
    points = spark.createDataFrame([(1, {"indices": [1], "values": [-1.0]})], "id long, vector struct<indices: array<int>, values: array<float>>")
    with pytest.raises(Exception, match="negative"):
        P.build_postings(points).collect()


def test_nothing(spark):
    points, _ = table(spark, 8, 1, 1.3)
    queries, _ = asked(spark, 3, 1)
    assert P.postings_topk(P.build_postings(points.where("false")), queries, 2).collect() == []
    assert P.postings_topk(P.build_postings(points), queries.where("false"), 2).collect() == []


def test_same_as_the_scan_on_documents(spark):
    d = C.read_table(spark, SF_MID, "documents", "doc_id", "text").where(C.T.under_length("text"))
    pts = d.select(F.col("doc_id").alias("id"), C.HASH.sparse("text").alias("vector"))
    q = C.benchmark_queries(spark, SF_MID).select("query_id", C.HASH.column("query").alias("vector"))
    want = vector_topk(pts, q, 5, sparse=True, dim=C.HASH.dim)
    index = P.build_postings(pts).persist()
    assert sorted(map(tuple, P.postings_topk(index, q, 5).collect())) == sorted(map(tuple, want.collect()))
    read = P.postings_read(index, q, 5).agg(F.sum("n_read"), F.sum("n_postings")).first()
    assert 0 < read[0] <= read[1]
    index.unpersist()
