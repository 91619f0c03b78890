"""Search quality with known answers, sparse = dense, two-stage result shape."""

from pyspark.sql import functions as F

from places import SF_MID, SF_SMALL
from pagesift.operators import search as SR
from pagesift.plans import catalog as C


def test_recall_on_verbatim_passages(spark):
    """Benchmark passages that occur verbatim in an indexed document should
    mostly be found in the top-5 (truth computed by brute force here)."""
    docs = {r.doc_id: r.text for r in C.read_table(spark, SF_MID, "documents", "doc_id", "text").collect()}
    bench = {r.item_id: r.text for r in C.read_table(spark, SF_MID, "benchmark", "item_id", "text").collect()}
    indexed = {d for d, t in docs.items() if len(t.split(" ")) < 1200}
    truth = {q: {d for d in indexed if p and p in docs[d]} for q, p in bench.items()}
    truth = {q: ds for q, ds in truth.items() if ds}
    res = C.queries()["doc_search"](spark, SF_MID).collect()
    found = {q for q in truth if any(r.query_id == q and r.doc_id in truth[q] for r in res)}
    assert len(truth) >= 10
    assert len(found) / len(truth) >= 0.5


def test_sparse_equals_dense(spark):
    a = C.queries()["lexical_topk"](spark, SF_SMALL)
    b = C.queries()["doc_search"](spark, SF_SMALL).select("query_id", "rank", "doc_id", "score")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(a) == key(b)


def test_search_result_shape(spark):
    df = C.queries()["search"](spark, SF_SMALL)
    rows = df.collect()
    assert df.columns == ["query_id", "rank", "date", "url", "score", "sentence", "sentence_distance"]
    per_q = {}
    for r in rows:
        per_q.setdefault(r.query_id, []).append(r)
    for q, rs in per_q.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1)) and len(rs) <= 3
        assert all(x.score >= y.score for x, y in zip(rs, rs[1:]))
        assert all(r.sentence is None or r.sentence_distance >= 0 for r in rs)


def test_search_blocked_plan_equals_broadcast_plan(spark):
    from pagesift.operators import search as SR
    points, articles, _ = C.pages_collection(spark, SF_SMALL)
    q = C.benchmark_queries(spark, SF_SMALL)
    a = SR.search(points, articles, q, C.HASH, 3)
    b = SR.search(points, articles, q, C.HASH, 3, max_broadcast_bytes=20_000)  # forces query chunks
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(a) == key(b) and len(key(a)) > 0


def test_sentences_as_sparse_vectors(spark):
    """Sentences take the sparse vectors of an encoder that has them, for the same answers."""
    class Spare:
        def __init__(self, dense=()):
            self.dense, self.dim = dense, C.HASH.dim
            if dense:
                self.sparse = C.HASH.sparse

        def column(self, text):
            assert not self.dense or text in self.dense, text
            return C.HASH.column(text)

    arts = spark.createDataFrame([(i, f"one {w}. two {w} here! three? {w} four.") for i, w in enumerate("red blue green red".split())], "id long, article string")
    asked = spark.createDataFrame([(1, "blue here"), (2, "red four three"), (3, "none of it")], "query_id long, query string")
    points = arts.select("id", C.HASH.column("article").alias("vector"))
    got, want = (sorted(SR.search(points, arts, asked, e, 3, date_col=None).collect()) for e in (Spare(("query",)), Spare()))
    assert len(want) == 9 and all(r.sentence for r in want) and str(got) == str(want)
