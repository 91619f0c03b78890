"""Request URLs against the standard library on a small fixture."""

from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

from pagesift.functions.requests import with_params

PARAMS = {"utm_source": "x y", "page": "1"}


def brute(url, params):
    parts = list(urlparse(url))
    q = dict(parse_qsl(parts[4]))
    q.update(params)
    parts[4] = urlencode(q)
    return urlunparse(parts)


def test_with_params_matches_stdlib(spark):
    urls = ["https://a.example/p", "https://a.example/p?page=2&ref=x", "http://b.example/q?x=1#top",
            "https://c.example/r?name=a%20b", "https://d.example/s/",
            "https://e.example/?a=1&b=2&a=3", "https://f.example/?a=&b", "https://g.example/?page=1&page=2"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in df.select(with_params("u", PARAMS)).collect()]
    assert got == [brute(u, PARAMS) for u in urls]


def test_bad_percent_and_row_params(spark):
    df = spark.createDataFrame([("http://a.example/?a=100%", {"b": "1"}), ("http://a.example/?a=1&a=2", {"a": "9"}),
                                (None, {"a": "1"}), ("http://a.example/x", None)], "u string, p map<string,string>")
    assert [r[0] for r in df.select(with_params("u", "p")).collect()] == [
        "http://a.example/?a=100%25&b=1", "http://a.example/?a=9", None, "http://a.example/x"]
