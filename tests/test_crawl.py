"""Sitemap parsing and keyword filter: golden cases."""

from pyspark.sql import functions as F

from pagesift.operators import crawl as C

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def _links(spark, docs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "d int, xml string")
    rows = C.links(df, "xml", "url", ["d"]).orderBy("d", "pos").collect()
    return [(r.d, r.loc) for r in rows]


def test_sitemap_parsing_cases(spark):
    docs = [
        f"<urlset {NS}><url><loc>https://a.example/x?p=1&amp;q=2</loc></url></urlset>",
        f"<urlset {NS}><url><loc>  https://a.example/trim  </loc></url></urlset>",
        f"<urlset {NS}><url/><url><loc>https://a.example/kept</loc></url></urlset>",
        f"<urlset {NS}><url><loc>https://a.example/broken</loc></url",
        "",
        f'<urlset {NS} xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"><url><loc>https://a.example/p</loc>'
        f"<image:image><image:loc>https://a.example/img.jpg</image:loc></image:image></url></urlset>",
        f"<urlset {NS}><url><loc><![CDATA[https://a.example/cdata]]></loc></url></urlset>",
        f"<urlset {NS}><url><loc>https://a.example/single</loc></url></urlset>",
    ]
    got = _links(spark, docs)
    assert got == [(0, "https://a.example/x?p=1&q=2"), (1, "https://a.example/trim"),
                   (2, "https://a.example/kept"), (5, "https://a.example/p"),
                   (6, "https://a.example/cdata"), (7, "https://a.example/single")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "d int, xml string")
    rejected = sorted((r.d, r.reason, r.n_entries, r.n_without_loc) for r in C.parse_rejects(df, "xml", "url", ["d"]).collect())
    assert rejected == [(2, "without_loc", 2, 1), (3, "malformed", 0, 0), (4, "malformed", 0, 0)]


def test_link_tag_is_a_parameter(spark):
    df = spark.createDataFrame([(0, f"<urlset {NS}><url><href>https://a.example/x</href></url></urlset>")], "d int, xml string")
    assert [r.loc for r in C.links(df, "xml", "url", ["d"], "href").collect()] == ["https://a.example/x"]


def test_keyword_filter(spark):
    df = spark.createDataFrame([("https://s/post-sitemap.xml",), ("https://s/category-sitemap.xml",)], "loc string")

    def kept(keywords):
        kw = F.array(*[F.lit(k) for k in keywords]).cast("array<string>")
        return [r.loc for r in df.where(C.keyword_match("loc", kw)).collect()]

    assert kept([""]) == ["https://s/post-sitemap.xml", "https://s/category-sitemap.xml"]
    assert kept([]) == []
    assert kept(["/post", "sitemap"]) == ["https://s/post-sitemap.xml", "https://s/category-sitemap.xml"]


def test_crawl_end_to_end(spark):
    idx = spark.createDataFrame([("s", "https://s/index.xml",
                                  f"<sitemapindex {NS}><sitemap><loc>https://s/post-sitemap.xml</loc></sitemap>"
                                  f"<sitemap><loc>https://s/tag-sitemap.xml</loc></sitemap></sitemapindex>")],
                                "site string, index_url string, xml string")
    sm = spark.createDataFrame([
        ("https://s/post-sitemap.xml", f"<urlset {NS}><url><loc>https://s/a</loc></url><url><loc>https://s/a</loc></url></urlset>"),
        ("https://s/tag-sitemap.xml", f"<urlset {NS}><url><loc>https://s/t</loc></url></urlset>")],
        "doc_url string, xml string")
    cfg = idx.select("index_url", F.array(F.lit("/post-sitemap")).alias("keywords"))
    rows = C.crawl(cfg, idx, sm).orderBy("link_pos").collect()
    assert [r.url for r in rows] == ["https://s/a", "https://s/a"]  # duplicates kept
    stats = {(r.site, r.sitemap): r.n_links for r in C.crawl_stats(C.crawl(cfg, idx, sm)).collect()}
    assert stats[(None, None)] == 2 and stats[("s", None)] == 2


def test_sitemap_files_reader(spark, tmp_dir):
    import os
    from pagesift.sources import sitemaps as SM
    docs = spark.createDataFrame([
        ("a", f"<urlset {NS}><url><loc>https://a/1?x=1&amp;y=2</loc></url><url/><url><loc>https://a/2</loc></url></urlset>"),
        ("b", f"<urlset {NS}><url><loc>https://b/1</loc></url></urlset>"),
    ], "doc_url string, xml string")
    path = os.path.join(tmp_dir, "sm")
    SM.write_sitemap_files(docs, path)
    got = sorted((r.doc_url, r.loc) for r in SM.read_sitemap_files(spark, path).collect())
    assert got == [("a", "https://a/1?x=1&y=2"), ("a", "https://a/2"), ("b", "https://b/1")]
