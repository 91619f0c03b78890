"""URL list slice, sink and scan."""

import os

import pytest
from pyspark.sql import functions as F

from pagesift.sources import urls as U

LIST = ["u0", "u1", "u2", "u3", "", "u4"]


@pytest.fixture()
def positioned(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(LIST)], "seq long, url string")
    return U.with_positions(df, ["seq"])


@pytest.mark.parametrize("offset,nb,want", [
    (-1, -1, ["u0", "u1", "u2", "u3"]),
    (0, -1, ["u0", "u1", "u2", "u3"]),
    (-1, 2, ["u0", "u1"]),
    (1, 2, ["u1", "u2"]),
    (3, 5, ["u3"]),
    (9, 1, []),
])
def test_slice_golden(positioned, offset, nb, want):
    got = [r.url for r in U.url_slice(positioned, offset, nb).orderBy("pos").collect()]
    assert got == want


@pytest.mark.parametrize("offset,nb", [(0, 0), (-2, 1), (0, -2)])
def test_slice_rejects_bad_arguments(positioned, offset, nb):
    with pytest.raises(ValueError):
        U.url_slice(positioned, offset, nb)


def test_slice_equals_list_slicing(spark):
    urls = [f"https://h/{i}" for i in range(57)]
    df = spark.createDataFrame([(i * 3, u) for i, u in enumerate(urls)], "seq long, url string").repartition(5)
    pos = U.with_positions(df, ["seq"])
    for off, nb in [(0, 10), (13, 7), (50, 20), (5, -1)]:
        got = [r.url for r in U.url_slice(pos, off, nb).orderBy("pos").collect()]
        assert got == (urls[off:] if nb == -1 else urls[off:off + nb])


def test_csv_roundtrip_keeps_quotes_commas_and_blanks(spark, tmp_dir):
    urls = ['https://h/a,b', 'https://h/"q"', " https://h/lead", "https://h/trail  "]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    path = os.path.join(tmp_dir, "list")
    U.write_url_list(df, path)
    U.write_url_list(df.limit(1), path, mode="append")
    back = sorted(r.url for r in U.read_url_list(spark, path).collect())
    assert back == sorted(urls + urls[:1])
    stripped = sorted(r.url for r in U.strip_trailing(U.read_url_list(spark, path)).collect())
    assert "https://h/trail" in stripped and " https://h/lead" in stripped


def test_read_order_is_file_order(spark, tmp_dir):
    urls = [f"https://h/{i:04d}" for i in range(300)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "seq long, url string")
    path = os.path.join(tmp_dir, "ordered")
    U.write_url_list(df.orderBy("seq").coalesce(1), path)
    back = U.read_url_list(spark, path, with_order=True)
    pos = U.with_positions(back, U.ORDER)
    assert [r.url for r in pos.orderBy("pos").collect()] == urls


def test_append_order_and_blank_lines(spark, tmp_dir):
    path = os.path.join(tmp_dir, "lists")
    first = [f"b{i}" for i in range(40)] + ["", "after"]
    second = ["a,0", 'a"1', "a2"]
    for mode, urls in (("overwrite", first), ("append", second), ("append", ["z"])):
        df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "seq long, url string").repartition(4)
        U.write_url_list(df, path, mode=mode, order="seq")
    pos = U.with_positions(U.read_url_list(spark, path, with_order=True), U.ORDER)
    assert [r.url for r in pos.orderBy("pos").collect()] == first + second + ["z"]
    assert [r.url for r in U.url_slice(pos, 35, 20).orderBy("pos").collect()] == first[35:40]
