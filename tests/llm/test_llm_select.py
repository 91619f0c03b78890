"""Sharding and importance resampling."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagesift.llm import shard_packing as S
from pagesift.llm import target_resample as T

SF, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def words(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def features(t):
    w = words(t)
    return [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute_resample(rows, target, percent=25):
    s, t = collections.Counter(), collections.Counter()
    found = [features(x) for _, x in rows]
    for f in found:
        s.update(f)
    for x in target:
        t.update(features(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000) / ((s[b] + 1.0) * (big_t + 10_000)))) for b in s}
    out = []
    for (i, x), f in zip(rows, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    k = percent * len(order) // 100
    ranks = {id(r): n + 1 for n, r in enumerate(order[:k])}
    return [(*r, ranks.get(id(r))) for r in out]


def same(got, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_crc_of_pairs():
    rng = random.Random(2)
    made = T.Features(10_000)
    for _ in range(300):
        t = " ".join("".join(rng.choices("abcZ09é中", k=rng.choice([1, 2, 5, 31, 32, 33, 90]))) for _ in range(rng.randint(0, 12)))
        got, n = made.of(t.encode())
        assert got.tolist() == features(t) and n == len(words(t))


def test_resampling(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    target = pd.read_parquet(f"{SF}/benchmark.parquet").text.tolist()
    rows = list(docs[["doc_id", "text"]].itertuples(index=False, name=None))
    same(T.resample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect(), brute_resample(rows, target))


@pytest.mark.parametrize("percent,epsilon", [(25, 0.005), (50, 1e-9), (100, 0.2), (0, 0.1), (1, 0.3)])
def test_odd_rows(spark, odd, percent, epsilon):
    """Nulls, ties and repeated rows, more of them than are drawn."""
    many = odd.select("doc_id", "text").unionByName(spark.range(60).selectExpr(
        "CASE WHEN id < 40 THEN id % 7 END AS doc_id", "repeat('same words here ', 8) AS text"))
    many = many.selectExpr("*", "1 AS score", "2 AS rank", "3 AS weight", "4 AS `dotted.n`")
    target = spark.createDataFrame([("same words",), (None,)], "text string")
    want = brute_resample([(r.doc_id, r.text) for r in many.collect()], ["same words", None], percent)
    same(T.resample(many, target, percent=percent, epsilon=epsilon).collect(), want)
    same(T.resample(many, target.where("false"), percent=percent).collect(), brute_resample([(r.doc_id, r.text) for r in many.collect()], [], percent))


def test_resampling_nothing(spark, none):
    assert T.resample(none, none).collect() == []


def test_resampling_twin(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = T.op12_target_resample(spark, SF)
    want = con.execute(T.OP12_SQL)
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    same(got.collect(), [tuple(r[i] for i in at) for r in want.fetchall()])


def shard_rules(rows, n_shards, split=True):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n_shards))
    for mine in by.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    return by


def spread(rows, n_shards):
    """(most - least) over the mean for bytes, tokens and rows."""
    out = []
    for what in (lambda r: r.size, lambda r: r.tokens, lambda r: 1):
        load = [0] * n_shards
        for r in rows:
            load[r.shard] += what(r)
        out.append((max(load) - min(load)) / (sum(load) / n_shards))
    return out


def test_query_is_even(spark):
    rows = S.op11_shard_packing(spark, SF_MID).collect()
    docs = pd.read_parquet(f"{SF_MID}/documents.parquet")
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(docs.doc_id, docs.text))
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    shard_rules(rows, 16)
    assert spread(rows, 16)[0] < 0.01 and max(spread(rows, 16)) < 0.1
    place = collections.defaultdict(set)
    for r in rows:
        place[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in place.values())


def test_greedy_rule(spark):
    """All groups heavy: the same as one plain loop over groups by falling share."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    groups = collections.Counter(t or "" for t in docs.text)
    total = np.array([sum(f(t) * c for t, c in groups.items()) for f in (lambda t: len(t.encode()) + 1, lambda t: len(t.encode().split()), lambda t: 1)], float)
    left, where = [[1.0] * 3 for _ in range(4)], {}
    import xxhash
    vec = {t: [len(t.encode()) * c + c, len(t.encode().split()) * c, c] for t, c in groups.items()}
    vec = {t: [x / (y / 4) for x, y in zip(v, total)] for t, v in vec.items()}
    hashed = lambda t: np.array(divmod(xxhash.xxh3_128_intdigest(t.encode()), 1 << 64), np.uint64).view(np.int64).tolist()
    for t in sorted(groups, key=lambda t: (-max(vec[t]), -sum(vec[t]), hashed(t))):
        dots = [sum(a * b * w for a, b, w in zip(row, vec[t], (64, 1, 1))) for row in left]
        j = max(range(4), key=lambda j: (round(dots[j], 12), -j))
        left[j] = [a - b for a, b in zip(left[j], vec[t])]
        where[t] = j
    got = S.pack(spark.read.parquet(f"{SF}/documents.parquet"), 4, keep=("doc_id", "text"), heavy_share=1000, split_share=9).collect()
    assert all(where[r.text or ""] == r.shard for r in got)


@pytest.mark.parametrize("partition_rows,heavy_share", [(1 << 18, 256), (500, 8), (200, 32)])
def test_hot_group(spark, partition_rows, heavy_share):
    """A third of all rows are copies of one text: split, everything even, light groups together."""
    docs = spark.range(9000).selectExpr("CASE WHEN id % 5 > 0 THEN id END AS doc_id",
                                        "CASE WHEN id % 3 = 0 THEN 'a copy of one text' WHEN id % 50 = 1 THEN NULL ELSE repeat(concat('w', id % 2000, ' '), cast(id % 97 as int)) END AS text",
                                        "1 AS shard", "2 AS _hash", "3 AS `dotted.x`", "4 AS _piece").repartition(5)
    rows = S.pack(docs, 16, keep=("doc_id", "text", "_hash", "dotted.x", "shard"), heavy_share=heavy_share, partition_rows=partition_rows).collect()
    shard_rules(rows, 16)
    assert spread(rows, 16)[0] < 0.05 and max(spread(rows, 16)) < 0.2
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r.text or ""].add(r.shard)
    assert len(by_text["a copy of one text"]) > 5
    assert all(len(s) == 1 for t, s in by_text.items() if t not in ("a copy of one text", ""))  # both hold over a quarter of a shard
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in docs.collect())


def test_shard_odd_rows(spark, odd, none, tmp_dir):
    rows = S.pack(odd).collect()
    shard_rules(rows, 16)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in rows) == sorted(
        (r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()) + 1) for r in odd.collect())
    assert S.pack(none).collect() == []
    path = f"{tmp_dir}/shards"
    S.write_shards(odd.drop("dotted.name"), path, 3)
    back = spark.read.parquet(path)
    assert back.count() == 13 and back.agg(F.max("shard")).first()[0] == 2
