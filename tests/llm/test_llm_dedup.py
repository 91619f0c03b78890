"""Suffix arrays, substring dedup, SimHash groups and fingerprints against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from llm_brute import bits_of, classes
from pagesift.llm import rare_digest as R
from pagesift.llm import simhash_gph as G
from pagesift.llm import suffix_dedup as S
from pagesift.llm.suffix_groups import suffix_array

SF = "/root/testdata/sf0.001"


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(1500):
        x = [rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 40))]
        x = x * 2 + x[:3] if rng.random() < 0.3 else x
        assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def removed(texts, length=400):
    """Per text: bytes, removed bytes, runs, digest of the rest."""
    hashes = [[xxhash.xxh3_128_intdigest(t[i:i + length]) for i in range(len(t) - length + 1)] for t in texts]
    seen, out = collections.Counter(h for hs in hashes for h in hs), []
    for t, hs in zip(texts, hashes):
        covered = np.zeros(len(t), bool)
        for i, h in enumerate(hs):
            if seen[h] > 1:
                covered[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(t), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choice("abcd \n") for _ in range(n))

    p, q, texts = noise(900), noise(405), []
    for _ in range(50):
        k = rng.random()
        if k < .3:
            texts.append(noise(rng.randint(0, 600)) + p[rng.randint(0, 300):rng.randint(500, 900)] + noise(rng.randint(0, 300)))
        elif k < .5:
            texts.append(noise(50) + q[rng.randint(0, 8):405 - rng.randint(0, 8)] + noise(50) + q[rng.randint(0, 4):])
        elif k < .6:
            texts.append("a" * rng.randint(380, 1200))
        elif k < .7:
            texts.append("ab" * rng.randint(180, 700) + noise(10))
        elif k < .8:
            at = rng.randrange(len(p))
            texts.append(p[:at] + "Z" + p[at + 1:])
        else:
            texts.append(rng.choice(texts) if texts else None)
    return texts + [None, "", "x" * 399, "x" * 400, "é" * 700]


@pytest.mark.parametrize("group", [4096, 3])  # 3: most groups take the way of very large ones
def test_substring_dedup(spark, repeats, group, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 8_000)
    monkeypatch.setattr(S, "BUCKET_UNITS", 40)
    monkeypatch.setattr(S, "GROUP", group)
    texts = repeats + pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(S.remove_repeats(df)).collect()}
    assert [got[i] for i in range(len(texts))] == removed([(t or "").encode() for t in texts])


def test_substring_dedup_odd_rows(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(rows, removed([(r.text or "").encode() for r in rows])))
    assert collections.Counter(map(tuple, S.digest(S.remove_repeats(odd)).collect())) == want
    assert S.remove_repeats(none).collect() == []


def test_simhash_groups(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(pd.read_parquet(f"{SF}/documents.parquet").text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [bits_of(t) for _, t in rows]
    want, roots = classes(fps, [i for i, _ in rows])
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in G.near_duplicates(df).collect())
    assert got == collections.Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, want))
    kept = G.keep_one(df.withColumn("_fp", df.doc_id)).collect()
    assert len(kept) == len(set(roots))
    assert {r.doc_id for r in kept if r.doc_id is not None} == {c for c in want if c is not None}


def test_simhash_odd_columns(spark, odd, none):
    assert G.near_duplicates(odd).count() == odd.count()
    assert G.near_duplicates(none).collect() == []


@pytest.mark.parametrize("bucket", [4096, 8])  # 8: buckets are split
def test_links_of_a_cluster(spark, bucket, monkeypatch):
    """A chain and a ball of close fingerprints: one component each, no pair table."""
    monkeypatch.setattr(G, "BUCKET_ROWS", bucket)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} | {rng.getrandbits(64) for _ in range(300)}
    chain = rng.getrandbits(64)
    for k in range(15):
        fps.add(chain)
        for b in rng.sample(range(64), 3):
            chain ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in G.links(df, 3).collect()]
    place = {f: i for i, f in enumerate(fps)}
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(place[a])] = find(place[b])
    _, want = classes(fps, list(range(len(fps))))
    assert collections.Counter(collections.Counter(find(i) for i in range(len(fps))).values()) == collections.Counter(collections.Counter(want).values())
    roots = {r.node: r.root for r in G.components(G.links(df, 3)).collect()}
    assert len(set(roots.values())) == sum(1 for n in collections.Counter(want).values() if n > 1)


def test_allocate_is_the_best_allocation():
    import itertools
    rng = random.Random(3)
    for _ in range(50):
        m = rng.randint(1, 4)
        cost = [[rng.random() * 10 ** t for t in range(3)] for _ in range(m)]
        total = 3 - m + 1
        options = [(sum(c[t] for c, t in zip(cost, ts) if t >= 0), ts) for ts in itertools.product(range(-1, 3), repeat=m) if sum(ts) == total]
        if options:
            assert abs(G.allocate(cost, total)[0] - min(options)[0]) < 1e-9


def features(t):
    if len(t) < 64:
        return []
    rank = R._rank(np.array([sum(int(R._F[c]) for c in collections.Counter(t[i:i + 64]).values()) for i in range(len(t) - 63)]))
    if len(t) < 128:
        return [int(np.argmin(rank))]
    points = collections.Counter(min(range(i, i + 64), key=lambda j: (rank[j], j)) for i in range(len(rank) - 63))
    return [i for i in range(len(rank)) if points[i] >= R.POINTS and rank[i] < R.NEVER]


def test_features_equal_brute_force():
    texts = [t.encode() for t in pd.read_parquet(f"{SF}/documents.parquet").text[:8]]
    texts += [b"a" * 300, b"ab" * 100, b"x" * 64, b"hello", b"", b"q" * 127 + b"abc" * 30]
    assert [list(f) for f in R.features(texts)] == [features(t) for t in texts]


def expected(rows):
    """From sorted (id, text) rows."""
    out = []
    for i, (doc, s) in enumerate(rows):
        follows = rows[(i + 1) % len(rows)][1]
        k = len(s) // 4
        new = s[:len(s) - k] + follows[:k]
        a, b, c = (R.Chain(R._hashes(x.encode(), R.features([x.encode()])[0])) for x in (s, new, follows))
        out.append((doc, len(s), hashlib.sha256(new.encode()).hexdigest(), a.text(), b.text(), R.likeness(a, b), R.likeness(a, c)))
    return out


def test_fingerprints_of_documents(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    got = sorted(map(tuple, R.fingerprint_edits(spark.read.parquet(f"{SF}/documents.parquet").repartition(5)).collect()))
    assert got == expected(list(zip(d.doc_id.tolist(), d.text.tolist())))
    assert sum(r[5] for r in got) / len(got) > 0.5 > 0.05 > sum(r[6] for r in got) / len(got)


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = R.fingerprint_edits(odd).collect()
    assert len(got) == odd.count()
    assert {r.fingerprint for r in got if not r.n_chars} == {"0:0:"}
    by = collections.defaultdict(set)
    for r in R.fingerprint(odd, keep=("text",)).collect():
        by[r.text or ""].add(r.fingerprint)
    assert all(len(f) == 1 for f in by.values()) and len(set(map(tuple, by.values()))) == len(by)
    assert R.fingerprint_edits(none).collect() == []
    assert R.fingerprint_edits(odd.where("doc_id = 5")).first().near_next == 1.0


def test_short_texts_keep_likeness_when_edited():
    prose = [t for t in pd.read_parquet(f"{SF}/documents.parquet").text if len(t) > 600 and len(set(t.split())) > 60][:20]
    assert len(prose) == 20
    near, other = collections.defaultdict(list), []
    for n in [*range(64, 200, 6), *range(200, 401, 40)]:
        for a, b in zip(prose, prose[1:]):
            cut = a.encode()[:n].decode(errors="ignore")
            _, _, _, _, edited, follows = R.compare_neighbours([cut, b[100:100 + n]])[0]
            near[n].append(edited)
            other.append(follows)
    for n, found in near.items():
        if n < 85:  # no 64 bytes are left together
            assert max(found) == 0
        elif n >= 142:
            assert min(found) > 0 and sum(0 < x < 1 for x in found) > len(found) / 2 and sum(found) / len(found) > 0.3
        elif n >= 128:
            assert sum(x > 0 for x in found) > 0.8 * len(found)
    assert sum(other) / len(other) < 0.02


def test_text_without_a_feature_selects_the_rarest():
    text = b"abcdefg " * 80
    assert not len(R.features([text])[0])
    hashes = R._hashes(text, [])
    assert hashes and hashlib.sha1(text).digest() not in hashes
    assert R._hashes(b"a" * 300, []) == [hashlib.sha1(b"a" * 300).digest()]


def test_chain_text_round_trip():
    chain = R.Chain([hashlib.sha1(bytes([i % 256, i // 256])).digest() for i in range(400)])
    back = R.Chain.read(chain.text())
    assert back.text() == chain.text() and R.likeness(chain, back) == 1.0 and list(back.counts) == [160, 160, 80]
