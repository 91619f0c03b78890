"""Decontamination, personal data and the quality classifier."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from llm_brute import BASE, base_spans, judged, lower, words
from pagesift.llm import pii as P
from pagesift.llm import quality_rff as Q
from pagesift.llm import wu_manber as W

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("block_bytes", [W.BLOCK_BYTES, 1500])  # 1500: several passes, merged
def test_decontamination(spark, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0 OR text LIKE '%a%'")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    short = spark.createDataFrame([(900, "the"), (901, "of the"), (902, ""), (903, None), (None, "and the in"), (901, "of the")], "item_id long, text string")
    bench = bench.unionByName(short)
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], judged([r.text for r in rows], [tuple(r) for r in bench.collect()])))
    got = {r[0]: tuple(r)[1:] for r in W.decontaminate(docs, bench, block_bytes=block_bytes)
           .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == want and sum(w[4] for w in want.values()) > 10


@pytest.mark.parametrize("block_bytes", [W.BLOCK_BYTES, 10])
def test_decontamination_odd_rows(spark, odd, none, block_bytes):
    bench = spark.createDataFrame([(1, "two words"), (2, "a"), (3, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string")
    rows = odd.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(rows, judged([r.text for r in rows], [tuple(b) for b in bench.collect()])))
    found = W.decontaminate(odd, bench, keep=tuple(c for c in odd.columns if "." not in c), block_bytes=block_bytes)
    got = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert W.decontaminate(none, bench).collect() == []
    assert not any(r.contaminated for r in W.decontaminate(odd, bench.where("false")).collect())


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(W, "PIECE_WORDS", 20)
    long = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 13))) for i in range(188)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    assert W.decontaminate(docs, bench).where("n_hit = 13").count() == 188


def test_base_spans(spark):
    rng = random.Random(3)
    bits = ["a", "@", ".", "b.c", "1", "22", "255", "+", "-", " ", "(", ")", "é", "\U0001f600", "_", "%", "4111111111111111",
            "4111 1111 1111 1111", "+1 (988) 555-2485", "", "", "256", "\n", "x@y.z", "1.2.3.4", "00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(2500)]
    texts += pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    texts += ["+1 " * 2000 + "9" * 5000 + "a." * 20000 + "x@y.z " * 3000, "1" * 20000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in P.digest(P.find_personal_data(df)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w[3] == k for w in want) for k, _ in BASE]


def test_added_spans_checks_and_context(spark):
    rows = [("IBAN DE89 3704 0044 0532 0130 00 end", ["iban"]), ("IBAN DE89 3704 0044 0532 0130 01 end", []),
            ("ssn 123-45-6789", ["national_id"]), ("part 123-45-6789", []), ("ssn 666-45-6789", []),
            ("call 555-123-4567", ["local_phone"]), ("code 555-123-4567", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.pii_spans if not s.base] for r in P.find_personal_data(df).collect()}
    assert [got[i] for i in range(len(rows))] == [k for _, k in rows]
    score = P.find_personal_data(spark.createDataFrame([(1, "x a@b.co"), (2, "mail a@b.co")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert score[0].pii_spans[0].score < score[1].pii_spans[0].score


def test_context_on_both_sides_and_over_other_matches(spark):
    far = "x" + " y" * 24  # 49 code points
    rows = [("call 555-123-4567 or 555-987-6543", 2), ("ssn: 123-45-6789, 123-45-6788\n123-45-6787", 3),
            ("ssn 000-45-6789, 123-45-6789", 1), ("123-45-6789 is the ssn", 1), ("555-123-4567 or 555-987-6543 (mobile)", 2),
            (f"ssn {far} 123-45-6789 {far} ssn", 0), ("ssn" + "." * 45 + "123-45-6789", 1),
            ("ssn" + "." * 46 + "123-45-6789", 0), ("recall" + "." * 44 + "555-123-4567", 0), ("123-45-6789" + "." * 45 + "ssn", 1),
            ("123-45-6789" + "." * 46 + "ssn", 0), ("phone \U0001f600 555-123-4567, " + "555-123-4567, " * 9, 3)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: sum(not s.base for s in r.pii_spans) for r in P.find_personal_data(df).collect()}
    assert [got[i] for i in range(len(rows))] == [n for _, n in rows]
    assert P.redact(df).where("doc_id = 0").first().text == "call [LOCAL_PHONE] or [LOCAL_PHONE]"


def iban(country, bban):
    rest = int("".join(str(int(c, 36)) for c in bban + country + "00")) % 97
    return f"{country}{98 - rest:02d}{bban}"


def test_ibans_before_capitals_and_digits(spark):
    rows = [("{} QAR 5", "QA58DOHB00001234567890ABCDEFG"), ("{} PS 1", "PS92PALS000000000400123456702"), ("IBAN {} BIC COBADEFF", "DE89370400440532013000"), ("{} EUR 100", "DE89 3704 0044 0532 0130 00"), ("A {} 12 B", "GB82 WEST 1234 5698 7654 32"),
            ("{} {} X", "NL91ABNA0417164300"), ("{}\n2024", "NO9386011117947"), ("{} SWIFT ABC", "MT84MALT011000012345MTLCAST001S")]
    tails = ("{} BIC COBADEFF", "{} EUR 100", "to {} 7")
    rows += [(tail, iban(c, ("ABCD" + "123456789" * 4)[:n - 4])) for lengths in (P.IBAN_LENGTHS, P.OTHER_LENGTHS)
             for n, codes in lengths.items() for c in codes.split() for tail in tails]
    texts = [t.replace("{}", x) for t, x in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.pii_spans if s.kind == "iban"] for r in P.find_personal_data(df).collect()}
    assert len(rows) > 300
    assert [got[i] for i in range(len(rows))] == [[x] * t.count("{}") for t, x in rows]
    assert P.redact(df).where("doc_id = 2").first().text == "IBAN [IBAN] BIC COBADEFF"


def test_redaction_and_odd_rows(spark, odd, none):
    df = spark.createDataFrame([(1, "é a@b.co, 10.0.0.1!"), (2, None), (3, ""), (4, "4111 1111 1111 1111"), (5, "clean")], "doc_id long, text string")
    assert [r.text for r in P.redact(df).orderBy("doc_id").collect()] == ["é [EMAIL], [IP]!", None, "", "[CARD]", "clean"]
    plain = [c for c in odd.columns if "." not in c]
    assert sorted(map(str, P.redact(odd.select(plain)).collect())) == sorted(map(str, odd.select(plain).collect()))
    assert P.digest(P.find_personal_data(odd)).count() == odd.count()
    assert P.find_personal_data(none).collect() == []


def test_luhn_and_mod97(spark):
    df = spark.createDataFrame([("79927398713", "GB82 WEST 1234 5698 7654 32"), ("79927398710", "GB82 WEST 1234 5698 7654 33")], "d string, i string")
    assert [tuple(r) for r in df.select(P.luhn(F.col("d")), P.mod97(F.col("i"))).collect()] == [(True, True), (False, False)]


def test_personal_data_runs_without_python(spark):
    plan = P.digest(P.find_personal_data(spark.read.parquet(f"{SF}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_on_held_out_labels(spark):
    scored = Q.op7_quality_rff(spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    j = scored[scored.held_out].merge(labels, on="doc_id")
    good, bad = j[j.quality == 1].score.to_numpy(), j[j.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    assert len(bad) > 5 and auc > 0.98 and (j.predicted == j.quality).mean() > 0.97
    assert scored.score.between(0, 1).all() and len(scored) == 1000
    kept = Q.keep_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(scored[scored.predicted == 1].doc_id)


def test_quality_does_not_see_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(Q.score_quality(docs, x).select("doc_id", "score").collect()) for x in (labels, other))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (5, 1), (6, None), (7, 0), (99, 1)], "doc_id long, quality int")
    got = Q.score_quality(odd, labels, keep=("doc_id", "text", "score")).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in Q.score_quality(odd, labels.where("false")).collect()} == {0.5}
    assert Q.score_quality(none, labels).collect() == []


def test_kernel_and_calibration():
    rng = np.random.default_rng(0)
    m = Q.Model(np.zeros(Q.N_STATS), np.ones(Q.N_STATS), features=20_000)
    x = rng.normal(0, 0.5, (5, Q.N_STATS))
    phi = m.phi(x)[:, :-1]
    want = np.exp(-Q.GAMMA * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(phi @ phi.T - want).max() < 0.04
    xs, ys = Q.pool_adjacent(np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0]), np.ones(6))
    assert list(ys) == [0, 1 / 3, 1] and list(xs) == [0, 2, 4.5] or (np.diff(ys) > 0).all()


def test_fit_equals_a_direct_ridge_solution(spark):
    """The partition-summed normal equations against least squares over stacked rows, the calibration against a plain isotonic fit."""
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    rows = docs.merge(labels, on="doc_id")
    stats, y = np.array([Q.statistics((t or "").encode()) for t in rows.text]), rows.quality.to_numpy(float)
    df = spark.createDataFrame([(bytearray(s.tobytes()), float(v)) for s, v in zip(stats, y)], "_stats binary, _y double").repartition(7)
    model = Q.fit(df)
    spread = stats.std(0)
    assert np.allclose(model.mean, stats.mean(0)) and np.allclose(model.scale, np.where(spread > 1e-9, spread, 1), atol=1e-6)
    phi = model.phi(stats)
    shrink = np.sqrt(np.append(np.full(model.features, Q.RIDGE * len(y)), 0) + 1e-9)  # ridge as extra rows
    direct = np.linalg.lstsq(np.vstack([phi, np.diag(shrink)]), np.append(y, np.zeros(len(shrink))), rcond=None)[0]
    assert np.allclose(phi @ model.coef, phi @ direct, atol=1e-6)
    # Isotonic by definition: at each cell the largest over starts of the smallest over ends of the block means.
    raw = phi @ model.coef
    cell = np.clip((raw + 0.5) / 2 * Q.GRID, 0, Q.GRID - 1).astype(int)
    cells = np.unique(cell)
    w, m = (np.array([f(cell == c) for c in cells]) for f in (np.sum, lambda at: y[at].mean()))
    cw, cm = np.append(0, np.cumsum(w)), np.append(0, np.cumsum(w * m))
    iso = [max(min((cm[e] - cm[s]) / (cw[e] - cw[s]) for e in range(i + 1, len(cells) + 1)) for s in range(i + 1)) for i in range(len(cells))]
    blocks = np.array([raw[cell == c].mean() for c in cells])
    levels, at = np.unique(np.round(iso, 9), return_inverse=True)
    centres = [np.average(blocks[at == k], weights=w[at == k]) for k in range(len(levels))]
    assert np.allclose(model.score(stats), np.clip(np.interp(raw, centres, levels), 0, 1), atol=1e-6)
