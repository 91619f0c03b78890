"""Chat round trip, Katz scores and the pipeline."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from pagesift.llm import chat as C
from pagesift.llm import katz as K

SF = "/root/testdata/sf0.001"


def test_render_round_trip():
    rng = random.Random(1)
    bits = ["<", "|", "\\", "im_start", "im_end", "|>", "<|im_start|>", "<|im_end|>", "\n", "a", "%", "%0A", "<|", "%25", "<\\|"]
    for _ in range(20_000):
        role, text = "".join(rng.choices(bits, k=rng.randint(0, 4))), "".join(rng.choices(bits, k=rng.randint(0, 8)))
        assert C.parse(C.render(role, text) * 2) == [(role, text)] * 2
    assert C.render("user", "plain") == "<|im_start|>user\nplain<|im_end|>\n"
    parser, out = C.Parser(), C.render("a", "x<|im_end|>") + C.render("b", "y")
    assert [t for c in out for t in parser.feed(c)] == [("a", "x<|im_end|>"), ("b", "y")]


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user\n", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\na<|im_start|>b<|im_end|>\n"])
def test_grammar_errors(bad):
    with pytest.raises(ValueError):
        C.parse(bad)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi <|im_end|>"), (1, 0, "user", None), (1, 2, None, "<\\|"), (1, 0, "user", "again"), (None, 0, "assistant", "é\U0001f600"),
            (2, 5, "assistant", "a"), (2, 6, "assistant", "b"), (2, 6, "assistant", "b"), (3, 0, "us\ner", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in C.read_back(C.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], C.render(r[2] or "", r[3] or ""), r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(loss),
                hashlib.sha256(loss.encode()).hexdigest(), sum(len(t[1]) for t in turns))
        assert tuple(got[conv])[1:] == want
    assert C.read_back(C.format_turns(df.where("false"))).collect() == []


def katz(rows, order):
    """The recursion of the definition, over plain dictionaries."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    texts = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    count = [None] + [collections.Counter() for _ in range(order)]
    context = [None] + [collections.Counter() for _ in range(order)]
    for h, t in zip(held, texts):
        p = [b"\t"] * (order - 1) + t
        for i in range(order - 1, len(p)):
            for o in range(1, order + 1 if not h else 1):
                count[o][tuple(p[i - o + 1:i + 1])] += 1
                context[o][tuple(p[i - o + 1:i])] += 1
    after = [None] + [collections.defaultdict(list) for _ in range(order)]
    for o in range(1, order + 1):
        for g in count[o]:
            after[o][g[:-1]].append(g)
    stats = {o: [sum(v == c for v in count[o].values()) for c in range(1, K.K + 2)] + [len(count[o]), sum(count[o].values())] for o in range(1, order + 1)}
    model = K.Model(stats, sum(not h for h in held), order)
    alphas = {}

    def alpha(h):
        if h not in alphas:
            gs = after[len(h) + 1][h]
            alphas[h] = (1 - sum(prob(g) for g in gs)) / (1 - sum(prob(g[1:]) for g in gs))
        return alphas[h]

    def prob(g):
        o, c = len(g), count[len(g)].get(g, 0)
        if o == 1:
            return float(model.unigram(np.array([c]))[0])
        if c:
            return float(model.discounts[o].of(np.array([c]))[0]) / context[o][g[:-1]]
        return (alpha(g[:-1]) if context[o].get(g[:-1]) else 1.0) * prob(g[1:])

    for h in list(context[order])[:10]:  # all words and the unknown one sum to one
        assert abs(sum(prob(h + w) for w in count[1]) + prob(h + (b"never seen",)) - 1) < 1e-9
    n, v = stats[1][-1], stats[1][-2]
    out = []
    for h, t in zip(held, texts):
        p = [b"\t"] * (order - 1) + t
        known = [count[1].get((w,), 0) for w in t]
        out.append((h, len(t), sum(c > 0 for c in known), n, sum(math.log10((c + 1) / (n + v + 1)) for c in known),
                    sum(math.log10(prob(tuple(p[i - order + 1:i + 1]))) for i in range(order - 1, len(p)))))
    return out


def same(got, want):
    got, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[2:5], round(r[5], 3))) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, order, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(K, "BUCKET_KEYS", 900)
    d = pd.read_parquet(f"{SF}/documents.parquet")[:80]
    rows = list(zip(d.doc_id.tolist(), d.text.tolist()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same([tuple(r) for r in K.score_texts(df, order).collect()], [(i, *w) for (i, _), w in zip(rows, katz(rows, order))])


def test_katz_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same([tuple(r) for r in K.score_texts(odd).collect()], [(i, *w) for (i, _), w in zip(rows, katz(rows, 2))])
    assert K.score_texts(none).collect() == []
    held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.score) for r in K.score_texts(held).collect()} == {(0, 0, 0.0)}


def test_packing():
    a = np.array([0, 1, 70_000, 2 ** 32 - 1], np.uint32)
    assert K._unpack(K._pack(a), np.uint32).tolist() == a.tolist()
    assert K._unpack(K._pack(a[:0]), np.uint32).tolist() == []


def test_pipeline_stages(spark):
    """Each stage against its operator's checked results on its own input."""
    import corpus_pipeline as pipe
    import public_tokenizers
    import sentencepiece
    from llm_brute import base_spans, bits_of, classes, judged

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipe.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "personal_data", "encoding"]
    steps = [docs.toPandas()]
    for k, (_, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        steps.append(docs.toPandas())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    held = labels[[zlib.crc32(str(i).encode()) % 3 == 1 for i in labels.doc_id]]
    kept = set(steps[1].doc_id)
    assert np.mean([(i in kept) == (q == 1) for i, q in zip(held.doc_id, held.quality)]) > 0.9
    groups, _ = classes([bits_of(t) for t in steps[1].text], steps[1].doc_id.tolist())
    assert sorted(steps[2].doc_id) == sorted(set(groups))
    bench = list(pd.read_parquet(f"{sf}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False, name=None))
    clean = [i for i, w in zip(steps[2].doc_id, judged(steps[2].text, bench)) if not w[4]]
    assert sorted(steps[3].doc_id) == sorted(clean) and len(clean) < len(steps[2])
    text = dict(zip(steps[4].doc_id, steps[4].text))
    assert sorted(text) == sorted(clean) and not any(base_spans(t) for t in text.values())
    assert all(n == len(text[i]) for i, n in zip(steps[4].doc_id, steps[4].n_chars))
    assert all(text[i] == t for i, t in zip(steps[3].doc_id, steps[3].text) if "[" not in text[i])
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {i: n for i, n in zip(steps[5].doc_id, steps[5].n_tokens)} == {i: len(sp.encode(t)) for i, t in text.items()}


def test_stages_keep_columns(spark, odd):
    """Nulls, repeated rows, odd texts, and columns whose names the operators use or that hold a dot: values stay."""
    import corpus_pipeline as pipe
    extra = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "_spans", "_items", "_sha", "_copies", "_copy", "_id", "_hash", "_score_", "_id_",
             "_fp", "a.b", "keep_0", "kept_3"]
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source", "cast(-1 AS long) AS n_chars",
                          *[f"concat('{c}', coalesce(cast(doc_id AS string), 'none')) AS `{c}`" for c in extra]).where("doc_id IS NULL OR doc_id <> 7").persist()
    rows = docs.count()
    for k, (name, stage) in enumerate(pipe.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        found = out.collect()
        assert 0 < len(found) <= rows and (name != "personal_data" or len(found) == rows)
        for r in found:
            tail = "none" if r.doc_id is None else r.doc_id
            assert all(r[c] == f"{c}{tail}" for c in extra)
            assert r.n_chars == (-1 if name != "personal_data" else None if r.text is None else len(r.text))
    assert pipe.encoding(spark, docs, SF).count() == rows
    for _, stage in pipe.STAGES:
        assert stage(spark, docs.where("false"), SF).collect() == []


def test_registered_queries_and_twins(spark):
    import duckdb

    from pagesift.llm import queries as LQ
    names = list(LQ.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, text in LQ.oracle_sql().items():
        got = LQ.queries()[name](spark, SF)
        want = con.execute(text)
        at = [[d[0] for d in want.description].index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
