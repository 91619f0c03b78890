"""Token counts and piece encoding against the libraries, over whole tables and made-up texts."""

import hashlib
import random

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pagesift.llm import bpe_count as B
from pagesift.llm import piece_bpe as P

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
BITS = [" ", "  ", "\n", "\t", "a", "the", "é", "▁", "\x1c", "\x85", "　", "\xa0", "'s", "'S", "<|endoftext|>", "<s>", "<0x0A>",
        "1", "²", "…", "漢", "😀", "​", "ﬁ", ".", "!!", "_", "\x00", "﻿", "----", "ing", "aaaa"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + \
        pd.read_parquet(f"{SF}/documents.parquet").text.tolist() + ["b" * 20_000, "ab" * 5_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library(texts, library):
    counter = B.BpeCounter(open(JSON, "rb").read())
    assert [counter.count(t) for t in texts] == [len(library[0].encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_with_a_tiny_cache(texts, library):
    counter = B.BpeCounter(open(JSON, "rb").read())
    counter.of_piece.entries = counter.after_space.entries = counter.first_of.entries = 7
    some = texts[:300]
    assert [counter.count(t) for t in some] == [len(library[0].encode(t, add_special_tokens=False).ids) for t in some]


def test_count_query_and_odd_rows(spark, odd, none, library):
    got = sorted(B.count_tokens(odd, JSON, keep=("doc_id", "text", "n_tokens")).collect(), key=str)
    assert len(got) == odd.count()
    for r in got:
        n = len(library[0].encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)
    assert B.count_tokens(none, JSON).collect() == []


def test_ids_and_decoding_equal_the_library(texts, library):
    bpe = P.PieceBpe(open(MODEL, "rb").read())
    assert not bpe.whole
    for t in texts:
        ids = library[1].encode(t)
        assert bpe.encode(t) == ids
        assert bpe.decode(ids) == library[1].decode(ids)


def test_whole_text_without_cutting(texts, library):
    bpe = P.PieceBpe(open(MODEL, "rb").read())
    bpe.whole = True
    for t in texts[:400]:
        assert bpe.encode(t) == library[1].encode(t)


def test_encode_query_round_trip_and_odd_rows(spark, odd, none, library):
    for r in P.encode_digest(odd, MODEL, keep=("doc_id", "text", "n_tokens")).collect():
        ids = library[1].encode(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library[1].decode(ids).encode()).hexdigest()
    back = P.decode(P.encode(odd, MODEL), MODEL).collect()
    assert sorted(r.text for r in back) == sorted((r.text or "").replace("▁", " ") for r in odd.collect())
    assert P.encode_digest(none, MODEL).collect() == []
