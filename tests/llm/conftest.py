import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that every operator must take: nulls, empty, ties, repeats, long and odd texts; columns that clash."""
    long_word, long_text = "z" * 30_000, "some words of a long text " * 4_000
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "no id here"), (None, None), (5, "two words"), (6, "two words"),
            (7, long_word), (8, long_text), (9, "  spaced \n\t out\x0b "), (10, "éè\U0001f600 ▁ "), (11, "<|endoftext|> x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Names that the operators use themselves.
    return df.selectExpr("doc_id", "text", "'x' AS n_tokens", "1 AS score", "2 AS _text_", "3 AS _fp", "4 AS fingerprint",
                         "5 AS component_id", "6 AS n_words", "7 AS chunk", "8 AS `dotted.name`", "9 AS _stats", "10 AS pii_spans")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")
