"""Word count, length limit, sentence rule, chunks."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagesift.functions import text as T


def test_word_count_golden(spark):
    df = spark.createDataFrame([("",), ("a  b ",), ("a\nb",)], "t string")
    assert [r[0] for r in df.select(T.word_count("t")).collect()] == [1, 4, 1]


def test_length_limit_is_strict(spark):
    df = spark.createDataFrame([(" ".join(["w"] * 1199),), (" ".join(["w"] * 1200),)], "t string")
    assert [r[0] for r in df.select(T.under_length("t")).collect()] == [True, False]


def test_sentence_golden(spark):
    s = 'M. Pokora est là. J. R. R. Tolkien aussi... Oui? "Non." Enfin! Le no 3. un. En 2003. Matt etc. et fin'
    want = ["M. Pokora est là.", "J. R. R. Tolkien aussi... Oui?", '"Non."', "Enfin!", "Le no 3. un.",
            "En 2003.", "Matt etc.", "et fin"]
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(T.sentences("t")).first()[0] == want


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n\"A1", max_size=40), min_size=150, max_size=150))
def test_sentences_lose_only_whitespace(spark, samples):
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for s, sents in zip(samples, [r[0] for r in df.select(T.sentences("t")).collect()]):
        assert "".join("".join(x.split()) for x in sents) == "".join(s.split())
        assert all(x and x == x.rstrip() for x in sents)


def test_chunks_cover_and_bound(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 5, 10, 11, 23)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, chunks in zip(texts, [r[0] for r in df.select(T.chunks("t", 10, 3)).collect()]):
        words = t.split(" ")
        assert all(len(c.split(" ")) <= 10 for c in chunks)
        covered = set()
        for i, c in enumerate(chunks):
            start = i * 7
            assert c.split(" ") == words[start:start + 10]
            covered.update(range(start, start + len(c.split(" "))))
        assert covered == set(range(len(words)))
