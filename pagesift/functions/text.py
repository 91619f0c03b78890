"""Text rules as column expressions: word count (A7), length filter (P2),
sentence split (F4), word-window chunks (F12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAX_WORDS

MARK = "\x1e"
# Sentence rule. Break after . ! ? (plus closing quotes or
# brackets) before whitespace; no break after an ellipsis, after a
# one-letter initial before a letter (applied twice, for "J. R. R."),
# or after a number + period before a lower-case letter.
SENT_MARK_RE = r"""([.!?]+["')\]}]*\s+)"""
SENT_UNMARK_ELLIPSIS_RE = r"""(\.{2,}["')\]}]*\s+)\x{1e}"""
SENT_UNMARK_INITIAL_RE = r"""((?:^|[\s(\x{1e}])\p{L}\.\s+)\x{1e}(\p{L})"""
SENT_UNMARK_ORDINAL_RE = r"""(\d\.\s+)\x{1e}(\p{Ll})"""


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """Split on a single space: runs of spaces give empty words."""
    return F.split(_c(text), " ", -1)


def word_count(text) -> Column:
    return F.size(words(text))


def under_length(text, max_words: int = MAX_WORDS) -> Column:
    """Strictly fewer than ``max_words`` words."""
    return word_count(text) < F.lit(max_words)


def sentences(text) -> Column:
    """array<string> of sentences, right-trimmed, empties dropped.

    The mark itself (a control character) counts as a space in a text.
    """
    m = F.regexp_replace(F.replace(_c(text), F.lit(MARK), F.lit(" ")), SENT_MARK_RE, "$1" + MARK)
    m = F.regexp_replace(m, SENT_UNMARK_ELLIPSIS_RE, "$1")
    m = F.regexp_replace(m, SENT_UNMARK_INITIAL_RE, "$1$2")
    m = F.regexp_replace(m, SENT_UNMARK_INITIAL_RE, "$1$2")
    m = F.regexp_replace(m, SENT_UNMARK_ORDINAL_RE, "$1$2")
    trimmed = F.transform(F.split(m, MARK, -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def chunk_starts(n_words, size: int, overlap: int) -> Column:
    """0-based word offsets of windows of ``size`` words overlapping by ``overlap``."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    return F.sequence(F.lit(0), F.greatest(_c(n_words) - F.lit(overlap + 1), F.lit(0)), F.lit(step))


def chunks(text, size: int, overlap: int) -> Column:
    """array<string> of word windows; every window has at most ``size`` words."""
    w = words(text)
    return F.transform(chunk_starts(F.size(w), size, overlap),
                       lambda s: F.array_join(F.slice(w, s + 1, size), " "))


def sentence_chunks(text, size: int) -> Column:
    """array<string> of whole sentences packed in order, at most ``size`` words a chunk.

    A chunk takes sentences while their words fit and joins them by a space;
    a sentence of more words than ``size`` is cut into windows of its own.
    Words are those of ``word_count``, so joined sentences add up.
    """
    if size < 1:
        raise ValueError("a chunk needs room for a word")
    # Long sentences as windows first; then every piece fits, and pieces carry whether they are such windows.
    pieces = F.flatten(F.transform(sentences(text), lambda s: F.when(word_count(s) <= size, F.array(F.struct(
        s.alias("s"), word_count(s).alias("n"), F.lit(False).alias("alone")))).otherwise(F.transform(chunks(s, size, 0), lambda c: F.struct(
            c.alias("s"), word_count(c).alias("n"), F.lit(True).alias("alone"))))))
    # Left to right: where chunks start, and the words of the last one (full after a window).
    start = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"), F.lit(size).alias("used"))

    def step(a, p):
        new = p["alone"] | (a["used"] + p["n"] > size)
        return F.struct(F.when(new, F.array_append(a["at"], a["i"])).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"),
                        F.when(p["alone"], F.lit(size)).when(new, p["n"]).otherwise(a["used"] + p["n"]).alias("used"))

    def cut(p):
        at = F.aggregate(p, start, step, lambda a: a["at"])
        return F.transform(F.arrays_zip(at.alias("a"), F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(p))).alias("b")),
                           lambda r: F.array_join(F.transform(F.slice(p, r["a"] + 1, r["b"] - r["a"]), lambda x: x["s"]), " "))
    # One element, so the pieces are computed once.
    return F.transform(F.array(pieces), lambda p: F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(cut(p)))[0]
