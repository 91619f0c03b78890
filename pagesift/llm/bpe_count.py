"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut as the vocabulary's byte-level pre-tokenizer does; each piece
starts as its bytes in a linked list. A heap holds the adjacent pairs that
have a merge; the lowest rank (leftmost on ties) is popped again and again and
joined, stale entries being skipped. The count is the initial symbols minus
the merges; no identifiers are emitted.

Scale: one pass, no shuffle. Counts of space-separated segments are kept per
worker in a two-generation table of bounded size (a segment's count depends
on nothing outside it), so frequent words are merged once.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame

from .common import map_texts, read_table

#: The pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 250_000
CACHED_CHARS = 64


class SegmentCache(dict):
    """Values by segment: two generations, the older one dropped when the newer is full."""

    def __init__(self, fn, entries: int = CACHE_ENTRIES, longest: int = CACHED_CHARS):
        super().__init__()
        self.fn, self.entries, self.longest, self.old = fn, entries, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BpeCounter:
    def __init__(self, vocabulary_json: bytes):
        spec = json.loads(vocabulary_json)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without prefix space or normalizer is needed")
        vocab = model["vocab"]
        self.first = [vocab[c] for _, c in sorted(byte_alphabet().items())]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.made.append(vocab[a + b])
        # Merges of two single bytes, as the heap's entries without the place.
        single = {s: b for b, s in enumerate(self.first)}
        self.pair = {(single[k >> 32], single[k & 0xFFFFFFFF]): r << 32 for k, r in self.rank.items()
                     if k >> 32 in single and k & 0xFFFFFFFF in single}
        added = [t for t in spec.get("added_tokens", [])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that strip or match whole words are not supported")
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.of_piece = SegmentCache(self._count_piece)
        self.first_of = SegmentCache(self._count)              # a part's first segment
        self.after_space = SegmentCache(lambda s: self._count(" " + s))
        self.uneven = regex.compile(r" (?=\s|\Z)").search
        self.cuts = regex.compile(r" (?=\S)").split

    def merges(self, data: bytes) -> int:
        """Merges that apply to one piece."""
        n = len(data)
        if n < 2:
            return 0
        pair, rank, made, push, pop = self.pair, self.rank.get, self.made, heapq.heappush, heapq.heappop
        heap = [r | i for i, r in enumerate(map(pair.get, zip(data, data[1:]))) if r is not None]
        if not heap:
            return 0
        heapq.heapify(heap)
        symbol = [*map(self.first.__getitem__, data), -1]  # a guard ends the list
        after, before, done = list(range(1, n + 2)), list(range(-1, n)), 0
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if rank(symbol[i] << 32 | symbol[j]) != r:
                continue  # stale
            new = symbol[i] = made[r]
            symbol[j] = -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                s = rank(new << 32 | symbol[k])
                if s is not None:
                    push(heap, s << 32 | i)
            p = before[i]
            if p >= 0:
                s = rank(symbol[p] << 32 | new)
                if s is not None:
                    push(heap, s << 32 | p)
        return done

    def _count(self, segment: str) -> int:
        return sum(map(self.of_piece.__getitem__, self.pieces(segment)))

    def _count_piece(self, piece: str) -> int:
        data = piece.encode()
        return len(data) - self.merges(data)

    def count(self, text: str) -> int:
        """Tokens of a text; an added token's string counts as one."""
        parts = self.added.split(text) if self.added else [text]
        total = len(parts) - 1
        for part in parts:
            if part:
                # A space before a non-space always begins a piece, and nothing before it matters after it.
                segments = self.cuts(part) if self.uneven(part) else part.split(" ")
                total += self.first_of[segments[0]]
                after = self.after_space
                for s in segments[1:]:
                    total += after[s]
        return total


_COUNTERS: dict[int, BpeCounter] = {}


def _counter(data: bytes) -> BpeCounter:
    """One counter per worker process, kept across tasks."""
    key = hash(data)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = BpeCounter(data)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text.

    ``vocabulary`` is the path of a byte-level tokenizers .json file on the
    driver; the file's bytes (a few MB at any input size) are broadcast. Null
    and empty texts have 0 tokens; strings of added tokens count as one token
    each, as by the library's default. Result columns replace kept columns of
    the same name.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        from pagesift.llm.bpe_count import _counter
        counter = _counter(sent.value)

        def fn(texts):
            tokens = [counter.count(t.decode()) for t in texts]
            return [[len(t) for t in texts], tokens, [n > limit for n in tokens]]
        return fn

    return map_texts(docs, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")],
                     make, text_col, keep)


def op2_bpe_count(spark, sf_dir):
    import public_tokenizers
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
