"""SentencePiece BPE encoding by backtracking, and decoding.

A vocabulary's merges (best score first, leftmost on ties) fix which token
sequences are encodings: exactly those whose tokens each encode to themselves
and whose neighbours, joined and merged again, come back as the same two
tokens. So a segment is encoded left to right: Aho-Corasick gives the longest
token at each position; a token is taken if it is compatible with the token
before it, else its next shorter prefix is tried; where none fits, the position
is cleared in a bitfield of usable positions and the last token is taken back.
Characters outside the vocabulary become byte tokens and separate the text.

No piece holds a space mark after another character, so a text is cut before
each run of marks and the segments are encoded on their own; a worker keeps a
bounded two-generation table of them. One pass, no shuffle.
"""

from __future__ import annotations

import codecs
import heapq
import re

import ahocorasick
from pyspark.sql import DataFrame

from .bpe_count import SegmentCache
from .common import map_texts, read_table, sha256_hex

MARK = "▁"
codecs.register_error("replace-bytes", lambda e: ("\ufffd", e.start + 1))  # one for each byte
PAIR_ENTRIES = 250_000


class PieceBpe:
    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.normalize("  ﬁ ") != MARK * 3 + "ﬁ" + MARK:
            raise ValueError("a model with identity normalization, a dummy prefix and escaped spaces is needed")
        self.piece = [sp.id_to_piece(i) for i in range(len(sp))]
        normal = [i for i in range(len(sp)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.piece[i]: sp.get_score(i) for i in normal}
        self.id = {self.piece[i]: i for i in normal}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        if len(self.byte_id) != 256 or any(c not in self.id for p in self.id for c in p):
            raise ValueError("byte fallback and single-character pieces are needed")
        self.data = [p.replace(MARK, " ").encode() for p in self.piece]
        for b, i in self.byte_id.items():
            self.data[i] = bytes([b])
        for i in range(len(sp)):
            if sp.is_control(i):
                self.data[i] = b""
            elif sp.is_unknown(i):
                self.data[i] = sp.decode([i]).encode()
        # Pieces that their own merges rebuild; others never occur in an encoding.
        self.usable = {p for p in self.id if self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.usable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.usable), None) for p in self.usable}
        # Pairs of tokens, joined by a line feed (no piece holds one), by whether they fit.
        self.fits = SegmentCache(lambda pair: self._apart(*pair.split("\n")), PAIR_ENTRIES)
        # True if some piece holds a mark after another character: then texts stay whole.
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.segment = SegmentCache(self._segment)

    def merge(self, text: str) -> list[str]:
        """The merges themselves: best score first, leftmost on ties."""
        token, score = list(text), self.score.get
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, token[i] + token[i + 1]) for i in range(n - 1) if (s := score(token[i] + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if token[i] is None or j >= n or token[i] + token[j] != joined:
                continue
            token[i], token[j], after[i] = joined, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (s := score(pair := token[left] + token[right])) is not None:
                    heapq.heappush(heap, (-s, left, pair))
        return [t for t in token if t is not None]

    def _apart(self, left: str, right: str) -> bool:
        """Do two tokens, joined and merged again, come back as they were?"""
        return self.score.get(left + right) is None and self.merge(left + right) == [left, right]

    def backtrack(self, text: str) -> list[str]:
        """The encoding of a text whose characters are all in the vocabulary."""
        n = len(text)
        longest: list[str] = [""] * n
        for end, p in self.automaton.iter(text):
            start = end - len(p) + 1
            if len(p) > len(longest[start]):
                longest[start] = p
        usable = bytearray(b"\x01") * (n + 1)  # positions not yet known to fail
        tokens: list[str] = []
        at, token, shorter, fits = 0, longest[0], self.shorter, self.fits
        while True:
            last = tokens[-1] if tokens else None
            while token and not (usable[at + len(token)] and (last is None or fits[f"{last}\n{token}"])):
                token = shorter[token]
            if token:
                tokens.append(token)
                at += len(token)
                if at == n:
                    return tokens
                token = longest[at]
            else:
                usable[at] = 0
                tokens.pop()
                at -= len(last)
                token = shorter[last]

    def _ids(self, text: str) -> list[int]:
        ids: list[int] = []
        run = 0
        for i, c in enumerate(text):
            if c not in self.id:
                if run < i:
                    ids += map(self.id.__getitem__, self.backtrack(text[run:i]))
                ids += map(self.byte_id.__getitem__, c.encode())
                run = i + 1
        if run < len(text):
            ids += map(self.id.__getitem__, self.backtrack(text[run:]))
        return ids

    def _segment(self, tail: str) -> tuple[int, str, bytes]:
        """Of a mark and what follows it: number of ids, the ids in decimal, the decoded bytes."""
        ids = self._ids(MARK + tail)
        return len(ids), ",".join(map(str, ids)), self.decode_bytes(ids)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.data.__getitem__, ids))

    def encode_segments(self, text: str) -> list[tuple[int, str, bytes]]:
        if not text:
            return []
        if self.whole:
            return [self._segment(text.replace(" ", MARK))]
        if MARK in text or "  " in text or text[0] == " ":
            marked = MARK + text.replace(" ", MARK)
            tails = [s[1:] for s in re.findall(f"{MARK}+[^{MARK}]*", marked)]
        else:
            tails = text.split(" ")
        return list(map(self.segment.__getitem__, tails))

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_segments(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the first one is dropped; a byte
        that is not part of a valid character is U+FFFD."""
        data = self.decode_bytes(ids)
        first = next((self.piece[i] for i in ids if self.data[i]), "")
        if first.startswith(MARK):
            data = data[1:]
        return data.decode("utf-8", "replace-bytes")


_MODELS: dict[int, PieceBpe] = {}


def _model(data: bytes) -> PieceBpe:
    """One model per worker process, kept across tasks."""
    key = hash(data)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceBpe(data)
    return _MODELS[key]


def _send(spark, path: str):
    """The bytes of a model file on the driver (a few MB at any input size), broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_digest(docs: DataFrame, model: str, text_col: str = "text",
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    Null and empty texts have no ids (the digests of the empty string). Result
    columns replace kept columns of the same name.
    """
    sent = _send(docs.sparkSession, model)

    def make():
        from pagesift.llm.piece_bpe import _model
        bpe = _model(sent.value)

        def fn(texts):
            out = ([], [], [])
            for t in texts:
                segments = bpe.encode_segments(t.decode())
                out[0].append(sum(s[0] for s in segments))
                out[1].append(sha256_hex(",".join([s[1] for s in segments]).encode()))
                # The first segment begins with the dummy mark.
                out[2].append(sha256_hex(b"".join([s[2] for s in segments])[1:]))
            return list(out)
        return fn

    return map_texts(docs, [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
                     make, text_col, keep)


def encode(docs: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ids themselves: ``ids`` array<int> beside the kept columns; null and empty texts have none."""
    sent = _send(docs.sparkSession, model)

    def make():
        from pagesift.llm.piece_bpe import _model
        bpe = _model(sent.value)
        return lambda texts: [[bpe.encode(t.decode()) for t in texts]]

    return map_texts(docs, [("ids", "array<int>")], make, text_col, keep)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``text`` of each row's ids beside the kept columns; null ids are an empty text."""
    from pyspark.sql import functions as F

    from .common import col
    sent = _send(encoded.sparkSession, model)
    listed = encoded.select(*[col(c) for c in keep if c.lower() != "text"], F.array_join(col(ids_col), ",").alias("_ids_"))

    def make():
        from pagesift.llm.piece_bpe import _model
        bpe = _model(sent.value)
        return lambda rows: [[bpe.decode([int(i) for i in r.split(b",")]) if r else "" for r in rows]]

    return map_texts(listed, [("text", "string")], make, "_ids_", tuple(c for c in keep if c.lower() != "text"))


def op8_piece_bpe(spark, sf_dir):
    import public_tokenizers
    return encode_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
