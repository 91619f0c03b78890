"""Benchmark decontamination by Wu-Manber search over words.

Documents and benchmark items are lower-cased (A-Z) and cut into words. Each
run of ``window`` item words is a pattern (a shorter item is one pattern). A
text is scanned with Wu-Manber tables: the block of two words at the scan
position gives a shift that skips positions where no pattern can end; at
shift zero the block selects a bucket of patterns, which are compared word by
word. Patterns are grouped by their length, so short items do not shorten the
shifts of the long ones.

Scale: documents are scanned in place, one pass, no shuffle. The benchmark is
the stated query set. It is cut into pieces of bounded size and these into
blocks of bounded bytes; each block is broadcast to one pass over the
documents, and the passes' hits are merged per row. One block (the usual case)
needs no merging.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_texts, sha256_hex

#: Words: digits, a-z and everything outside ASCII; A-Z is lower-cased first.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                   for b in range(256))
# Bytes of benchmark text in one broadcast block, and words in one piece of an item.
BLOCK_BYTES = 16 << 20
PIECE_WORDS = 20_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class WuManber:
    """Shift and bucket tables for word patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, list[str]]):
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for words in patterns:
            for end in range(self.block, length + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket[words[-self.block:]].append(words)

    def search(self, words: list[bytes], spans: list[int], items: set[str]) -> None:
        """Append start, end of each occurrence to spans and its items to items."""
        m, n, shift, default = self.length, len(words), self.shift, self.default
        bucket, patterns = self.bucket, self.patterns
        end = m
        if self.block == 1:
            for i, w in enumerate(words):
                if (w,) in patterns:
                    spans += (i, i + 1)
                    items.update(patterns[(w,)])
            return
        while end <= n:
            key = (words[end - 2], words[end - 1])
            step = shift.get(key, default)
            if step:
                end += step
                continue
            found = words[end - m:end]
            for pattern in bucket[key]:
                if pattern[0] == found[0] and list(pattern) == found:
                    spans += (end - m, end)
                    items.update(patterns[pattern])
            end += 1


def compile_block(rows: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    """Tables for (item id, text of words) rows."""
    by_length: dict[int, dict[tuple, list[str]]] = defaultdict(dict)
    for item, text in rows:
        words = text.split()
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m].setdefault(tuple(words[i:i + m]), []).append(item)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def _pieces(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Items as pieces of at most PIECE_WORDS words that together hold every window."""
    step = max(1, PIECE_WORDS - window + 1)

    def make():
        def fn(texts):
            out = []
            for t in texts:
                w = words_of(t)
                last = max(1, len(w) - window + 1)
                out.append([b" ".join(w[i:i + step + window - 1]).decode() for i in range(0, last, step)] if w else [])
            return [out]
        return fn

    items = map_texts(benchmark.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("_item"),
                                       col(text_col).alias("_text")),
                      [("_pieces", "array<string>")], make, "_text", ("_item",))
    return items.select("_item", F.explode("_pieces").alias("_piece"))


def _judge(n_words: int, spans: list[int], items) -> tuple[int, int, str, bool]:
    hit, reach = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if b > reach:
            hit += b - max(a, reach)
            reach = b
    return hit, len(items), sha256_hex(",".join(sorted(items)).encode()), hit > 0 and 20 * hit >= n_words


RESULT = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"),
          ("contaminated", "boolean")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text",
                  keep: tuple[str, ...] = ("doc_id",), item_col: str = "item_id", item_text: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hits of benchmark word windows in each document.

    Returns the ``keep`` columns with n_words, n_hit (words inside any
    occurrence), n_items, items_sha256 (ids sorted as strings, comma-joined)
    and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words and are never contaminated; items
    without words have no window; a null item id counts as the empty string;
    repeated items count once; an empty benchmark hits nothing. Result columns
    replace kept columns of the same name; kept columns called _sha, _spans,
    _items, _copies or _copy are left out.
    """
    spark = docs.sparkSession
    pieces = _pieces(benchmark, window, item_col, item_text)
    total = pieces.agg(F.sum(F.octet_length("_piece"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    numbered = pieces.withColumn("_block", F.pmod(F.xxhash64("_item", "_piece"), F.lit(blocks)))
    parts = []
    for k in range(blocks):
        rows = [(r[0], r[1].encode()) for r in numbered.where(F.col("_block") == k).select("_item", "_piece").collect()]
        sent = spark.sparkContext.broadcast(rows)
        parts.append(_one_pass(docs, sent, window, text_col, keep, final=blocks == 1))
    if blocks == 1:
        return parts[0]
    # Rows of equal kept columns and equal text have equal hits: merge the passes by them.
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    names = [c for c in parts[0].columns if c not in ("_spans", "_items")]
    merged = found.groupBy(*[col(c) for c in names]).agg(
        F.flatten(F.collect_list("_spans")).alias("_spans"),
        F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"),
        F.floor(F.count("*") / blocks).cast("int").alias("_copies"))
    merged = merged.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    # Union of the spans, left to right: hit words and the reach so far.
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size("_spans") - 2, F.lit(2)), lambda i: F.struct(
        F.get("_spans", i).alias("a"), F.get("_spans", i + 1).alias("b"))))
    hit = F.when(F.size("_spans") == 0, F.lit(0).cast("long")).otherwise(F.aggregate(
        pairs, F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("reach")),
        lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], s["reach"]))).alias("hit"),
                              F.greatest(s["reach"], x["b"]).alias("reach")),
        lambda s: s["hit"]))
    kept = [c for c in names if c not in ("_sha", "n_words")]
    return merged.select(
        *[col(c) for c in kept], "n_words", hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _one_pass(docs, sent, window, text_col, keep, final):
    def make():
        tables = compile_block(sent.value, window)

        def fn(texts):
            out = []
            for t in texts:
                words, spans, items = words_of(t), [], set()
                for table in tables:
                    table.search(words, spans, items)
                n = len(words)
                out.append((n, *_judge(n, spans, items)) if final else (n, sha256_hex(t), spans, sorted(items)))
            return list(map(list, zip(*out, strict=True))) if out else [[] for _ in range(5 if final else 4)]
        return fn

    fields = RESULT if final else [("n_words", "bigint"), ("_sha", "string"), ("_spans", "array<bigint>"),
                                   ("_items", "array<string>")]
    gone = {"n_hit", "n_items", "items_sha256", "contaminated", "_sha", "_spans", "_items", "_copies", "_copy"}
    return map_texts(docs, fields, make, text_col, tuple(c for c in keep if c.lower() not in gone))


def op5_wu_manber(spark, sf_dir):
    from .common import read_table
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Windows by a join on their words; at the scale of the driver's check.
OP5_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s
        FROM (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
occ AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
found AS (SELECT doc_id, i, m, item FROM occ JOIN pat USING (m, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
          FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
