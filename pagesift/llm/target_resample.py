"""Importance resampling towards a target distribution.

Features are all runs of one and two words, hashed to buckets by crc32. A
bucket's gain is the log ratio of its smoothed shares in the target and in the
corpus; a document's weight is the mean gain of its features, its score the
weight plus Gumbel noise drawn from its id. The highest scores are drawn.

Weights come from arrays: a text's words are looked up once, the crc of a pair
of words follows from those of the words (crc32 is linear, so the first one's
is moved on by a table for the length of the second), and gains are one gather
and one sum. Both passes over the texts are narrow; only bucket counts (one
row per task and bucket) and numbers of fixed size move.

The cutoff is found without sorting the scores: a quantile sketch gives a
bracket of scores, exact counts above and inside it tell whether it holds the
cutoff (else it is widened, at last to all scores), and only the rows inside
are sorted, over range partitions. Drawn rows then get their ranks from a range
sort with offsets; the others are not sorted at all.

Null and empty texts have no features, weight 0 and cannot be drawn (too few
words); a null id draws the noise of the empty string and comes last among
ties; repeated rows are drawn one by one (ties of equal score and id: by
features, then weight). An empty corpus gives no rows; an empty target leaves
its counts at zero. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ids import dense_index
from ..session import cut_lineage, ship_package
from .common import col, map_texts, read_table, slices, text_bytes

BUCKETS, PERCENT, SEED, MIN_WORDS, SCALE = 10_000, 25, 7, 20, 1000
KNOWN_WORDS = 250_000       # words whose crc a worker holds at a time
MOVES = 32                  # lengths with a table; pairs with a longer second word are hashed directly
EPSILON = 0.005             # first half width of the bracket, as a share of the rows
#: A-Z to lower case, 0-9, a-z and all bytes from 0x80 as they are, the rest is white space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _move_tables() -> np.ndarray:
    """[length, byte place, byte]: what a crc's byte turns into when so many bytes follow it."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # of one byte, without the start value
    out = np.empty((MOVES + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(MOVES):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ one[out[n] & np.uint32(255)]
    return out


class Features:
    """Buckets of the features of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.moves = buckets, _move_tables()
        self.forget()

    def forget(self) -> None:
        self.number, self.words = {}, []
        self.crc = np.empty(1024, np.uint32)     # of the word, and of the word and a space
        self.open = np.empty(1024, np.uint32)
        self.size = np.empty(1024, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        a, b = len(self.words), len(self.words) + len(new)
        while b > len(self.crc):
            self.crc, self.open, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.crc, self.open, self.size))
        self.number.update(zip(new, range(a, b)))
        self.words += new
        self.crc[a:b] = [zlib.crc32(w) for w in new]
        self.open[a:b] = [zlib.crc32(w + b" ") for w in new]
        self.size[a:b] = [len(w) for w in new]

    def of(self, text: bytes) -> tuple[np.ndarray, int]:
        """(bucket of each feature, number of words)."""
        words = text.translate(_FOLD).split()
        if len(self.words) > KNOWN_WORDS:
            self.forget()
        try:
            at = np.array([self.number[w] for w in words], np.int64)
        except KeyError:
            self._learn(words)
            at = np.array([self.number[w] for w in words], np.int64)
        if len(at) < 2:
            return self.crc[at].astype(np.int64) % self.buckets, len(at)
        head, size, m = self.open[at[:-1]], self.size[at[1:]], self.moves
        short = np.minimum(size, MOVES)
        pairs = self.crc[at[1:]].copy()
        for k in range(4):
            pairs ^= m[short, k, (head >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.nonzero(size > MOVES)[0].tolist():
            pairs[i] = zlib.crc32(words[i] + b" " + words[i + 1])
        return np.concatenate([self.crc[at], pairs]).astype(np.int64) % self.buckets, len(at)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = batch.column(0)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in slices(sizes):
                found = [made.of(t)[0] for t in text_bytes(texts.slice(a, b - a))]
                total += np.bincount(np.concatenate(found), minlength=buckets)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    counts = docs.select(col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket: fixed size
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * log ratio of the smoothed shares) of each bucket."""
    n, big_s, big_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(scale * math.log(((t + 1.0) * (big_s + n)) / ((s + 1.0) * (big_t + n))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_words, n_features and weight (the floored mean gain) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def make():
        made, table = Features(len(sent.value)), sent.value

        def fn(texts):
            out = [[], [], []]
            for t in texts:
                found, n = made.of(t)
                for c, x in zip(out, (n, len(found), int(table[found].sum()) // len(found) if len(found) else 0), strict=True):
                    c.append(x)
            return out
        return fn

    return map_texts(docs, [("n_words", "bigint"), ("n_features", "bigint"), ("weight", "bigint")], make, text_col, keep)


def _noise(seed: int, scale: int):
    """floor(-scale * ln(-ln(u))) with u from the first 8 hex digits of sha256 of `seed:id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("bigint")


ORDER = ["_down", "_none", "doc_id", "n_features", "weight"]


def cutoff(rows: DataFrame, k: int, n: int, epsilon: float = EPSILON) -> tuple[int, object]:
    """(score, id) of the k-th of n rows, highest score first, ties to the smaller id (null last).

    ``rows``: score, doc_id. The bracket around the share k / n of a quantile
    sketch is checked by exact counts and widened until it holds the cutoff.
    """
    width = epsilon
    while True:
        low, high = max(0.0, 1 - k / n - width), min(1.0, 1 - k / n + width)
        accuracy = min(100_000, max(1000, math.ceil(4 / width)))  # the sketch's size
        a, b = rows.agg(F.percentile_approx("score", [low, high], accuracy)).first()[0]
        if width >= 1:
            a, b = rows.agg(F.min("score"), F.max("score")).first()
        above, inside = rows.agg(F.count_if(F.col("score") > b), F.count_if(F.col("score").between(a, b))).first()
        if above < k <= above + inside:
            break
        width *= 4
    bracket = rows.where(F.col("score").between(a, b)).select(
        (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_none"), "doc_id")
    found = dense_index(bracket, ["_down", "_none", "doc_id"], start=1, col="_place")
    down, _, doc = found.where(F.col("_place") == k - above).select("_down", "_none", "doc_id").first()
    return -down, doc


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", epsilon: float = EPSILON) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (1, 2, ... of drawn rows, else null) of every row."""
    docs = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(docs, "text", buckets), bucket_counts(target, target_text, buckets), scale)
    rows = cut_lineage(weights(docs, gain).withColumn("score", F.col("weight") + _noise(seed, scale)))
    eligible = rows.where(F.col("n_words") >= min_words)
    n = eligible.count()
    k = percent * n // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    score, doc = cutoff(eligible.select("score", "doc_id"), k, n, epsilon)
    tied = F.lit(True) if doc is None else F.coalesce(F.col("doc_id") <= F.lit(doc), F.lit(False))
    drawn = (F.col("n_words") >= min_words) & ((F.col("score") > score) | ((F.col("score") == score) & tied))
    candidates = rows.where(drawn).withColumns({"_down": -F.col("score"), "_none": F.col("doc_id").isNull()})
    # Repeated rows at the cutoff may be more than are drawn.
    ranked = dense_index(candidates, ORDER, start=1, col="rank").withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.select(*columns, "rank").unionByName(rows.where(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def op12_target_resample(spark, sf_dir):
    found = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: crc32 byte by byte from its polynomial, over the distinct features; at the scale of the driver's check.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
texts AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark
), w AS (
  SELECT side, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), f AS (
  SELECT side, r, unnest(w) AS f FROM w
  UNION ALL SELECT side, r, w[i] || ' ' || w[i + 1] FROM (SELECT side, r, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)
), u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
steps AS (
  SELECT f, x, CAST(4294967295 AS BIGINT) AS c, 0 AS k FROM u
  UNION ALL
  SELECT f, x, xor(c // 256, t[1 + CAST(xor(c % 256, CAST(strpos('0123456789ABCDEF', substr(x, 2 * k + 1, 1)) * 16 - 16
                                              + strpos('0123456789ABCDEF', substr(x, 2 * k + 2, 1)) - 1 AS BIGINT)) AS BIGINT)]), k + 1
  FROM steps, tab WHERE k < length(x) / 2
), b AS (SELECT f, xor(c, CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM steps WHERE k = length(x) / 2),
fb AS (SELECT side, r, bucket FROM f JOIN b USING (f)),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM fb GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln(((CAST(n.t AS DOUBLE) + 1) * (CAST(tot.s AS DOUBLE) + 10000))
                                         / ((CAST(n.s AS DOUBLE) + 1) * (CAST(tot.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM n, tot),
p AS (SELECT r, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
      FROM fb JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
h AS (SELECT r, CAST('0x' || substr(sha256('7:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w WHERE side = 'd'),
s AS (SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
      FROM w JOIN h USING (r) LEFT JOIN p USING (r) WHERE side = 'd'),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
             count(*) OVER (PARTITION BY n_words >= 20) AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (25 * n) // 100 THEN place END AS rank, n_words FROM o
"""
