"""Document fingerprints from improbable features.

A feature is a window of 64 bytes. Its entropy is compared with that of
typical text: the further away, the rarer. In each run of 64 features the
rarest one (leftmost on ties) gains a point; features with 16 points or more
are selected, so that a few per kilobyte stand for the text, wherever they
lie. That is too few, or none, in a short text: texts under 512 bytes, and
others without any, select the rarest feature of each run of 16 as well, so
that an edit leaves some. Only texts under 64 bytes, or all of runs of the same
bytes, are one feature as a whole. An edit that leaves no 64 bytes together
leaves no feature and no likeness.

A selected feature sets five bits of a 2048-bit Bloom filter; after 160
different features the next filter of the chain begins.

Two chains are compared filter by filter: the common bits, normalised between
a chance level (from the numbers of features) and the most that could be
common; the shorter chain's filters each take their best partner, averaged.

Scale: texts move once, to be next to their successor: ranges of ids between
bounds that are ids of the data, so that the first row of a range is known and
its copy can be sent to the range before. Each range is sorted and streamed.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package
from .common import SLICE_BYTES, col, map_texts, read_table, sha256_hex, slices

WIDTH = 64            # bytes of a feature, and features of a run
POINTS = 16
SHORT, SHORT_RUN = 512, 16  # texts of fewer bytes than SHORT, or without a feature, select in runs of SHORT_RUN as well
FILTER_BITS, FILTER_KEYS, FILTER_FEATURES = 2048, 5, 160
CUTOFF = 0.3          # share of the way from chance to full overlap that counts as nothing
# Entropy of typical text windows, as a share of the most possible (6 bits): centre and spread.
TYPICAL, SPREAD = 0.64, 0.05
LOWEST = 0.1          # windows below are runs of the same bytes and never selected
BLOCK = 1 << 19       # bytes handled by one vectorised pass
_SCALE = 1 << 20
_F = np.round(np.array([0, *(k * np.log2(k) for k in range(1, WIDTH + 1))]) * _SCALE).astype(np.int64)
_STEP = _F[1:] - _F[:-1]
NEVER = 1001
_POS = 1 << 40


def _rank(weight: np.ndarray) -> np.ndarray:
    """Rank of windows by the sum of k log2 k over their byte counts; lower is rarer."""
    entropy = 1 - weight / (_SCALE * WIDTH * np.log2(WIDTH))
    rank = np.round(1000 * np.exp(-0.5 * ((entropy - TYPICAL) / SPREAD) ** 2)).astype(np.int64)
    return np.where(entropy < LOWEST, NEVER, rank)


def _ranks(x: np.ndarray) -> np.ndarray:
    """Rank of the window at each position of a byte array (64 or longer)."""
    n = len(x)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the 63 that follow, precede
    for d in range(1, WIDTH):
        same = (x[:-d] == x[d:]).view(np.uint8)
        after[:n - d] += same
        before[d:] += same
    weight = np.empty(n - WIDTH + 1, np.int64)
    weight[0] = _F[np.bincount(x[:WIDTH], minlength=256)].sum()
    # The window moves on by one: a byte enters, one leaves.
    weight[1:] = _STEP[before[WIDTH:]] - _STEP[after[:n - WIDTH]]
    return _rank(np.cumsum(weight))


def _select(rank: np.ndarray, runs: np.ndarray, run: int, least: int) -> np.ndarray:
    """Positions with enough points, from the runs that begin at ``runs``; run is a power of 2."""
    key = rank * _POS + np.arange(len(rank))
    width = 1
    while width < run:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    best = key[runs] % _POS
    points = np.bincount(best, minlength=len(rank))
    return np.nonzero((points >= least) & (rank < NEVER))[0]


def features(texts: list[bytes], run: int = WIDTH, least: int = POINTS) -> list[np.ndarray]:
    """Positions of the selected features of each text: those with ``least`` points from runs of ``run`` features."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    long = [i for i, t in enumerate(texts) if len(t) >= WIDTH + run]
    for a, b in slices([len(texts[i]) for i in long], BLOCK):
        part = long[a:b]
        rank = _ranks(np.frombuffer(b"".join(texts[i] for i in part), np.uint8))
        starts = np.cumsum([0, *(len(texts[i]) for i in part)])
        # Only runs inside one text count; windows over a seam are in none of them.
        runs = np.concatenate([np.arange(starts[k], starts[k + 1] - WIDTH - run + 2) for k in range(len(part))])
        found = _select(rank, runs, run, least)
        cut = np.searchsorted(found, starts)
        for k, i in enumerate(part):
            out[i] = found[cut[k]:cut[k + 1]] - starts[k]
    for i, t in enumerate(texts):
        if WIDTH <= len(t) < WIDTH + run:  # fewer features than a run: the rarest stands for all
            rank = _ranks(np.frombuffer(t, np.uint8))
            out[i] = np.array([int(np.argmin(rank))])
    return out


def _hashes(text: bytes, at) -> list[bytes]:
    """Hashes of the features, in short texts with those of short runs; a text without any is one feature itself."""
    sha = hashlib.sha1
    if WIDTH <= len(text) and (len(text) < SHORT or not len(at)):
        at = np.union1d(at, features([text], SHORT_RUN, 1)[0]).astype(np.int64)
    return [sha(text[p:p + WIDTH]).digest() for p in at] or ([sha(text).digest()] if text else [])


class Chain:
    """Bloom filters in the order of the features, with the number of features of each."""

    def __init__(self, hashes: list[bytes]):
        different = list(dict.fromkeys(hashes))
        bits = np.frombuffer(b"".join(h[:2 * FILTER_KEYS] for h in different), ">u2").reshape(-1, FILTER_KEYS) % FILTER_BITS
        n = -(-len(different) // FILTER_FEATURES)
        self.counts = np.array([min(FILTER_FEATURES, len(different) - k * FILTER_FEATURES) for k in range(n)], np.int64)
        cells = np.zeros((n, FILTER_BITS), np.uint8)
        cells[np.repeat(np.arange(len(different)) // FILTER_FEATURES, FILTER_KEYS), bits.ravel()] = 1
        self.filters = np.packbits(cells, axis=1) if n else np.zeros((0, FILTER_BITS // 8), np.uint8)

    def text(self) -> str:
        last = int(self.counts[-1]) if len(self.counts) else 0
        return f"{len(self.counts)}:{last}:" + base64.b64encode(self.filters.tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Chain:
        n, last, data = text.split(":")
        chain = cls([])
        chain.filters = np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(n), FILTER_BITS // 8)
        chain.counts = np.full(int(n), FILTER_FEATURES)
        if int(n):
            chain.counts[-1] = int(last)
        return chain


def likeness(a: Chain, b: Chain) -> float:
    """0 to 1; 1 for equal chains. An empty chain is like an empty one only."""
    if len(a.counts) > len(b.counts):
        a, b = b, a
    if not len(a.counts):
        return 1.0 if not len(b.counts) else 0.0
    size_b = np.bitwise_count(b.filters).sum(1)
    p, total = 1 - 1 / FILTER_BITS, 0.0
    for f, n in zip(a.filters, a.counts, strict=True):
        common = np.bitwise_count(f & b.filters).sum(1)
        size = int(np.bitwise_count(f).sum())
        most = np.minimum(size, size_b)
        na, nb = FILTER_KEYS * n, FILTER_KEYS * b.counts
        chance = FILTER_BITS * (1 - p ** na - p ** nb + p ** (na + nb))
        floor = chance + CUTOFF * np.maximum(most - chance, 0)
        equal = (common == size) & (common == size_b)
        score = np.where(equal, 1.0, np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1) * (common > floor))
        total += float(score.max())
    return total / len(a.counts)


def _edited(text: bytes, at: np.ndarray, hashes: list[bytes], kept: int, new: bytes) -> list[bytes]:
    """Feature hashes of an edited text whose first ``kept`` bytes are those of ``text``.

    A feature's points depend on bytes up to 127 after it, so those before
    kept - 127 are as they were; the rest is computed anew, from 64 bytes before.
    In short texts, and without features before or after the edit, all is.
    """
    safe = kept - 2 * WIDTH + 1
    if min(len(text), len(new)) < SHORT or not len(at) or safe < 4 * WIDTH or len(new) - safe < 2 * WIDTH:
        return _hashes(new, features([new])[0])
    start = safe - WIDTH
    tail = features([new[start:]])[0] + start
    k = int(np.searchsorted(at, safe))
    found = np.concatenate([at[:k], tail[tail >= safe]])
    if not len(found):
        return _hashes(new, found)
    return hashes[:k] + [hashlib.sha1(new[p:p + WIDTH]).digest() for p in found[k:]]


def compare_neighbours(texts: list[str]) -> list[tuple]:
    """For each text but the last, with its successor: n_chars, edited digest, both fingerprints, both likenesses."""
    data = [t.encode() for t in texts]
    at = features(data)
    hashes = [_hashes(t, p) for t, p in zip(data, at, strict=True)]
    chains = [Chain(h) for h in hashes]
    out = []
    for i in range(len(texts) - 1):
        n = len(texts[i])
        head = texts[i][:n - n // 4].encode()
        new = head + texts[i + 1][:n // 4].encode()
        chain = Chain(_edited(data[i], at[i], hashes[i], len(head), new))
        out.append((n, sha256_hex(new), chains[i].text(), chain.text(), likeness(chains[i], chain), likeness(chains[i], chains[i + 1])))
    return out


def fingerprint(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``fingerprint`` of each whole text, in place; null and empty texts have an empty chain."""
    def make():
        def fn(texts):
            return [[Chain(_hashes(t, p)).text() for t, p in zip(texts, features(texts), strict=True)]]
        return fn
    return map_texts(docs, [("fingerprint", "string")], make, text_col, keep)


RESULT = [("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()),
          ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64())]


def fingerprint_edits(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and its edited text, and their likenesses.

    The edited text has the last floor(n/4) code points replaced by the first
    as many of the next document (ascending integer id, nulls first; rows of
    one id by the hash of their text; the last is followed by the first, a
    single row by itself). Null texts are empty. Rows of one id are one
    streamed task's work. No rows give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks, nulls, low = src.agg(
        F.percentile_approx("doc_id", [k / pieces for k in range(1, pieces)], 20 * pieces),
        F.max(F.col("doc_id").isNull()), F.min("doc_id")).first()
    # Bounds are ids of the data, so the first row of each range is one with the bound as its id.
    bounds = sorted({b for b in marks or [] if nulls or b > low})
    bounds = np.array(bounds, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Range of each row. A row that begins a range also ends the range before it; the first of all ends the last."""
        for batch in batches:
            unknown = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            part = np.where(unknown, 0, np.searchsorted(bounds, ids, side="right"))
            starts = ~unknown & np.isin(ids, bounds)
            begins = np.where(starts, part - 1, len(bounds))
            again = np.nonzero(starts | (unknown if nulls else ~unknown & (ids == low)))[0]
            both = batch.take(pa.array(np.concatenate([np.arange(len(ids)), again])))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([part, begins[again]]).astype(np.int32)),
                pa.array(np.repeat([0, 1], [len(ids), len(again)]).astype(np.int32)), *both.columns], names=["part", "copy", "doc_id", "text"])

    rows = src.mapInArrow(place, "part int, copy int, doc_id long, text string")
    rows = rows.repartition("part").sortWithinPartitions("part", "copy", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    schema = StructType().add("doc_id", "long")
    for name, kind, _ in RESULT:
        schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int | None, str]] = []  # rows of one part, the last one still without a successor
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                same = held and row[0] == held[-1][0]
                if same and held[-1][1]:
                    continue  # one copy is enough
                if held and not same:
                    yield _finish(held)
                    held, size = [], 0
                elif size > SLICE_BYTES // 4:
                    yield _finish([*held, row])
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield _finish(held)

    return rows.mapInArrow(run, schema)


def _finish(rows: list[tuple]) -> pa.RecordBatch:
    """Results of all rows but the last, which only follows."""
    made = compare_neighbours([r[3] for r in rows])
    cols = list(zip(*made, strict=True)) if made else [[]] * len(RESULT)
    arrays = [pa.array([r[2] for r in rows[:-1]], pa.int64()), *(pa.array(c, k) for c, (_, _, k) in zip(cols, RESULT, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(n for n, _, _ in RESULT)])


def op3_rare_digest(spark, sf_dir):
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))
