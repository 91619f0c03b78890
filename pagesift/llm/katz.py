"""Katz backoff language model: Good-Turing counts, exactly normalised backoff.

    P(w | h) = d(c) c(hw) / c(h)          if hw was counted in training
             = alpha(h) P(w | shorter h)  otherwise

d(c) is the Good-Turing discount for counts up to K (absolute discounting
where the counts of counts do not give one between 0 and 1). alpha(h) gives the
mass that the discounts of h leave free to the words not counted after h, in
proportion to their shorter-context probability, so the probabilities of all
words and one unknown word sum to one. Words are lower-cased (A-Z); a text is
its words and one end mark, after begin marks that are context only.

Layout for scale: texts are cut into chunks (one row each: the tokens as small
numbers and the hashes of the chunk's words), written to the shared folder. A
chunk's different n-grams, as sorted 64-bit hashes with training counts, go in
slices to count buckets by the hash's first bits; a bucket adds the slices up,
answers each with the total counts, and marks in one slice of each n-gram that
it owns it. Back in its chunk, every n-gram so has its count. The owners'
sums for the backoff weights and the requests for them take the same way, by
the context's hash. So counting and lookups move one entry per chunk and
n-gram, not one per token, and a frequent n-gram is as light as any other.
Buckets and chunks are of bounded size at any input.

Every token is then evaluated by the recursion above.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path, ship_package
from .common import col, read_table, text_bytes

ORDER = 2
K = 5                       # counts up to K are discounted
FLOOR = 0.05                # what larger counts give up, so that no context leaves nothing to other words
CHUNK_BYTES = 16 << 20      # text of one chunk
BUCKET_KEYS = 1 << 21       # hashes of one count bucket, on average
END, BEGIN = b"\n", b"\t"   # white space, so no words

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence's hash and the next word's."""
    x = (a ^ (a >> np.uint64(29))) * _MUL + b
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(31))


def _pack(a: np.ndarray) -> bytes:
    """An array of numbers as compressed planes of their bytes."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T) if len(a) else a
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind) if len(planes) else np.zeros(0, kind)


CHUNK = "chunk long, ids array<bigint>, held binary, lens binary, tokens binary, words binary, n_grams long"


def _write_chunks(docs: DataFrame, path: str) -> None:
    """docs: (id long, held boolean, text string)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        chunk = TaskContext.get().partitionId() << 24
        ids, held, tokens, size = [], [], [], 0
        number: dict = {}

        def fresh():
            known = defaultdict()
            known.default_factory = known.__len__
            known[END]  # number 0
            return known

        def done():
            lens = np.array([len(t) for t in tokens], np.int32)
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            all_tokens = np.concatenate(tokens)
            row = [[chunk], [ids], [np.array(held, np.uint8).tobytes()], [lens.tobytes()], [_pack(all_tokens.astype(np.uint32))],
                   [words.tobytes()], [len(all_tokens)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                                              names=["chunk", "ids", "held", "lens", "tokens", "words", "n_grams"])

        number = fresh()
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True)
            for i, h, text in rows:
                words = text.lower().split()
                words.append(END)
                tokens.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                ids.append(i)
                held.append(h)
                size += len(text) + 1
                if size >= CHUNK_BYTES:
                    yield done()
                    chunk, ids, held, tokens, size, number = chunk + 1, [], [], [], 0, fresh()
        if ids:
            yield done()

    docs.mapInArrow(run, CHUNK).write.option("compression", "zstd").parquet(path)


class Grams:
    """The n-grams at each position of a chunk, by order: different hashes, and which one is at a position."""

    def __init__(self, held: bytes, lens: bytes, tokens: bytes, words: bytes, order: int):
        self.lens = np.frombuffer(lens, np.int32)
        self.held = np.frombuffer(held, np.uint8).astype(bool)
        word = np.frombuffer(words, np.uint64)
        at = _unpack(tokens, np.uint32)
        token = word[at]
        n = len(token)
        self.starts = np.cumsum(self.lens) - self.lens
        start = np.repeat(self.starts, self.lens)
        self.train = ~np.repeat(self.held, self.lens)
        self.first = np.zeros(n, bool)
        self.first[self.starts] = True
        begin = np.uint64(xxhash.xxh64_intdigest(BEGIN))
        place = np.arange(n)

        def back(k):
            return np.where(place - k >= start, token[np.maximum(place - k, 0)], begin)

        self.keys, self.which, self.context = [], [], [None]
        for o in range(1, order + 1):
            gram = back(o - 1)
            for k in range(o - 2, -1, -1):
                gram = _mix(gram, back(k))
            keys, which = np.unique(gram, return_inverse=True)
            self.keys.append(keys)
            self.which.append(which.astype(np.int32))
            if o < order:  # the context of order o + 1: this gram one place back, or begin marks only
                empty = begin
                for _ in range(o - 1):
                    empty = _mix(np.array([empty]), np.array([begin]))[0]
                shifted = np.empty(n, np.uint64)
                shifted[1:] = gram[:-1]
                shifted[self.first] = empty
                self.context.append(shifted)

    def training_counts(self, o: int) -> np.ndarray:
        return np.bincount(self.which[o - 1][self.train], minlength=len(self.keys[o - 1]))


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted hashes by their first bits, and where each begins (and the last ends)."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1]) if len(keys) else np.zeros(0, np.int64)
    return bucket[at], np.append(at, len(keys)).astype(np.int64)


REQUEST = "o int, bucket long, chunk long, keys binary, counts binary"


def _requests(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grams = Grams(r["held"], r["lens"], r["tokens"], r["words"], order)
                for o in range(1, order + 1):
                    keys, counts = grams.keys[o - 1], grams.training_counts(o)
                    buckets, at = _cuts(keys, bits)
                    ranges = list(zip(at[:-1], at[1:], strict=True))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([o] * len(ranges), pa.int32()), pa.array(buckets, pa.int64()), pa.array([r["chunk"]] * len(ranges), pa.int64()),
                        pa.array([keys[a:b].tobytes() for a, b in ranges], pa.binary()),
                        pa.array([_small(counts[a:b]).tobytes() for a, b in ranges], pa.binary())], names=["o", "bucket", "chunk", "keys", "counts"])

    return chunks.select("chunk", "held", "lens", "tokens", "words").mapInArrow(run, REQUEST)


def _ints(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Rows of equal first ``keys`` columns, sorted, also over batches."""
    held: list[dict] = []
    for batch in batches:
        names = batch.schema.names[:keys]
        for r in batch.to_pylist():
            if held and any(held[-1][n] != r[n] for n in names):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


REPLY = "chunk long, o int, bucket long, totals binary, owned binary, stats array<bigint>"


def _answer_counts(requests: DataFrame) -> DataFrame:
    """Total counts for each slice; chunk -1 has each bucket's counts of counts, types and tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
            counts = np.concatenate([_ints(r["counts"], len(k)) for r, k in zip(rows, keys, strict=True)])
            ends = np.cumsum([len(k) for k in keys])
            _, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            types = np.bincount(which, weights=counts).astype(np.int64)
            owned = np.zeros(len(which), bool)
            owned[first] = True
            totals = types[which]
            seen = types[types > 0]
            hist = np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[1:K + 2]
            parts = list(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array([*(r["chunk"] for r in rows), -1], pa.int64()), pa.array([rows[0]["o"]] * (len(rows) + 1), pa.int32()),
                pa.array([rows[0]["bucket"]] * (len(rows) + 1), pa.int64()),
                pa.array([*(_small(totals[a:b]).tobytes() for a, b in parts), b""], pa.binary()),
                pa.array([*(np.packbits(owned[a:b]).tobytes() for a, b in parts), b""], pa.binary()),
                pa.array([*([None] * len(rows)), [*hist.tolist(), len(seen), int(seen.sum())]], pa.list_(pa.int64())),
            ], names=["chunk", "o", "bucket", "totals", "owned", "stats"])

    return requests.repartition("o", "bucket").sortWithinPartitions("o", "bucket", "chunk").mapInArrow(run, REPLY)


class Discounts:
    """Good-Turing discounts of one order from its counts of counts n[1..K+1]."""

    def __init__(self, n: list[int]):
        n = [0, *n]
        floor = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        self.d = np.ones(K + 1)
        for c in range(1, K + 1):
            d = (((c + 1) * n[c + 1] / (c * n[c])) - tail) / (1 - tail) if n[c] and tail < 1 else 0.0
            self.d[c] = d if 0 < d < 1 else (c - floor) / c
        self.d[0] = 0.0

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= K, c * self.d[np.minimum(c, K)], c - FLOOR)


class Model:
    """What every chunk needs of the whole training corpus; a few numbers per order."""

    def __init__(self, stats: dict[int, list[int]], texts: int, order: int):
        self.order, self.texts = order, texts
        self.discounts = {o: Discounts(stats.get(o, [0] * (K + 3))[:K + 1]) for o in range(1, order + 1)}
        hist = stats.get(1, [0] * (K + 3))
        self.types, self.tokens = hist[K + 1], hist[K + 2]
        # Order 1: discounted relative counts; the rest is the unknown word's, never nothing.
        low = sum(hist[c - 1] * (c - float(self.discounts[1].of(np.array([c]))[0])) for c in range(1, K + 1))
        low += FLOOR * (self.types - sum(hist[:K]))
        kept = (self.tokens - low) / self.tokens if self.tokens else 0.0
        self.unknown = max(1 - kept, 1 / (self.tokens + self.types + 1)) if self.tokens else 1.0
        self.scale = (1 - self.unknown) / kept if kept else 0.0

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts[1].of(c) / max(self.tokens, 1) * self.scale, self.unknown)


STATE = "kind int, o int, bucket long, chunk long, keys binary, left binary, lower binary, state binary"


def _evaluate(chunk: dict, replies: list[dict], order: int, bits: int, model: Model):
    """Of one chunk: texts' results but for the backoff weights; owners' sums and requests for weights, by context."""
    grams = Grams(chunk["held"], chunk["lens"], chunk["tokens"], chunk["words"], order)
    total, owned = [], []
    by = defaultdict(list)
    for r in replies:
        by[r["o"]].append(r)
    for o in range(1, order + 1):
        keys = grams.keys[o - 1]
        buckets, at = _cuts(keys, bits)
        slices = sorted(by[o], key=lambda r: r["bucket"])
        if [r["bucket"] for r in slices] != buckets.tolist():
            raise RuntimeError("a chunk's counts are incomplete")
        sizes = np.diff(at)
        total.append(np.concatenate([_ints(r["totals"], n) for r, n in zip(slices, sizes, strict=True)]))
        owned.append(np.concatenate([np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=n) for r, n in zip(slices, sizes, strict=True)]).astype(bool))
    count = [t[w] for t, w in zip(total, grams.which, strict=True)]  # by position
    context_count = [None]
    for o in range(2, order + 1):
        c = np.empty_like(count[o - 2])
        c[1:] = count[o - 2][:-1]
        c[grams.first] = model.texts
        context_count.append(c)
    # Probability where the n-gram was counted, by order.
    direct = [model.unigram(count[0])]
    for o in range(2, order + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            direct.append(np.where(count[o - 1] > 0, model.discounts[o].of(count[o - 1]) / context_count[o - 1], 0.0))
    n = len(grams.first)
    log, open_ = np.zeros(n), np.ones(n, bool)
    asks = []  # (order, positions that back off in a context seen in training)
    for o in range(order, 0, -1):
        here = open_ & ((count[o - 1] > 0) | (o == 1))
        log[here] = np.log10(direct[o - 1][here])
        open_ &= ~here
        if o > 1:
            asks.append((o, np.nonzero(open_ & (context_count[o - 1] > 0))[0]))
    doc = np.repeat(np.arange(len(grams.lens)), grams.lens)
    base = np.log10((count[0] + 1) / (model.tokens + model.types + 1))
    state = {"ids": chunk["ids"], "held": grams.held, "n": grams.lens.astype(np.int64), "known": np.bincount(doc[count[0] > 0], minlength=len(grams.lens)),
             "base": np.add.reduceat(base, grams.starts), "score": np.add.reduceat(log, grams.starts), "asks": []}
    out = []
    for o in range(2, order + 1):
        # One position for each owned, counted n-gram.
        some = np.full(len(grams.keys[o - 1]), -1)
        some[grams.which[o - 1]] = np.arange(n)
        own = some[owned[o - 1] & (total[o - 1] > 0)]
        keys, which = np.unique(grams.context[o - 1][own], return_inverse=True)
        c = count[o - 1][own]
        left = np.bincount(which, c - model.discounts[o].of(c), len(keys))
        lower = np.bincount(which, direct[o - 2][own], len(keys))
        whole = np.bincount(which, c, len(keys))
        buckets, at = _cuts(keys, bits)
        out += [(1, o, int(k), keys[a:b].tobytes(), np.concatenate([left[a:b], whole[a:b]]).tobytes(), lower[a:b].tobytes())
                for k, a, b in zip(buckets, at[:-1], at[1:], strict=True)]
    for o, where in asks:
        keys, which = np.unique(grams.context[o - 1][where], return_inverse=True)
        cell, times = np.unique(doc[where].astype(np.int64) * max(len(keys), 1) + which, return_counts=True)
        state["asks"].append((o, len(keys), cell, times))
        buckets, at = _cuts(keys, bits)
        out += [(2, o, int(k), keys[a:b].tobytes(), b"", b"") for k, a, b in zip(buckets, at[:-1], at[1:], strict=True)]
    return state, out


def _backoff(rows: DataFrame) -> DataFrame:
    """Answer requests (kind 2) with log10 alpha from the sums (kind 1) of the same bucket; states (kind 0) pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            if group[0]["o"] == 0:
                for r in group:
                    yield _batch([(r["chunk"], 0, 0, r["state"])])
                continue
            sums = [r for r in group if r["kind"] == 1]
            asked = [r for r in group if r["kind"] == 2]
            if not asked:
                continue
            keys, which = np.unique(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in sums]), return_inverse=True)
            pairs = [np.frombuffer(r["left"]).reshape(2, -1) for r in sums]
            left, whole = (np.bincount(which, np.concatenate([p[i] for p in pairs]), len(keys)) for i in (0, 1))
            lower = np.bincount(which, np.concatenate([np.frombuffer(r["lower"]) for r in sums]), len(keys))
            alpha = np.log10(np.maximum(left / whole, 1e-300)) - np.log10(np.maximum(1 - lower, 1e-300))
            for r in asked:
                at = np.searchsorted(keys, np.frombuffer(r["keys"], np.uint64))
                yield _batch([(r["chunk"], r["o"], r["bucket"], alpha[at].tobytes())])

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                                          names=["chunk", "o", "bucket", "data"])

    placed = rows.select("o", "bucket", "kind", "chunk", "keys", "left", "lower", "state")
    placed = placed.repartition("o", "bucket").sortWithinPartitions("o", "bucket", "kind", "chunk")
    return placed.mapInArrow(run, "chunk long, o int, bucket long, data binary")


def score_texts(docs: DataFrame, order: int = ORDER, text_col: str = "text", id_col: str = "doc_id", holdout: int = 2,
                modulus: int = 7) -> DataFrame:
    """One row per row of docs: its id (as long), held_out, n_tokens, n_known,
    train_tokens, base_score and score (log10 probability of the text).

    Rows whose crc32(id as text) mod ``modulus`` is ``holdout`` do not train;
    a null id counts as the empty string there. Null and empty texts are the
    end mark alone. Without training texts every word is the unknown word, of
    probability 1. Repeated rows train and are scored each. No rows give none.
    """
    import pickle

    spark = docs.sparkSession
    ship_package(spark)
    key = F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")))
    path = shared_path(spark, f"katz-{uuid.uuid4().hex}")
    _write_chunks(docs.select(col(id_col).cast("long").alias("id"), (key % modulus == holdout).alias("held"), col(text_col).cast("string").alias("text")), f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    tokens = chunks.agg(F.sum("n_grams")).first()[0] or 0
    bits = max(0, (tokens * order // BUCKET_KEYS).bit_length())
    _answer_counts(_requests(chunks, order, bits)).write.option("compression", "zstd").parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    sums = counts.where("chunk = -1").select("o", F.posexplode("stats").alias("i", "v")).groupBy("o", "i").agg(F.sum("v").alias("v")).collect()
    stats: dict[int, list[int]] = defaultdict(lambda: [0] * (K + 3))
    for o, i, v in sums:  # K + 3 numbers per order
        stats[o][i] = v
    texts = docs.where(key % modulus != holdout).count()
    model = Model(dict(stats), texts, order)

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        state, out = _evaluate(left.to_pylist()[0], right.to_pylist(), order, bits, model)
        chunk = left.column("chunk")[0].as_py()
        rows = [(0, 0, chunk, chunk, b"", b"", b"", zstandard.compress(pickle.dumps(state), 1)),
                *((kind, o, bucket, chunk, *blobs, b"") for kind, o, bucket, *blobs in out)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["kind", "o", "bucket", "chunk", "keys", "left", "lower", "state"])

    replies = counts.where("chunk >= 0").select("chunk", "o", "bucket", "totals", "owned")
    states = chunks.drop("n_grams").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(evaluate, STATE)

    def finish(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["o"], r["bucket"]))
        state = pickle.loads(zstandard.decompress(rows[0]["data"]))
        score = state["score"].copy()
        for o, n, cell, times in state["asks"]:
            alpha = np.concatenate([np.frombuffer(r["data"]) for r in rows if r["o"] == o] or [np.zeros(0)])
            if n:
                score += np.bincount(cell // n, alpha[cell % n] * times, len(score))
        return pa.table([pa.array(state["ids"], pa.int64()), pa.array(state["held"]), pa.array(state["n"]), pa.array(state["known"], pa.int64()),
                         pa.array([model.tokens] * len(score), pa.int64()), pa.array(state["base"]), pa.array(score)], names=OUT)

    OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    done = _backoff(states).groupBy("chunk").applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("doc_id", id_col)


def op9_katz(spark, sf_dir):
    return score_texts(read_table(spark, sf_dir, "documents"))
