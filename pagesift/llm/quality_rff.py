"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Each whole text becomes a vector of statistics (character classes, words,
lines, repetition). Standardized by the training rows, they are mapped to
random Fourier features whose products approximate a Gaussian kernel. Ridge
coefficients come from the normal equations, summed by partition; the raw
scores are calibrated by isotonic regression (pool adjacent violators) on a
fixed grid of scores and interpolated between its steps.

Scale: texts are read once; the statistics (a few hundred bytes a document)
are checkpointed and used for both training and scoring. What reaches the
driver is of fixed size: the means, SUM_PARTS sums of the normal equations,
GRID calibration cells. All labelled training rows are used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage, ship_package
from .common import col, fresh, map_texts, read_table

FEATURES = 256       # random Fourier features
GAMMA = 0.02         # of the kernel exp(-gamma * |x - y|^2) on standardized statistics
RIDGE = 1e-3         # times the training rows
SEED = 7
GRID = 2048          # calibration cells
SUM_PARTS = 16
CLIP = 6.0           # standardized statistics are cut here, so that odd texts stay near the kernel's support

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b"|", b"!?",
            b"#$%&*@^~", b".,;:", b"\"'()[]{}<>", b"-_=+/\\`", bytes(range(128, 256))]
_OF_CLASS = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _OF_CLASS[list(_c), _i] = 1
N_STATS = len(_CLASSES) + 14


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole text; an empty text is all zeros."""
    n = len(text)
    if not n:
        return [0.0] * N_STATS
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / n
    classes = share @ _OF_CLASS
    seen = share[share > 0]
    words, lines = text.split(), text.split(b"\n")
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    often = Counter(words)
    same = Counter(lines)
    w = max(len(words), 1)
    letters = classes[0] + classes[1] + classes[-1]
    top = max(often.values(), default=0)
    return [*np.sqrt(classes).tolist(), float(np.log1p(n)), float(classes[0] / max(letters, 1e-9)),
            float(-(seen * np.log2(seen)).sum()), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())),
            float(np.log1p(len(often)) / np.log1p(w)), top / w, float((lengths <= 3).mean()),
            float(np.log1p(w / len(lines))), 1 - len(same) / len(lines),
            sum(len(x) * k for x, k in same.items() if k > 1) / n,
            sum(k for x, k in often.items() if not (x[-1:].isalnum() or x[-1] >= 128)) / w,
            sum(k for x, k in often.items() if x.isupper() and len(x) > 1) / w]


def describe(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    def make():
        def fn(texts):
            flat = np.array([statistics(t) for t in texts], np.float64)
            return [pa.array(flat.tobytes()[i * N_STATS * 8:(i + 1) * N_STATS * 8] for i in range(len(texts)))]
        return fn
    return map_texts(docs, [("_stats", "binary")], make, text_col, keep)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, N_STATS)


class Model:
    """Everything a score needs; of fixed size."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, gamma: float = GAMMA, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.features = mean, scale, features
        self.w = rng.normal(0, np.sqrt(2 * gamma), (N_STATS, features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.coef = np.zeros(features + 1)
        self.coef[-1] = 0.5
        self.x = self.y = None

    def phi(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.sqrt(2 / self.features) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.phi(stats) @ self.coef

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return np.clip(np.interp(raw, self.x, self.y) if self.x is not None else raw, 0, 1)


def _summed(rows: DataFrame, size: int, make) -> np.ndarray:
    """Sum of the vectors ``make(batch)`` over all batches: by partition, then in SUM_PARTS parts."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    parts = rows.mapInArrow(first, "v binary").repartition(SUM_PARTS).mapInArrow(again, "v binary")
    return sum((np.frombuffer(r[0]) for r in parts.collect()), np.zeros(size))


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit: (mean x, value) of each pooled block, x ascending."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(training: DataFrame) -> Model:
    """A model from rows (_stats, _y); without rows every score is 0.5."""
    rows = training.select("_stats", "_y")

    def moments(batch):
        s = _matrix(batch.column(0))
        return np.concatenate([[len(s)], s.sum(0), (s * s).sum(0)])

    m = _summed(rows, 1 + 2 * N_STATS, moments)
    n = max(m[0], 1)
    mean = m[1:1 + N_STATS] / n
    spread = np.sqrt(np.maximum(m[1 + N_STATS:] / n - mean * mean, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))
    if not m[0]:
        return model
    d = model.features + 1

    def products(batch):
        phi, y = model.phi(_matrix(batch.column(0))), batch.column(1).to_numpy()
        return np.concatenate([(phi.T @ phi).ravel(), phi.T @ y])

    s = _summed(rows, d * d + d, products)
    a, b = s[:d * d].reshape(d, d), s[d * d:]
    penalty = np.full(d, RIDGE * n)
    penalty[-1] = 0  # the constant is free
    model.coef = np.linalg.solve(a + np.diag(penalty + 1e-9), b)

    def cells(batch):
        raw, y = model.raw(_matrix(batch.column(0))), batch.column(1).to_numpy()
        at = np.clip((raw + 0.5) / 2 * GRID, 0, GRID - 1).astype(int)
        return np.concatenate([np.bincount(at, v, GRID) for v in (np.ones(len(raw)), raw, y)])

    c = _summed(rows, 3 * GRID, cells).reshape(3, GRID)
    full = c[0] > 0
    model.x, model.y = pool_adjacent(c[1][full] / c[0][full], c[2][full] / c[0][full], c[0][full])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  label_col: str = "quality", keep: tuple[str, ...] = ("doc_id",), holdout: int | None = 1) -> DataFrame:
    """held_out, score (0 to 1) and predicted (score >= 0.5) beside the kept columns.

    Rows whose crc32(id as text) mod 3 equals ``holdout`` never train (None:
    all labelled rows train). Only the text enters a score. Null and empty
    texts are scored by their statistics (zeros); a null id is held out by the
    empty string's remainder and never labelled; several labels of one id
    count as their mean; without any label all scores are 0.5; repeated rows
    stay. Result columns replace kept columns of the same name; kept columns called _id_, _held,
    _stats or _words are left out.
    """
    ship_package(docs.sparkSession)
    # Only what is needed goes on, under names of our own beside the kept ones.
    kept = [c for c in keep if c.lower() not in ("held_out", "score", "predicted", "_id_", "_held", "_stats", "_words")]
    stats = describe(docs.select(*[col(c) for c in kept], col(id_col).alias("_id_"), col(text_col).alias("_words")), "_words", ("_id_", *kept))
    stats = stats.withColumn("_held", F.crc32(F.coalesce(F.col("_id_").cast("string"), F.lit(""))) % 3 == (1 if holdout is None else holdout))
    stats = cut_lineage(stats)
    truth = labels.groupBy(col(id_col).alias("_id_")).agg(F.avg(col(label_col).cast("double")).alias("_y")).where("_y is not null")
    training = stats.select("_id_", "_held", "_stats")
    if holdout is not None:
        training = training.where(~F.col("_held"))
    model = fit(cut_lineage(training.join(truth, "_id_")))
    src = stats.select(*[col(c) for c in kept], F.col("_held").alias("held_out"), "_stats")
    schema = StructType(src.schema.fields[:-1]).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return src.mapInArrow(run, schema)


def keep_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 label_col: str = "quality", holdout: int | None = 1) -> DataFrame:
    """The rows of docs with a score of 0.5 or more; columns as they were.

    Trained as score_quality does. Texts are read twice and neither shuffled
    nor written.
    """
    held = F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))) % 3 == (1 if holdout is None else holdout)
    known = docs.select(col(id_col).alias("_id_"), held.alias("_held"), col(text_col).alias("_t"))
    if holdout is not None:
        known = known.where(~F.col("_held"))
    truth = labels.groupBy(col(id_col).alias("_id_")).agg(F.avg(col(label_col).cast("double")).alias("_y")).where("_y is not null")
    model = fit(cut_lineage(describe(known, "_t", ("_id_",)).join(truth, "_id_")))

    def make():
        return lambda texts: [model.score(np.array([statistics(t) for t in texts]).reshape(-1, N_STATS))]

    score = fresh(docs, "_score_")
    scored = map_texts(docs, [(score, "double")], make, text_col, tuple(docs.columns))
    return scored.where(col(score) >= 0.5).select(*[col(c) for c in docs.columns])


def op7_quality_rff(spark, sf_dir):
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
