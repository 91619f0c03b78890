"""Exact top-k over sparse vectors by postings in impact order.

The index is cut into shards of a few thousand rows, made where the rows lie.
A shard holds its vectors and, per bucket, the postings (row, weight) with the
largest weights first, in blocks whose first weight is their maximum. A query
reads its buckets' blocks from the largest possible contribution downwards;
what it has not read can add at most the sum of the next blocks' maxima. Once
that bound is below the k-th best sum so far, no unread row can be among the
k best, the rest of the postings is skipped, and the rows whose sum plus bound
can still reach are scored exactly from their vectors. Weights are not
negative. No (row, query) pair becomes a row of a table, and a bucket that
nearly every row has is spread over all shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BROADCAST_MAX_BYTES
from ..session import cut_lineage, ship_package
from .topk import BLOCK_ROWS, CAND_SCHEMA, _final_rank, _key_np, _list_to_matrix, _pack, _unpack

SHARD_ROWS = 4096
BLOCK = 32          # postings of a block
STEP = 0.7          # each round reads blocks that can add at least this share of the last round's limit
INDEX_SCHEMA = ("shard long, ids array<long>, row_starts array<int>, row_buckets array<int>, row_weights array<float>, "
                "buckets array<int>, list_starts array<int>, list_rows array<int>, list_weights array<float>")


class Shard:
    """Vectors by row (ids, row_*) and by bucket in impact order (buckets, list_*)."""

    def __init__(self, ids, row_starts, row_buckets, row_weights, buckets, list_starts, list_rows, list_weights):
        self.ids, self.row_starts, self.row_buckets, self.row_weights = ids, row_starts, row_buckets, row_weights
        self.buckets, self.list_starts, self.list_rows, self.list_weights = buckets, list_starts, list_rows, list_weights
        self.block_max = None

    @classmethod
    def of(cls, ids: np.ndarray, starts: np.ndarray, buckets: np.ndarray, weights: np.ndarray) -> Shard:
        if (weights < 0).any():
            raise ValueError("weights must not be negative")
        rows = np.repeat(np.arange(len(ids)), np.diff(starts))
        order = np.lexsort((rows, -weights, buckets))
        found, first = np.unique(buckets[order], return_index=True)
        return cls(ids, starts, buckets, weights, found, np.append(first, len(order)), rows[order], weights[order])

    def columns(self) -> list:
        return [self.ids, self.row_starts, self.row_buckets, self.row_weights, self.buckets, self.list_starts, self.list_rows, self.list_weights]

    def _blocks(self) -> None:
        """Per block: its list, its postings and its first, largest weight."""
        sizes = np.diff(self.list_starts)
        self.blocks_of = (sizes + BLOCK - 1) // BLOCK
        self.first_block = np.concatenate([[0], np.cumsum(self.blocks_of)])
        self.block_list = np.repeat(np.arange(len(sizes)), self.blocks_of)
        inside = np.arange(len(self.block_list)) - self.first_block[self.block_list]
        self.block_start = self.list_starts[self.block_list] + inside * BLOCK
        self.block_size = np.minimum(BLOCK, self.list_starts[self.block_list + 1] - self.block_start)
        self.block_max = self.list_weights[self.block_start].astype(np.float64)

    def topk(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(rows, scores) that hold the k best of this shard for a dense query, and postings read and held for it."""
        if (q < 0).any():
            raise ValueError("weights must not be negative")
        if self.block_max is None:
            self._blocks()
        n, asked = len(self.ids), q[self.buckets]
        can_add = asked[self.block_list] * self.block_max
        order = np.nonzero(can_add > 0)[0]
        order = order[np.argsort(-can_add[order], kind="stable")]  # in every list the blocks keep their order
        falling = can_add[order]
        sums, taken = np.zeros(n), np.zeros(len(self.buckets), np.int64)
        read, at, kth = 0, 0, -np.inf
        rest = float((asked * self.block_max[self.first_block[:-1]]).sum()) if len(order) else 0.0
        limit = float(falling[0]) if len(order) else 0.0
        while at < len(order) and not (kth > -np.inf and _key_np(np.float64(rest + 1e-9)) < _key_np(np.float64(kth))):
            limit *= STEP
            stop = max(at + 1, int(np.searchsorted(-falling, -limit, side="right")))
            blocks = order[at:stop]
            at, sizes = stop, self.block_size[blocks]
            postings = _ranges(self.block_start[blocks], sizes)
            sums += np.bincount(self.list_rows[postings], self.list_weights[postings] * np.repeat(asked[self.block_list[blocks]], sizes), n)
            read += len(postings)
            taken += np.bincount(self.block_list[blocks], minlength=len(taken))
            open_ = np.nonzero((taken < self.blocks_of) & (asked > 0))[0]
            rest = float(can_add[self.first_block[open_] + taken[open_]].sum())
            if n > k:
                kth = float(np.partition(sums, n - k)[n - k])
        low = -np.inf if n <= k else _key_np(np.float64(kth))
        rows = np.nonzero(_key_np(sums + rest + 1e-9) >= low)[0]
        sizes = self.row_starts[rows + 1] - self.row_starts[rows]
        at = _ranges(self.row_starts[rows], sizes)
        scores = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.row_weights[at] * q[self.row_buckets[at]], len(rows))
        return rows, scores, read, int(self.block_size[order].sum())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def build_postings(points: DataFrame, id_col: str = "id", vec_col: str = "vector", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Shards (one row each, INDEX_SCHEMA) of the rows of each partition; null vectors are left out.

    ``vec_col``: struct<indices: array<int>, values: array<float>>, as a sparse encoder gives it.
    """
    ship_package(points.sparkSession)
    src = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))  # no filter here: it would encode twice

    def run(batches):
        held, rows, number = [], 0, TaskContext.get().partitionId() << 32

        def shard(parts, number):
            ids = np.concatenate([p[0] for p in parts])
            starts = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])
            made = Shard.of(ids, starts, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])).columns()
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float32(), pa.int32(), pa.int32(), pa.int32(), pa.float32()]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, t)) for c, t in zip(made, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *arrays],
                                              names=[f.split()[0] for f in INDEX_SCHEMA.split(", ")])

        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for at in range(0, batch.num_rows, shard_rows):
                part = batch.slice(at, min(shard_rows, batch.num_rows - at))
                idx, val = (pa.compute.struct_field(part.column(1), name) for name in ("indices", "values"))
                held.append((part.column(0).to_numpy(), pa.compute.list_value_length(idx).to_numpy(),
                             idx.flatten().to_numpy(zero_copy_only=False), val.flatten().to_numpy(zero_copy_only=False)))
                rows += part.num_rows
                if rows >= shard_rows:
                    yield shard(held, number)
                    held, rows, number = [], 0, number + 1
        if held:
            yield shard(held, number)

    return src.mapInArrow(run, INDEX_SCHEMA)


def _scan(index: DataFrame, queries: DataFrame, k: int, schema: str, emit, max_broadcast_bytes: int) -> DataFrame:
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("qvec"),
                       F.lit(int(k)).alias("k")).where("qvec is not null")
    packed = cut_lineage(_pack(q, False, BLOCK_ROWS))
    size = packed.agg(F.sum(F.octet_length("block"))).first()[0] or 0
    parts = max(1, math.ceil(size / max_broadcast_bytes))
    blocks = packed.select("block")  # measured: broadcast within the budget only
    pairs = index.crossJoin(F.broadcast(blocks) if parts == 1 else blocks.repartition(parts))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(*(c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns[1:9]))
                asked = _unpack(batch.column(9)[i].as_buffer())
                width = int(asked.column(1).value_lengths()[0].as_py())
                _, mat = _list_to_matrix(asked.column(1), width)
                yield emit(shard, asked.column(0).to_numpy(), mat)

    return pairs.mapInArrow(run, schema)


def postings_topk(index: DataFrame, queries: DataFrame, k: int, max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """The k best rows of every query: (query_id, rank, id, score), equal to the exact scan.

    ``queries``: query_id and a dense ``vector``. Ties go to the smaller id.
    """
    def emit(shard, qids, mat):
        out = [[], [], []]
        for qid, q in zip(qids.tolist(), mat, strict=True):
            rows, scores, _, _ = shard.topk(q, k)
            best = np.lexsort((shard.ids[rows], -_key_np(scores)))[:k]
            for c, x in zip(out, ([qid] * len(best), shard.ids[rows[best]].tolist(), scores[best].tolist()), strict=True):
                c += x
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()),
                                           pa.array([k] * len(out[0]), pa.int32())], names=["query_id", "id", "score", "k"])

    return _final_rank(_scan(index, queries, k, CAND_SCHEMA, emit, max_broadcast_bytes), k, 1, [], ["query_id"])


def postings_read(index: DataFrame, queries: DataFrame, k: int, max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """(query_id, n_read, n_postings): postings that each query reads, of those in its buckets."""
    def emit(shard, qids, mat):
        found = [shard.topk(q, k)[2:] for q in mat]
        return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array([r for r, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())],
                                          names=["query_id", "n_read", "n_postings"])

    scanned = _scan(index, queries, k, "query_id long, n_read long, n_postings long", emit, max_broadcast_bytes)
    return scanned.groupBy("query_id").agg(F.sum("n_read").alias("n_read"), F.sum("n_postings").alias("n_postings"))
