"""Sharding by vector bin packing.

Documents go to shards of near equal bytes, tokens and rows. What is placed is
a group of equal texts, as a vector of its shares of a shard's capacity in the
three sizes; it goes to the shard where the dot product of the vector with the
capacity left is highest (ties: the lowest shard), larger groups first. Bytes,
whose evenness is promised, weigh more in the product than the other two:
what comes last are small texts, which otherwise only even out rows.

Scale: texts are read once and become rows of fixed size. Groups of more than
1/HEAVY of a capacity in any size are at most 3 * shards * HEAVY; they are
placed one after the other, those above SPLIT of a capacity (copies of one
text) in equal pieces of at most PIECE. The other groups are hashed over partitions, and each
partition places its own into its share of what is left; every partition ends
even to within a small document, so the sum does. A group's rows meet in one
task only where the group is light: the rows of heavy ones never move, they
look their shard up in a table of that bounded size. Places inside shards are
offsets of the tasks' counts.

The law kept is `bytes`; equal texts share a shard unless they are split. A
single text larger than a shard's share cannot be split and makes its shard
larger than the rest. Null texts are empty (size 1: bytes plus 1); null ids
and repeated rows are rows like any other. No rows give no rows. Kept columns
of the same name as a result column give way to it.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage
from .common import col, fresh, map_texts, read_table

SHARDS = 16
HEAVY = 256                 # a heavy group has more than 1/HEAVY of a shard's capacity
SPLIT, PIECE = 0.25, 1 / 32  # groups above the one share of a capacity are split into pieces of at most the other
WEIGHTS = (64.0, 1.0, 1.0)  # of bytes, tokens and rows in the dot product
PARTITION_ROWS = 1 << 18    # rows of light groups that one task places
DIMS = ("size", "tokens", "_one")
MADE = [("size", "bigint"), ("text_crc32", "bigint"), ("tokens", "bigint"), ("_hash", "bigint"), ("_hash2", "bigint")]


def place(vectors: np.ndarray, left: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each vector (in order); ``left`` (shards x sizes) is used up."""
    out = np.empty(len(vectors), np.int64)
    for i, (v, w) in enumerate(zip(vectors, vectors * np.array(weights), strict=True)):
        j = int((left @ w).argmax())
        left[j] -= v
        out[i] = j
    return out


def descending(vectors: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """Order of placing: the largest share first; ties by the group's hash."""
    return np.lexsort((*ties[::-1], -vectors.sum(1), -vectors.max(1, initial=0)))


def measured(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Size, crc, tokens (words between white space) and 128 bits of hash of each text."""
    def make():
        def fn(texts):
            hashes = np.array([divmod(xxhash.xxh3_128_intdigest(t), 1 << 64) for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
            return [[len(t) + 1 for t in texts], [zlib.crc32(t) for t in texts], [len(t.split()) for t in texts],
                    pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
        return fn
    return map_texts(docs, MADE, make, text_col, keep)


def _placed_light(rows: DataFrame, capacity: np.ndarray, left: np.ndarray, light: np.ndarray) -> DataFrame:
    """Each partition's groups, placed into its share of the capacity left."""
    names = rows.columns
    at = [names.index(c) for c in ("size", "tokens", "_hash", "_hash2")]

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        size, tokens, h, h2 = (table.column(i).to_numpy() for i in at)
        order = np.lexsort((h2, h))
        starts = np.nonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(h2[order]) != 0)]))[0]
        first, copies = order[starts], np.diff(np.append(starts, len(order)))
        vectors = np.stack([size[first] * copies, tokens[first] * copies, copies], 1) / capacity
        share = np.divide(vectors.sum(0), light, out=np.zeros(3), where=light > 0)
        by_size = descending(vectors, h[first], h2[first])
        shard = np.empty(len(first), np.int64)
        shard[by_size] = place(vectors[by_size], left * share)
        of_row = np.empty(len(order), np.int64)
        of_row[order] = np.repeat(shard, copies)
        yield from table.append_column("shard", pa.array(of_row)).to_batches()

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("shard", LongType())]))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with the task's number and each row's place among the task's rows of its shard."""
    at = rows.columns.index("shard")

    def run(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            shard = batch.column(at).to_numpy()
            places = np.empty(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                mine = shard == s
                n = int(mine.sum())
                places[mine] = np.arange(n) + seen.get(s, 0)
                seen[s] = seen.get(s, 0) + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), task)), pa.array(places)],
                                             names=[*batch.schema.names, "_task", "_place"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_task", LongType()), StructField("_place", LongType())]))


def pack(docs: DataFrame, n_shards: int = SHARDS, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
         heavy_share: int = HEAVY, split_share: float = SPLIT, piece_share: float = PIECE, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """The kept columns, size, text_crc32, tokens, shard and slot (0, 1, ... in each shard) of every row."""
    spark = docs.sparkSession
    result = {"size", "text_crc32", "tokens", "shard", "slot"}
    keep = tuple(c for c in keep if c.lower() not in result)
    # Kept columns travel under names of their own, so they cannot clash with the columns used here.
    inner = [f"keep_{i}" for i in range(len(keep))]
    src = docs.select(*[col(c).alias(i) for c, i in zip(keep, inner, strict=True)], col(text_col).alias("text"))
    base = cut_lineage(measured(src, "text", tuple(inner)))  # fixed partitions: row numbers and pieces stay the same
    n, size, tokens = base.agg(F.count(F.lit(1)), F.sum("size"), F.sum("tokens")).first()
    capacity = np.maximum(np.array([size or 0, tokens or 0, n], np.float64) / n_shards, 1e-9)
    groups = base.groupBy("_hash", "_hash2").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    share = F.greatest(F.col("size") * F.col("n") / float(capacity[0]), F.col("tokens") * F.col("n") / float(capacity[1]), F.col("n") / float(capacity[2]))
    heavy = groups.withColumn("share", share).where(F.col("share") > 1.0 / heavy_share).orderBy("_hash", "_hash2").collect()  # 3 * shards * heavy_share at most

    pieces = [(g, min(g.n, math.ceil(g.share / piece_share)) if g.share > split_share else 1) for g in heavy]
    numbered = base.withColumn("_row", F.monotonically_increasing_id())
    table = spark.createDataFrame([(g["_hash"], g["_hash2"], m) for g, m in pieces], "_h long, _h2 long, _pieces int")
    marked = numbered.join(F.broadcast(table), (F.col("_hash") == F.col("_h")) & (F.col("_hash2") == F.col("_h2")), "left").drop("_h", "_h2")
    marked = marked.withColumn("_piece", F.pmod("_row", F.col("_pieces").cast("long")))
    split = {(g["_hash"], g["_hash2"]) for g, m in pieces if m > 1}
    counted = {}
    if split:
        for r in marked.where("_pieces > 1").groupBy("_hash", "_hash2", "_piece").agg(F.count(F.lit(1)).alias("n")).collect():
            counted[(r["_hash"], r["_hash2"], r["_piece"])] = r.n
    parts = [(g, p, counted.get((g["_hash"], g["_hash2"], p), 0) if m > 1 else g.n) for g, m in pieces for p in range(m)]
    vectors = np.array([(g.size * c, g.tokens * c, c) for g, _, c in parts], np.float64).reshape(-1, 3) / capacity
    left = np.ones((n_shards, 3))
    order = descending(vectors, np.array([g["_hash"] for g, _, _ in parts], np.int64), np.array([p for _, p, _ in parts], np.int64))
    shards = np.empty(len(parts), np.int64)
    shards[order] = place(vectors[order], left)
    light = np.array([size or 0, tokens or 0, n], np.float64) / capacity - vectors.sum(0)

    where = spark.createDataFrame([(g["_hash"], g["_hash2"], p, int(s)) for (g, p, _), s in zip(parts, shards, strict=True)],
                                  "_h long, _h2 long, _p long, shard long")
    rows = [*inner, *(c for c, _ in MADE)]
    of_heavy = marked.where("_pieces IS NOT NULL").join(
        F.broadcast(where), (F.col("_hash") == F.col("_h")) & (F.col("_hash2") == F.col("_h2")) & (F.col("_piece") == F.col("_p"))).select(*rows, "shard")
    n_light = n - sum(c for _, _, c in parts)
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_light // 1000), math.ceil(n_light / partition_rows))
    of_light = _placed_light(marked.where("_pieces IS NULL").select(*rows).repartition(tasks, "_hash", "_hash2"), capacity, left, light)
    placed = cut_lineage(_numbered(of_heavy.unionByName(of_light).drop("_hash", "_hash2")))
    # One row a task and shard.
    counts = placed.groupBy("_task", "shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), ["_task", "shard"]).select(
        *[F.col(i).alias(c) for c, i in zip(keep, inner, strict=True)], "size", "text_crc32", "tokens",
        F.col("shard").cast("int").alias("shard"), (F.col("_offset") + F.col("_place")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, text_col: str = "text") -> None:
    """Write whole rows as one folder per shard, in the order of their slots inside each file."""
    names = tuple(docs.columns)
    packed = pack(docs, n_shards, text_col, names)
    # A shard is cut into files by the hash of its slots' blocks, so no task writes a whole shard.
    block = fresh(packed, "block")
    packed.withColumn(block, F.floor(F.col("slot") / 100_000)).repartition(F.col("shard"), F.col(block)) \
        .sortWithinPartitions("shard", "slot").drop(block).write.partitionBy("shard").parquet(path)


def op11_shard_packing(spark, sf_dir):
    packed = pack(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "tokens")
