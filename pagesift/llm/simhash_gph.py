"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: lower-cased (A-Z) words, shingles of ``shingle`` words, XXH64
(seed 42) of each shingle, a bit for each majority. Links: distinct
fingerprints at most ``distance`` bits apart.

Search: the 64 bits are grouped into m partitions so that correlated bits lie
together. Two fingerprints within ``distance`` bits are within t_p bits in
some partition p whenever the thresholds sum to distance - m + 1. A dynamic
programme gives each partition the threshold (-1: not probed) that makes the
estimated candidates plus keys fewest, over m from 1 to distance + 1; the
estimates come from counts over all fingerprints. A partition of threshold t
is probed by keys (mask, value): its bits with any t of them left out.
Fingerprints that share a key are verified by their whole distance.

Scale: equal fingerprints are one row from the start. A key that too many
fingerprints share is split again by the same principle on the remaining bits
(exact; no cap), so no bucket grows with a group of near copies. Buckets are
verified in vectorised blocks and give a spanning forest, never all pairs;
the forests are joined by star contraction, checkpointed each round. Only the
64 x 64 bit counts and the partition sizes reach the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import col, fresh, map_texts, read_table

SEED = 42
BITS = 64
# Fingerprints in one bucket before it is split further, and compared pairs held at a time.
BUCKET_ROWS = 4096
PAIR_BLOCK = 2_000_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(itertools.accumulate(map(len, words)))
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(BITS, np.int64), n - shingle + 1
    starts = [0, *[e + i + 1 for i, e in enumerate(ends[:count - 1])]]
    stops = [e + i + shingle - 1 for i, e in enumerate(ends[shingle - 1:])]
    for at in range(0, count, 1 << 16):  # bounds the bit matrix of a very long text
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)], strict=True)), "<u8")
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id",), name: str = "_fp") -> DataFrame:
    """The 64-bit fingerprint (as a signed long) of each whole text; no words: 0."""
    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]
    return map_texts(docs, [(name, "bigint")], make, text_col, keep)


# --- partitions and thresholds -------------------------------------------------

def _bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for each two bits the rows that have both set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            v = batch.column(0).to_numpy().astype(np.int64).view(np.uint8)
            for at in range(0, len(v), 8 << 16):
                b = np.unpackbits(v[at:at + (8 << 16)], bitorder="little").reshape(-1, BITS).astype(np.float32)
                both += b.T @ b
                n += len(b)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(i * BITS + j)], pa.int32()), pa.array([n, *both[i, j].astype(np.int64)], pa.int64())], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for cell, count in rows:  # at most 64 * 64 + 1
        if cell < 0:
            n = count
        else:
            both[cell // BITS, cell % BITS] = count
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size; each takes in turn the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        rest = sorted(left)
        group = [max(rest, key=lambda b: corr[b, rest].sum())]
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda b: corr[b, group].sum()))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _distances(p: np.ndarray, most: int) -> list[float]:
    """Chance of at most t differing bits (independent bits with set rates p)."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist).tolist()


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one per partition, that sum to total at least cost.

    cost[p][t]: of partition p at threshold t; threshold -1 is free. Dynamic
    programme over partitions and the sum so far.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, len(row)):
                new = (c + (row[t] if t >= 0 else 0.0), [*ts, t])
                if used + t not in step or new < step[used + t]:
                    step[used + t] = new
        best = step
    return best[total]


def plan(fps: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, threshold -1 left out."""
    n, both = _bit_counts(fps)
    p = np.diag(both) / max(n, 1)
    layouts = {m: group_bits(n, both, m) for m in range(1, distance + 2)}
    masks = [(m, k, _signed(mask_of(g))) for m, groups in layouts.items() for k, g in enumerate(groups)]
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v"))
                                           for i, (_, _, mask) in enumerate(masks)])).alias("k")).select("k.*")
    same = {r[0]: r[1] for r in keyed.groupBy("i", "v").agg(F.count("*").cast("double").alias("c"))
            .groupBy("i").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2)).collect()}
    best = None
    for m, groups in layouts.items():
        cost = []
        for k, g in enumerate(groups):
            i = next(i for i, x in enumerate(masks) if x[:2] == (m, k))
            chance = _distances(p[g], distance)
            row = []
            for t in range(0, min(distance, 2) + 1):
                # Pairs that agree on all bits are counted; the estimate carries them on to t bits.
                candidates = max(same.get(i, 0), n * n / 2 * chance[0]) * chance[t] / max(chance[0], 1e-300)
                row.append(0.02 * candidates + n * math.comb(len(g), t))  # a key is shuffled, a pair only compared
            cost.append(row)
        total = distance - m + 1
        if total <= len(groups) * min(distance, 2):
            found = allocate(cost, total)
            if best is None or found[0] < best[0]:
                best = (*found, groups)
    return [(g, t) for g, t in zip(best[2], best[1], strict=True) if t >= 0]


# --- probing and verifying -------------------------------------------------

def _key_masks(parts: list[tuple[list[int], int]]) -> list[int]:
    return sorted({_signed(mask_of(set(g) - set(out))) for g, t in parts for out in itertools.combinations(g, min(t, len(g)))})


def _split_hot(keyed: DataFrame, distance: int) -> DataFrame:
    """Split keys that more than BUCKET_ROWS fingerprints share.

    Those agree on the mask, so they differ in at most ``distance`` of the
    other bits: cut these into distance + 1 parts, one of which must agree.
    Repeated until no bucket is large or fewer bits than parts are left (then
    a bucket holds few distinct values anyway).
    """
    done = None
    while True:
        hot = keyed.groupBy("mask", "value").count().where((F.col("count") > BUCKET_ROWS) & (F.bit_count(F.bitwise_not("mask")) > distance)).select("mask", "value")
        hot = cut_lineage(hot)
        if hot.isEmpty():
            return keyed if done is None else done.unionByName(keyed)
        cold = keyed.join(hot, ["mask", "value"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        masks = []
        for row in hot.select("mask").distinct().collect():  # one of the plan's masks each
            free = [b for b in range(BITS) if not row[0] >> b & 1]
            size = math.ceil(len(free) / (distance + 1))
            masks += [(row[0], _signed((row[0] & (1 << 64) - 1) | mask_of(free[i:i + size]))) for i in range(0, len(free), size)]
        finer = keyed.sparkSession.createDataFrame(masks, "mask long, finer long")
        keyed = keyed.join(hot, ["mask", "value"], "left_semi").join(F.broadcast(finer), "mask") \
            .select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("value"))
        keyed = cut_lineage(keyed.distinct())


class Forest:
    """Vectorised union-find over positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while len(a):
            ra, rb = parent[a], parent[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            ra, rb = ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]


def bucket_links(fp: np.ndarray, bucket: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within buckets; rows are sorted by bucket number."""
    n = len(fp)
    forest = Forest(n)
    last = np.searchsorted(bucket, bucket, side="right") - np.arange(n) - 1  # rows of the bucket that follow
    rows = np.nonzero(last > 0)[0]
    step, held_a, held_b, held = 1, [], [], 0
    while len(rows):
        near = np.bitwise_count(fp[rows] ^ fp[rows + step]) <= distance
        held_a.append(rows[near])
        held_b.append(rows[near] + step)
        held += int(near.sum())
        if held > PAIR_BLOCK:
            forest.join(np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b, held = [], [], 0
        step += 1
        rows = rows[last[rows] >= step]
    if held:
        forest.join(np.concatenate(held_a), np.concatenate(held_b))
    child = np.nonzero(forest.parent != np.arange(n))[0]
    return fp[child], fp[forest.parent[child]]


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all within ``distance`` bits."""
    masks = _key_masks(plan(fps, distance))
    keyed = fps.select("fp", F.explode(F.lit(masks).cast("array<bigint>")).alias("mask")) \
        .withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    keyed = _split_hot(keyed, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of a bucket that may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                block = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
                rest = block if rest is None else np.concatenate([rest, block])
                if not len(rest):
                    continue
                open_ = (rest[:, 1:] == rest[-1, 1:]).all(1)
                ready, rest = rest[~open_], rest[open_]
            else:
                ready = rest
            if ready is None or not len(ready):
                continue
            turn = np.concatenate([[0], np.cumsum((ready[1:, 1:] != ready[:-1, 1:]).any(1))])
            a, b = bucket_links(ready[:, 0].copy().view(np.uint64), turn, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    buckets = keyed.select("fp", "mask", "value").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return buckets.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating stars.

    Each round sends every node's larger neighbours, then its smaller ones, to
    its smallest neighbour; the rounds grow with the logarithm of the longest
    path. Each round is checkpointed.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.*").where("u <> v").distinct()
        small = cut_lineage(small)
        # Stars: every node has one parent, and no parent has one.
        many = small.groupBy("u").count().where("count > 1").limit(1)
        deep = small.select("u").join(small.select(F.col("v").alias("u")), "u", "left_semi").limit(1)
        edges = small
        if many.select("u").unionByName(deep).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, text_col: str = "text",
                    id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id among all documents reachable over links
    of at most ``distance`` bits, the document itself included. Null and empty
    texts have fingerprint zero and link like any other; kept columns called
    _fp, _root or fp are left out; texts shorter than a
    shingle are one shingle; repeated rows stay; null ids stay and count for
    no component's id (null where a component has no other).
    """
    keep = [c for c in dict.fromkeys((id_col, *keep)) if c.lower() not in ("_fp", "_root", "fp")]
    prints = cut_lineage(fingerprints(docs, shingle, text_col, tuple(keep), "_fp"))
    return with_components(prints, id_col, distance) \
        .withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0"))).drop("_fp", "_root")


def with_components(prints: DataFrame, id_col: str, distance: int) -> DataFrame:
    """prints with component_id and the component's root fingerprint (_root)."""
    first = cut_lineage(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min(col(id_col)).alias("low")))
    stars = cut_lineage(components(links(first.select("fp"), distance)))
    # Fingerprints with their component's root, then the root's smallest id.
    rooted = first.join(stars, first.fp == stars.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lows, "root").select(F.col("fp").alias("_fp"), "component_id", F.col("root").alias("_root"))
    return prints.select(*[col(c) for c in prints.columns if c.lower() not in ("component_id", "fingerprint")]).join(classes, "_fp")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without near duplicates: of each component the row of the smallest id.

    Of several rows with that id the one of the smallest text hash stays, of
    equal rows one; a component of null ids keeps one row. All columns stay.
    """
    identity = [col(id_col), F.xxhash64(F.coalesce(col(text_col), F.lit("")))]
    key = [c.alias(n) for c, n in zip(identity, ("_id", "_hash"), strict=True)]
    prints = cut_lineage(fingerprints(docs.select(*key, col(text_col).alias("_t")), shingle, "_t", ("_id", "_hash"), "_fp"))
    classed = with_components(prints, "_id", distance)
    best = classed.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_hash")).alias("w")).select("w._id", "w._hash")
    mine = [fresh(docs, "_id"), fresh(docs, "_hash")]
    marked = docs.select("*", *[c.alias(n) for c, n in zip(identity, mine, strict=True)])
    best = best.toDF("w_id", "w_hash").select(F.struct("w_id", "w_hash").alias(fresh(docs, "_best")))
    won = col(best.columns[0])
    same = col(mine[0]).eqNullSafe(won["w_id"]) & (col(mine[1]) == won["w_hash"])
    return marked.join(best, same, "left_semi").dropDuplicates(mine).drop(*mine)


def op6_simhash_gph(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))
