"""Exact substring deduplication with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else (same text included) is removed; judged on the input.

Which strings can be repeated at all is settled by content: each window of
``length`` bytes chooses an anchor, the place of its smallest 16-byte hash
within its first bytes; equal windows choose the same place. The windows of
one anchor are a unit; they share a core from the anchor on. Units whose core
occurs once hold no repeated window, units that are equal as a whole hold only
repeated ones. Of the others, one copy each goes on: cut into finer units
(same rule, a narrower choice), each as its core and the few bytes left and
right of it. Those with the same core are put into one sequence, the core as
one symbol, and its suffix array (linear grouping construction, see
suffix_groups) brings equal windows together: a window is repeated where it
has its whole length in common with a neighbour of the array.

Scale: documents are cut into chunks of bounded size, written compressed to
the shared folder. A chunk's units go to buckets by their hash and answers
come back, one entry per chunk and unit, so a passage that a third of all
documents share is one entry per chunk, and copies of a text inside a chunk
are one text. Suffix arrays are built over bounded blocks; where more than
GROUP different surroundings of one core come together, each of their windows
is counted by its hash instead (Spark's aggregation, exact, no cap).
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
from .katz import _cuts, _groups
from .suffix_groups import suffix_array

LENGTH = 400
WIDE, NARROW = 200, 32      # choices for anchors: of units, of fine units
GRAM = 16
CHUNK_BYTES = 16 << 20
BUCKET_UNITS = 1 << 19      # entries of one bucket, on average
GROUP = 4096                # surroundings of one core in one suffix array
SYMBOLS = 1 << 18           # symbols of one suffix array
SPAN = 1 << 20              # windows handled by one vectorised pass
_POS = np.uint64((1 << 21) - 1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def _anchors(x: np.ndarray, windows: int, choice: int) -> np.ndarray:
    """Anchor of each of the first windows: leftmost smallest hash among ``choice`` places."""
    eight = np.ndarray((len(x) - 7,), "<u8", x, strides=(1,))
    h = _mix(_mix(eight[:-8] * _M1) + eight[8:] * _M2)[:windows + choice - 1]
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    low, width = key, 1
    while 2 * width <= choice:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = choice - width
    if rest:
        low = np.minimum(low[:len(low) - rest], low[rest:])
    return (low[:windows] & _POS).astype(np.int64)


def units(text: bytes, first: int, last: int, choice: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of the units among windows first..last of a text."""
    out = ([], [], [])
    for at in range(first, last + 1, SPAN):
        n = min(SPAN, last + 1 - at)
        a = _anchors(np.frombuffer(text, np.uint8, n + length - 1, at), n, choice)
        cut = np.nonzero(np.diff(a))[0] + 1
        low = np.concatenate([[0], cut])
        out[0].append(a[low] + at)
        out[1].append(low + at)
        out[2].append(np.concatenate([cut - 1, [n - 1]]) + at)
    return tuple(np.concatenate(o) for o in out) if out[0] else (np.zeros(0, np.int64),) * 3


CHUNK = "chunk long, ids array<bigint>, lens binary, texts binary, n_bytes long"


def _write_chunks(docs: DataFrame, path: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        chunk, ids, texts, size = TaskContext.get().partitionId() << 24, [], [], 0

        def done():
            row = [[chunk], [ids], [np.array([len(t) for t in texts], np.int64).tobytes()], [zstandard.compress(b"".join(texts), 3)], [size]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["chunk", "ids", "lens", "texts", "n_bytes"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield done()
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield done()

    docs.mapInArrow(run, CHUNK).write.parquet(path)


class Chunk:
    """Texts of a chunk, each different one once, and the units of those that are long enough."""

    def __init__(self, row: dict, length: int, choice: int):
        data, ends = zstandard.decompress(row["texts"]) if row["n_bytes"] else b"", np.cumsum(np.frombuffer(row["lens"], np.int64))
        texts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        number: dict[bytes, int] = {}
        self.of_row = [number.setdefault(t, len(number)) for t in texts]
        self.texts = list(number)
        copies = np.bincount(self.of_row, minlength=len(self.texts))
        doc, anchor, low, high, key, whole, times = [], [], [], [], [], [], []
        digest = xxhash.xxh3_64_intdigest
        core = length - choice
        for d, t in enumerate(self.texts):
            if len(t) < length:
                continue
            a, p, q = units(t, 0, len(t) - length, choice, length)
            doc.append(np.full(len(a), d))
            anchor.append(a)
            low.append(p)
            high.append(q)
            key.append(np.fromiter((digest(t[i:i + core]) for i in a.tolist()), np.uint64, len(a)))
            whole.append(np.fromiter((digest(t[i:j]) for i, j in zip(p.tolist(), (q + length).tolist(), strict=True)), np.uint64, len(a)))
            times.append(np.full(len(a), copies[d]))

        def join(parts, kind):
            return np.concatenate(parts) if parts else np.zeros(0, kind)

        self.doc, self.anchor, self.low, self.high = (join(x, np.int64) for x in (doc, anchor, low, high))
        key, whole, times = join(key, np.uint64), join(whole, np.uint64), join(times, np.int64)
        # Different (core, unit) entries in order of the core's hash, and how often each occurs.
        order = np.lexsort((whole, key))
        k, w = key[order], whole[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
        entry = np.cumsum(fresh) - 1
        self.entry = np.empty(len(k), np.int64)
        self.entry[order] = entry
        self.keys, self.wholes = k[fresh], w[fresh]
        self.times = np.minimum(np.bincount(entry, times[order], int(fresh.sum())), 2).astype(np.uint8)
        self.sample = np.empty(len(self.keys), np.int64)  # one unit of each entry
        self.sample[entry] = order


def _slices(keys: np.ndarray, bits: int, chunk: int, *columns) -> Iterator[tuple]:
    buckets, at = _cuts(keys, bits)
    for k, a, b in zip(buckets.tolist(), at[:-1], at[1:], strict=True):
        yield (k, chunk, keys[a:b].tobytes(), *(c[a:b].tobytes() for c in columns))


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


_I, _B = pa.int64(), pa.binary()
ASK = [("bucket", _I), ("chunk", _I), ("keys", _B), ("wholes", _B), ("times", _B)]
FINE = [("bucket", _I), ("chunk", _I), ("keys", _B), ("more", _B), ("sides", _B), ("times", _B)]
FULL, MIXED, OWNED = 1, 2, 4


def _ask_units(chunks: DataFrame, bits: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r, length, WIDE)
                yield _rows(list(_slices(c.keys, bits, r["chunk"], c.wholes, c.times)), ASK)
    return chunks.drop("ids").mapInArrow(run, "bucket long, chunk long, keys binary, wholes binary, times binary")


def _answer_units(asked: DataFrame) -> DataFrame:
    """For each entry: is the whole unit repeated, do different units share its core, is this its one copy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 1):
            key = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
            whole = np.concatenate([np.frombuffer(r["wholes"], np.uint64) for r in rows])
            times = np.concatenate([np.frombuffer(r["times"], np.uint8) for r in rows]).astype(np.int64)
            order = np.lexsort((whole, key))
            k, w = key[order], whole[order]
            new_key = np.ones(len(k), bool)
            new_key[1:] = k[1:] != k[:-1]
            new = new_key.copy()
            new[1:] |= w[1:] != w[:-1]
            unit, core = np.cumsum(new) - 1, np.cumsum(new_key) - 1
            total = np.bincount(unit, times[order])
            kinds = np.bincount(core[new])
            answer = np.empty(len(k), np.uint8)
            answer[order] = FULL * (total[unit] > 1) + MIXED * (kinds[core] > 1) + OWNED * new
            ends = np.cumsum([len(r["times"]) for r in rows])
            yield _rows([(r["chunk"], rows[0]["bucket"], answer[a:b].tobytes()) for r, a, b in zip(rows, [0, *ends[:-1]], ends, strict=True)],
                        [("chunk", _I), ("bucket", _I), ("answer", _B)])

    return asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, "chunk long, bucket long, answer binary")


def _answers(replies: list[dict], keys: np.ndarray, bits: int, kind) -> np.ndarray:
    """The replies to a chunk's slices, in the order of its entries."""
    buckets, at = _cuts(keys, bits)
    got = sorted(replies, key=lambda r: r["bucket"])
    parts = [np.frombuffer(r["answer"], kind) for r in got]
    if [r["bucket"] for r in got] != buckets.tolist() or [len(p) for p in parts] != np.diff(at).tolist():
        raise RuntimeError("a chunk's answers are incomplete")
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class Fine:
    """Fine units of a chunk's own copies: (core hash, second core hash, bytes around the core)."""

    def __init__(self, chunk: Chunk, answer: np.ndarray, length: int):
        side = NARROW - 1
        core = length - side
        own = chunk.sample[(answer & MIXED > 0) & (answer & OWNED > 0)]
        own_full = (answer[chunk.entry[own]] & FULL) > 0
        at, key, more, sides, full = [], [], [], [], []
        for u, whole in zip(own.tolist(), own_full.tolist(), strict=True):
            text = chunk.texts[chunk.doc[u]]
            for a, p, q in zip(*(x.tolist() for x in units(text, int(chunk.low[u]), int(chunk.high[u]), NARROW, length)), strict=True):
                both = xxhash.xxh3_128_intdigest(text[a:a + core])
                left, right = text[p:a], text[a + core:q + length]
                at.append((u, a, p, q))
                key.append(both >> 64)
                more.append(both & 0xFFFFFFFFFFFFFFFF)
                sides.append(bytes([len(left), len(right)]) + left.rjust(side, b"\0") + right.ljust(side, b"\0"))
                full.append(whole)
        self.at = np.array(at, np.int64).reshape(-1, 4)
        self.full = np.array(full, bool)
        key, more = np.array(key, np.uint64), np.array(more, np.uint64)
        side_rows = np.array(sides, f"V{2 + 2 * side}") if sides else np.zeros(0, f"V{2 + 2 * side}")
        order = np.lexsort((more, key))
        self.order = order
        self.keys, self.more, self.sides = key[order], more[order], side_rows[order]
        # A copy of a unit that is repeated as a whole only helps the others.
        self.times = np.where(self.full[order], 2, 1).astype(np.uint8)


def _fine(chunks: DataFrame, replies: DataFrame, bits: int, length: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = Chunk(row, length, WIDE)
        fine = Fine(chunk, _answers(right.to_pylist(), chunk.keys, bits, np.uint8), length)
        return pa.Table.from_batches([_rows(list(_slices(fine.keys, bits, row["chunk"], fine.more, fine.sides, fine.times)), FINE)])

    return chunks.drop("ids").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        run, "bucket long, chunk long, keys binary, more binary, sides binary, times binary")


def repeated_windows(sides: list[bytes], side: int, cores: list[int]) -> list[int]:
    """For each entry the bits d whose window (d bytes before the core) is in another entry of the same core.

    Entries are different within a core. The suffix array of all entries, each
    core one symbol of its own, has equal windows side by side.
    """
    symbols, starts, lefts = [], [], []
    at = 0
    for s, core in zip(sides, cores, strict=True):
        left, right = s[0], s[1]
        body = np.frombuffer(s, np.uint8)[2:].astype(np.int64) + 2
        symbols += [body[side - left:side], [258 + core], body[side:side + right], [1]]
        starts.append(at)
        lefts.append(left)
        at += left + right + 2
    text = np.concatenate([np.asarray(x, np.int64) for x in symbols])
    window = side + 1  # symbols of a window: side bytes around the core symbol
    sa = suffix_array(text)
    padded = np.concatenate([text, np.zeros(window, np.int64)])
    same = np.ones(len(sa) - 1, bool)
    for j in range(window):
        same &= padded[sa[:-1] + j] == padded[sa[1:] + j]
    hit = np.zeros(len(text) + 1, bool)
    hit[sa[:-1][same]] = True
    hit[sa[1:][same]] = True
    out = []
    for s, start, left in zip(sides, starts, lefts, strict=True):
        right, bits = s[1], 0
        for d in range(max(0, side - right), left + 1):
            if hit[start + left - d]:
                bits |= 1 << d
        out.append(bits)
    return out


def _answer_fine(asked: DataFrame, side: int) -> DataFrame:
    """(chunk, bucket, answer: 32 bits an entry), and rows (entry, window hash) of very large groups."""
    row_size = 2 + 2 * side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 1):
            key = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
            more = np.concatenate([np.frombuffer(r["more"], np.uint64) for r in rows])
            times = np.concatenate([np.frombuffer(r["times"], np.uint8) for r in rows])
            around = [r["sides"][i:i + row_size] for r in rows for i in range(0, len(r["sides"]), row_size)]
            answer = np.zeros(len(key), np.uint32)
            hot: list[tuple] = []
            ends = np.cumsum([len(r["times"]) for r in rows])
            begins = np.concatenate([[0], ends[:-1]])
            order = np.lexsort((more, key))
            k, m = key[order], more[order]
            cut = np.nonzero((k[1:] != k[:-1]) | (m[1:] != m[:-1]))[0] + 1 if len(k) else []
            block_sides, block_cores, block_of, size = [], [], [], 0

            def flush():
                nonlocal block_sides, block_cores, block_of, size
                if block_sides:
                    for bits, entries in zip(repeated_windows(block_sides, side, block_cores), block_of, strict=True):
                        answer[entries] |= bits
                block_sides, block_cores, block_of, size = [], [], [], 0

            for core, members in enumerate(np.split(order, cut)):
                if len(members) < 2:
                    continue
                by: dict[bytes, list[int]] = defaultdict(list)
                for i in members.tolist():
                    by[around[i]].append(i)
                for entries in by.values():  # equal as a whole: all windows repeated
                    if len(entries) > 1:
                        answer[entries] = 0xFFFFFFFF
                if len(by) < 2 or all(times[e[0]] > 1 or len(e) > 1 for e in by.values()):
                    continue
                if len(by) > GROUP:
                    for s, entries in by.items():
                        left, right, chunk_of = s[0], s[1], np.searchsorted(ends, entries[0], side="right")
                        for d in range(max(0, side - right), left + 1):
                            body = s[2 + side - d:2 + 2 * side - d]
                            h = xxhash.xxh3_128_digest(int(key[entries[0]]).to_bytes(8) + int(more[entries[0]]).to_bytes(8) + bytes([d]) + body)
                            hot.append((rows[chunk_of]["chunk"], rows[0]["bucket"], int(entries[0] - begins[chunk_of]), d, h))
                    continue
                block_sides += by
                block_cores += [core] * len(by)
                block_of += by.values()
                size += sum(s[0] + s[1] + 2 for s in by)
                if size > SYMBOLS:
                    flush()
            flush()
            yield _rows([(r["chunk"], rows[0]["bucket"], answer[a:b].tobytes(), -1, -1, None) for r, a, b in zip(rows, begins, ends, strict=True)], FINE_REPLY)
            for i in range(0, len(hot), 1 << 16):
                yield _rows([(c, b, None, e, d, h) for c, b, e, d, h in hot[i:i + (1 << 16)]], FINE_REPLY)

    FINE_REPLY = [("chunk", _I), ("bucket", _I), ("answer", _B), ("entry", pa.int32()), ("d", pa.int32()), ("window", _B)]
    return asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(
        run, "chunk long, bucket long, answer binary, entry int, d int, window binary")


def _mark(chunk: Chunk, answer: np.ndarray, fine: Fine, bits: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Removed byte ranges (starts, ends), merged, of each different text."""
    side = NARROW - 1
    whole = np.nonzero(answer[chunk.entry] & FULL)[0] if len(answer) else np.zeros(0, np.int64)
    doc, first, last = [chunk.doc[whole]], [chunk.low[whole]], [chunk.high[whole]]
    by_place = np.empty(len(bits), np.uint32)
    by_place[fine.order] = bits
    for (u, a, p, q), b in zip(fine.at.tolist(), by_place.tolist(), strict=True):
        if not b:
            continue
        hits = np.array([x for x in range(p, q + 1) if b >> (a - x) & 1], np.int64)
        if len(hits):
            doc.append(np.full(len(hits), chunk.doc[u]))
            first.append(hits)
            last.append(hits)
    doc, first, last = (np.concatenate(x) for x in (doc, first, last))
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order] + length
    out = []
    cut = np.searchsorted(doc, np.arange(len(chunk.texts) + 1))
    for d in range(len(chunk.texts)):
        s, e = first[cut[d]:cut[d + 1]], last[cut[d]:cut[d + 1]]
        if len(s):
            reach = np.maximum.accumulate(e)
            new = np.concatenate([[True], s[1:] > reach[:-1]])
            out.append((s[new], reach[np.append(np.nonzero(new)[0][1:] - 1, len(s) - 1)]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: id (long), n_bytes, spans (start, end of each removed run in turn) and kept (the other bytes).

    Null texts are empty; texts shorter than ``length`` keep all; equal rows
    remove each other; null ids stay; no rows give none. ``length`` is 256 at
    least.
    """
    spark = docs.sparkSession
    if length < 256:
        raise ValueError("length must be 256 or more")
    ship_package(spark)
    path = shared_path(spark, f"repeats-{uuid.uuid4().hex}")
    _write_chunks(docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")), f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, (total * 2 // WIDE // BUCKET_UNITS).bit_length())
    _answer_units(_ask_units(chunks, bits, length)).write.parquet(f"{path}/units")
    known = spark.read.parquet(f"{path}/units")
    _answer_fine(_fine(chunks, known, bits, length), NARROW - 1).write.parquet(f"{path}/fine")
    fine = spark.read.parquet(f"{path}/fine")
    # Windows of very large groups: repeated where their hash is.
    hot = fine.where("window is not null")
    often = hot.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    extra = hot.join(often, "window").groupBy("chunk", "bucket", "entry").agg(F.sum(F.expr("shiftleft(1L, d)")).alias("bits")) \
        .groupBy("chunk", "bucket").agg(F.collect_list(F.struct("entry", "bits")).alias("extra"))
    fine = fine.where("window is null").select("chunk", "bucket", "answer").join(extra, ["chunk", "bucket"], "left")
    none = F.array().cast("array<struct<entry:int,bits:bigint>>")
    replies = known.select("chunk", "bucket", "answer", F.lit(0).alias("level"), none.alias("extra")).unionByName(
        fine.select("chunk", "bucket", "answer", F.lit(1).alias("level"), F.coalesce("extra", none).alias("extra")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = Chunk(row, length, WIDE)
        got = right.to_pylist()
        answer = _answers([r for r in got if r["level"] == 0], chunk.keys, bits, np.uint8)
        parts = Fine(chunk, answer, length)
        second = [r for r in got if r["level"] == 1]
        for r in second:
            if r["extra"]:
                a = np.frombuffer(r["answer"], np.uint32).copy()
                for x in r["extra"]:
                    a[x["entry"]] |= x["bits"]
                r["answer"] = a.tobytes()
        spans = _mark(chunk, answer, parts, _answers(second, parts.keys, bits, np.uint32), length)
        n, listed, kept = [], [], []
        for d in chunk.of_row:
            text, (s, e) = chunk.texts[d], spans[d]
            n.append(len(text))
            listed.append(np.stack([s, e], 1).ravel())
            cuts = [0, *listed[-1].tolist(), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
        return pa.table([pa.array(row["ids"], _I), pa.array(n, _I), pa.array(listed, pa.list_(_I)), pa.array(kept, _B)], names=["id", "n_bytes", "spans", "kept"])

    done = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, "id long, n_bytes long, spans array<bigint>, kept binary")
    return done.withColumnRenamed("id", id_col)


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(col(id_col), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                          (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op1_suffix_dedup(spark, sf_dir):
    return digest(remove_repeats(read_table(spark, sf_dir, "documents")))
