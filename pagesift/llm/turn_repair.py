"""Conversation structure repair: cheapest edits, least audit.

A conversation's roles must read `(s?(ua)+)?` by their initials. Rows are kept
(K, 0), given the other of the roles user and assistant (R, 1) or deleted
(D, 2); blank and repeated rows must be deleted; a truncated row that stays
costs 5 more; a user or assistant turn of empty text may be inserted anywhere
(I, 5). Of all cheapest edits the one whose audit (their initials in order) is
least in ASCII order is taken.

Method. A node is a gap between rows together with what stands before it
(nothing, s, u, a). A dynamic programme from the end gives every node its cost
to go; arcs that keep it are optimal. Nodes are ranked by the first 1, 2, 4,
... initials of their least audit: a node's rank over twice the length is that
of its rank and the rank of the node its pointer leads to, and pointers double
along. The ranks choose each node's arc, and the doubled pointers read the
whole path of every conversation at once. An edit leads from a node to one
other node, so equal audits are equal paths.

Scale: rows are sorted over range partitions by conversation, turn and digest,
so a conversation of any length lies in as many partitions as it fills; the
stretch of one in a partition is a segment. Of segments whose conversation
goes on elsewhere (two a partition at most) the driver gets a 4 x 4 cost
matrix, then where the least path leaves it, and hands back the state in which
each begins and the costs beyond its end. "Seen earlier" is the least turn of
a role and text in its conversation, an aggregate joined back. Only the digest
of one conversation's text is sequential, by its definition: its pieces pass
one task as a stream.

Ties: rows of one turn are in the order of the md5 of role and text, nulls
first. Null roles and texts are one space, so a null text is blank. Roles go
by their first character; a role of another initial, or an empty one, cannot
be kept. Repeated rows are duplicates. A null conversation id is a
conversation of its own. Empty tables give no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from ..session import cut_lineage, ship_package
from .common import col, read_table

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a kept row of an initial, and after an inserted or rerolled one.
_KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = (USER, USER, ASSISTANT, USER)
_NAME = {USER: "user", ASSISTANT: "assistant"}
_INITIAL = {"s": 1, "u": 2, "a": 3}
_WHITE = " \t\n\x0b\x0c\r"
END, DELETE, INSERT, KEEP, REROLE = range(5)     # in ASCII order of the initials
LETTER = " DIKR"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 1, 2, 5, 5
FAR = 1 << 40                                    # the cost of what cannot be
PLAIN, TRUNCATED, BLANK, DUPLICATE = range(4)    # faults
PARTITION_BYTES = 64 << 20
GROUP_ROWS = 1 << 15                             # rows of whole conversations that are ranked at once
PIECE_BYTES = 8 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Cost and target of [edit, kind of row, state]; a kind is 4 * initial + fault."""
    cost = np.full((5, 16, 4), FAR, np.int64)
    target = np.zeros((5, 16, 4), np.int64)
    for kind in range(16):
        initial, fault = " sua"[kind // 4], kind % 4
        stays = COST_TRUNCATED if fault == TRUNCATED else 0
        for s in range(4):
            cost[DELETE, kind, s], target[DELETE, kind, s] = COST_DELETE, s
            cost[INSERT, kind, s], target[INSERT, kind, s] = COST_INSERT, _NEXT[s]
            if fault in (BLANK, DUPLICATE):
                continue
            cost[REROLE, kind, s], target[REROLE, kind, s] = COST_REROLE + stays, _NEXT[s]
            if s in _KEPT.get(initial, {}):
                cost[KEEP, kind, s], target[KEEP, kind, s] = stays, _KEPT[initial][s]
    return cost, target


_COST, _TARGET = _tables()
_ROW_ARCS = [[[(int(_COST[e, k, s]), int(_TARGET[e, k, s])) for e in (DELETE, KEEP, REROLE) if _COST[e, k, s] < FAR]
              for s in range(4)] for k in range(16)]


def _inserted(c: tuple) -> tuple:
    """Costs to go of a gap, when turns may be inserted there."""
    u, a = min(c[USER], COST_INSERT + c[ASSISTANT]), min(c[ASSISTANT], COST_INSERT + c[USER])
    return min(c[NOTHING], COST_INSERT + u), min(c[SYSTEM], COST_INSERT + u), u, a


STOP = _inserted((0, FAR, FAR, 0))               # behind the last row


def costs_to_go(kinds: list[int], after: tuple) -> list[tuple]:
    """Costs to go of each gap, from before the first row to behind the last (``after``)."""
    gaps, c = [after], after
    for kind in reversed(kinds):
        arcs = _ROW_ARCS[kind]
        c = _inserted(tuple(min(cost + c[t] for cost, t in arcs[s]) for s in range(4)))
        gaps.append(c)
    return gaps[::-1]


class Run:
    """The rows of one conversation in one partition, in order."""

    def __init__(self, conv):
        self.conv, self.turns, self.roles, self.texts, self.again = conv, [], [], [], []
        self.first = self.last = False
        self.entry, self.after = NOTHING, None   # after: costs beyond the end, where the conversation goes on

    def judge(self) -> None:
        self.kinds, self.counts, before = [], [0, 0, 0, 0], None
        for row in zip(self.turns, self.roles, self.texts, self.again, strict=True):
            core = row[2].rstrip(_WHITE)
            fault = BLANK if not core else DUPLICATE if row[3] or row[:3] == before else TRUNCATED if core[-1] not in ".!?" else PLAIN
            self.kinds.append(4 * _INITIAL.get(row[1][:1], 0) + fault)
            self.counts[fault] += 1
            before = row[:3]

    def illegal(self) -> int:
        initials = [r[:1] for r in self.roles]
        return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def least_paths(runs: list[Run]) -> list[tuple[list[int], list[int], int]]:
    """For each judged run (edits, gaps at which they are made, state at the end): its cheapest edits of least audit."""
    gaps = np.array([len(r.kinds) + 1 for r in runs])
    base = np.concatenate([[0], np.cumsum(gaps)])
    togo = np.array([c for r in runs for c in costs_to_go(r.kinds, r.after or STOP)], np.int64)
    kinds = np.concatenate([[*r.kinds, 0] for r in runs]).astype(np.int64)
    last = np.zeros(len(kinds), bool)
    last[base[1:] - 1] = True
    n = len(kinds) * 4
    state = np.tile(np.arange(4), len(kinds))
    gap = np.repeat(np.arange(len(kinds)), 4)
    kind, at_end, cost = kinds[gap], last[gap], togo.ravel()
    closed = at_end & np.repeat([r.after is not None for r in runs], gaps)[gap]
    # Optimal arcs: target of [edit, node], or -1.
    arcs = np.full((5, n), -1, np.int64)
    stops = at_end & (closed | np.isin(state, (NOTHING, ASSISTANT)))
    arcs[END, stops] = np.nonzero(stops)[0]
    for edit in (DELETE, INSERT, KEEP, REROLE):
        to = (gap + (edit != INSERT)) * 4 + _TARGET[edit, kind, state]
        open_ = ~closed if edit == INSERT else ~at_end
        step = _COST[edit, kind, state]
        good = open_ & (step < FAR)
        good[good] = step[good] + cost[to[good]] == cost[good]
        arcs[edit, good] = to[good]
    arcs[1:, stops] = -1
    label = np.argmax(arcs >= 0, axis=0)
    node = np.arange(n)
    # Ranks by doubled lengths.
    rank, ptr = label, arcs[label, node]
    while True:
        doubled = rank * (int(rank.max()) + 1) + rank[ptr]
        rank, far = np.unique(doubled, return_inverse=True)[1], ptr[ptr]
        if (far == ptr).all():
            break
        ptr = far
    # The ranks choose the arc; then pointers and lengths by doubling.
    keys = np.where(arcs >= 0, np.arange(5)[:, None] * n + rank[np.maximum(arcs, 0)], np.iinfo(np.int64).max)
    label = np.argmin(keys, axis=0)
    ptr = arcs[label, node]
    length, pointers = (label != END).astype(np.int64), [ptr]
    while (ptr[ptr] != ptr).any():
        length, ptr = length + length[ptr], ptr[ptr]
        pointers.append(ptr)
    starts = base[:-1] * 4 + np.array([r.entry for r in runs])
    sizes = length[starts]
    steps = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    path = np.repeat(starts, sizes)
    for k, hop in enumerate(pointers):
        on = (steps >> k & 1).astype(bool)
        path[on] = hop[path[on]]
    ends = pointers[-1][starts]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return [(label[path[a:b]].tolist(), (path[a:b] - base[i] * 4).tolist(), int(ends[i] % 4))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def repaired(run: Run, edits: list[int], nodes: list[int]) -> Iterator[tuple]:
    """(turn, role, text, edit) of each edit in order; deleted rows as they were."""
    for edit, node in zip(edits, nodes, strict=True):
        i, s = divmod(node, 4)
        if edit == INSERT:
            yield None, _NAME[_NEXT[s]], "", edit
        else:
            yield run.turns[i], _NAME[_NEXT[s]] if edit == REROLE else run.roles[i], run.texts[i], edit


def _runs(batches: Iterator[pa.RecordBatch], known: dict) -> Iterator[list[Run]]:
    """Groups of judged runs of a sorted partition; ``known``: (entry, after) of segments by (partition, is first)."""
    pid = TaskContext.get().partitionId()
    run, group, rows, first = None, [], 0, True

    def close(run, first, last):
        run.first, run.last = first, last
        run.entry, run.after = known.get((pid, first), (NOTHING, None)) if first or last else (NOTHING, None)
        run.judge()
        return run

    for batch in batches:
        for conv, turn, role, text, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run is None or conv != run.conv:
                if run is not None:
                    group.append(close(run, first, False))
                    rows, first = rows + len(run.kinds), False
                    if rows >= GROUP_ROWS:
                        yield group
                        group, rows = [], 0
                run = Run(conv)
            run.turns.append(turn)
            run.roles.append(role)
            run.texts.append(text)
            run.again.append(again)
    if run is not None:
        yield [*group, close(run, first, True)]


def _schema(conv: StructField, fields: list[tuple[str, str]]) -> StructType:
    return StructType([conv, *(StructField(name, DataType.fromDDL(kind)) for name, kind in fields)])


class Placed:
    """Sorted rows in the shared folder, and how segments of longer conversations hang together."""

    def __init__(self, rows: DataFrame):
        self.rows, self.kind = rows, rows.schema["conv_id"]
        self.known, self.linked = {}, set()
        self._link()

    def _segments(self, known: dict, wanted: set | None) -> list:
        """Cost matrices of the outer segments of each partition, or the states at the end of the wanted ones."""
        schema = _schema(self.kind, [("pid", "int"), ("first", "boolean"), ("last", "boolean"), ("found", "array<bigint>")])

        def run(batches):
            pid, out = TaskContext.get().partitionId(), []
            for group in _runs(batches, known):
                for r in group:
                    if not (r.first or r.last) or wanted is not None and (pid, r.first) not in wanted:
                        continue
                    if wanted is None:  # cost from each state before it to each state behind it
                        unit = [tuple(0 if s == e else FAR for s in range(4)) for e in range(4)]
                        found = [c for e in unit for c in costs_to_go(r.kinds, e)[0]]
                    else:
                        found = []
                        for r.entry in range(4):
                            found.append(least_paths([r])[0][2])
                    out.append((r.conv, pid, r.first, r.last, found))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [kind, pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        kind = to_arrow_type(self.kind.dataType)
        found = self.rows.mapInArrow(run, schema).collect()  # two rows of fixed size a partition at most
        return sorted(found, key=lambda r: (r.pid, not r.first))

    def _link(self) -> None:
        found = self._segments({}, None)
        chains, chain = [], []
        for r in found:
            if chain and r.first and chain[-1].last and r.conv_id == chain[-1].conv_id:
                chain.append(r)
            else:
                chains.append(chain)
                chain = [r]
        chains = [c for c in [*chains, chain] if len(c) > 1]
        if not chains:
            return
        beyond = {}
        for chain in chains:
            after = None
            for r in reversed(chain):
                beyond[(r.pid, r.first)] = after
                m, v = r.found, after or STOP
                after = tuple(min(m[4 * e + s] + v[e] for e in range(4)) for s in range(4))
        self.linked = set(beyond)
        ends = {(r.pid, r.first): r.found for r in self._segments({k: (NOTHING, v) for k, v in beyond.items()}, self.linked)}
        for chain in chains:
            state = NOTHING
            for r in chain:
                self.known[(r.pid, r.first)] = (state, beyond[(r.pid, r.first)])
                state = ends[(r.pid, r.first)][state]

    def edits(self) -> DataFrame:
        """Repaired conversations: conv_id, partition and place (their order), turn, role, text, edit (K, R, D or I)."""
        known, kind = self.known, self.kind
        schema = _schema(kind, [("partition", "int"), ("place", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"), ("edit", "string")])

        def run(batches):
            pid, place = TaskContext.get().partitionId(), 0
            kinds = [to_arrow_type(kind.dataType), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            for group in _runs(batches, known):
                out = []
                for r, (edits, nodes, _) in zip(group, least_paths(group), strict=True):
                    for turn, role, text, edit in repaired(r, edits, nodes):
                        out.append((r.conv, pid, place, turn, role, text, LETTER[edit]))
                        place += 1
                cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        return self.rows.mapInArrow(run, schema)

    def summary(self) -> DataFrame:
        """One row per conversation: SUMMARY."""
        known, linked, kind = self.known, self.linked, self.kind
        schema = _schema(kind, [("partition", "int"), ("piece", "int"), ("whole", "boolean"), *PART])

        def run(batches):
            pid = TaskContext.get().partitionId()
            kinds = [to_arrow_type(kind.dataType), pa.int32(), pa.int32(), pa.bool_(), *(_ARROW[k] for _, k in PART)]
            for group in _runs(batches, known):
                out = []
                for r, (edits, nodes, _) in zip(group, least_paths(group), strict=True):
                    whole = (pid, r.first) not in linked or not (r.first or r.last)
                    lines = [f"{role}:{text}".encode() for _, role, text, edit in repaired(r, edits, nodes) if edit != DELETE]
                    cost = sum(_COST[e, r.kinds[min(i >> 2, len(r.kinds) - 1)], i & 3] for e, i in zip(edits, nodes, strict=True))
                    turns = [t for t in r.turns if t is not None]
                    part = [len(set(turns)), min(turns, default=None), max(turns, default=None), *(r.counts[f] for f in (BLANK, DUPLICATE, TRUNCATED)),
                            r.illegal(), int(cost), r.roles[0][:1], r.roles[-1][:1], "".join(LETTER[e] for e in edits)]
                    if whole:
                        out.append((r.conv, pid, 0, True, *part, hashlib.sha256(b"\n".join(lines)).hexdigest(), None))
                        continue
                    out.append((r.conv, pid, 0, False, *part, None, b""))
                    held, size = [], 0
                    for line in [*lines, None]:
                        if held and (line is None or size > PIECE_BYTES):
                            out.append((r.conv, pid, len(out), False, *[None] * len(part), None, b"\n".join(held)))
                            held, size = [], 0
                        held.append(line)
                        size += len(line or b"")
                cols = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        parts = self.rows.mapInArrow(run, schema)
        gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
        whole = parts.where("whole").select("conv_id", gaps, *[c for c, _ in SUMMARY[1:]])
        return whole.unionByName(_joined(parts.where("not whole").drop("whole"), kind)) if linked else whole


PART = [("n_turns", "bigint"), ("min_turn", "bigint"), ("max_turn", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"),
        ("truncated", "bigint"), ("illegal", "bigint"), ("cost", "bigint"), ("head", "string"), ("tail", "string"), ("audit", "string"),
        ("repaired_sha256", "string"), ("data", "binary")]
SUMMARY = [("gaps", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("illegal", "bigint"),
           ("cost", "bigint"), ("audit", "string"), ("repaired_sha256", "string")]
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _joined(parts: DataFrame, kind) -> DataFrame:
    """Summaries of conversations whose segments lie in several partitions: a stream of their pieces in order."""
    schema = _schema(kind, SUMMARY)

    def run(batches):
        now, s, arrow = None, None, None

        def done():
            gaps = s["max"] - s["min"] + 1 - s["turns"] if s["turns"] else 0
            row = (now, gaps, *s["sums"][:3], s["sums"][3], s["sums"][4], "".join(s["audit"]), s["sha"].hexdigest())
            kinds = [arrow, *(_ARROW[k] for _, k in SUMMARY)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=schema.names)

        for batch in batches:
            arrow = batch.schema.field(0).type
            for conv, _, _, turns, low, high, blank, dup, cut, illegal, cost, head, tail, audit, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s is None or conv != now:
                    if s is not None:
                        yield done()
                    now, s = conv, {"sums": [0] * 5, "turns": 0, "min": None, "max": None, "tail": None, "audit": [], "sha": hashlib.sha256(), "any": False}
                if turns is None:  # a piece of the text
                    s["sha"].update(b"\n" + data if s["any"] else data)
                    s["any"] = True
                    continue
                s["sums"] = [a + b for a, b in zip(s["sums"], (blank, dup, cut, illegal, cost), strict=True)]
                if s["tail"] is not None and s["tail"] + head not in ("su", "ua", "au"):
                    s["sums"][3] += 1
                s["tail"] = tail
                if turns:  # turns are in order, so only the neighbours can be the same
                    s["turns"] += turns - (s["max"] == low)
                    s["min"], s["max"] = low if s["min"] is None else s["min"], high
                s["audit"].append(audit)
        if s is not None:
            yield done()

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "partition", "piece").mapInArrow(run, schema)


def place(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
          partitions: int | None = None) -> Placed:
    """Sort turns for repair; ``edits()`` of the result are the repaired turns, ``summary()`` has a row per conversation."""
    spark = turns.sparkSession
    ship_package(spark)
    src = turns.select(col(conv_col).alias("conv_id"), col(turn_col).cast("bigint").alias("turn"),
                       F.coalesce(col(role_col).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(col(text_col).cast("string"), F.lit(" ")).alias("text"))
    src = src.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    if partitions is None:
        size = src.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PARTITION_BYTES))
    seen = src.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first")) \
        .select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    marked = src.join(seen, src["conv_id"].eqNullSafe(seen["c"]) & (src["digest"] == seen["d"])) \
        .select("conv_id", "turn", "role", "text", "digest", (F.struct("turn") > F.col("first")).alias("again"))
    order = ["conv_id", "turn", "digest"]
    rows = marked.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return Placed(cut_lineage(rows.drop("digest")))


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its
    sentence ends (2), comes twice (3) or gets the role user (4). Nulls are one space."""
    def plain(c):
        return F.coalesce(col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op13_turn_repair(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = place(damage(turns)).summary()
    every = turns.select(F.col("conv_id").alias("every")).distinct()
    joined = every.join(found, every["every"].eqNullSafe(found["conv_id"]), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return joined.select(F.col("every").alias("conv_id"),
                         *[F.coalesce(F.col(c), F.lit(empty.get(c, 0)).cast(k)).alias(c) for c, k in SUMMARY])


def _op13_sql() -> str:
    """The damage, the faults and the programme row by row from the end; a state is its (cost, audit, lines)."""
    def put(edit: str, cost: str, line: str | None, after: str) -> str:
        lines = f"list_prepend({line}, {after}.l)" if line else f"{after}.l"
        return f"{{'c': {after}.c + {cost}, 'a': '{edit}' || {after}.a, 'l': {lines}}}"

    def least(options: list[str]) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def state(me: str, kept: dict[str, str], new: str, name: str) -> str:
        stays = "CASE WHEN fault = 'truncated' THEN 5 WHEN fault <> '' THEN 1000000000 ELSE 0 END"
        return least([put("D", "2", None, me), put("R", f"1 + {stays}", f"'{name}:' || text", new),
                      *[put("K", f"CASE WHEN role[1] = '{i}' THEN {stays} ELSE 1000000000 END", "role || ':' || text", to) for i, to in kept.items()]])

    def inserted(source: str) -> str:
        user = put("I", "5", "'user:'", "u2")
        return (f"SELECT conv_id, i, {least(['n', user])} AS n, {least(['s', user])} AS s, u2 AS u, {least(['a', put('I', '5', chr(39) + 'user:' + chr(39), 'u')])} AS a "
                f"FROM (SELECT *, {least(['u', put('I', '5', chr(39) + 'assistant:' + chr(39), 'a')])} AS u2 FROM {source})")

    stop, far = ("{'c': %d::BIGINT, 'a': '', 'l': []::VARCHAR[]}" % c for c in (0, 10 ** 9))
    step = (f"(SELECT rec.conv_id, rec.i - 1 AS i, {state('n', {'s': 's', 'u': 'u'}, 'u', 'user')} AS n, {state('s', {'u': 'u'}, 'u', 'user')} AS s, "
            f"{state('u', {'a': 'a'}, 'a', 'assistant')} AS u, {state('a', {'u': 'u'}, 'u', 'user')} AS a "
            "FROM rec JOIN f ON f.conv_id IS NOT DISTINCT FROM rec.conv_id AND f.i = rec.i - 1)")
    return rf"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),
steps AS (
  SELECT x, CAST(4294967295 AS BIGINT) AS c, 0 AS k FROM (SELECT DISTINCT x FROM plain)
  UNION ALL SELECT x, xor(c // 256, t[1 + CAST(xor(c % 256, CAST(ord(x[k + 1]) AS BIGINT)) AS BIGINT)]), k + 1 FROM steps, tab WHERE k < length(x)
), kinds AS (SELECT x, xor(c, CAST(4294967295 AS BIGINT)) % 20 AS kind FROM steps WHERE k = length(x)),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM plain JOIN kinds USING (x) WHERE kind <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS i FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
               WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
               WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
             lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
ends AS (SELECT conv_id, max(i) + 1 AS i, {stop} AS n, {far} AS s, {far} AS u, {stop} AS a FROM f GROUP BY conv_id),
rec AS ({inserted("ends")} UNION ALL {inserted(step)}),
best AS (SELECT conv_id, n.c AS cost, n.a AS audit, sha256(array_to_string(n.l, chr(10))) AS repaired_sha256 FROM rec WHERE i = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP13_SQL = _op13_sql()
