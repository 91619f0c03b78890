"""Conversation repair against a search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from pagesift.llm import turn_repair as R

SF = "/root/testdata/sf0.001"


def digest_key(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    """rows (turn, role, text) of one conversation -> summary, from the definition; every cheapest edit list is looked at."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda w: (w[0] is not None, w[0] or 0, digest_key(w[1], w[2])))
    seen, fault = set(), []
    for _, role, text in rows:
        last = re.findall("[^\x20\x09-\x0d]", text)[-1:]
        fault.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]

    @functools.cache
    def best(i, done):
        """(cost, audit, lines) from row i on, after roles that read ``done`` (its last two initials)."""
        found = []
        if i == len(rows) and done[-1:] in ("", "a"):
            found.append((0, "", ()))
        ok = {"": "su", "s": "u", "u": "a", "a": "u"}[done[-1:]]
        new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[done[-1:]]
        if i < len(rows):
            def then(cost, letter, role, line):
                c, a, l = best(i + 1, role or done)
                found.append((c + cost, letter + a, ((line,) if line is not None else ()) + l))
            _, role, text = rows[i]
            then(2, "D", "", None)
            if fault[i] not in ("blank", "duplicate"):
                extra = 5 if fault[i] == "truncated" else 0
                if role[:1] and role[:1] in ok:
                    then(extra, "K", role[0], f"{role}:{text}")
                then(1 + extra, "R", new[0], f"{new}:{text}")
        return min(found + [(c + 5, "I" + a, (f"{new}:",) + l) for c, a, l in inserted(i, new[0])])

    @functools.cache
    def inserted_(i, done):
        return best_plain(i, done)

    def inserted(i, done):
        # One more insertion at the same place is enough: two in a row from u or a come back to the same state.
        out = [best_plain(i, done)]
        nxt = "a" if done == "u" else "u"
        name = {"u": "user", "a": "assistant"}[nxt]
        c, a, l = best_plain(i, nxt)
        out.append((c + 5, "I" + a, (f"{name}:",) + l))
        return [o for o in out if o[0] < 10 ** 6]

    @functools.cache
    def best_plain(i, done):
        found = [(10 ** 9, "", ())]
        if i == len(rows):
            return (0, "", ()) if done == "a" else found[0]
        ok = {"u": "a", "a": "u"}[done]
        new = {"u": "assistant", "a": "user"}[done]
        _, role, text = rows[i]

        def then(cost, letter, state, line):
            c, a, l = best(i + 1, state)
            found.append((c + cost, letter + a, ((line,) if line is not None else ()) + l))
        then(2, "D", done, None)
        if fault[i] not in ("blank", "duplicate"):
            extra = 5 if fault[i] == "truncated" else 0
            if role[:1] == ok:
                then(extra, "K", ok, f"{role}:{text}")
            then(1 + extra, "R", new[0], f"{new}:{text}")
        return min(found)

    cost, audit, lines = best(0, "")
    assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines))
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["a.", "b!", "c", " ", "", None, "d?", "e. ", "é.", "f"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3, -2]), rng.choice(roles), rng.choice(texts) if rng.random() < .5 else f"{turn} x."))
    return rows


def check(spark, rows, partitions):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS digest", "2 AS `dotted.x`").repartition(4)
    placed = R.place(df, partitions=partitions)
    got = {r[0]: tuple(r)[1:] for r in placed.summary().collect()}
    convs = {r[0] for r in rows}
    assert set(got) == convs
    for conv in convs:
        assert got[conv] == brute([r[1:] for r in rows if r[0] == conv]), conv
    return placed, got


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_random_conversations(spark, partitions):
    placed, got = check(spark, random_rows(partitions, 150), partitions)
    edits = placed.edits().orderBy("partition", "place").collect()
    for conv, g in got.items():
        mine = [e for e in edits if e.conv_id == conv]
        assert "".join(e.edit for e in mine) == g[6]
        lines = [f"{e.role}:{e.text}" for e in mine if e.edit != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == g[7]


def test_one_conversation_over_many_partitions(spark):
    """A conversation that holds nearly all rows lies in many partitions, its repeats too."""
    rng = random.Random(4)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", "ok.", f"{t}", ""])) for t in range(400)]
    placed, _ = check(spark, rows + random_rows(9, 10), 12)
    assert len(placed.linked) >= 8


def test_query_and_damage(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = damaged(rows)
    got = {r[0]: tuple(r)[1:] for r in R.op13_turn_repair(spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, g in got.items():
        assert g == brute([r[1:] for r in left if r[0] == conv])
    odd = random_rows(3, 30)
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, R.damage(df).collect()), key=key) == sorted(damaged(odd), key=key)


def test_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    placed = R.place(df)
    assert placed.summary().collect() == [] and placed.edits().collect() == []


def test_long_text(spark):
    check(spark, [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", " " * 100_000), (1, 2, "assistant", "y.")], 2)
