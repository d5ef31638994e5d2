"""Repair of conversations against a search over all edits, whole and split into blocks."""

import hashlib
import heapq
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from darkroom.llm import queries, repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
TURNS = "conv_id long, turn long, role string, text string"


def judged(rows):
    """(turn, role, text, fault) in order."""
    out, seen = [], set()
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        said = text.strip(" \t\n\x0b\x0c\r")
        out.append((turn, role, text, "b" if not said else "d" if (role, text) in seen else "" if said[-1] in ".!?" else "t"))
        seen.add((role, text))
    return out


def brute(rows):
    """Dijkstra over (cost, audit); the first accepted has the least cost, then the least audit."""
    todo, done = [(0, "", 0, 0, ())], set()
    while todo:
        cost, audit, i, state, said = heapq.heappop(todo)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(said)
        moves = [(3, "I", 0, r, f"{n}:") for r, n in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            _, role, text, fault = rows[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state, said))
            if fault not in ("b", "d"):
                more = 3 * (fault == "t")
                moves += [(more, "K", 1, role[:1], f"{role}:{text}")] + [(3 + more, "R", 1, r, f"{n}:{text}") for r, n in (("u", "user"), ("a", "assistant"))]
        for c, edit, step, role, out in moves:
            if (state, role) in NEXT:
                heapq.heappush(todo, (cost + c, audit + edit, i + step, NEXT[state, role], (*said, out)))


def report(rows):
    rows = judged(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    faults, initials = [r[3] for r in rows], [r[1][:1] for r in rows]
    cost, audit, said = brute(rows)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, said


@pytest.fixture(scope="module")
def conversations():
    rng, out = random.Random(7), {}
    for conv in range(120):
        n = rng.randint(1, 14)
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "system", "tool", " ", "Assistant"]])
        texts = ["", " \n", "yes.", "no", "Why?", f"t{rng.random()}", f"t{rng.random()}."]
        out[conv] = [(rng.choice([i, i, i, rng.randint(-3, 20), None]), rng.choice(roles), rng.choice(texts)) for i in range(n)]
    out[500] = [(i, ("user", "assistant")[i % 2] if rng.random() < 0.9 else "system", f"t{i}" + rng.choice([".", "."," "]) if rng.random() < 0.8 else "again.") for i in range(700)]
    out[501] = [(None, "user", "same.")] * 90
    out[502] = [(3, "system", f"{i}!") for i in range(70)]
    return out


@pytest.mark.parametrize("long,block", [(1 << 16, 1 << 16), (5, 4), (0, 1), (20, 64)])
def test_against_search(spark, conversations, long, block):
    rows = [(conv, *r) for conv, turns in conversations.items() for r in turns]
    df = spark.createDataFrame(rows, TURNS).withColumns({"at": F.lit("clash"), "block": F.lit("clash"), "fault": F.lit("clash"), "_long": F.lit(1)}).repartition(5)
    pieces = repair.repaired(df, long, block)
    got = {r.conv_id: r for r in repair.report(pieces).collect()}
    said = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.conv_id, r.piece)):
        assert r.piece < r.pieces
        said.setdefault(r.conv_id, []).extend(f"{t.role}:{t.text}" for t in r.turns)
    assert set(got) == set(conversations)
    for conv, turns in conversations.items():
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, said[conv]) == report(turns), conv
    hashes = {r.conv_id: r.repaired_sha256 for r in queries._sha_of_pieces(pieces).collect()}
    assert hashes == {c: hashlib.sha256("\n".join(s).encode()).hexdigest() for c, s in said.items()}


def damaged(conv, rows):
    for turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            yield from [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = {conv: [(i, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a.", "b", f"{i}? "])) for i in range(rng.randint(1, 9))] for conv in range(150)}
    rows[None] = [(0, "user", "a."), (None, "assistant", "b."), (2, "user", "c."), (3, "assistant", "x" * 100_000 + "!")]
    path = str(tmp_path)
    spark.createDataFrame([(c, *r) for c, rs in rows.items() for r in rs], TURNS).withColumn("audit", F.lit("clash")).write.parquet(f"{path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op12_repair(spark, path).collect()}
    assert set(got) == set(rows)
    gone = 0
    for conv, turns in rows.items():
        *numbers, said = report(list(damaged(conv, turns)))
        gone += not list(damaged(conv, turns))
        r = got[conv]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256] == [*numbers, hashlib.sha256("\n".join(said).encode()).hexdigest()], conv
    assert gone
    spark.createDataFrame([], TURNS).write.parquet(f"{path}/none/conversations.parquet")
    assert queries.op12_repair(spark, f"{path}/none").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(queries.oracle_sql()["op12_repair"])
    got = queries.op12_repair(spark, "/root/testdata/sf0.001").select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
