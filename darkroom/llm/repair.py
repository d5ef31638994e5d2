"""Repair of conversations at the least cost, by cost layers as in agrep.

Roles must read as an optional system turn, then user and assistant in turn: s?(ua)+, or nothing. For each place of a
conversation a bitset holds, in layers of rising cost, the states of that grammar from which the rest can be accepted
at exactly that cost; four bits are a layer. An edit shifts layers by its cost, a role moves bits from state to state, so a
turn takes a few operations on 64 bits. The first layer that holds the start state gives the cost, and walking the
bits forward from there gives the edits, the ASCII-least first.

No state's cost is more than 10 above another's where both are finite (an inserted or rerolled turn costs 3, a deleted
one 4), so LAYERS layers above the lowest hold all that can be part of a cheapest repair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkroom.llm.common import arrow_rows, bounded_broadcast, power_of_two, shuffle_partitions, staged

#: Costs of edits, and what an unended turn that stays adds.
INSERT, REROLE, DELETE, UNENDED = 3, 3, 4, 3
#: ASCII white space, and the signs that end a turn.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Faults of a turn.
NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: States of the grammar: nothing yet, after a system, user, assistant turn. Roles go by the state they lead to.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
ROLE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAME = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
LAYERS = 16
_ALL = (1 << 4 * LAYERS) - 1
_EACH = _ALL // 15
#: Conversations of more turns are split into blocks of at most so many.
LONG = 1 << 16
#: Rows that go to a Python worker together, and long conversations that are broadcast at most.
ROWS, MOST_LONG = 1000, 200_000
#: Code points of a text that decide in which part of a long conversation it lies, where turns and roles agree.
PREFIX = 64


def _before(role: int, states: int) -> int:
    """The states from which a turn of the role leads into the given ones, layer by layer."""
    if role == USER:
        found = states & (_EACH << USER)
        return found >> 2 | found >> 1 | found << 1
    if role in (SYSTEM, ASSISTANT):
        return (states & (_EACH << role)) >> 1
    return 0


def _after(state: int, role: int) -> int | None:
    """The state that a turn of the role leads to, if the grammar allows it."""
    allowed = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
    return role if role in allowed[state] else None


def _opened(states: int) -> int:
    """The layers with up to two turns inserted first; more never pay."""
    for _ in range(2):
        states |= (_before(USER, states) | _before(ASSISTANT, states)) << 4 * INSERT
    return states


def _lowered(base: int, states: int) -> tuple[int, int]:
    """The layers from the lowest on that is not empty."""
    if not states:
        return base, 0
    low = ((states & -states).bit_length() - 1) // 4
    return base + low, (states >> 4 * low) & _ALL


#: What the end of a conversation costs: nothing where it may end, else the turns still due.
END = (0, _opened(1 << START | 1 << ASSISTANT) & _ALL)


def layers(roles: list[int], faults: list[int], end: tuple[int, int] = END) -> list[tuple[int, int]]:
    """(lowest cost, layers from it on) for each place of a conversation, or of a block of one that goes on as `end` says."""
    found = [end]
    base, states = end
    for role, fault in zip(reversed(roles), reversed(faults)):
        now = states << 4 * DELETE
        if fault not in (BLANK, DUPLICATE):
            more = UNENDED if fault == TRUNCATED else 0
            now |= _before(role, states) << 4 * more
            now |= (_before(USER, states) | _before(ASSISTANT, states)) << 4 * (REROLE + more)
        base, states = _lowered(base, _opened(now))
        found.append((base, states))
    return found[::-1]


def costs(place: tuple[int, int]) -> list[int | None]:
    """The least cost of each state at a place."""
    base, states = place
    mine = [states & (_EACH << s) for s in range(4)]
    return [base + ((m & -m).bit_length() - 1) // 4 if m else None for m in mine]


def layers_of(least: list[int | None]) -> tuple[int, int]:
    """The layers that hold each state at its least cost."""
    base = min(c for c in least if c is not None)
    return base, sum(1 << 4 * (c - base) + s for s, c in enumerate(least) if c is not None) & _ALL


def _holds(place: tuple[int, int], state: int | None, cost: int) -> bool:
    layer = cost - place[0]
    return state is not None and 0 <= layer < LAYERS and bool(place[1] >> (4 * layer + state) & 1)


def traced(roles: list[int], faults: list[int], found: list[tuple[int, int]], state: int, last: bool = True) -> tuple[str, list[tuple[int, int | None]], int]:
    """(audit, turns, state at the end): the ASCII-least of the cheapest edits from a state on, and for each turn that
    is left the row it comes from (-1 if it is inserted) and its new role (None if it keeps its own)."""
    cost = costs(found[0])[state]
    audit, turns, i = [], [], 0
    while i < len(roles) or (last and cost):
        fault, extra = (faults[i], UNENDED if faults[i] == TRUNCATED else 0) if i < len(roles) else (BLANK, 0)
        stays = fault not in (BLANK, DUPLICATE)
        inserted = next((t for t in (USER, ASSISTANT) if _holds(found[i], _after(state, t), cost - INSERT)), None)
        if i < len(roles) and _holds(found[i + 1], state, cost - DELETE):
            edit, cost, i = "D", cost - DELETE, i + 1
        elif inserted is not None:
            edit, cost, state = "I", cost - INSERT, inserted
            turns.append((-1, inserted))
        elif stays and _holds(found[i + 1], _after(state, roles[i]), cost - extra):
            edit, cost, state = "K", cost - extra, roles[i]
            turns.append((i, None))
            i += 1
        else:
            new = next(t for t in (USER, ASSISTANT) if stays and _holds(found[i + 1], _after(state, t), cost - REROLE - extra))
            edit, cost, state = "R", cost - REROLE - extra, new
            turns.append((i, new))
            i += 1
        audit.append(edit)
    return "".join(audit), turns, state


def fault_of(text: Column) -> Column:
    """BLANK, TRUNCATED or NONE by what a text itself shows."""
    said = F.rtrim(text, F.lit(SPACE))
    return F.when(said == "", BLANK).when(~F.right(said, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(NONE)


_STATS = ("blank", "duplicate", "truncated", "illegal", "cost", "distinct_turns")
_PIECE = "piece long, pieces long, " + ", ".join(f"{c} long" for c in _STATS) + ", first_turn long, last_turn long, audit string, turns array<struct<role: string, text: string>>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


@dataclass
class _Turns:
    """Turns of one conversation, or of a block of it, in order."""

    turn: list
    role: list[str]
    text: list[str]
    fault: list[int]

    def facts(self) -> dict:
        initials = [r[:1] for r in self.role]
        known = [t for t in self.turn if t is not None]
        return {
            "blank": self.fault.count(BLANK), "duplicate": self.fault.count(DUPLICATE), "truncated": self.fault.count(TRUNCATED),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "distinct_turns": len(set(known)),
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
        }

    def roles(self) -> list[int]:
        return [ROLE.get(r[:1], START) for r in self.role]

    def edited(self, turns: list[tuple[int, int | None]]) -> list[dict]:
        return [{"role": self.role[i] if new is None else NAME[new], "text": "" if i < 0 else self.text[i]} for i, new in turns]


def _whole(rows: _Turns) -> dict:
    """The only piece of a conversation that is not split."""
    seen: set[tuple[str, str]] = set()
    for i, said in enumerate(zip(rows.role, rows.text)):
        if rows.fault[i] != BLANK and said in seen:
            rows.fault[i] = DUPLICATE
        seen.add(said)
    roles = rows.roles()
    found = layers(roles, rows.fault)
    audit, turns, _ = traced(roles, rows.fault, found, START)
    return rows.facts() | {"piece": 0, "pieces": 1, "cost": costs(found[0])[START], "audit": audit, "turns": rows.edited(turns)}


def _batch(ids: list, id_type: pa.DataType, rows: list[dict]) -> pa.RecordBatch:
    names = ["piece", "pieces", *_STATS, "first_turn", "last_turn"]
    arrays = [pa.array(ids, id_type), *[pa.array([r[c] for r in rows], pa.int64()) for c in names], pa.array([r["audit"] for r in rows], pa.string()), pa.array([r["turns"] for r in rows], _TURNS)]
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *names, "audit", "turns"])


def _pieces_of_short(rows: DataFrame, id_type: str) -> DataFrame:
    """Conversations that one task holds; each is complete when the next one begins in its sorted partition."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, done, kind = None, [], [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now[0]:
                    if now is not None:
                        ids.append(now[0])
                        done.append(_whole(now[1]))
                    now = (conv, _Turns([], [], [], []))
                for to, x in zip((now[1].turn, now[1].role, now[1].text, now[1].fault), (turn, role, text, fault)):
                    to.append(x)
            if done:
                yield _batch(ids, kind, done)
                ids, done = [], []
        if now is not None:
            yield _batch([now[0]], kind, [_whole(now[1])])

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
    return sorted_rows.mapInArrow(of, f"conv_id {id_type}, {_PIECE}")


def _pieces_of_long(rows: DataFrame, id_type: str, block: int) -> DataFrame:
    """Conversations that are split: rows are sorted over all partitions, so that a conversation lies in many, and
    numbered; a block is so many numbers.

    Each block gives the costs from each state at its begin to each at its end, four by four. These are chained by
    conversation, and then each block is repaired from the state and costs that its neighbours give.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, PREFIX)]
    spread = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "text")
    placed = staged(spread.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", block.bit_length() - 1)), "placed")
    fresh = placed.groupBy("conv_id", "role", F.md5(F.col("text").cast("binary")).alias("said")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("fresh"))
    fault = F.when((F.col("fault") != BLANK) & F.col("fresh").isNull(), DUPLICATE).otherwise(F.col("fault")).cast("int")
    marked = staged(placed.select("conv_id", "block", "at", "turn", "role", "fault").join(fresh, "at", "left").withColumn("fault", fault).drop("fresh"), "marked")

    def matrix(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        some = _Turns(*(rows.column(c).to_pylist() for c in ("turn", "role", "role", "fault")))
        roles, ways = some.roles(), []
        for state in range(4):
            ways.append(costs(layers(roles, some.fault, (0, 1 << state))[0]))
        facts = some.facts()
        return pa.table({
            "conv_id": pa.array([key[0].as_py()], key[0].type), "block": [key[1].as_py()], "costs": pa.array([[-1 if c is None else c for way in ways for c in way]], pa.list_(pa.int64())),
            "first_turn": pa.array([facts["first_turn"]], pa.int64()), "last_turn": pa.array([facts["last_turn"]], pa.int64()),
            "first_role": [some.role[0][:1]], "last_role": [some.role[-1][:1]], "distinct_turns": pa.array([facts["distinct_turns"]], pa.int64()), "illegal": pa.array([facts["illegal"]], pa.int64()),
        })

    def chain(key: tuple, rows: pa.Table) -> pa.Table:
        found = rows.sort_by("block").to_pylist()
        least, ends = costs(END), []
        for r in reversed(found):
            ends.append(least)
            way = np.array(r["costs"], dtype=object).reshape(4, 4)  # by state at the end, then at the begin
            least = [min((way[t][s] + ends[-1][t] for t in range(4) if way[t][s] >= 0 and ends[-1][t] is not None), default=None) for s in range(4)]
        ends, state, out = ends[::-1], START, []
        known = None
        for i, r in enumerate(found):
            twice = int(known is not None and r["first_turn"] == known)
            known = known if r["last_turn"] is None else r["last_turn"]
            out.append((r["block"], i, [-1 if c is None else c for c in ends[i]], r["distinct_turns"] - twice, r["illegal"] + int(i > 0 and found[i - 1]["last_role"] + r["first_role"] not in LEGAL)))
        cols = list(zip(*out))
        return pa.table({
            "conv_id": pa.array([key[0].as_py()] * len(out), key[0].type), "block": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int64()), "pieces": pa.array([len(out)] * len(out), pa.int64()),
            "ends": pa.array(cols[2], pa.list_(pa.int64())), "distinct_turns": pa.array(cols[3], pa.int64()), "illegal": pa.array(cols[4], pa.int64()),
        })

    made = staged(marked.groupBy("conv_id", "block").applyInArrow(matrix, f"conv_id {id_type}, block long, costs array<long>, first_turn long, last_turn long, first_role string, last_role string, distinct_turns long, illegal long"), "matrices")
    ends = staged(made.groupBy("conv_id").applyInArrow(chain, f"conv_id {id_type}, block long, piece long, pieces long, ends array<long>, distinct_turns long, illegal long"), "chained")

    # where a block is entered depends on how the one before is left: every block is walked from each state, and the
    # four ends of all blocks of a conversation are then followed from the first on
    def walks(key: tuple, rows: pa.Table, end: pa.Table) -> pa.Table:
        rows, end = rows.sort_by("at"), end.to_pylist()[0]
        some = _Turns(*(rows.column(c).to_pylist() for c in ("turn", "role", "role", "fault")))
        found = layers(some.roles(), some.fault, layers_of([None if c < 0 else c for c in end["ends"]]))
        last = end["piece"] + 1 == end["pieces"]
        left = [traced(some.roles(), some.fault, found, s, last)[2] if c is not None else -1 for s, c in enumerate(costs(found[0]))]
        return pa.table({"conv_id": pa.array([key[0].as_py()], key[0].type), "block": [key[1].as_py()], "left": pa.array([left], pa.list_(pa.int32()))})

    def entries(key: tuple, rows: pa.Table) -> pa.Table:
        found, state, out = rows.sort_by("block").to_pylist(), START, []
        for r in found:
            out.append(state)
            state = r["left"][state]
        return pa.table({"conv_id": pa.array([key[0].as_py()] * len(out), key[0].type), "block": pa.array([r["block"] for r in found], pa.int64()), "entry": pa.array(out, pa.int32())})

    by = ("conv_id", "block")
    left = staged(marked.groupBy(*by).cogroup(ends.groupBy(*by)).applyInArrow(walks, f"conv_id {id_type}, block long, left array<int>"), "walks")
    entry = left.groupBy("conv_id").applyInArrow(entries, f"conv_id {id_type}, block long, entry int")
    plan = staged(entry.withColumnRenamed("conv_id", "_conv").join(ends, (F.col("_conv").eqNullSafe(F.col("conv_id"))) & (entry["block"] == ends["block"])).select(ends["*"], "entry"), "entries")
    texts = placed.select("conv_id", "block", "at", "turn", "role", "text")
    texts = texts.join(marked.select("at", "fault"), "at")

    def repair(key: tuple, rows: pa.Table, plan: pa.Table) -> pa.Table:
        rows, end = rows.sort_by("at"), plan.to_pylist()[0]
        some = _Turns(*(rows.column(c).to_pylist() for c in ("turn", "role", "text", "fault")))
        roles, last = some.roles(), end["piece"] + 1 == end["pieces"]
        found = layers(roles, some.fault, layers_of([None if c < 0 else c for c in end["ends"]]))
        audit, turns, state = traced(roles, some.fault, found, end["entry"], last)
        spent = costs(found[0])[end["entry"]] - (0 if last else end["ends"][state])
        row = some.facts() | {c: end[c] for c in ("piece", "pieces", "distinct_turns", "illegal")} | {"cost": spent, "audit": audit, "turns": some.edited(turns)}
        return pa.Table.from_batches([_batch([key[0].as_py()], key[0].type, [row])])

    return texts.groupBy(*by).cogroup(plan.groupBy(*by)).applyInArrow(repair, f"conv_id {id_type}, {_PIECE}")


def repaired(turns: DataFrame, long: int = LONG, block: int = LONG) -> DataFrame:
    """The repaired turns of each conversation (conv_id, turn, role, text), in pieces: conv_id, piece, pieces, audit, turns
    (role, text), what the piece costs, its blank, duplicate, truncated and illegal turns, and its turn numbers.

    Turns go by turn (nulls first), then role and text. A null role or text is one space. A turn is blank without any sign,
    duplicate if role and text stood there before, truncated if its last sign is none of ENDS; the first fault counts. A
    role goes by its first letter; one without is never kept. Repeated rows are duplicates. No rows give no rows; a
    null conv_id is a conversation of its own. Other columns are not read.

    A conversation of up to `long` turns is one piece. Longer ones have pieces of up to `block` turns (a power of two),
    so that no task holds more than that of a conversation.
    """
    spark, id_type = turns.sparkSession, turns.schema["conv_id"].dataType.simpleString()
    spoken = F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), spoken.alias("text"), fault_of(spoken).cast("int").alias("fault"))
    many = staged(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select(F.col("conv_id").alias("_long")), "long")
    found = many.count()
    with arrow_rows(spark, ROWS):
        if not found:
            return staged(_pieces_of_short(rows, id_type), "pieces")
        few, same = bounded_broadcast(many, found, MOST_LONG), F.col("conv_id").eqNullSafe(F.col("_long"))
        short, rest = rows.join(few, same, "left_anti"), rows.join(few, same, "left_semi")
        return staged(_pieces_of_short(short, id_type).unionByName(_pieces_of_long(rest, id_type, power_of_two(block))), "pieces")


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit over all its pieces."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    gaps = lambda first, last, n: F.when(first.isNull(), 0).otherwise(F.least(last - first + 1 - n, most)).cast("long")
    stats = ["blank", "duplicate", "truncated", "illegal", "cost"]
    one = pieces.where("pieces = 1").select("conv_id", gaps(whole("first_turn"), whole("last_turn"), whole("distinct_turns")).alias("gaps"), *stats, "audit")
    many = pieces.where("pieces > 1").groupBy("conv_id").agg(
        gaps(F.min(whole("first_turn")), F.max(whole("last_turn")), F.sum(whole("distinct_turns"))).alias("gaps"), *[F.sum(c).alias(c) for c in stats],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    return one.unionByName(many)
