"""Repair of the structure of conversations at the least cost, by a rank-compressed dynamic programme.

A conversation is in order if its roles' initials read (s?(ua)+)?.  Every turn is one macro edit: a run of inserted turns and what becomes
of the turn itself (kept, given another role, deleted), written as I...I and K, R or D.  No code is another's beginning, so the edits of
two ways to the same turn compare as their codes do, one after the other.  A layer of the programme, after each turn,
has the four states of the pattern; for each, the least cost and, instead of the audit string, its rank among the layer's
strings: a way's rank follows from its parent's rank and its code.  Strings are put together at the end, along the parents.

A state whose cost is far behind another's is left out, so a layer's costs differ by little; its ranks are below four.  So layers
repeat, and one step is a look into a table.

Rows are sorted into ranges by conversation and turn.  A conversation that lies within a range is repaired there.  One that touches the
range's ends may go on in others, however many it fills: each of its blocks tells the cost and rank from any state to any other, a scan
over these numbers finds the states between blocks, and then all blocks are rebuilt in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, within_bound

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\v\f\r"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where a state goes on by an initial.
GOES = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: Turns that the end inserts, by state: an opened exchange is closed, a system's turn gets one.
TAIL = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Codes of macro edits, in the order of their strings; longer runs of insertions only come back to a state at more cost.
CODES = sorted("I" * k + x for k in range(3) for x in "DKR")
#: What two insertions cost: any state does what another can for less more (a kept first turn of the system is deleted instead), so a
#: state further behind is on no cheapest way.
BEHIND = 2 * INSERT
#: Rows and code points of a conversation that a task keeps before it takes it for one of several ranges.
MOST_ROWS, MOST_TEXT = 20_000, 1 << 25
FAULTS = (None, "blank", "duplicate", "truncated")

Layer = tuple[tuple[int | None, ...], tuple[int, ...]]
#: From each state alone.
ALONE: list[Layer] = [(tuple(0 if q == p else None for q in range(4)), (0,) * 4) for p in range(4)]


def _after(state: int, initials: Iterable[str]) -> int | None:
    for x in initials:
        if (state := GOES.get((state, x))) is None:
            return None
    return state


def inserted(state: int, n: int) -> list[str]:
    """The initials of n turns that are inserted at a state."""
    out: list[str] = []
    for _ in range(n):
        out.append(NEXT[state])
        state = GOES[state, out[-1]]
    return out


@cache
def moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, code) of each macro edit of a turn, the cheapest and then least code of those from one state to another."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    more = TRUNCATED if fault == 3 else 0
    for p in range(4):
        for k, code in enumerate(CODES):
            at = _after(p, inserted(p, len(code) - 1))
            cost = INSERT * (len(code) - 1)
            if code[-1] == "D":
                q, cost = at, cost + DELETE
            elif fault in (1, 2):
                continue
            elif code[-1] == "K":
                q, cost = _after(at, [initial]), cost + KEEP + more
            else:
                q, cost = _after(at, [NEXT[at]]), cost + REROLE + more
            if q is not None:
                best[p, q] = min(best.get((p, q), (cost, k)), (cost, k))
    return [(p, q, *found) for (p, q), found in best.items()]


@cache
def step(layer: Layer, initial: str, fault: int) -> tuple[Layer, int, tuple[tuple[int, int] | None, ...]]:
    """The next layer, with costs from 0 on; what was taken off them; and each state's parent and code."""
    costs, ranks = layer
    ways: list[tuple | None] = [None] * 4
    for p, q, cost, code in moves(initial, fault):
        if costs[p] is not None:
            way = (costs[p] + cost, ranks[p], code, p)
            ways[q] = way if ways[q] is None else min(ways[q], way)
    off = min(w[0] for w in ways if w)
    ways = [w if w and w[0] <= off + BEHIND else None for w in ways]
    order = {w: i for i, w in enumerate(sorted({w[1:3] for w in ways if w}))}
    found = tuple(None if w is None else w[0] - off for w in ways), tuple(0 if w is None else order[w[1:3]] for w in ways)
    return found, off, tuple(None if w is None else (w[3], w[2]) for w in ways)


def run(turns: Sequence[tuple[str, int]], layer: Layer = ALONE[EMPTY]) -> tuple[Layer, int, list[tuple]]:
    """The last layer over turns (initial, fault), what was taken off its costs, and the parents of all layers."""
    cost, parents = 0, []
    for turn in turns:
        layer, off, own = step(layer, *(turn if turn[0] in ("s", "u", "a") else ("", turn[1])))
        cost += off
        parents.append(own)
    return layer, cost, parents


def last_state(layer: Layer) -> int:
    """The state of the cheapest way to an end, of equally cheap ones the least string's."""
    return min((c + INSERT * TAIL[q], r, q) for q, (c, r) in enumerate(zip(*layer)) if c is not None)[2]


def codes(parents: list[tuple], state: int) -> list[str]:
    """The code of each turn on the way to a state."""
    out = []
    for own in reversed(parents):
        state, code = own[state]
        out.append(CODES[code])
    return out[::-1]


def applied(found: Sequence[str], initials: Sequence[str], state: int = EMPTY) -> Iterator[tuple[int, int, str, str | None]]:
    """(turn, nth, edit, initial) of each edit in order; a deleted turn has no initial, a kept one its own."""
    for i, (code, own) in enumerate(zip(found, initials)):
        for nth, x in enumerate(inserted(state, len(code) - 1)):
            yield i, nth, "I", x
            state = GOES[state, x]
        x = {"K": own, "R": NEXT[state], "D": None}[code[-1]]
        yield i, len(code) - 1, code[-1], x
        if x is not None:
            state = GOES[state, x]


def fault_of(text: str) -> int:
    """0, or which of FAULTS a text alone shows."""
    body = text.rstrip(SPACE)
    return 1 if not body else 0 if body[-1] in ".!?" else 3


def illegal_pairs(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def gaps(turns: Iterable[int | None]) -> int:
    """Whole numbers missing between the least and the largest turn."""
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


# -- rows -----------------------------------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of turns, damaged by crc32 of conv_id:turn modulo 20, with gone, which marks those that are dropped.

    0 drops a row, 1 empties its text, 2 takes . ! ? out of it, 3 repeats it, 4 makes it the user's.  Nulls are written as one space.
    """
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), written("role").alias("role"), written("text").alias("text"))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    rows = rows.withColumn("kind", kind).withColumn("copies", F.when(F.col("kind") == 3, 2).otherwise(1))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


_ROW = "conv_id long, turn long, role string, text string, gone boolean"
_EDIT = "nth int, edit string, fault string"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SORTED = f"{_ROW}, place long, whole boolean, {_EDIT}, {_REPORT}"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], _KINDS[kind]) for name, kind in kinds], names=[name for name, _ in kinds])


def _line(role: str, text: str) -> str:
    return f"{role}:{text}"


def _faults(rows: list[dict]) -> list[int]:
    seen: set[tuple[str, str]] = set()
    out = []
    for r in rows:
        fault = fault_of(r["text"])
        if fault != 1:
            own = r["role"], r["text"]
            fault = 2 if own in seen else fault
            seen.add(own)
        out.append(fault)
    return out


def _repaired(rows: list[dict], report: bool) -> list[dict]:
    """The edits of a whole conversation, or one row that reports on them."""
    conv_id, rows = rows[0]["conv_id"], [r for r in rows if not r["gone"]]
    faults, initials = _faults(rows), [r["role"][:1] for r in rows]
    layer, cost, parents = run(list(zip(initials, faults)))
    state = last_state(layer)
    found = codes(parents, state)
    ends = inserted(state, TAIL[state])
    if report:
        lines = [_line(ROLES[x] if e in "IR" else rows[i]["role"], "" if e == "I" else rows[i]["text"]) for i, _, e, x in applied(found, initials) if x is not None]
        text = "\n".join(lines + [_line(ROLES[x], "") for x in ends])
        own = {"blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3), "illegal": illegal_pairs(initials), "gaps": gaps(r["turn"] for r in rows)}
        own |= {"cost": cost + layer[0][state] + INSERT * len(ends), "audit": "".join(found) + "I" * len(ends)}
        return [{"conv_id": conv_id, "whole": True, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(), **own}]
    out = [_edit(rows[i], rows[i]["place"], nth, e, x, faults[i]) for i, nth, e, x in applied(found, initials)]
    return out + [{"conv_id": conv_id, "whole": True, "place": rows[-1]["place"], "nth": len(CODES) + k, "edit": "I", "role": ROLES[x], "text": ""} for k, x in enumerate(ends)]


def _edit(row: dict, place: int, nth: int, edit: str, initial: str | None, fault: int) -> dict:
    own = {"conv_id": row["conv_id"], "whole": True, "place": place, "nth": nth, "edit": edit}
    if edit == "I":
        return own | {"role": ROLES[initial], "text": ""}
    return own | {"turn": row["turn"], "role": ROLES[initial] if edit == "R" else row["role"], "text": row["text"], "fault": FAULTS[fault]}


def _within(report: bool):
    """Repairs the conversations that lie within a sorted range; the rows of those at its ends pass through, with their places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[dict] = []
        passing, there, volume, at = True, object(), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                row["place"] = (row.pop("part") << 40) + at
                at += 1
                if row["conv_id"] != there:
                    if held:
                        out += _repaired(held, report)
                    held, volume, passing, there = [], 0, at == 1, row["conv_id"]
                if passing:
                    out.append(row)
                else:
                    held.append(row)
                    volume += len(row["text"])
                    if len(held) > MOST_ROWS or volume > MOST_TEXT:
                        out, held, passing = out + held, [], True
            yield _batch(out, _SORTED)
            out = []
        yield _batch(held, _SORTED)

    return work


# -- conversations over several ranges --------------------------------------------------------------------------------------

_TURN = "conv_id long, place long, part long, turn long, initial string, fault int, gone boolean, key string"
_BLOCK = "conv_id long, part long, n long, first string, last string, illegal long, least long, most long, turns long, blank long, duplicate long, truncated long, costs array<long>, ranks array<long>"
_CHOICE = "conv_id long, part long, begin int, state int, tail int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _turns(rows: DataFrame) -> DataFrame:
    """What the programme needs of rows: no texts.  Duplicates are told by the first place of each role and text."""
    body = F.rtrim("text", F.lit(SPACE))
    alone = F.when(body == "", 1).when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    key = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    found = rows.select("conv_id", "place", F.shiftright("place", 40).alias("part"), "turn", F.substring("role", 1, 1).alias("initial"), alone.alias("fault"), "gone", key.alias("key"))
    found = stage(found, "turns")
    firsts = found.where("fault <> 1 and not gone").groupBy("conv_id", "key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = within_bound(stage(firsts.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first"), "firsts"))
    again = F.coalesce((F.col("fault") != 1) & (F.col("place") > F.col("first")), F.lit(False))
    met = found.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    return met.select("conv_id", "place", "part", "turn", "initial", F.when(again, 2).otherwise(F.col("fault")).alias("fault"), "gone")


def _block(table: pa.Table) -> pa.Table:
    """What one range's turns of a conversation come to, from any state to any other."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    own = {"conv_id": rows[0]["conv_id"], "part": rows[0]["part"]}
    rows = [r for r in rows if not r["gone"]]
    costs, ranks = [], []
    for alone in ALONE:
        layer, off, _ = run([(r["initial"], r["fault"]) for r in rows], alone)
        costs += [None if c is None else c + off for c in layer[0]]
        ranks += layer[1]
    initials, known = [r["initial"] for r in rows], {r["turn"] for r in rows if r["turn"] is not None}
    faults = [r["fault"] for r in rows]
    own |= {"n": len(rows), "first": next(iter(initials), None), "last": next(reversed(initials), None), "illegal": illegal_pairs(initials)}
    own |= {"least": min(known, default=None), "most": max(known, default=None), "turns": len(known), "costs": costs, "ranks": ranks}
    own |= {"blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3)}
    return pa.Table.from_batches([_batch([own], _BLOCK)])


def over(layer: Layer, costs: Sequence[int | None], ranks: Sequence[int]) -> tuple[Layer, list[int | None]]:
    """The layer after a block, and each state's parent before it."""
    ways: list[tuple | None] = [None] * 4
    for q in range(4):
        some = [(layer[0][p] + costs[4 * p + q], layer[1][p], ranks[4 * p + q], p) for p in range(4) if layer[0][p] is not None and costs[4 * p + q] is not None]
        ways[q] = min(some, default=None)
    order = {w: i for i, w in enumerate(sorted({w[1:3] for w in ways if w}))}
    found = tuple(None if w is None else w[0] for w in ways), tuple(0 if w is None else order[w[1:3]] for w in ways)
    return found, [None if w is None else w[3] for w in ways]


def _scan(table: pa.Table) -> pa.Table:
    """The states before and after each block of a conversation, and its report's numbers; a row for each block."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    layer, parents = ALONE[EMPTY], []
    for r in rows:
        layer, own = over(layer, r["costs"], r["ranks"])
        parents.append(own)
    state = last_state(layer)
    report = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
    report["cost"] = layer[0][state] + INSERT * TAIL[state]
    full = [r for r in rows if r["n"]]
    report["illegal"] += illegal_pairs_between(full)
    known = [r for r in full if r["turns"]]
    distinct = sum(r["turns"] for r in known) - sum(a["most"] == b["least"] for a, b in zip(known, known[1:]))
    report["gaps"] = known[-1]["most"] - known[0]["least"] + 1 - distinct if known else 0
    out = []
    for i in range(len(rows) - 1, -1, -1):
        begin = parents[i][state]
        out.append({"conv_id": rows[i]["conv_id"], "part": rows[i]["part"], "begin": begin, "state": state, "tail": TAIL[state] if i == len(rows) - 1 else 0, **report})
        state = begin
    return pa.Table.from_batches([_batch(out, _CHOICE)])


def illegal_pairs_between(blocks: Sequence[dict]) -> int:
    """Pairs of initials out of order where one block ends and the next begins."""
    return sum(illegal_pairs([a["last"], b["first"]]) for a, b in zip(blocks, blocks[1:]))


_REBUILT = "conv_id long, place long, nth int, edit string, initial string, fault string"


def _rebuild(table: pa.Table) -> pa.Table:
    """The edits of one block between its states."""
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    begin, state, tail, conv_id, last = rows[0]["begin"], rows[0]["state"], rows[0]["tail"], rows[0]["conv_id"], rows[-1]["place"]
    rows = [r for r in rows if not r["gone"]]
    initials = [r["initial"] for r in rows]
    _, _, parents = run([(r["initial"], r["fault"]) for r in rows], ALONE[begin])
    out = [{"conv_id": conv_id, "place": rows[i]["place"], "nth": nth, "edit": e, "initial": x, "fault": None if e == "I" else FAULTS[rows[i]["fault"]]} for i, nth, e, x in applied(codes(parents, state), initials, begin)]
    out += [{"conv_id": conv_id, "place": last, "nth": len(CODES) + k, "edit": "I", "initial": x} for k, x in enumerate(inserted(state, tail))]
    return pa.Table.from_batches([_batch(out, _REBUILT)])


def _across(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the conversations that touch the ends of ranges: their edits with texts, and a row for each with its report's numbers.

    A group is one range's turns of a conversation; a scan's group has a row for each range.
    """
    turns = stage(_turns(rows), "turns")
    blocks = turns.groupBy("conv_id", "part").applyInArrow(_block, _BLOCK)
    choices = stage(blocks.groupBy("conv_id").applyInArrow(_scan, _CHOICE), "choices")
    states = choices.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "begin", "state", "tail")
    met = turns.join(within_bound(states), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    edits = stage(met.groupBy("conv_id", "part").applyInArrow(_rebuild, _REBUILT), "edits")
    there = F.col("edit") != "I"
    texts = rows.select("place", "turn", "role", "text")
    role = F.when(F.col("edit").isin("K", "D"), F.col("role")).when(F.col("initial") == "u", ROLES["u"]).otherwise(ROLES["a"])
    whole = edits.join(texts, "place").select("conv_id", "place", "nth", "edit", F.when(there, F.col("turn")).alias("turn"), role.alias("role"), F.when(there, F.col("text")).otherwise("").alias("text"), "fault")
    return whole, choices.drop("part", "begin", "state", "tail").distinct()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the digest of each conversation, whose edits come in order; holds one row's text and the audit at a time."""
    schema = "conv_id long, audit string, repaired_sha256 string"
    there, audit, hashed = object(), [], None

    def told() -> list[dict]:
        return [] if hashed is None else [{"conv_id": there, "audit": "".join(audit), "repaired_sha256": hashed.hexdigest()}]

    for batch in batches:
        out: list[dict] = []
        for conv_id, edit, line in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "line"))):
            if hashed is None or conv_id != there:
                out += told()
                there, audit, hashed, some = conv_id, [], hashlib.sha256(), False
            audit.append(edit)
            if line is not None:
                hashed.update((b"\n" if some else b"") + line.encode())
                some = True
        yield _batch(out, schema)
    yield _batch(told(), schema)


def _ranged(turns: DataFrame, report: bool) -> DataFrame:
    """The rows of turns, sorted into ranges: repaired where a conversation lies in one, else as they are with their places."""
    small_batches(turns.sparkSession)
    order = ["conv_id", "turn", "tie", "row"]
    rows = turns.withColumn("tie", F.xxhash64("role", "text")).withColumn("row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    return stage(ranged.select(*_names(_ROW), "part").mapInArrow(_within(report), _SORTED), "conversations")


def _read(turns: DataFrame) -> DataFrame:
    """turns with the columns that repair() works on; nulls are one space, and gone is false if there is none."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if dict(turns.dtypes).get("gone") == "boolean" else F.lit(False)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), written("role"), written("text"), gone.alias("gone"))


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest edits that put each conversation in order: conv_id, place, nth, edit, turn, role, text, fault.

    turns needs conv_id, turn, role and text; a boolean column gone marks rows that only tell of their conversation.  Sorted by
    place and nth, a conversation's rows whose edit isn't D are the repaired one; inserted rows have no turn and an empty
    text, and deleted ones are there with what they had.  Among the cheapest edits the least string of initials decides.

    Turns are taken in their order, nulls first; rows of one turn by a hash of role and text, so repeated rows are next to each other,
    and all but the first are duplicates.  Null roles and texts are one space: no legal role, and blank.  Rows of a null
    conv_id are one conversation.  Conversations without rows, and an empty table, give no rows.  Other columns are ignored.
    """
    rows = _ranged(_read(turns), report=False)
    columns = ["conv_id", "place", "nth", "edit", "turn", "role", "text", "fault"]
    edits, _ = _across(rows.where("whole is null").select(*_names(_ROW), "place"))
    return rows.where("whole").select(columns).unionByName(edits.select(columns))


def report(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns, which is as in repair(): gaps, faults, illegal pairs, cost, audit and the repaired text's digest.

    audit has the initials of repair()'s edits; repaired_sha256 is of its lines role:text.  A conversation all of whose rows are
    gone has zeros, no audit and the digest of nothing.  The texts of a conversation in several ranges are read by one task for the
    digest, which is serial by nature, one row at a time.
    """
    rows = _ranged(_read(turns), report=True)
    edits, numbers = _across(rows.where("whole is null").select(*_names(_ROW), "place"))
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    lines = edits.select("conv_id", "place", "nth", "edit", line.alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place", "nth")
    told = lines.mapInArrow(_digest, "conv_id long, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    met = numbers.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    met = met.withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
    columns = ["conv_id", *_names(_REPORT)]
    return rows.where("whole").select(columns).unionByName(met.select(columns))
