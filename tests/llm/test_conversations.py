"""Repair of conversations against versions that keep whole audit strings."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from lodestone.llm import conversations as C

LEGAL = re.compile(r"(s?(ua)+)?")


def by_enumeration(turns):
    """(cost, audit) of the best of all edits with at most two insertions at a place."""
    runs = ["".join(x) for n in range(3) for x in itertools.product("ua", repeat=n)]
    best = None
    for ops in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(turns)):
        if any(f in (1, 2) and op != "D" for op, (_, f) in zip(ops, turns)):
            continue
        for ins in itertools.product(runs, repeat=len(turns) + 1):
            roles, audit, cost = "", "", 0
            for run, op, (x, f) in zip(ins, [*ops, ""], [*turns, ("", 0)]):
                roles, audit, cost = roles + run, audit + "I" * len(run), cost + 5 * len(run)
                if op:
                    roles += "" if op == "D" else x if op == "K" else op[1]
                    # an initial of no legal role must not vanish
                    roles += "?" if op == "K" and x == "" else ""
                    cost += {"K": 0, "R": 1, "D": 2}[op[0]] + (5 if f == 3 and op != "D" else 0)
                    audit += op[0]
            if LEGAL.fullmatch(roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def by_strings(turns):
    """The same by a programme over strings, one insertion at a time."""
    best = {0: (0, "")}

    def insert(best):
        for _ in range(3):
            for q, (c, s) in list(best.items()):
                to = C.GOES[q, C.NEXT[q]]
                best[to] = min(best.get(to, (c + 5, s + "I")), (c + 5, s + "I"))
        return best

    for x, f in turns:
        new = {}
        for q, (c, s) in insert(best).items():
            ways = [(q, c + 2, s + "D")]
            if f not in (1, 2):
                more = 5 if f == 3 else 0
                ways += [(C.GOES[q, x], c + more, s + "K")] if (q, x) in C.GOES else []
                ways += [(C.GOES[q, C.NEXT[q]], c + 1 + more, s + "R")]
            for to, *way in ways:
                new[to] = min(new.get(to, tuple(way)), tuple(way))
        best = new
    return min(v for q, v in insert(best).items() if q in (C.EMPTY, C.ASSISTANT))


def found(turns):
    layer, cost, parents = C.run(turns)
    state = C.last_state(layer)
    return cost + layer[0][state] + 5 * C.TAIL[state], "".join(C.codes(parents, state)) + "I" * C.TAIL[state]


def test_enumerated():
    for n in range(3):
        for turns in itertools.product(itertools.product("sua?", (0, 1, 3)), repeat=n):
            assert found(turns) == by_enumeration(turns), turns


def test_strings_and_blocks():
    rng = random.Random(5)
    for _ in range(600):
        turns = [(rng.choice("suauaua?"), rng.choice((0, 0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 40))]
        assert found(turns) == by_strings(turns)
        # the same from blocks that know nothing of each other
        cuts = sorted(rng.choices(range(len(turns) + 1), k=rng.randint(0, 6)))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        layer, parents = C.ALONE[C.EMPTY], []
        for part in parts:
            costs, ranks = [], []
            for alone in C.ALONE:
                last, off, _ = C.run(part, alone)
                costs += [None if c is None else c + off for c in last[0]]
                ranks += last[1]
            layer, own = C.over(layer, costs, ranks)
            parents.append(own)
        state = last = C.last_state(layer)
        audit = ""
        for part, own in zip(reversed(parts), reversed(parents)):
            begin = own[state]
            audit = "".join(C.codes(C.run(part, C.ALONE[begin])[2], state)) + audit
            state = begin
        assert (layer[0][last] + 5 * C.TAIL[last], audit + "I" * C.TAIL[last]) == found(turns)


def test_layers_repeat():
    rng = random.Random(6)
    C.run([(rng.choice("sua?"), rng.choice((0, 1, 2, 3))) for _ in range(20_000)])
    assert C.step.cache_info().currsize < 5_000


# -- tables -----------------------------------------------------------------------------------------------------------------

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The report of each conversation, from the rows as they are before damage."""
    kept = defaultdict(list)
    for conv_id, turn, role, text in rows:
        out = kept[conv_id]
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    reports = {}
    for conv_id, turns in kept.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\v\f\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        cost, audit = by_strings([(x or "?", f) for x, f in zip(initials, faults)])
        lines, at = [], 0
        for e in audit:
            if e in "IR":
                lines.append([None, "" if e == "I" else turns[at][2]])
            elif e == "K":
                lines.append([turns[at][1], turns[at][2]])
            at += e != "I"
        shift = 1 if lines and lines[0][0] and lines[0][0][0] == "s" else 0
        text = "\n".join(f"{r if r is not None else ('user', 'assistant')[(i - shift) % 2]}:{t}" for i, (r, t) in enumerate(lines))
        known = {t for t, _, _ in turns if t is not None}
        gap = max(known) - min(known) + 1 - len(known) if known else 0
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        reports[conv_id] = (gap, faults.count(1), faults.count(2), faults.count(3), bad, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return reports


def some_rows(rng):
    texts = ["Yes.", "no", "", " \t", "Why?", "Same words here.", "trailing dot. ", "été!", None, "a.b!c?", "x" * 3000]
    rows = [(c, t if rng.random() < 0.9 else t + 3, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "u"]), rng.choice(texts)) for c in [*range(60), None] for t in range(rng.randint(1, 9))]
    rows += [(700, None, "user", "no turn."), (701, None, None, None), (702, 5, "user", "one."), (702, None, "system", "first.")]
    rows += [(2000 + i, 0, "user", "Hi.") for i in range(60)]  # some are dropped whole
    rows += [(-1, t, ("user", "assistant")[t % 2 if t % 17 else 0], rng.choice([f"turn {t}.", "said often.", "half", None])) for t in range(900)]  # over several ranges
    one = {(c, t): (c, t, r, x) for c, t, r, x in rows}  # what order rows of one turn have is the operator's own
    return list(one.values())


def as_reports(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def ranges(spark):
    """More ranges than Spark would make of small tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_reports_are_as_by_brute_force(spark, ranges):
    rows = some_rows(random.Random(8))
    turns = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    got = as_reports(C.report(C.damaged(turns)))
    assert got == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in got.values())  # all gone


def test_small_tables_in_one_range(spark):
    rows = some_rows(random.Random(9))
    assert as_reports(C.report(C.damaged(spark.createDataFrame(rows, SCHEMA).coalesce(1)))) == brute(rows)


def test_conversations_beyond_what_a_task_keeps(spark, monkeypatch):
    rows = some_rows(random.Random(10))
    want = brute(rows)
    monkeypatch.setattr(C, "MOST_ROWS", 4)
    # the limits go to the tasks with the function
    from pyspark import cloudpickle as pickle

    pickle.register_pickle_by_value(C)
    try:
        assert as_reports(C.report(C.damaged(spark.createDataFrame(rows, SCHEMA)))) == want
    finally:
        pickle.unregister_pickle_by_value(C)


def test_edits_are_what_reports_tell(spark, ranges):
    rows = some_rows(random.Random(12))
    turns = C.damaged(spark.createDataFrame(rows, SCHEMA)).cache()
    reports = as_reports(C.report(turns))
    edits = defaultdict(list)
    for r in sorted(C.repair(turns).collect(), key=lambda r: (r.place, r.nth)):
        edits[r.conv_id].append(r)
    for conv_id, told in reports.items():
        own = edits.get(conv_id, [])
        assert "".join(r.edit for r in own) == told[6]
        text = "\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == told[7]
        assert LEGAL.fullmatch("".join(r.role[:1] for r in own if r.edit != "D"))
        assert [sum(r.fault == f for r in own) for f in C.FAULTS[1:]] == list(told[1:4])
        assert all((r.turn is None and r.text == "") for r in own if r.edit == "I")
    turns.unpersist()


def test_repeated_rows_and_clashing_columns(spark, ranges):
    rows = [(1, 0, "user", "Hi.")] * 400 + [(1, 1, "assistant", "Yes.")] + [(None, None, None, None)] * 300
    turns = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", gone string, place string, nth int")
    got = as_reports(C.report(turns))
    assert got[1] == (0, 0, 399, 0, 399, 798, "K" + "D" * 399 + "K", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())
    assert got[None] == (0, 300, 0, 0, 299, 600, "D" * 300, hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.report(C.damaged(none)).count() == C.repair(none).count() == 0
