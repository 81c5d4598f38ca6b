"""Running values and what is built on them, over groups that lie in several ranges."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bindings, checks, sweeps


@pytest.fixture(autouse=True)
def ranges(spark):
    """As many ranges as on a large table."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def table(n=3000, seed=4):
    rng = random.Random(seed)
    groups = ["hot"] * 8 + ["a", "b", None, "c", "d"]
    return [(i, rng.choice(groups), rng.randrange(400), rng.choice([None, *range(-5, 9)])) for i in range(n)]


SCHEMA = "i long, g string, o int, x long"


@pytest.mark.parametrize("split", [True, False])
def test_running_values(spark, split):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    x = F.col("x")
    got = sweeps.before(df, ["g"], ["o", "i"], split, t=sweeps.total(x), n=sweeps.total(1), h=sweeps.highest(x), f=sweeps.first(x), l=sweeps.last(x)).collect()
    assert len(got) == len(rows)
    by = {r.i: r for r in got}
    for group in {r[1] for r in rows}:
        known, n = [], 0
        for i, _, _, x in sorted((r for r in rows if r[1] == group), key=lambda r: (r[2], r[0])):
            r = by[i]
            assert (r.t, r.n, r.h, r.f, r.l) == ((sum(known), n or None, max(known), known[0], known[-1]) if known else (None, n or None, None, None, None))
            n += 1
            known += [x] if x is not None else []


def test_no_task_holds_a_whole_group(spark):
    rows = [(i, "hot", 1, 1) for i in range(20_000)]  # even if all rows are of equal order
    found = sweeps.ranged(spark.createDataFrame(rows, SCHEMA).repartition(4), ["g"], ["o"])
    sizes = [r.n for r in found.groupBy("__part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) < 20_000 / 3
    counted = checks.occurrence(spark.createDataFrame(rows, SCHEMA), ["g"], ["o"])
    assert sorted(r[0] for r in counted.select("identity_occurrence").collect()) == list(range(20_000))


def test_carried_rows_are_as_few_as_ranges(spark):
    df = spark.createDataFrame([(i, f"g{i % 500}", i, 1) for i in range(5000)], SCHEMA)
    rows = sweeps.ranged(df, ["g"], ["o"])
    crossing = rows.groupBy("g").agg(F.countDistinct("__part").alias("n")).agg(F.sum(F.col("n") - 1)).first()[0]
    assert crossing <= 6


def test_spans_of_a_hot_group_in_linear_rows(spark):
    """100,000 spans of one group: candidates of a join of pairs would be 10**10 rows."""
    outer = spark.range(0, 100_000).select(F.lit(1).alias("d"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 7).alias("end"))
    inner = spark.range(0, 100_000).select(F.lit(1).alias("d"), (F.col("id") * 10 + F.col("id") % 3).alias("start"), (F.col("id") * 10 + 5 + F.col("id") % 4).alias("end"))
    got = checks.covered(inner, outer, ["d"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and got.count() == 75_000
    assert checks.merged_spans(outer, ["d"]).count() == 100_000
    assert [tuple(r) for r in checks.merged_spans(outer.withColumn("end", F.col("end") + 5), ["d"]).collect()] == [(1, 0, 1_000_002)]


def test_spans_equal_pairs(spark):
    rng = random.Random(9)
    made = lambda n, long: [(rng.choice([1, 1, 1, 2, 3]), s, s + rng.randrange(long)) for s in (rng.randrange(3000) for _ in range(n))]
    inner, outer = made(1500, 30) + [(None, 5, 6)], made(400, 90) + [(1, None, 5), (1, 5, None), (None, 0, 99)]
    df = lambda rows: spark.createDataFrame(rows, "d int, start int, end int")
    got = sorted(map(tuple, checks.covered(df(inner), df(outer), ["d"]).collect()))
    whole = [o for o in outer if None not in o]
    assert got == sorted(i for i in inner if any(o[0] == i[0] and o[1] <= i[1] and i[2] <= o[2] for o in whole))
    merged = []
    for o in sorted(whole):
        if merged and merged[-1][0] == o[0] and o[1] <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], o[2])
        else:
            merged.append(list(o))
    assert sorted(map(tuple, checks.merged_spans(df(whole), ["d"]).collect())) == [tuple(m) for m in merged]


@pytest.mark.parametrize("split", [True, False])
def test_lookups_equal_pairs(spark, split):
    rng = random.Random(2)
    names = ["hot"] * 6 + ["a", "b", None]
    uses = [(i, rng.choice(names), rng.randrange(60), rng.randrange(4), rng.choice([["in", "out"], ["in"], ["out"], []])) for i in range(800)]
    events = [(rng.choice(names), rng.choice(["in", "out", "else"]), rng.randrange(60), rng.randrange(4), f"e{i}") for i in range(60)]
    u = spark.createDataFrame(uses, "i long, name string, at_line int, at_column int, scopes array<string>")
    e = spark.createDataFrame(events, "name string, scope string, line int, column int, what string")
    got = {r.i: (r.n, r.scope, r.line, r.column) for r in bindings.visible(u, e, ["i"], ["name"], ["what"], split=split).collect()}
    want = {}
    for i, name, line, column, scopes in uses:
        for scope in scopes:
            before = sorted((x[2], x[3]) for x in events if name is not None and x[0] == name and x[1] == scope and (x[2], x[3]) < (line, column))
            if before:
                want[i] = (len(before), scope, *before[0])
                break
    assert got == want and len(want) > 300
