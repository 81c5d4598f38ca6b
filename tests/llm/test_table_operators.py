"""Near-duplicates, fingerprints, packing, shards, mixing and line dedup."""

import bisect
import hashlib
import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone import staging
from lodestone.functions import tables
from lodestone.llm import common, components, fingerprints, lines, mixing, packing, resembling, shards, simhash
from lodestone.llm.bytebpe import encoder

WORDS = [f"word{i}" for i in range(300)]


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


# -- near-duplicates --------------------------------------------------------------------------------------------------------------------


def test_components_of_chains_stars_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(1).shuffle(pairs)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys(range(200, 203), 200)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_no_link_is_lost(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 5))) for b in base for _ in range(8)]
    edges = [0, 1, (1 << 64) - 1, 1 << 63, 0xFFFF, 0xFFFF << 48, 0x8000800080008000]
    fps = sorted({*base, *near, *edges})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(sorted((r.u, r.v))) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want and len(want) > 100


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_joins_that_grow_with_the_input_are_never_broadcast(spark):
    # Spark's estimate leaves out what explode() adds: the driver had to hold 36 rows of each fingerprint
    distinct = staging.stage(spark.range(200).selectExpr("xxhash64(id) as fp", "id as first"), "fingerprints")
    for df in (simhash.links(distinct), components._star(distinct.selectExpr("fp as u", "first as v"), large=True)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tables_beyond_the_bound_shuffle(spark):
    ids, both = staging.stage(spark.range(60), "ids"), ((tables.if_small, 50), (common.within_bound, 50))
    for mark, rows in both:
        assert "SortMergeJoin" in ids.join(mark(ids, rows), "id")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in ids.join(mark(ids, 100), "id")._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_equal_brute_force(make, odd):
    rng = random.Random(3)
    rows = list(odd)
    for i in range(20, 60):
        w = rng.choices(WORDS, k=150)
        rows.append((i, " ".join(w), "en", "s"))
        w[rng.randrange(150)] = "changed"
        rows += [(i + 100, " ".join(w), "en", "s"), (i + 200, " ".join(w).upper(), "en", "s")]
    got = simhash.near_duplicates(make(rows, clash=True)).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    own = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = defaultdict(list)
    for (i, *_), r in zip(rows, own):
        least[r] += [i] if i is not None else []
    want = Counter((i, f"{fp:016x}", min(least[r], default=None)) for (i, *_), fp, r in zip(rows, fps, own))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.deduplicated(make(rows, clash=True)).collect()
    assert len(kept) == len(set(own))  # one row of each group
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({min(v) for v in least.values() if v})


def test_one_row_of_each_group_stays_without_ids(make):
    rows = [(None, "a b c d e f", "en", "s"), (None, "a b c d e f", "en", "t"), (None, "other words are here now", "en", "s"), (1, "a b c d e f", "en", "s"), (1, "something else entirely today", "en", "s")]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.deduplicated(make(rows)).collect())
    assert kept == [(0, "other words are here now"), (1, "a b c d e f"), (1, "something else entirely today")]


def test_no_documents(make):
    assert simhash.near_duplicates(make([])).count() == simhash.deduplicated(make([])).count() == 0


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, bool(w)))}


def test_frequent_members_are_put_off_wherever_their_hashes_lie(spark, make):
    passage = " ".join(f"common{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"own{k}x{i}" for i in range(140)) for k in range(30)]
    docs = make([(i, t, "en", "a") for i, t in enumerate(texts)]).withColumn("tie", F.xxhash64("text"))
    last = resembling._frequent(docs, resembling.LEAST)
    shared = set(resembling.shingles(passage).view(np.int64).tolist())
    assert shared == set(last.tolist())  # not only those that stand first in a text
    keys = resembling._prefixes(docs, resembling.LEAST, last).select("key").collect()
    assert not shared & {r.key for r in keys}


def test_resembling_leaves_no_spent_tables(spark, make):
    staging.drop_staged(spark)
    rows = [(i, " ".join(f"w{i % 7}x{j}" for j in range(40)) + f" own{i}", "en", "a") for i in range(40)]
    assert resembling.deduplicated(make(rows)).count() == 7
    top = staging.session_dir(spark).removeprefix("file://")
    left = {d.rsplit("-", 1)[0] for d in os.listdir(top)}
    assert not left & {"prefixes", "headed", "heads", "rooted", "members", "wanted", "differences", "told", "direct"}


@pytest.mark.parametrize("direct", [1, resembling.DIRECT])
def test_resembling_equals_brute_force(make, odd, monkeypatch, direct):
    monkeypatch.setattr(resembling, "MANY", 3)  # a small table has shingles to put off, too
    rng = random.Random(6)
    rows, chorus = list(odd), rng.choices(WORDS, k=30)
    for i in range(20, 60):
        w = chorus * (i % 3) + rng.choices(WORDS, k=rng.choice([4, 5, 9, 40, 150]))
        rows.append((i, " ".join(w), "en", "s"))
        for step in (100, 200, 300, 400):
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = f"changed{rng.randrange(9)}"
            rows.append((i + step, " ".join(w).title() + "\n", "en", "s"))
    sets = [five_words(t) for _, t, *_ in rows]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    far = [(i, j) for i, j in pairs if (brute_fingerprint(rows[i][1]) ^ brute_fingerprint(rows[j][1])).bit_count() > 3]
    own, least = roots(len(rows), pairs), defaultdict(list)
    for (i, *_), r in zip(rows, own):
        least[r] += [i] if i is not None else []
    kept = resembling.deduplicated(make(rows, clash=True), direct=direct).collect()
    assert len(far) > 10 and len(kept) == len(set(own)) < len(rows) - 10
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({min(v) for v in least.values() if v})
    assert resembling.deduplicated(make([])).count() == 0


def test_differences_from_a_hub_lose_no_pair_and_make_few(spark, make, monkeypatch):
    monkeypatch.setattr(resembling, "SERVED", 20)
    rng = random.Random(8)
    common = rng.choices(WORDS, k=120)

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(400)}"
        return w[: len(w) - rng.randrange(9)]

    texts = [edited(common, rng.randrange(1, 16)) for _ in range(120)]
    for n in (5, 7, 9, 14):  # families away from the common text, alike among themselves
        family = edited(common, n)
        texts += [edited(family, rng.randrange(3)) for _ in range(8)]
    docs = make([(i, " ".join(w), "en", "s") for i, w in enumerate(texts)]).select("doc_id", simhash.text_hash(F.col("text")).alias("tie"), "text")
    sets = {}
    for w in texts:
        x = resembling.shingles(" ".join(w))
        sets[resembling._node(x)] = set(x.tolist())
    nodes = docs.mapInArrow(resembling._sets, "doc_id long, tie long, node long, n int, f0 long, f1 long, f2 long, f3 long")
    nodes = nodes.withColumnRenamed("doc_id", "doc").withColumnRenamed("tie", "doc_tie").dropDuplicates(["node"])
    names = sorted(sets)
    for hub in (names[0], resembling._node(resembling.shingles(" ".join(texts[-1])))):
        parts = spark.createDataFrame([(1, x, hub if i < 2 else x) for i, x in enumerate([hub, *(x for x in names if x != hub)])], "key long, node long, root long")
        linked, pairs = resembling._by_hubs(resembling._differences(parts, docs, nodes, 1), nodes, resembling.LEAST)
        linked, pairs = {frozenset(r) for r in linked.collect()}, {frozenset(r) for r in pairs.collect()}
        alike = {frozenset((a, b)) for i, a in enumerate(names) for b in names[:i] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
        by_hub = {x for pair in linked for x in pair}
        one_root = frozenset(r.node for r in parts.collect() if r.root == hub)
        assert linked == {pair for pair in alike if hub in pair}
        lost = [pair for pair in alike - linked - pairs if not pair <= by_hub and pair != one_root]
        assert not lost and len(pairs & alike) > 20
        assert len(pairs) < len(names) * (len(names) - 1) // 2 // 5


# -- fingerprints ---------------------------------------------------------------------------------------------------------------------------


def brute_sketch(t, k=128):
    hashes, out = [xxhash.xxh64_intdigest(w, 42) for w in (t or "").encode().split()], set()
    for i in range(max(len(hashes) - 4, min(1, len(hashes)))):
        h = 42
        for x in hashes[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)[:k]


def likeness(a, b, k=128):
    u = sorted({*a, *b})[:k]
    return len({*u} & {*a} & {*b}) / len(u) if u else 1.0


@pytest.mark.parametrize("bucket, fan", [(3, 512), (2_000, 512), (2, 4)])
def test_fingerprints_equal_brute_force(make, odd, monkeypatch, bucket, fan):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(fingerprints, "FAN", fan)
    rows = [r for r in odd if r[0] is not None][1:] + [(i, random.Random(i).choice(" \n\t").join(random.Random(i).choices(WORDS, k=i)), "en", "s") for i in range(20, 40)]
    rows += [(60 + i, " ".join(WORDS[:i]) + "  " * (i % 3), "en", "s") for i in range(9)]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(make(rows, clash=True)).collect()}
    texts = sorted((i, t or "") for i, t, *_ in rows)
    assert len(got) == len(texts)
    for n, (i, t) in enumerate(texts):
        after = texts[(n + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = map(brute_sketch, (t, edited, after))
        r = got[i]
        assert r.edited_fingerprint == "".join(f"{x & (1 << 64) - 1:016x}" for x in b)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x & (1 << 64) - 1:016x}" for x in a) and (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))


def test_fingerprints_of_repeated_rows_null_ids_and_nothing(make, odd):
    assert fingerprints.edited_likeness(make(odd)).count() == len(odd)
    one = fingerprints.edited_likeness(make([(1, "a b c d e f g h", "en", "s")])).first()
    assert one.near_next == 1.0
    assert fingerprints.edited_likeness(make([])).count() == 0


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(9)
    a, b = [rng.getrandbits(63) for _ in range(6_000)], [rng.getrandbits(63) for _ in range(3_000)]
    both = spark.createDataFrame([(sorted(a)[:128], sorted(a[:3_000] + b)[:128], "k")], "a array<long>, b array<long>, k string").select(
        "k", "a", "b", fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.decode(fingerprints.encode(F.col("a"))).alias("d")
    ).first()
    assert both.d == both.a and abs(both.r - 1 / 3) < 0.15
    parts = spark.createDataFrame([("k", sorted(a[i::7])[:128]) for i in range(7)], "k string, sketch array<long>")
    assert fingerprints.merged(parts, ["k"]).first().sketch == sorted(a)[:128]
    whole = [x - (1 << 63) if i % 2 else x for i, x in enumerate(a)]  # both signs
    row = spark.createDataFrame([(sorted(whole)[:128], sorted(whole[:3_000])[:128])], "a array<long>, b array<long>")
    n, c = row.select(fingerprints.distinct_shingles(F.col("a")), fingerprints.containment(F.col("b"), F.col("a"))).first()
    assert abs(n / 6_000 - 1) < 0.3 and c > 0.7


def test_the_same_row_of_one_id_and_text_stays_in_any_order(make):
    rows = [(1, "one text", lang, source) for lang, source in (("en", "a"), ("de", "b"), (None, None))] + [(2, "another", "en", "a")] * 2 + [(3, "one text", "en", "a")]
    kept = set()
    for order, n in ((rows, 1), (rows[::-1], 1), (rows[2:] + rows[:2], 3)):
        docs = make(order, partitions=n)
        grouped = docs.select("doc_id", simhash.text_hash(F.col("text")).alias("tie"), F.crc32("text").alias("root"))
        kept.add(tuple(sorted(map(tuple, simhash.one_of_each(docs, grouped).collect()))))
    assert len(kept) == 1 and [r[0] for r in kept.pop()] == [1, 2]


# -- packing ------------------------------------------------------------------------------------------------------------------------------------


def check_packing(runs, sizes, capacity):
    left, filled = Counter(), defaultdict(list)
    for s, rank, n, first, each, offset in runs:
        for j in range(n):
            left[s, rank + j] += 1
            filled[first + j // each].append((offset + j % each * s, s))
    assert left == Counter({(s, r): 1 for s, n in sizes.items() for r in range(n)})
    for items in filled.values():
        at = 0
        for offset, s in sorted(items):
            assert offset == at
            at += s
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("seed", range(8))
def test_a_sweep_takes_the_best_gap_for_the_largest_document_first(seed):
    rng = random.Random(seed)
    docs, gaps = Counter(rng.choices(range(11, 21), k=40)), Counter(rng.choices(range(1, 21), k=30))  # no gap holds two
    numbers = iter(range(99))
    runs = [(g, next(numbers), 1) for g in gaps.elements()]
    placed, left, open_ = packing.swept([(s, 0, n) for s, n in docs.items()], runs, 20)
    free, want, lost = sorted(gaps.elements()), Counter(), Counter()
    for s in sorted(docs.elements(), reverse=True):
        fit = [g for g in free if g >= s]
        if fit:
            free.remove(min(fit))
            free += [min(fit) - s] if min(fit) > s else []
            want[s, 20 - min(fit)] += 1
        else:
            lost[s] += 1
    got = Counter()
    for s, _, n, _, each, offset in placed:
        assert each == 1
        got[s, offset] += n
    assert got == want and Counter({s: n for s, _, n in left}) == lost and sorted(g for g, _, n in open_ for _ in range(n)) == sorted(free)


@pytest.mark.parametrize("seed", range(2))
def test_a_distributed_round_leaves_nothing_that_a_gap_holds(spark, seed):
    rng = random.Random(seed)
    docs = [(s, 0, rng.randint(1, 50)) for s in range(1, 101) if rng.random() < 0.6]
    gaps = [(g, 1_000 * i, rng.randint(1, 60)) for i, g in enumerate(rng.choices(range(1, 101), k=70))]
    frame = lambda kind, runs: spark.createDataFrame([(kind, *r, 0, 0, 0) for r in runs], packing._RUNS)
    rows, _, left = packing._round(frame(packing._DOCUMENT, docs), frame(packing._GAP, gaps), 100)
    rows = rows.collect()
    some = lambda kind: [r for r in rows if r.kind == kind]
    volume = lambda kind: sum(r.size * r.n for r in some(kind))
    assert volume(packing._GAP) + volume(packing._PLACED) == sum(g * n for g, _, n in gaps)
    assert volume(packing._DOCUMENT) == left and left + volume(packing._PLACED) == sum(s * n for s, _, n in docs)
    largest = max(r.size for r in some(packing._GAP))
    assert left and all(r.size > largest for r in some(packing._DOCUMENT))


def one_at_a_time(sizes, capacity):
    """The number of sequences of best fit over documents in descending order."""
    gaps, used = [], 0
    for s in sorted(sizes.elements(), reverse=True):
        at = bisect.bisect_left(gaps, s)
        used += at == len(gaps)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - s)
    return used


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_packing_needs_no_more_than_best_fit(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    got = packing.pack(spark.read.parquet(path)).select("length", "sequence_id").collect()
    assert len({r.sequence_id for r in got}) == one_at_a_time(Counter(r.length for r in got), packing.CAPACITY)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_valid_and_close_to_the_bound(spark, seed):
    rng = random.Random(seed)
    capacity = [7, 64, 500, 64][seed]
    sizes = Counter(min(capacity, 1 + int(rng.expovariate(rng.choice([3, 8]) / capacity))) for _ in range([1, 50, 3_000, 3_000][seed]))
    runs = [tuple(r) for r in packing.best_fit(spark.createDataFrame(list(sizes.items()), "size long, n long"), capacity).collect()]
    n = check_packing(runs, sizes, capacity)
    bound = -(-sum(s * k for s, k in sizes.items()) // capacity)
    used = one_at_a_time(sizes, capacity)
    assert bound <= n <= used + max(1, used // 50)


def test_packed_rows(make, odd):
    rows = [*odd, *[(100 + i, "same text", "en", "hot") for i in range(300)], (9_999, "<|endoftext|> x", "en", "s")]
    got = packing.pack(make(rows, clash=True), capacity=64).collect()
    encode = encoder().slow.encode
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        for k, at in enumerate([0, *range(first, len(ids), 64)]):
            end = first if k == 0 else at + 64
            want[i, k, at, end - at, zlib.crc32(ids[at:end].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for items in filled.values():
        assert [o for o, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:k]) for k in range(len(items))]
        assert sum(n for _, n in items) <= 64
    assert len(filled) <= -(-sum(r.length for r in got) // 64) + 2


def test_packing_of_nothing(make):
    assert packing.pack(make([])).count() == 0


# -- shards -----------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1_000])
def test_permutation(n):
    p, q = shards.Permutation(n, 1), shards.Permutation(n, 2)
    x = p.slots(np.arange(n))
    assert sorted(x) == list(range(n)) and (p.sequences(x) == np.arange(n)).all()
    assert n < 64 or (x != q.slots(np.arange(n))).any()


def test_shards_round_trip(make, odd, tmp_path):
    index = shards.materialise(make(odd, clash=True), str(tmp_path), length=16, slots=8).orderBy("slot").collect()
    found = list(shards.read(f"file://{tmp_path}"))
    assert len(found) == len(index) and [r.slot for r in index] == list(range(len(index)))
    assert all(zlib.crc32(s.tobytes()) == r.ids_crc32 and r.byte_offset == r.slot % 8 * 32 for s, r in zip(found, index))
    order = shards.Permutation(len(found))
    stream = np.concatenate([found[s] for s in order.slots(np.arange(len(found)))])
    total = sum(r.n_tokens for r in index)
    assert not stream[total:].any()
    encode = encoder().encode
    each = sorted(((i is not None, i or 0), xxhash.xxh64_intdigest(ids) - (1 << 63), ids) for i, t, *_ in odd for ids in [np.append(encode(t or ""), 0).astype("<u2").tobytes()])
    assert stream[:total].tobytes() == b"".join(ids for *_, ids in each)
    assert [s.tolist() for s in shards.read(f"file://{tmp_path}", 6, 4)] == [s.tolist() for s in found[6:10]]
    assert {i for r in index for i in r.doc_ids} == {i for i, *_ in odd}


def test_shards_follow_the_rows_and_not_their_splits(make, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "RANGE", 3)
    written = []
    for n in (2, 6):
        shards.materialise(make(odd, partitions=n), str(tmp_path / "out"), length=16, slots=512)
        written.append([s.tolist() for s in shards.read(f"file://{tmp_path / 'out'}")])
    assert written[0] == written[1] and len(written[0]) > 100
    docs = make(odd, partitions=6)
    spark = docs.sparkSession
    spark.conf.set("spark.sql.files.minPartitionNum", 1)  # one task reads all parts
    try:
        shards.materialise(docs, str(tmp_path / "out"), length=16, slots=512)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert [s.tolist() for s in shards.read(f"file://{tmp_path / 'out'}")] == written[0]
    # a smaller corpus in the same folder leaves nothing of the larger one to read
    shards.materialise(make(odd[:3]), str(tmp_path / "out"), length=16, slots=512)
    assert len(list(shards.read(f"file://{tmp_path / 'out'}"))) < 5


def test_shards_survive_the_end_of_staging(spark, make, odd):
    from lodestone.staging import drop_staged

    path = shards.materialise(make(odd), length=16, slots=512).first().path
    drop_staged(spark)
    assert len(list(shards.read(path.rsplit("/", 2)[0], 0, 3))) == 3


def test_shards_of_nothing(make, tmp_path):
    assert shards.materialise(make([]), str(tmp_path)).count() == 0 and list(shards.read(f"file://{tmp_path}")) == []


# -- mixing -------------------------------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, full = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set()
    while left > 1e-9 and len(full) < len(names):
        free = [s for s in names if s not in full]
        share, left = left, 0.0
        for s in free:
            target[s] += share * w[s] / sum(w[f] for f in free)
        for s in free:
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                full.add(s)
    return target


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 60))), "en", rng.choices(["a", "b", "c", "é", None, "z"], [30, 1, 5, 3, 3, 8])[0]) for i in range(3_000)]
    return rows + [(5_000, "tiny", "en", "A"), (5_001, None, "en", "void"), (5_002, "", "en", "void")]


def test_mix_meets_its_targets(make):
    rows = corpus()
    got = mixing.mix(make(rows, clash=True)).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken == r.size * r.copies <= 3 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(make(rows, partitions=5)).collect()), key=repr)


def test_ids_that_repeat_or_are_null_are_taken_apart(make):
    """Sources of one id or none meet their targets as any other."""
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choices(WORDS, k=k))
    rows = [(i, text(20), "en", "a") for i in range(500)] + [(None, text(20), "en", "b") for _ in range(400)] + [(7, text(20), "en", "c") for _ in range(400)]
    rows += [(8, "the same five words here", "en", "d")] * 700 + [(None, None, "en", "d")] * 5
    got = mixing.mix(make(rows)).collect()
    sizes, taken = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 10 for s in sizes), (taken, want)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(make(rows, partitions=7)).collect()))
    out = Counter(r.source for r in mixing.mixed(make(rows, clash=True)).collect())
    assert out == Counter({s: sum(r.copies for r in got if r.source == s) for s in "abcd"})


def brute_copies(places, sizes, target, bits=36):
    """How often each document of a source is taken: whole copies, then by falling buckets of places, then the nearest one."""
    if not sum(sizes):
        return [0] * len(sizes)
    whole = int(target // sum(sizes))
    left = target - whole * sum(sizes)
    bucket = [(h % (1 << 64)) >> (64 - bits) for h in places]
    order = sorted(range(len(places)), key=lambda i: bucket[i])
    copies, taken, i = [whole] * len(places), 0, 0
    while i < len(order):
        same = [j for j in order[i:] if bucket[j] == bucket[order[i]]]
        if taken + sum(sizes[j] for j in same) > left:
            break
        for j in same:
            copies[j] += 1
            taken += sizes[j]
        i += len(same)
    rest = [j for j in order[i:] if abs(sizes[j] - (left - taken)) < left - taken]
    if i < len(order) and rest:
        copies[min(rest, key=lambda j: (abs(sizes[j] - (left - taken)), places[j]))] += 1
    return copies


def test_thresholds_are_as_by_brute_force(make):
    docs = make(corpus(2))
    placed = mixing._sized(docs).collect()
    edge = {r.source: r for r in mixing.thresholds(mixing._sized(docs), (5, 2, 1), 3.0, 1.0).collect()}
    got = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    for source, goal in edge.items():
        own = [r for r in placed if r.source == source]
        assert [got[r.doc_id] for r in own] == brute_copies([r.h for r in own], [r.size for r in own], goal.target), source


def test_mix_is_the_same_without_broadcasts(make, monkeypatch):
    want = sorted(map(tuple, mixing.mix(make(corpus())).collect()), key=repr)
    monkeypatch.setattr(mixing, "within_bound", lambda df: df)
    assert sorted(map(tuple, mixing.mix(make(corpus())).collect()), key=repr) == want


def test_smaller_budgets_are_nested(make):
    docs = make(corpus())
    small, large = ({r.doc_id: r.copies for r in mixing.mix(docs, share=s).collect()} for s in (0.2, 0.5))
    assert sum(small[i] > large[i] for i in small) <= 7  # the one closing document of a source at most


def test_mixed_repeats_rows(make, odd):
    docs = make(corpus())
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in copies.items() if c})
    assert mixing.mixed(make(odd, clash=True)).columns == make(odd, clash=True).columns
    assert mixing.mix(make(odd, clash=True)).count() == len(odd) and mixing.mix(make([])).count() == 0


# -- line dedup ------------------------------------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    seen, first = defaultdict(set), {}
    for i, t, _, s in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line.encode().split()) >= 3:
                seen[line].add(s)
                first.setdefault(line, (t, k))
    out = {}
    for i, t, *_ in rows:
        kept = t and [x for k, x in enumerate(t.split("\n")) if len(seen[x]) < least or first[x] == (t, k)]
        out[i] = t if t is None else "\n".join(kept or [])
    return out


@pytest.mark.parametrize("seed, small", [(1, True), (2, True), (3, False)])
def test_lines_equal_brute_force(make, monkeypatch, seed, small):
    if not small:  # as if the tables were too large for a broadcast
        monkeypatch.setattr(lines, "within_bound", lambda df: df)
    rng = random.Random(seed)
    pool = [f"line number {i} here" for i in range(40)] + ["too short", "", "All rights reserved."]
    rows = [(i, "\n".join(rng.choices(pool, rng.choices(range(1, 40), k=43), k=rng.randint(0, 6))), "en", rng.choice([None, *"abcdefghijklmno"])) for i in range(400)]
    rows += [(500 + i, rows[i][1], "en", "p") for i in range(40)]  # copies
    rows += [(1_000, None, "en", "a"), (1_001, "\n\n", None, "b")]
    docs = make(rows)
    assert {r.doc_id: r.text for r in lines.cleaned(docs).collect()} == brute_lines(rows, 10)


def test_lines_odd_rows(make, odd):
    clash = lines.cleaned(make(odd, clash=True))
    assert clash.count() == len(odd) and set(clash.columns) == {*make(odd, clash=True).columns, "n_removed"}
    bare = lines.cleaned(make(odd, clash=True), counts=False)
    assert bare.columns == make(odd, clash=True).columns
    assert lines.cleaned(make([])).count() == 0
