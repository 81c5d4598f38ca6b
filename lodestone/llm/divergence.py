"""How the sources of a language diverge in their words, by systolic rotation.

Words are counted by language and source, those that few of a language's documents have are left out, and the kept words of a language
are dealt into blocks and numbered there.  A group's counts in a block are a compressed vector.  Groups are dealt into bins; in a
round-robin tournament (circle method) each bin meets each other bin of its language once.  The vectors of a bin stay
in their partitions over all rounds; copies of its opponents' vectors travel to it, and a meeting evaluates both directions of
each pair.  So a task holds one block of two bins' vectors, and what a round moves is at most half of all vectors.

All arithmetic is in whole numbers.  Where a vector is built, a heap keeps the block's first words of its group's ranking, which
are then merged.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, within_bound

#: What a share is multiplied by, the documents of a language that must have a word, and the ranks of words that are told.
SCALE, DOCUMENTS, TOP = 1_000_000_000, 3, 200
#: Kept words of a language in a block, about; groups in a bin; rounds that one job plays.
BLOCK, BIN, ROUNDS = 1 << 16, 8, 8
#: Different words that a task counts before it passes them on.
HELD = 1 << 18
#: Letters: ASCII ones, in lower case, and all bytes of other characters; the rest parts words.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return text.encode().translate(_LETTERS).split()


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), in 64 bits: three decimal digits at a time, for totals below 9 * 10**15."""
    rest, out = np.asarray(count, np.int64) + 1, 0
    for _ in range(3):
        digits, rest = np.divmod(rest * 1_000, total)
        out = out * 1_000 + digits
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q)."""
    return (p - q) ** 2 // q


_COUNTS = "lang string, source string, term string, n long, documents long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, documents): the words of a task's documents; a row without a term tells of each group."""
    occurrences: dict[tuple[str, str], Counter] = {}
    having: dict[tuple[str, str], Counter] = {}
    held = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in occurrences.items():
            terms = list(found)
            n, documents = [found[t] for t in terms], [having[lang, source][t] for t in terms]
            terms = [None, *(t.decode() for t in terms)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array([0, *n], pa.int64()), pa.array([0, *documents], pa.int64())], names=["lang", "source", "term", "n", "documents"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            group = lang.as_py(), source.as_py()
            if group not in occurrences:
                occurrences[group], having[group] = Counter(), Counter()
            own = Counter(words(text.as_py()))
            before = len(having[group])
            occurrences[group].update(own)
            having[group].update(own.keys())
            held += len(having[group]) - before
        if held > HELD:
            yield from told()
            occurrences, having, held = {}, {}, 0
    yield from told()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): how often each group has each word and in how many documents; a null term tells of the group."""
    small_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def opponent(i: Column, r: Column, n: Column) -> Column:
    """Whom bin i of an even number n meets in round r, of 0 to n - 2, by the circle method."""
    last = n - 1
    met = F.pmod(r - i, last)
    # the last bin meets whom the circle would let meet itself: 2 x = r modulo n - 1, which is odd
    return F.when(i == last, F.pmod(r * (n / 2).cast("int"), last)).otherwise(F.when(met == i, last).otherwise(met)).cast("int")


def _vector(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending ids and their counts, compressed."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<i4").tobytes() + n.astype("<i8").tobytes(), 1)


def _dense(vector: bytes, size: int, total: int) -> np.ndarray:
    """The shares of all of a block's words."""
    data = zlib.decompress(vector)
    n = len(data) // 12
    found = np.zeros(size, np.int64)
    found[np.cumsum(np.frombuffer(data, "<i4", n))] = np.frombuffer(data, "<i8", n, 4 * n)
    return share(found, total) if size else found


_FRAGMENT = "lang string, source string, block int, bin int, size int, total long, vector binary, top array<struct<value:long,term:string>>"
_ENTRY = pa.struct([("id", pa.int32()), ("n", pa.int64()), ("lang_n", pa.int64()), ("term", pa.string())])
_TOP = pa.list_(pa.struct([("value", pa.int64()), ("term", pa.string())]))


def _fragments(top: int):
    """Makes each row's lists of a group's words in a block a vector, and keeps the top words of it by divergence from the language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, tops = [], []
            for found, total, lang_total in zip(batch.column("found"), batch.column("total").to_pylist(), batch.column("lang_total").to_pylist()):
                entries = found.values if found.is_valid else pa.array([], _ENTRY)
                ids, n, whole = (entries.field(k).to_numpy(zero_copy_only=False) for k in ("id", "n", "lang_n"))
                order = np.argsort(ids)
                vectors.append(_vector(ids[order], n[order]))
                p, q = (share(n, total), share(whole, lang_total)) if len(ids) else (n, n)
                above = np.flatnonzero(p > q)
                values, terms = divergence(p[above], q[above]).tolist(), entries.field("term").take(pa.array(above)).to_pylist()
                best = heapq.nsmallest(top, zip(values, terms), key=lambda x: (-x[0], x[1].encode()))
                tops.append([{"value": v, "term": t} for v, t in best])
            same = [batch.column(c) for c in ("lang", "source", "block", "bin", "size", "total")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(vectors, pa.binary()), pa.array(tops, _TOP)], names=[x.split()[0] for x in _FRAGMENT.split(", ")])

    return work


_MEETING = "lang string, source string, item string, value long"


def _both_ways(here: list[tuple[str, np.ndarray]], there: list[tuple[str, np.ndarray]], lang: str) -> list[tuple]:
    out = []
    for a, p in here:
        for b, q in there:
            apart = (p - q) ** 2
            out += [(lang, a, b, int((apart // q).sum())), (lang, b, a, int((apart // p).sum()))]
    return out


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 4
    return pa.Table.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["lang", "source", "item", "value"])


def _opened(table: pa.Table) -> list[tuple[str, np.ndarray]]:
    return [(r["source"], _dense(r["vector"], r["size"], r["total"])) for r in table.select(["source", "vector", "size", "total"]).to_pylist()]


def _at_home(table: pa.Table) -> pa.Table:
    """The pairs within one bin and block."""
    groups = _opened(table)
    lang = table.column("lang")[0].as_py()
    return _table([x for i, one in enumerate(groups) for x in _both_ways([one], groups[i + 1 :], lang)])


def _met(home: pa.Table, visitors: pa.Table) -> pa.Table:
    """The pairs of one bin's vectors with its visitors', one visiting bin at a time, in one block."""
    if not len(home) or not len(visitors):
        return _table([])
    visitors = visitors.rename_columns([c.removeprefix("v_") for c in visitors.column_names])
    here, lang = _opened(home), home.column("lang")[0].as_py()
    rounds = visitors.column("round").to_numpy()
    return _table([x for r in np.unique(rounds) for x in _both_ways(here, _opened(visitors.filter(pa.array(rounds == r))), lang)])


def _tournament(fragments: DataFrame, most_bins: int, rounds: int) -> DataFrame:
    """(lang, source, item, value): the sums over each block of each pair, both ways.

    The vectors that stay are dealt out once and kept by their partitions (lost ones are dealt again from the staged table); each job
    sends the visitors of a few rounds.  A bin's visitor is the one with the smaller number if the numbers' sum is even, else the other.
    """
    spark = fragments.sparkSession
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    vectors = fragments.select("lang", "source", "block", "bin", "bins", "size", "total", "vector")
    home = vectors.repartition(slots, "lang", "block", "bin").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = stage(home.groupBy("lang", "block", "bin").applyInArrow(_at_home, _MEETING).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "met")
        for first in range(0, most_bins - 1, rounds):
            last = F.least(F.lit(first + rounds - 1), F.col("bins") - 2)
            playing = vectors.where(F.col("bins") - 2 >= first).withColumn("round", F.explode(F.sequence(F.lit(first), last)))
            playing = playing.withColumn("other", opponent(F.col("bin"), F.col("round"), F.col("bins")))
            travels = (F.col("bin") < F.col("other")) == ((F.col("bin") + F.col("other")) % 2 == 0)
            visitors = playing.where(travels).withColumn("bin", F.col("other")).drop("other", "bins")
            visitors = visitors.toDF(*[f"v_{c}" for c in visitors.columns]).repartition(slots, "v_lang", "v_block", "v_bin")
            met = home.groupBy("lang", "block", "bin").cogroup(visitors.groupBy("v_lang", "v_block", "v_bin")).applyInArrow(_met, _MEETING)
            found = found.unionByName(stage(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "met"))
        return found
    finally:
        home.unpersist()


def audit(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP, block: int = BLOCK, bin_size: int = BIN, rounds: int = ROUNDS) -> DataFrame:
    """How each source of a language diverges from the others and from the language: lang, source, part, item, value, rank.

    docs needs text, lang and source; nulls are empty, and other columns are ignored.  Words that fewer documents of the language
    have are left out.  A group's share of a word is 1 + floor(10**9 (count + 1) / (all its counts + number of kept words)), and f is
    floor((p - q)**2 / q).  Part pair: the sum of f over all kept words against each other source of the language, all ranks.  Part
    term: the words that a source has, and has more of than the language, by f, the first ranks.  Equal values are ranked by the
    item's bytes.  A language without kept words has pairs of value 0; a group without words has the least shares.  A source alone
    in its language has no pairs.  Repeated rows count each.  An empty table gives no rows.
    """
    found = stage(counts(docs), "counts")
    terms = found.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents"))
    kept = stage(terms.where(F.col("documents") >= documents).drop("documents"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    langs = found.select("lang").distinct().join(langs, "lang", "left").na.fill(0, ["kept", "lang_total"])
    langs = within_bound(stage(langs.withColumn("blocks", F.ceil(F.greatest("kept", F.lit(1)) / block).cast("int")), "langs"))
    # numbers within blocks: a window holds one block of a language
    kept = kept.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    numbered = stage(kept.select("lang", "term", "lang_n", "block", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).alias("id")), "numbered")
    entries = stage(found.where("term is not null").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "entries")

    groups = found.where("term is null").select("lang", "source")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    bins = F.ceil(F.count("*").over(Window.partitionBy("lang")) / bin_size)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang")
    # an even number of bins; one that is empty lets its opponent rest
    groups = groups.withColumn("bins", (F.floor((bins + 1) / 2) * 2).cast("int")).withColumn("bin", F.pmod(place, F.col("bins")).cast("int"))
    groups = groups.withColumn("total", F.coalesce("own", F.lit(0)) + F.col("kept")).withColumn("lang_total", F.col("lang_total") + F.col("kept"))
    groups = stage(groups.select("lang", "source", "bin", "bins", "blocks", "total", "lang_total"), "groups")

    # every group has a vector in every block of its language, if only of its least share
    sizes = numbered.groupBy("lang", "block").agg(F.count("*").cast("int").alias("size"))
    each = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    each = each.join(within_bound(stage(sizes, "sizes")), ["lang", "block"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    lists = entries.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("id", "n", "lang_n", "term")).alias("found"))
    rows = each.join(lists, ["lang", "source", "block"], "left")
    fragments = rows.select("lang", "source", "block", "bin", "size", "total", "lang_total", "found").mapInArrow(_fragments(top), _FRAGMENT)
    fragments = stage(fragments, "fragments")
    bins_of = groups.select("lang", "bins").distinct()
    most = bins_of.agg(F.max("bins")).first()[0] or 0
    sums = _tournament(fragments.drop("top").join(within_bound(stage(bins_of, "bins")), "lang"), most, rounds)

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    heaps = fragments.select("lang", "source", F.explode("top").alias("t")).select("lang", "source", F.col("t.term").alias("item"), F.col("t.value").alias("value"))
    ranked = heaps.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(columns).unionByName(ranked.select(columns))


#: The same in SQL, each pair by a join on the language's kept words.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS tk FROM documents),
o AS (SELECT i, lang, source, unnest(tk) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(ln) AS ln FROM k GROUP BY lang),
t AS (SELECT g.lang, g.source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source) AS n FROM g),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.n + v.v))::BIGINT AS p,
        (1 + (1000000000::HUGEINT * (k.ln + 1)) // (v.ln + v.v))::BIGINT AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
