"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents and the gaps of open sequences are both sorted by size into ranges.  A round sweeps the ranges in parallel: each
document asks for its successor among the gaps, the smallest that holds it; where several ask for one gap they are served by
rank, larger ones first; what a document leaves of a gap is a gap for the smaller ones of the sweep.  Documents without a successor in
their range meet the gaps that other ranges have left.  Then the updated gaps go to their ranges and the next round begins.

Sizes are whole numbers up to the capacity, so in both lists equal entries stand in runs, and the rows of a sweep are runs: their
number follows the number of sizes and not the corpus.  Texts are cut and hashed, sizes counted, and every document is ranked within
its size without gathering a size in one task, and then joined to the run that holds its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import small_batches, stage, within_bound

CAPACITY, END = 2_048, 0
#: Each size is ranked in so many parts at least, and in more where there are more documents than ROWS times that.
PARTS, ROWS = 64, 100_000
#: Ranges of sizes that are swept in parallel; bands, each but the last from half of its largest size on; ranks in a block.
RANGES, BANDS, BLOCK = 4, 3, 1 << 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first has what is left over, the others are full."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of each document: its ids, closed by end, and the CRC-32 of each piece's ids."""
    small_batches(docs.sparkSession)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                rows += [(doc_id, i, at, n, zlib.crc32(ids[at : at + n])) for i, (at, n) in enumerate(cut(len(ids), capacity))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, PIECES)


def swept(docs: Iterable[tuple[int, int, int]], gaps: Iterable[tuple[int, int, int]], capacity: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """One sweep over runs of documents (size, rank, n) and of gaps (size, sequence, n): (placed, documents left, gaps left).

    Documents are served from the largest on.  A document's successor is the smallest gap that holds it; a gap takes as many
    documents of the size that wins it as it holds, and what is left of it is a gap again.  placed has (size, rank, n, sequence, each,
    offset): documents rank, rank + 1, ... of that size, each of them to a sequence, the first at offset.
    """
    free = sorted(gaps)
    placed, left = [], []
    for size, rank, n in sorted(docs, key=lambda d: (-d[0], d[1])):
        while n and (at := bisect_left(free, (size,))) < len(free):
            gap, first, there = free.pop(at)
            each = gap // size
            taken = min(n, there * each)
            whole, rest = divmod(taken, each)
            for m, k, skip in ((whole, each, 0), (1, rest, whole)):
                if m and k:
                    placed.append((size, rank + skip * each, m * k, first + skip, k, capacity - gap))
                    if gap > k * size:
                        insort(free, (gap - k * size, first + skip, m))
            used = whole + (rest > 0)
            if used < there:
                insort(free, (gap, first + used, there - used))
            rank, n = rank + taken, n - taken
        if n:
            left.append((size, rank, n))
    return placed, left, free


_RUNS = "kind int, size long, at long, n long, sequence long, each long, offset long"
_NAMES = [x.split()[0] for x in _RUNS.split(", ")]
_GAP, _DOCUMENT, _PLACED = range(3)


def _sweep(capacity: int):
    """swept() over each partition's rows of _RUNS; what was placed before passes through."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {_GAP: [], _DOCUMENT: []}
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            done = batch.filter(pa.array(kind >= _PLACED))
            yield pa.RecordBatch.from_arrays([done.column(c) for c in _NAMES], names=_NAMES)
            some = batch.filter(pa.array(kind < _PLACED))
            for k, *run in zip(*(some.column(c).to_pylist() for c in _NAMES[:4])):
                rows[k].append(tuple(run))
        placed, left, gaps = swept(rows[_DOCUMENT], rows[_GAP], capacity)
        out = [(_PLACED, *x) for x in placed] + [(k, *x, 0, 0, 0) for k, some in ((_DOCUMENT, left), (_GAP, gaps)) for x in some]
        columns = list(zip(*out)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.int32()) for i, c in enumerate(columns)], names=_NAMES)

    return sweep


def _round(docs: DataFrame, gaps: DataFrame, capacity: int) -> tuple[DataFrame, int, int]:
    """(rows, documents placed, volume left) of one bulk-synchronous round, run as one job.

    Each range of sizes is swept by itself, then what is left of all ranges together: one run a size and gap at most, not documents.
    """
    kind, spread = F.col("kind"), F.pmod(F.xxhash64("size", "at"), F.lit(RANGES))
    own = F.when(kind == _PLACED, spread).otherwise(F.expr(f"size * {RANGES} div {capacity + 1}"))
    rows = docs.unionByName(gaps).repartitionById(RANGES, own.cast("int")).mapInArrow(_sweep(capacity), _RUNS)
    rest = F.when(kind == _PLACED, spread).otherwise(0)
    rows = rows.repartitionById(RANGES, rest.cast("int")).mapInArrow(_sweep(capacity), _RUNS)
    seen = Observation()
    volume = F.sum(F.when(kind == _DOCUMENT, F.col("size") * F.col("n")).otherwise(0))
    rows = stage(rows.observe(seen, F.count_if(kind == _PLACED).alias("placed"), F.coalesce(volume, F.lit(0)).alias("volume")), "round")
    return rows, seen.get["placed"], seen.get["volume"]


def best_fit(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs n documents of each size in sizes (size, n): (size, rank, n, sequence, each, offset), see swept().

    As many sequences as all sizes fill are open from the start.  Rounds run by falling bands of sizes, so that small
    documents fill what larger ones leave; where a round places nothing, the documents left open new sequences.  All placing is
    done by Spark; of a round its counts alone reach the driver.
    """
    spark = sizes.sparkSession
    zero = [F.lit(0).cast("long").alias(c) for c in ("sequence", "each", "offset")]
    sizes = stage(sizes.select(F.lit(_DOCUMENT).alias("kind"), F.col("size").cast("long").alias("size"), F.lit(0).cast("long").alias("at"), F.col("n").cast("long").alias("n"), *zero), "sizes")

    def opened(first: int, volume: int) -> tuple[DataFrame, int]:
        n = -(-volume // capacity)
        return spark.createDataFrame([(_GAP, capacity, first, n, 0, 0, 0)] if n else [], _RUNS), first + n

    placed = spark.createDataFrame([], _RUNS)
    gaps, count = opened(0, int(sizes.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0))
    docs = sizes.limit(0)
    bounds = [*(capacity >> k for k in range(BANDS)), 0]
    for high, low in zip(bounds, bounds[1:]):
        docs = docs.unionByName(sizes.where((F.col("size") > low) & (F.col("size") <= high)))
        while True:
            done, some, volume = _round(docs, gaps, capacity)
            placed = placed.unionByName(done.where(F.col("kind") == _PLACED))
            docs = done.where(F.col("kind") == _DOCUMENT)
            gaps = done.where(F.col("kind") == _GAP)
            if not volume:
                docs = sizes.limit(0)
                break
            if not some:
                more, count = opened(count, volume)
                gaps = gaps.unionByName(more)
    return placed.select("size", F.col("at").alias("rank"), "n", "sequence", "each", "offset")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs needs doc_id (long) and text; other columns are ignored.  A null or empty text is the closing id alone.  Null
    doc_ids and repeated rows have pieces of their own.  An empty table gives no rows.  Places are the same in each run but for
    repeated rows, which may change places with each other.
    """
    items = stage(pieces(docs, vocabulary, capacity, end), "pieces")
    parts = max(PARTS, items.count() // ROWS)
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = stage(items.groupBy("length", "part").agg(F.count("*").alias("n")), "sizes")
    runs = stage(best_fit(counts.groupBy(F.col("length").alias("size")).agg(F.sum("n").alias("n")), capacity), "runs")

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = counts.select("length", "part", before.alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = items.withColumn("own", own).join(bases, ["length", "part"])
    ranked = ranked.withColumn("place", F.col("base") + F.col("own")).withColumn("block", F.expr(f"place div {BLOCK}"))
    # a run is told to each block of ranks that it reaches into, so that a rank looks for it among few
    last = F.expr(f"(rank + n - 1) div {BLOCK}")
    blocks = runs.select("*", F.explode(F.sequence(F.expr(f"rank div {BLOCK}"), last)).alias("block"))
    met = (F.col("d.length") == F.col("r.size")) & (F.col("d.block") == F.col("r.block")) & F.expr("d.place between r.rank and r.rank + r.n - 1")
    out = ranked.alias("d").join(within_bound(stage(blocks, "blocks")).alias("r"), met)
    nth = F.col("place") - F.col("rank")
    return out.select(
        "doc_id", "piece", "start", "d.length", "ids_crc32", (F.col("sequence") + F.expr("(place - rank) div each")).alias("sequence_id"),
        (F.col("offset") + nth % F.col("each") * F.col("d.length")).alias("offset"),
    )
