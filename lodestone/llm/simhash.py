"""SimHash near-duplicates by pigeonring filtering.

Fingerprints of 64 bits are four segments on a ring.  If two differ in at most three bits, then from some segment on
every chain of l segments differs in at most 3 l / 4 bits (the pigeonring principle, Qin and Xiao 2018): none in the
first segment, at most one in the first two, at most two in the first three.  The join key holds the first segment and
the second up to one bit, so each bucket is cut by 32 bits and candidates stay few at any size; then come the longer
chain and the full check.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import shuffled, small_batches, stage, within_bound
from .components import components

SEGMENTS, WIDTH = 4, 16
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of text: ASCII lower case, shingles of so many words, XXH64; no words: 0."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if len(parts) >= words else [b" ".join(parts)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(x) for x in text], np.uint64).view(np.int64))


def _segment(fp: Column, i: Column | int) -> Column:
    """The i-th segment of the ring."""
    return F.expr(f"shiftrightunsigned({fp}, {WIDTH} * (({i}) % {SEGMENTS})) & {(1 << WIDTH) - 1}")


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """(u, v): the pairs of different fingerprints fp in distinct that differ in at most three bits; a pair may repeat.

    To match second segments up to one bit, those of odd parity are also written with each bit flipped, and then meet
    those of even parity; equal ones meet as they are.  So a fingerprint makes 4 rows on one side and 36 on average on
    the other, whatever the number of fingerprints.
    """
    if most != SEGMENTS - 1:
        raise ValueError("the key below is made for one bit less than there are segments")
    start = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("i"))
    start = start.withColumn("a", _segment("fp", "i")).withColumn("b", _segment("fp", "i + 1"))
    key = lambda b: F.expr(f"shiftleft(cast(i as bigint), 32) | shiftleft(a, 16) | {b}")
    left = start.select("fp", "i", key("b").alias("key"))
    flips = F.expr(f"case when bit_count(b) % 2 = 1 then concat(array(-1), sequence(0, {WIDTH - 1})) else array(-1) end")
    right = start.withColumn("flip", F.explode(flips)).withColumn("b", F.expr("case when flip < 0 then b else b ^ shiftleft(1L, flip) end"))
    right = right.select(F.col("fp").alias("fp2"), key("b").alias("key"), (F.col("flip") >= 0).alias("flipped"))
    chain = F.lit(0)
    for step in range(3):
        chain = chain + F.expr(f"bit_count(shiftrightunsigned(fp ^ fp2, {WIDTH} * ((i + {step}) % {SEGMENTS})) & {(1 << WIDTH) - 1})")
    near = (chain <= 2) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= most)
    once = F.col("flipped") | (F.col("fp") < F.col("fp2"))
    met = left.join(shuffled(right), "key").where(once & near)
    return met.select(F.col("fp").alias("u"), F.col("fp2").alias("v"))


def text_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, fp, root, component_id) for each row of docs; root is the group's smallest fingerprint."""
    small_batches(docs.sparkSession)
    marked = stage(docs.select("doc_id", text_hash(F.col("text")).alias("tie"), _fingerprints(F.coalesce("text", F.lit(""))).alias("fp")), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = stage(components(links(distinct)), "roots")
    labelled = distinct.join(shuffled(roots), distinct.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.where("node is not null").groupBy("root").agg(F.min("first").alias("least"))
    # one row a fingerprint; a fingerprint of very many copies is a skewed key on the other side alone, which AQE splits
    named = labelled.join(shuffled(least), "root", "left").select("fp", "root", F.coalesce("least", "first").alias("component_id"))
    return marked.join(shuffled(named), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs, which needs doc_id and text; other columns are ignored.

    component_id is the smallest doc_id reached over links of at most three differing bits, the row's own included.
    Equal fingerprints, exact copies among them, are one node, so copies make no pairs.  Null and empty texts, and texts of
    white space only, have fingerprint zero and are linked like any other.  Rows with a null doc_id get their group's
    smallest id, null only if it has none.  Repeated rows each give a row.  An empty table gives no rows.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each root in grouped (doc_id, tie, root) the row with the smallest doc_id; tie is the text_hash().

    Among rows of one doc_id and group the text's hash decides; null doc_ids come last.  Of rows of one id and text, which
    may differ in other columns, the one whose columns have the least hash stays, so each run keeps the same.
    """
    rows = stage(grouped, "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")).alias("best")
    kept = rows.groupBy("root").agg(best).select("best.doc_id", "best.tie")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (text_hash(F.col("d.text")) == F.col("k.tie"))
    # most rows stay, so the kept ids grow with the input: both sides are sorted, which spills where memory is short
    out = docs.alias("d").join(shuffled(kept.alias("k")), same, "left_semi")
    repeated = stage(rows.groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if not repeated.limit(1).count():
        return out
    # only rows that repeat are ranked, and one row a task and group is shuffled
    marked = out.withColumn("__own", F.xxhash64(*docs.columns)).alias("d")
    again = F.col("d.doc_id").eqNullSafe(F.col("r.__id")) & (text_hash(F.col("d.text")) == F.col("r.__tie"))
    met = marked.join(within_bound(repeated).alias("r"), again, "left")
    alone = met.where("__tie is null").select(docs.columns)
    one = met.where("__tie is not null").groupBy("__id", "__tie").agg(F.min_by(F.struct(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns]), "__own").alias("row"))
    return alone.unionByName(one.select("row.*"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each group of near_duplicates() one, that with the smallest doc_id.  Columns as in docs."""
    return one_of_each(docs, _grouped(docs).select("doc_id", "tie", "root"))
