"""Document fingerprints: bottom-k sketches of word-shingle hashes, on Spark's own functions only.

A sketch holds the k smallest different hashes of a set of shingles, ascending.  Sketches of parts merge into the sketch
of the whole, so sets of any size are sketched in one aggregation.  Of two sketches, the k smallest hashes of both
together are a random sample of the union; the share of it that both have estimates the resemblance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, K = 5, 128
#: Rows of a bucket of neighbouring documents.  Cuts are found on two levels of at most FAN each, so buckets stay that small up to
#: 2,000 * 512 * 512 rows; beyond, they grow and windows spill.
BUCKET_ROWS, FAN = 2_000, 512
_SPACES = "[ \\t\\n\\x0b\\f\\r]"


def words(text: Column) -> Column:
    """The words of text, null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "), " "), "")


def _named(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: the one-element array gives it a name."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _least(h: Column, k: int, short: bool) -> Column:
    """The k smallest different hashes of the shingles of word hashes h; with short, fewer words make one of the whole sequence."""
    first = F.slice(h, F.lit(1), F.greatest(F.size(h) - (SHINGLE - 1), F.least(F.size(h), F.lit(1)) if short else F.lit(0)))
    found = F.transform(first, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, SHINGLE)]))
    return F.slice(F.sort_array(F.array_distinct(found)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    """The sketch of text's five-word shingles; fewer words: of one shingle, the whole sequence; none: empty."""
    return _named(_hashes(text), lambda h: _least(h, k, True))


def begun(shared: Column, k: int = K) -> Column:
    """What the sketch of any text that begins with shared needs of it: own (its sketch), last (its last four word hashes), size (its words).

    shared is empty or ends in a space.
    """

    def of(head: Column) -> Column:
        last = F.slice(head, F.greatest(F.size(head) - (SHINGLE - 2), F.lit(1)), SHINGLE - 1)
        return F.struct(_least(head, k, False).alias("own"), last.alias("last"), F.size(head).alias("size"))

    return _named(_hashes(shared), of)


def finished(begin: Column, rest: Column, k: int = K) -> Column:
    """The sketch of a text that goes on with rest after begun(): the sketches of both parts merged.

    Shingles across the border begin in the last four words of the first part.
    """

    def of(h: Column) -> Column:
        short = begin["size"] + F.size(h) < SHINGLE
        return _named(F.concat(begin["last"], h), lambda x: F.when(short, _least(x, k, True)).otherwise(merge(begin["own"], _least(x, k, False), k)))

    return _named(_hashes(rest), of)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sets together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """(*keys, sketch): the sketch of all parts of a key.

    Hashes are counted once a key before the shuffle; a key's hashes are dealt over salts first, and each salt keeps k.
    """
    one = parts.select(*keys, F.explode(column).alias("__hash")).distinct().withColumn("__salt", F.pmod("__hash", F.lit(salts)))
    upto = Window.partitionBy(*keys, "__salt").orderBy("__hash")
    few = one.withColumn("__n", F.row_number().over(upto)).where(F.col("__n") <= k)
    return few.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set("__hash")), 1, k).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of shingles of either that both have; of two empty sets: 1."""
    whole = merge(a, b, k)
    return F.when(F.size(whole) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), whole)) / F.size(whole))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The number of different shingles: exact below k, else estimated from the k-th smallest hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has, 0 to 1; of an empty a: 1."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(both / distinct_shingles(a, k), F.lit(1.0)))


def encode(a: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def decode(text: Column) -> Column:
    """The sketch that encode() wrote."""
    return F.transform(F.filter(F.split(text, "(?<=\\G.{16})"), lambda x: x != ""), lambda x: F.conv(x, 16, -10).cast("long"))


def _cuts(doc_id: str, n: int) -> Column:
    """The ids that cut all rows into n about equal ranges."""
    return F.sort_array(F.array_distinct(F.percentile_approx(doc_id, [i / n for i in range(1, n)] or [0.5], 100 * n)))


def _bucketed(docs: DataFrame) -> DataFrame:
    """docs with __bucket, numbered in the order of doc_id: neighbouring ids, about BUCKET_ROWS rows each."""
    rows, *_ = docs.agg(F.count("*")).first()
    n = max(1, -(-rows // BUCKET_ROWS))
    coarse = min(FAN, -(-n // FAN))
    fine = min(FAN, -(-n // coarse))
    above = lambda cuts: F.size(F.filter(cuts, lambda c: F.col("doc_id") > c))
    # at most FAN ids, in one row
    found = docs.agg(_cuts("doc_id", coarse)).first()[0] if coarse > 1 else None
    whole = docs.withColumn("__coarse", above(F.array(*[F.lit(c) for c in found]).cast("array<long>")) if found else F.lit(0))
    # at most FAN rows of at most FAN ids
    inner = whole.groupBy("__coarse").agg(_cuts("doc_id", fine).alias("__cuts"))
    number = F.col("__coarse") * FAN + (F.coalesce(F.greatest(above(F.col("__cuts")), F.lit(0)), F.lit(0)) if fine > 1 else F.lit(0))
    return whole.join(F.broadcast(inner), "__coarse").withColumn("__bucket", number).drop("__coarse", "__cuts")


def with_next(docs: DataFrame, *stages: dict[str, Column], carried: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) with the columns of stages, computed one after the other; carried and text also as next_... of the next row.

    Rows are in the order of doc_id; the last row's next is the first.

    Rows of one doc_id follow each other by their text's hash; null doc_ids come first.  Texts are shuffled once, into
    buckets of neighbouring ids; a copy of each bucket's first row goes to the bucket before it.
    """
    bucketed = _bucketed(docs)
    # one row a bucket
    heads = bucketed.groupBy("__bucket").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    heads = heads.withColumn("before", F.lag("__bucket").over(Window.orderBy("__bucket")))
    heads = heads.withColumn("before", F.coalesce("before", F.max("__bucket").over(Window.partitionBy(F.lit(0)))))
    heads = heads.select("__bucket", "before", F.when(F.col("nulls") == 0, F.col("first")).alias("head"))
    placed = bucketed.join(F.broadcast(heads), "__bucket")
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("ghost"))
    copy = F.struct(F.col("before").alias("bucket"), F.lit(1).alias("ghost"))
    at = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, copy)).otherwise(F.array(own)))
    dealt = placed.select("doc_id", "text", at.alias("at")).select("doc_id", "text", F.col("at.bucket").alias("__bucket"), F.col("at.ghost").alias("__ghost"))
    dealt = dealt.repartition("__bucket").select("*", F.xxhash64("text").alias("__tie"))
    for columns in stages:
        dealt = dealt.select("*", *[c.alias(name) for name, c in columns.items()])
    order = Window.partitionBy("__bucket").orderBy("__ghost", F.col("doc_id").asc_nulls_first(), "__tie")
    out = dealt.select("*", *[F.lead(name).over(order).alias(f"next_{name}") for name in ("text", *carried)])
    return out.where("__ghost = 0").drop("__ghost", "__bucket", "__tie")


def edited_likeness(docs: DataFrame, k: int = K) -> DataFrame:
    """One row for each row of docs, which needs doc_id (long) and text; other columns are ignored.

    The edited text is the text with its last quarter replaced by as much of the next document's beginning.  Null texts
    are empty; an empty text's edited text is empty.  Texts of the same shingles have the same fingerprint; texts without words have an empty one,
    which is like itself only.  A single row is its own next.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), n - quarter)
    rest = lambda c: F.expr(f"substring({c}, length(shared) + 1)")
    rows = with_next(
        docs, {"shared": F.regexp_extract(kept, f"(?s)\\A(.*{_SPACES})", 1)},  # the words that end before the edit
        {"begun": begun(F.col("shared"), k)}, {"sketch": finished(F.col("begun"), rest("text"), k)}, carried=("sketch",),
    )
    edited = F.concat(kept, F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", "shared", "begun", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.explode(F.array(finished(F.col("begun"), rest("edited"), k))).alias("edited_sketch"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        encode(F.col("sketch")).alias("fingerprint"), encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("in_edited"),
    )
