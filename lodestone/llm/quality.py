"""Quality rules with adaptive thresholds.

Two fixed rules fail a text outright.  All others compare a text with its own kind: quantile sketches of each measure are kept
per language and source, and a text fails if a measure lies far outside its group's usual spread.  A sketch counts values in
buckets of equal relative width (DDSketch, Masson et al. 2019); sketches merge by adding counts, in any order to the same
result.  A group's quantiles are blended with its language's, and those with the whole corpus's, by the number of texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, within_bound

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: The share by which a sketch's quantiles may be off.
ACCURACY = 0.005
#: A parent's quantiles weigh as much as so many texts of the group.
PRIOR = 200
#: Measure: (upper quantile, reach, slack, whether low values fail too).  A measure fails beyond the upper quantile by more than
#: reach times its distance from the median, and never within slack of it; low values in the same way.  The upper quantile is
#: one that ordinary texts with a repeated header or a table don't exceed.
MEASURES = {"symbols_per_word": (0.9, 3.0, 0.1, False), "dup_line_share": (0.99, 3.0, 0.05, False), "chars_per_word": (0.95, 2.0, 0.5, True), "repeat_share": (0.99, 3.0, 0.05, False)}
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_GAMMA, _ZERO = (1 + ACCURACY) / (1 - ACCURACY), -(1 << 40)
_SPACE = " \t\n\v\f\r"


def repeated_words(words: list[bytes]) -> int:
    """The words that lie in a window of three that the text has more than once."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    x = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    # pairs first, so that numbers stay small in texts of any length
    _, pair = np.unique(x[:-1] * len(known) + x[1:], return_inverse=True)
    _, which, times = np.unique(pair[:-1] * len(known) + x[2:], return_inverse=True, return_counts=True)
    begins = np.flatnonzero(times[which] > 1)
    inside = np.zeros(len(words) + 1, np.int64)
    for at in range(3):
        inside[begins + at] = 1
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The counts of COUNTS; null: zeros."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    spaces = sum(map(text.count, _SPACE))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in COUNTS.split(", ")]
    for batch in batches:
        columns = list(zip(*(measure(x.as_py()) for x in batch.column("text")))) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "lang", "source", *names])


def _bucket(value: Column) -> Column:
    """The number of value's bucket; zero has one of its own, below all others."""
    return F.when(value > 1e-9, F.ceil(F.log(value) / F.lit(math.log(_GAMMA)))).otherwise(_ZERO).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketches of all groups; bounded in rows by the range of the values."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _bucket(F.col(m)).alias("bucket")) for m in MEASURES])).alias("m")
    return rows.select("lang", "source", each).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, n, low, mid, high) of the sketches that counts merges to by keys."""
    merged = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("bucket") == _ZERO, 0.0).otherwise(F.pow(F.lit(_GAMMA), F.col("bucket")) * (2 / (1 + _GAMMA)))
    ranked = merged.select(*keys, "measure", upto.alias("upto"), F.sum("n").over(by).alias("n"), value.alias("value"))
    high = F.element_at(F.create_map(*[F.lit(x) for m, (q, *_) in MEASURES.items() for x in (m, q)]), F.col("measure"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("value")))
    return ranked.groupBy(*keys, "measure").agg(F.max("n").alias("n"), at(1 - high).alias("low"), at(F.lit(0.5)).alias("mid"), at(high).alias("high"))


def fences(rows: DataFrame) -> DataFrame:
    """(lang, source, lo_..., hi_...): the bounds of each measure in each group of rows; those of equal rows are equal, whatever their order.

    The rows are read once; all else is merged from the groups' sketches.
    """
    counts = stage(sketches(rows.where("not base_failed")), "sketches")
    levels = [stage(quantiles(counts, keys), "quantiles") for keys in (["lang", "source"], ["lang"], [])]
    group, lang, whole = (df.select(*[F.col(c).alias(f"{a}_{c}") for c in df.columns]) for a, df in zip("glw", levels))
    same = F.col("g_measure") == F.col("l_measure")
    found = group.join(within_bound(lang), same & F.col("g_lang").eqNullSafe(F.col("l_lang"))).join(F.broadcast(whole), F.col("g_measure") == F.col("w_measure"))  # one row a measure
    blend = lambda n, own, parent: (n * own + PRIOR * parent) / (n + PRIOR)
    low, mid, high = (blend(F.col("g_n"), F.col(f"g_{c}"), blend(F.col("l_n"), F.col(f"l_{c}"), F.col(f"w_{c}"))) for c in ("low", "mid", "high"))
    reach, slack = (F.element_at(F.create_map(*[F.lit(x) for m, v in MEASURES.items() for x in (m, v[i])]), F.col("g_measure")) for i in (1, 2))
    found = found.select(
        F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), F.col("g_measure").alias("measure"),
        (high + F.greatest(reach * (high - mid), slack)).alias("hi"), (low - F.greatest(reach * (mid - low), slack)).alias("lo"),
    )
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    bounds = [b for m, (*_, both) in MEASURES.items() for b in (of(m, "hi").alias(f"hi_{m}"), (of(m, "lo") if both else F.lit(None).cast("double")).alias(f"lo_{m}"))]
    return found.groupBy("lang", "source").agg(*bounds)


def judged(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, kept, the measures and the group's bounds.

    docs needs doc_id (long), text, lang and source; other columns are ignored.  Null and empty texts have no words and
    fail the base rules.  Null languages and sources are groups of their own.  Texts that fail the base rules don't shape
    the thresholds; where a group has no other texts all its texts fail.  A measure exactly at a bound is within it.  Texts of any length are
    measured whole.  Repeated rows each give a row.  An empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text").mapInArrow(_measured, f"doc_id long, lang string, source string, {COUNTS}")
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n)
    per_word = lambda c: F.when(n > 0, F.col(c) / n).otherwise(0.0)
    rows = stage(rows.select(
        "*", failed.alias("base_failed"),
        per_word("n_symbols").alias("symbols_per_word"), per_word("word_chars").alias("chars_per_word"), per_word("n_repeat_words").alias("repeat_share"),
        F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(0.0).alias("dup_line_share"),
    ), "measures")
    bounds = within_bound(stage(fences(rows), "fences"))
    same = F.col("r.lang").eqNullSafe(F.col("b.lang")) & F.col("r.source").eqNullSafe(F.col("b.source"))
    fits: Column = F.lit(True)
    for m, (*_, low) in MEASURES.items():
        fits &= F.col(m) <= F.col(f"hi_{m}")
        if low:
            fits &= F.col(m) >= F.col(f"lo_{m}")
    out = rows.alias("r").join(bounds.alias("b"), same, "left")
    kept = ~F.col("base_failed") & F.coalesce(fits, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "r.lang", "r.source", *MEASURES, *[f"hi_{m}" for m in MEASURES])
