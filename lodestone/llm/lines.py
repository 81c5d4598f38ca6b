"""Line dedup by distinct-site spread: lines that very many sites share are boilerplate.

Sites are counted by a HyperLogLog sketch per line hash; sketches merge by aggregation, so the most common line is a
few hundred bytes a task when it is shuffled.  Lines whose estimate is near the threshold get an exact count.  Of each
boilerplate line the first occurrence stays (smallest doc_id, then place), there and in exact copies of that document, so
that copies stay copies; all others go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stage, within_bound

#: A line of so many words at least that so many sites have is boilerplate.
MIN_WORDS, MIN_SITES = 3, 10
#: The sketches' size (the logarithm of their registers), and how near to the threshold counts are made exact; the
#: sketches' standard error is about 1.04 / sqrt(2 ** LG_K), a sixth of that band.
LG_K, BAND = 9, 0.3


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, site, place, line): a row for each line that has words enough; line is its hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce("source", F.lit("\0")).alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "words"))
    return rows.where(F.regexp_count("words", F.lit(WORD)) >= MIN_WORDS).select("doc_id", "tie", "site", "place", F.xxhash64("words").alias("line"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, first): the hash of each line that min_sites sites have at least, and where it stands first."""
    lines = _lines(docs)
    first = F.min(F.struct("doc_id", "tie", "place")).alias("first")
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sites"), first)
    spread = spread.withColumn("n", F.hll_sketch_estimate("sites")).where(F.col("n") >= min_sites * (1 - BAND)).select("line", "first", "n")
    spread = stage(spread, "spread")
    near = within_bound(spread.where(F.col("n") <= min_sites * (1 + BAND)).select("line"))
    # each line and site once before the count
    exact = lines.select("line", "site").join(near, "line").distinct().groupBy("line").agg(F.count("*").alias("exact"))
    found = spread.join(exact, "line", "left").where(F.coalesce("exact", "n") >= min_sites)
    return found.select("line", "first")


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = True) -> DataFrame:
    """The rows of docs without boilerplate lines, and with counts two columns more: n_lines and n_removed.

    docs needs doc_id, text and source; all its columns stay but those that counts replaces.  A null text stays null and has no lines; a text that loses
    all its lines is empty.  Null sources are one site.  Null doc_ids come first in the order of places.  Repeated rows
    lose and keep the same lines.  An empty table gives no rows.
    """
    found = within_bound(stage(boilerplate(docs, min_sites), "boilerplate"))
    gone = _lines(docs).join(found, "line").where((F.col("tie") != F.col("first.tie")) | (F.col("place") != F.col("first.place")))
    gone = gone.groupBy("doc_id", "tie").agg(F.collect_set("place").alias("__gone")).alias("g")
    text = docs.alias("d").withColumn("__tie", F.xxhash64("text"))
    rows = text.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("__tie") == F.col("g.tie")), "left")
    lines = F.split("d.text", "\n")
    # the places that stay, by a hash of those that go; the one-element array gives the lines a name, so that they are split once
    stay = lambda each: F.transform(F.array_except(F.sequence(F.lit(0), F.size(each) - 1), "__gone"), lambda i: F.get(each, i))
    left = F.element_at(F.transform(F.array(lines), stay), 1)
    text = F.when(F.col("__gone").isNull(), F.col("d.text")).otherwise(F.array_join(left, "\n"))
    keep = [text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    n = {"n_lines": F.size(lines), "n_removed": F.size("__gone")} if counts else {}
    return rows.select(*keep, *[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long").alias(name) for name, c in n.items()])


#: The same in SQL, for tables whose doc_ids differ.
SQL = f"""
WITH lines AS (
  SELECT doc_id, sha256(text) AS own, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(line, '{WORD}')) >= {MIN_WORDS} AS long_enough FROM lines
), spread AS (
  SELECT line, min({{'d': doc_id, 't': own, 'p': place}}) AS first FROM counted WHERE long_enough GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), marked AS (
  SELECT c.doc_id, c.place, c.line, s.line IS NOT NULL AND (c.own <> s.first.t OR c.place <> s.first.p) AS gone
  FROM counted c LEFT JOIN spread s ON c.line = s.line AND c.long_enough
), joined AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count_if(gone)::BIGINT AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, j.text AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN joined j USING (doc_id)
"""
