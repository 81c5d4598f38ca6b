"""The queries over the driver's tables, and the same in SQL.

Where a table stands in for what it has no rows of, the docstring says so: then the query shows the operator, not its
domain.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text, vectors
from .functions.tables import if_small
from .operators import archives, bindings, bm25, checks, chunker, dense, fusion, metrics, postings, rules
from .plans import migration, retrieval, samples
from .sources import tables
from .staging import stage, staged_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BUDGET, ROUND = 100_000, 9


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query with its SQL, if SQL can tell it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.documents(spark, sf_dir) if name == "documents" else tables.read(spark, sf_dir, name)


# -- SQL parts ------------------------------------------------------------------------------------------------------------

_PATTERN = r"[\p{L}\p{N}]+(?:[._-][\p{L}\p{N}]+)*"


def _tokens(column: str) -> str:
    folded = f"list_transform(regexp_extract_all({column}, '{_PATTERN}'), lambda x: replace(lower(x), 'ß', 'ss'))"
    return f"flatten(list_transform({folded}, lambda w: CASE WHEN regexp_matches(w, '[._-]') THEN list_concat([w], regexp_split_to_array(w, '[._-]')) ELSE [w] END))"


_BM25 = f"""
d AS (SELECT doc_id, {_tokens("text")} AS tk FROM documents),
n AS (SELECT count(*) AS n, avg(len(tk)) AS a FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_tokens("text")})) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score
      FROM q JOIN df USING (term) JOIN tf USING (term), n GROUP BY query_id, doc_id),
bm25 AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) WHERE rank <= 8)
"""


def _dense(queries: str) -> str:
    return f"""
dense AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (
  SELECT q.query_id, e.vec_id AS doc_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
  FROM embeddings e, ({queries}) q)) WHERE rank <= 8)
"""


_PAIRED = "SELECT b.item_id AS query_id, v.embedding FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id"
_HYBRID = f"""
{_BM25}, {_dense(_PAIRED)},
f AS (SELECT coalesce(b.query_id, d.query_id) AS query_id, coalesce(b.doc_id, d.doc_id) AS doc_id, b.rank AS bm25_rank, d.rank AS dense_rank,
        b.score AS bm25_score, d.score AS dense_score, coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0) AS rrf_score
      FROM bm25 b FULL JOIN dense d ON b.query_id = d.query_id AND b.doc_id = d.doc_id),
hybrid AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, least(bm25_rank, dense_rank),
        coalesce(bm25_rank, 9) + coalesce(dense_rank, 9), doc_id) AS rank, doc_id, rrf_score, bm25_rank, dense_rank, bm25_score, dense_score FROM f)
"""
_HYBRID_ROWS = "SELECT query_id, rank, doc_id, round(rrf_score, 9) AS rrf_score, bm25_rank, dense_rank, bm25_score, dense_score FROM hybrid"
_SCORES = f"""
{_HYBRID},
hits AS (SELECT 'bm25' AS system, query_id, rank, doc_id FROM bm25 UNION ALL SELECT 'dense', query_id, rank, doc_id FROM dense
         UNION ALL SELECT 'hybrid', query_id, rank, doc_id FROM hybrid),
gold AS (SELECT s.system, b.item_id AS query_id, v.label FROM benchmark b JOIN embeddings v ON v.vec_id = b.item_id, (VALUES ('bm25'), ('dense'), ('hybrid')) s(system)),
first AS (SELECT g.system, g.query_id, min(h.rank) FILTER (WHERE e.label = g.label) AS first_gold_rank, count(h.rank) AS returned_count
          FROM gold g LEFT JOIN hits h ON h.system = g.system AND h.query_id = g.query_id LEFT JOIN embeddings e ON e.vec_id = h.doc_id GROUP BY ALL),
scores AS (SELECT system, query_id, first_gold_rank, coalesce((first_gold_rank = 1)::INT, 0) AS recall_at_1, coalesce((first_gold_rank <= 3)::INT, 0) AS recall_at_3,
             round(CASE WHEN first_gold_rank <= 5 THEN 1.0::DOUBLE / first_gold_rank ELSE 0 END, 9) AS reciprocal_rank_at_5, returned_count FROM first)
"""

# -- retrieval ------------------------------------------------------------------------------------------------------------


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for the benchmark's items: those of equal ids.  The pairing is synthetic; the tables have none."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return e.join(if_small(_asked(spark, sf_dir).select("query_id")), "query_id")


@query(f"WITH {_BM25} SELECT query_id, rank, doc_id, score FROM bm25")
def bm25_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best documents for each benchmark item."""
    return bm25.search(table(spark, sf_dir, "documents"), _asked(spark, sf_dir))


@query(f"WITH {_BM25} SELECT query_id, rank, doc_id, score FROM bm25")
def bm25_index_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index: built over all documents, opened, and searched by the terms' buckets and the blocks that can reach the top."""
    path = staged_path(spark, "index")
    postings.build(table(spark, sf_dir, "documents"), path)
    return postings.search(postings.opened(spark, path), _asked(spark, sf_dir))


@query(f"SELECT count(*) AS n_docs, sum(len(tk))::BIGINT AS total_tokens, round(avg(len(tk)), 9) AS avgdl FROM (SELECT {_tokens('text')} AS tk FROM documents)")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that lengths are weighed by."""
    return bm25.corpus_stats(table(spark, sf_dir, "documents")).withColumn("avgdl", F.round("avgdl", ROUND))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each term."""
    return bm25.document_frequencies(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL")
def term_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document has each term."""
    return bm25.term_frequencies(table(spark, sf_dir, "documents"))


@query(f"SELECT item_id, unnest(range(len(tk))) AS pos, unnest(tk) AS term FROM (SELECT item_id, {_tokens('text')} AS tk FROM benchmark)")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each benchmark item, in order."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.tokens(F.col("text"))).alias("pos", "term"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) - 1 AS first_pos FROM (SELECT item_id AS query_id, unnest(range(len(tk))) AS pos, unnest(tk) AS term FROM (SELECT item_id, {_tokens('text')} AS tk FROM benchmark)) GROUP BY query_id, term")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different terms of each benchmark item, numbered by where they stand first."""
    return bm25.query_terms(_asked(spark, sf_dir)).select("query_id", "term", F.col("pos").cast("long").alias("first_pos"))


@query(f"WITH {_dense('SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0')} SELECT * FROM dense")
def dense_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest vectors of each vector whose id is divisible by 20 (the search's query set)."""
    points = _points(spark, sf_dir)
    return dense.search(points, points.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"))


@query(f"WITH {_HYBRID} {_HYBRID_ROWS}")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings of the benchmark's items fused; vectors are paired by id."""
    fused = retrieval.hybrid(table(spark, sf_dir, "documents"), _points(spark, sf_dir), _asked(spark, sf_dir), _paired(spark, sf_dir))
    return fused.withColumn("rrf_score", F.round("rrf_score", ROUND))


@query(f"WITH {_HYBRID} {_HYBRID_ROWS} WHERE rank <= 3")
def hybrid_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of the fused ranking."""
    return fusion.top(hybrid_rrf(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The systems on the benchmark's items; relevant is what has the label of the item's vector."""
    vectors_ = _paired(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    hits = retrieval.systems(table(spark, sf_dir, "documents"), _points(spark, sf_dir), _asked(spark, sf_dir), vectors_).join(labels, "doc_id", "left")
    return retrieval.evaluate(vectors_.select("query_id", "label"), hits, "label")


@query(f"WITH {_SCORES} SELECT * FROM scores")
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system's first relevant rank and scores on each item."""
    return _scores(spark, sf_dir)[0].withColumn("reciprocal_rank_at_5", F.round("reciprocal_rank_at_5", ROUND))


@query(f"WITH {_SCORES} SELECT system, count(*) AS question_count, round(avg(recall_at_1), 9) AS recall_at_1, round(avg(recall_at_3), 9) AS recall_at_3, round(avg(reciprocal_rank_at_5), 6) AS mrr_at_5 FROM scores GROUP BY system")
def eval_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system's means."""
    out = _scores(spark, sf_dir)[1]
    return out.select("system", "question_count", F.round("recall_at_1", ROUND).alias("recall_at_1"), F.round("recall_at_3", ROUND).alias("recall_at_3"), F.round("mrr_at_5", 6).alias("mrr_at_5"))


@query(f"WITH {_BM25} SELECT b.query_id, min(b.rank) FILTER (WHERE contains(d.text, i.text)) AS first_gold_rank, count(*) AS returned_count FROM bm25 b JOIN documents d USING (doc_id) JOIN benchmark i ON i.item_id = b.query_id GROUP BY b.query_id")
def first_gold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rank at which a document holds the benchmark item word for word."""
    # eight rows a query meet the texts where these are
    found = if_small(stage(bm25.search(table(spark, sf_dir, "documents"), _asked(spark, sf_dir)), "hits"))
    hits = found.join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "doc_id")
    met = hits.join(_asked(spark, sf_dir), "query_id").select("query_id", "rank", F.col("body").contains(F.col("text")).alias("gold"))
    return met.groupBy("query_id").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("first_gold_rank"), F.count("*").alias("returned_count"))


@query(f"WITH {_BM25}, p AS (SELECT query_id, count(*) AS n, min(rank) AS low, max(rank) AS high, count(DISTINCT rank) AS ranks FROM bm25 WHERE (query_id + rank) % 9 <> 0 GROUP BY query_id) SELECT query_id FROM p WHERE low <> 1 OR high <> n OR ranks <> n")
def rank_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items whose ranks aren't 1, 2, 3, ...; a hit of most was taken out, of some the last one."""
    return metrics.rank_gaps(bm25_top8(spark, sf_dir).where("(query_id + rank) % 9 <> 0"))


@query("SELECT item_id, 'query: ' || text AS query_input, 'passage: ' || text AS passage_input FROM benchmark")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as an embedding model gets them."""
    return table(spark, sf_dir, "benchmark").select("item_id", text.query_text(F.col("text")).alias("query_input"), text.passage_text(F.col("text")).alias("passage_input"))


@query("""SELECT vec_id, len(embedding)::BIGINT AS dimension, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-5 THEN 'not_unit' END AS error FROM embeddings""")
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, length and refusal of each vector."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).cast("long").alias("dimension"), F.round(vectors.norm(e), 6).alias("norm"), vectors.vector_error(e, 64).alias("error"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 2 THEN 383 ELSE 384 END::BIGINT AS dimension, item_id % 3 <> 0 AS in_range, item_id % 3 = 1 AS is_unit FROM benchmark")
def fake_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in vectors of the benchmark's texts (SHAKE-256, which SQL lacks): their size, range and unit length; by id some were
    stretched, some brought to unit length, and some cut by one number."""
    v, k = F.col("vector"), F.col("item_id") % 3
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.fake_vector()(text.query_text(F.col("text"))).alias("vector"))
    changed = F.when(k == 0, F.transform(v, lambda x: x * 40)).when(k == 1, F.transform(v, lambda x: x / vectors.norm(v))).otherwise(F.slice(v, 1, 383))
    rows = rows.withColumn("vector", changed)
    return rows.select("item_id", F.size(v).cast("long").alias("dimension"), F.forall(v, lambda x: x.between(-1, 1)).alias("in_range"), (F.abs(vectors.norm(v) - 1) < 1e-5).alias("is_unit"))


# -- set checks -----------------------------------------------------------------------------------------------------------

_KEY = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


_PLANTED = "chr(9) || replace(text, ' ', '  ') || chr(10)"


@query(f"SELECT DISTINCT {_KEY.format('d.text')} AS key FROM (SELECT text FROM documents UNION ALL SELECT {_PLANTED} FROM benchmark WHERE item_id % 5 = 0) d JOIN benchmark b ON {_KEY.format('d.text')} = {_KEY.format('b.text')}")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts that both documents and the benchmark have; items of some ids were put among the documents with other white space."""
    asked = table(spark, sf_dir, "benchmark")
    planted = asked.where("item_id % 5 = 0").select(F.concat(F.lit("\t"), F.regexp_replace("text", " ", "  "), F.lit("\n")).alias("text"))
    key = lambda df: df.select(text.question_key(F.col("text")).alias("key"))
    return checks.shared(key(table(spark, sf_dir, "documents").select("text").unionByName(planted)), key(asked), ["key"])


@query(f"SELECT item_id, {_KEY.format('text')} AS key FROM benchmark")
def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised text of each benchmark item."""
    return table(spark, sf_dir, "benchmark").select("item_id", text.question_key(F.col("text")).alias("key"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def stale_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label: what an index must not hold."""
    return checks.missing_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def id_set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only one of documents and labels has."""
    return checks.set_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT sha256(text) AS content_sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts that stand more than once."""
    return checks.duplicates(table(spark, sf_dir, "documents").select(text.sha256(F.col("text")).alias("content_sha256")), ["content_sha256"])


@query("SELECT doc_id, sha256(text) AS content_sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) - 1 AS identity_occurrence FROM documents")
def identity_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many earlier documents have the same text."""
    return checks.occurrence(table(spark, sf_dir, "documents").select("doc_id", text.sha256(F.col("text")).alias("content_sha256")), ["content_sha256"], ["doc_id"])


@query(f"""SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(('0x' || substr(h, 17, 1))::INT & 3) + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT doc_id, sha1(unhex('{text.POINT_NAMESPACE.replace("-", "")}') || encode('sha256:' || sha256(text))) AS h FROM documents)""")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point id of each document's content id."""
    return table(spark, sf_dir, "documents").select("doc_id", text.uuid5(F.concat(F.lit("sha256:"), text.sha256(F.col("text")))).alias("point_id"))


@query("SELECT l.doc_id, l.quality, l.toxic, d.doc_id IS NOT NULL AS known FROM labels l LEFT JOIN documents d USING (doc_id)")
def label_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each label's document exists."""
    known = table(spark, sf_dir, "documents").select("doc_id").distinct().withColumn("known", F.lit(True))
    return table(spark, sf_dir, "labels").join(known, "doc_id", "left").select("doc_id", "quality", "toxic", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"SELECT doc_id, source, n_chars, (sum(n_chars) OVER w)::BIGINT AS running_total, sum(n_chars) OVER w <= {BUDGET} AS within_budget FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their ids against a budget of characters for each source (sources stand in for archives)."""
    out = checks.running_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", BUDGET)
    return out.select("doc_id", "source", "n_chars", "running_total", "within_budget")


@query("SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(trim(text), '^(?i)(query|passage):') THEN 'prefixed' END AS error FROM conversations")
def prefix_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each turn would be refused as a query."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.query_error(F.col("text")).alias("error"))


@query(f"""SELECT source, min_by(doc_id, doc_id) AS doc_id, 'over_budget' AS error_type FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS t FROM documents) WHERE t > {BUDGET} GROUP BY source""")
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document at which each source goes over the budget; sources within it have no row."""
    rows = running_budget(spark, sf_dir).withColumn("error_type", F.when(~F.col("within_budget"), "over_budget"))
    first = checks.first_violation(rows, ["source"], ["doc_id"])
    return first.join(rows.where("not within_budget").groupBy("source").agg(F.min("doc_id").alias("doc_id")), "source")


@query("SELECT event_id, user_id, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value <= before")
def not_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events whose value isn't above that of the user's event before (values stand in for offsets)."""
    return checks.not_increasing(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], ["event_id"], "value")


_SPANS = "SELECT user_id, event_id * 10 AS start, event_id * 10 + 5000 AS stop FROM events"


@query(f"""WITH s AS ({_SPANS}), m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
r AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(start) AS start, max(stop) AS stop FROM r GROUP BY user_id, run""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of each user's spans, one after each event (events stand in for chunks of a source)."""
    spans = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 5000).alias("stop"))
    return checks.merged_spans(spans, ["user_id"], "start", "stop")


@query(f"""WITH s AS ({_SPANS}) SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND s.start < e.event_id * 10 AND s.stop >= e.event_id * 10 + 5)""")
def covered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that lie within an earlier span of their user."""
    e = table(spark, sf_dir, "events")
    inner = e.select("event_id", "user_id", (F.col("event_id") * 10 - 1).alias("start"), (F.col("event_id") * 10 + 5).alias("end"))
    outer = e.select("user_id", (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 5000).alias("end"))
    return checks.covered(inner, outer, ["user_id"]).select("event_id")


@query(r"""SELECT item_id, 'Pydantic v1 to v2 migration. Rule category: Pydantic settings migration. Legacy API or concept: item ' || item_id || '. '
|| CASE WHEN item_id % 2 = 0 THEN '' ELSE 'AST context: call(' || item_id || '). ' END || 'Question: ' || trim(regexp_replace(text, '\s+', ' ', 'g')) AS query FROM benchmark""")
def rendered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts rendered as questions; category, API and context are made up from the id."""
    context = F.when(F.col("item_id") % 2 == 0, "").otherwise(F.concat(F.lit("call("), F.col("item_id").cast("string"), F.lit(")")))
    api = F.concat(F.lit("item  "), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", retrieval.rendered_query(F.lit("settings"), api, context, F.col("text")).alias("query"))


@query("""SELECT (SELECT count_if(quality = 1) FROM labels)::BIGINT AS positive_label_count, (SELECT count_if(quality <> 1) FROM labels)::BIGINT AS negative_label_count, (SELECT count(DISTINCT toxic) FROM labels) AS gold_heading_count,
count(DISTINCT source) AS fixture_count, count(*) AS python_file_count, min(n_chars) AS min_python_loc, max(n_chars) AS max_python_loc FROM documents""")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of labels and their files (documents stand in for files, sources for fixtures, the toxic flag for headings)."""
    labels = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("expected"), F.array("toxic").alias("gold_heading"))
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("fixture_id"), F.col("doc_id").alias("file"), F.col("n_chars").alias("line_count"))
    return migration.label_summary(labels, lines)


# -- position-aware lookups and paths ----------------------------------------------------------------------------------------


@query("""SELECT p.event_id, count(s.event_id) AS n, CASE WHEN count(s.event_id) = 1 THEN min(s.event_id) END AS signup_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON s.user_id = p.user_id AND s.ts < p.ts GROUP BY p.event_id""")
def asof_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the one earlier signup of its user, null if there are none or several (users stand in for names)."""
    e = table(spark, sf_dir, "events")
    uses = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("at"))
    known = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("when"), F.col("event_id").alias("signup_id"))
    return bindings.latest_unique(uses, known, "event_id", ["user_id"], "at", "when", "signup_id")


@query("""WITH u AS (SELECT event_id, user_id FROM events WHERE event_type = 'purchase'),
c AS (SELECT u.event_id, b.event_type AS scope, count(*) AS n, min(b.event_id) AS first_id FROM u JOIN events b ON b.user_id = u.user_id AND b.event_id < u.event_id AND b.event_type IN ('click', 'signup') GROUP BY ALL)
SELECT event_id, min_by(n, scope) AS n, min(scope) AS scope, min_by(first_id, scope) AS first_id FROM c GROUP BY event_id""")
def visible_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the scope that decides, of clicks before signups, and its earlier events (users stand in for names, ids for places)."""
    e = table(spark, sf_dir, "events")
    line, column = F.expr("event_id div 100"), F.col("event_id") % 100
    uses = e.where("event_type = 'purchase'").select("event_id", "user_id", line.alias("at_line"), column.alias("at_column"), F.array(F.lit("click"), F.lit("signup")).alias("scopes"))
    known = e.where("event_type in ('click', 'signup')").select("user_id", F.col("event_type").alias("scope"), line.alias("line"), column.alias("column"), F.col("event_id").alias("first_id"))
    return bindings.visible(uses, known, ["event_id"], ["user_id"], ["first_id"]).select("event_id", "n", "scope", "first_id")


_PARTS = "list_filter(string_split(replace(regexp_replace(url, '^[a-z]+://', ''), chr(92), '/'), '/'), lambda c: c <> '' AND c <> '.')"


@query(f"""SELECT page_id, valid, CASE WHEN valid THEN array_to_string(parts, '/') END AS path,
  CASE WHEN valid THEN len(list_filter(parts[:-2], lambda c: lower(c) IN ('.venv', 'venv', 'site-packages', 'node_modules', '.git'))) > 0 END AS ignored,
  CASE WHEN valid THEN regexp_matches(parts[-1], '(?i)^.+\\.py$') END AS python
FROM (SELECT page_id, parts, NOT regexp_matches(raw, '^.:|^[/' || chr(92) || chr(92) || ']') AND len(parts) > 0 AND len(list_filter(parts, lambda c: regexp_matches(c, '[:\\x00-\\x1f]|[ .]$') OR regexp_matches(c, '(?i)^(con|prn|aux|nul|conin\\$|conout\\$|com[1-9¹²³]|lpt[1-9¹²³]) *(\\..*)?$'))) = 0 AS valid
  FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS raw, {_PARTS} AS parts FROM pages))""")
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules for member paths, on what follows the scheme of each page's address."""
    raw = F.regexp_replace("url", "^[a-z]+://", "")
    p = table(spark, sf_dir, "pages").select("page_id", paths.path_valid(raw).alias("valid"), paths.canonical_path(raw).alias("path"))
    return p.select("page_id", "valid", "path", paths.in_ignored_directory(F.col("path")).alias("ignored"), paths.is_python(F.col("path")).alias("python"))


@query(f"""WITH pages2 AS (SELECT url FROM pages UNION ALL SELECT url || '/MORE.html' FROM pages WHERE page_id % 7 = 0),
p AS (SELECT DISTINCT list_transform({_PARTS}, lambda c: lower(c)) AS k FROM pages2),
u AS (SELECT k[1] AS host, k, unnest(range(1, len(k))) AS n FROM p)
SELECT DISTINCT u.host FROM u JOIN p ON p.k = u.k[:u.n]""")
def path_prefix_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts at which one page's path leads on to another's (pages stand in for files); pages of some ids were given one below them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    urls = pages.select("url").unionByName(pages.where("page_id % 7 = 0").select(F.concat("url", F.lit("/MORE.html")).alias("url")))
    parts = F.transform(paths.components(F.regexp_replace("url", "^[a-z]+://", "")), lambda c: F.lower(c))
    keys = urls.select(parts.alias("key")).select(F.element_at("key", 1).alias("host"), "key", F.lit(False).alias("is_directory"))
    return archives.path_conflicts(keys, "host", "key")


# -- chunks -------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS source_chars, CASE WHEN doc_id % 4 = 0 AND length(text) <= 1200 THEN 0 ELSE length(text) END AS covered_chars, (doc_id % 4 = 0 AND length(text) BETWEEN 1 AND 1200)::BIGINT AS gap_count FROM documents")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the chunks of each document cover it: wholly, without gaps, but for short documents whose only chunk was taken out by id."""
    docs = table(spark, sf_dir, "documents")
    lost = docs.where((F.col("doc_id") % 4 == 0) & (F.length("text") <= chunker.MAX_CHARS)).select("doc_id")
    found = chunker.chunks(docs).join(lost, "doc_id", "left_anti")
    return chunker.audit(docs, found).select("doc_id", "source_chars", "covered_chars", "gap_count")


@query()
def chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of each document's chunks; cuts depend on those before them, which SQL can't tell."""
    docs = table(spark, sf_dir, "documents")
    return chunker.audit(docs, chunker.chunks(docs))


@query()
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents."""
    found = chunker.chunks(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "chunk_no", "start", "end", "continuation_index", "overlap_chars", "char_length", "content_sha256", "chunk_id")


_LETTERS = "'x' || regexp_replace(coalesce(substr(text, 1, 200), ''), '[^A-Za-z]', ' ', 'g')"


@query(f"""WITH d AS (SELECT doc_id, 4 + length({_LETTERS}) AS pre, length('' || doc_id) AS n, length({_LETTERS}) AS w FROM documents),
s AS (SELECT doc_id, pre + 2 AS a, pre + 2 + 9 + n + 2 + w + 2 + 6 + 14 + n + 1 + 3 + 2 AS b, w FROM d)
SELECT doc_id, 0 AS chunk_no, '' AS heading, 0::BIGINT AS "start", a::BIGINT AS "end" FROM s
UNION ALL SELECT doc_id, 1, 'Alpha ' || doc_id, a, b FROM s
UNION ALL SELECT doc_id, 2, 'Alpha ' || doc_id || ' > Beta', b, b + 11 + 2 + 5 + w + 1 FROM s""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a Markdown text made of each document's first letters: two headings, and a fence with what is none."""
    found = chunker.chunks(markdown_of(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.array_join("heading_path", " > ").alias("heading"), "start", "end")


def markdown_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a Markdown text of three sections and a fence, of each document's first letters."""
    w = F.concat(F.lit("x"), F.regexp_replace(F.coalesce(F.substring("text", 1, 200), F.lit("")), "[^A-Za-z]", " "))
    i = F.col("doc_id").cast("string")
    made = F.concat(F.lit("pre "), w, F.lit("\n\n## Alpha "), i, F.lit("\n\n"), w, F.lit("\n\n```py\n## no heading\n"), i, F.lit("\n```\n\n### Beta ##\n\ntail "), w, F.lit("\n"))
    return docs.select("doc_id", made.alias("text"))


_CHUNKS = "SELECT user_id, event_id * 10 - 3 AS start, event_id * 10 + 4000 AS stop FROM events WHERE event_id % 3 = 0"


@query(f"""WITH p AS (SELECT user_id AS doc_id, event_id * 10 AS start, event_id * 10 + 2500 AS stop, CASE WHEN event_id % 2 = 0 THEN 'fence' ELSE 'prose' END AS kind FROM events), s AS ({_CHUNKS}),
m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
r AS (SELECT *, sum((reach IS NULL OR start > reach)::INT) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM m),
u AS (SELECT user_id, min(start) AS start, max(stop) AS stop FROM r GROUP BY user_id, run)
SELECT doc_id, start, stop AS "end", kind, 'fence_split' AS reason FROM p WHERE kind = 'fence' AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = p.doc_id AND s.start <= p.start AND s.stop >= p.stop)
UNION ALL SELECT doc_id, start, stop, kind, 'not_covered' FROM p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = p.doc_id AND u.start <= p.start AND u.stop >= p.stop)""")
def uncovered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences that no chunk holds and blocks that chunks don't cover (spans after events stand in for blocks, and for chunks)."""
    e = table(spark, sf_dir, "events")
    blocks = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 2500).alias("end"), F.when(F.col("event_id") % 2 == 0, "fence").otherwise("prose").alias("kind"))
    spans = e.where("event_id % 3 = 0").select(F.col("user_id").alias("doc_id"), (F.col("event_id") * 10 - 3).alias("start"), (F.col("event_id") * 10 + 4000).alias("end"), F.lit(None).cast("string").alias("error"))
    return chunker.uncovered_blocks(blocks, spans)


# -- archives and rules, over archives made of the pages in plans.samples ------------------------------------------------------------


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    """A table of fixed rows."""
    literal = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


def _lines(pattern: str) -> list[tuple]:
    """(kind, path, line, match) of what the pattern finds at each line of the archives' sources."""
    return [(k, path, n, m[1]) for k, files in enumerate(samples.KINDS) for path, source in (files or {}).items() for n, line in enumerate(source.split("\n"), 1) for m in [re.search(pattern, line)] if m]


#: Kinds that are rejected by their members, and by their sources.
_REJECTED = {4: "invalid_member_path", 5: "invalid_archive", 6: "duplicate_destination", 7: "compression_ratio_exceeded", 8: "member_too_large", 9: "encrypted_member"}
_UNSCANNED = {2: "syntax_error", 10: "module_name_conflict"}
_ARCHIVES = f"""a AS (SELECT page_id, 'p' || page_id AS archive_id, page_id % {len(samples.KINDS)} AS kind, page_id % {samples.SHIFTS} AS shift, strlen(coalesce(html, '')) AS note FROM pages),
{_values("e", "kind, error", [*_REJECTED.items(), *_UNSCANNED.items()])},
{_values("f", "kind, ordinal, path, bytes, lines", [(k, i, p, len(t.encode()), len(t.splitlines())) for k, files in enumerate(samples.KINDS) for i, (p, t) in enumerate((files or {}).items())])},
m AS (SELECT archive_id, kind, ordinal, path, bytes + shift AS bytes, lines + shift AS lines, path LIKE 'venv/%' AS ignored, true AS source FROM a JOIN f USING (kind)
  UNION ALL SELECT archive_id, kind, (SELECT count(*) FROM f WHERE f.kind = a.kind), '{samples.NOTE}', note, 0, false, false FROM a WHERE kind <> 5)"""
_TOTALS = """count(*) AS archive_member_count, count(*) AS regular_file_count, 0::BIGINT AS directory_count, sum(bytes)::BIGINT AS total_uncompressed_bytes, count_if(source AND NOT ignored)::BIGINT AS python_file_count,
count_if(ignored)::BIGINT AS ignored_python_file_count, count_if(NOT source)::BIGINT AS ignored_non_python_file_count, coalesce(sum(lines) FILTER (WHERE source AND NOT ignored), 0)::BIGINT AS python_total_lines"""
_TOTAL_NAMES = "archive_member_count, regular_file_count, directory_count, total_uncompressed_bytes, python_file_count, ignored_python_file_count, ignored_non_python_file_count, python_total_lines"
_GOOD = f"kind NOT IN ({', '.join(map(str, {**_REJECTED, **_UNSCANNED}))})"
_FINDINGS = f"""{_ARCHIVES}, {_values("l", "kind, path, line, category", _lines(r"# (\w+)$"))}, {_values("r", "category, severity", list(rules.RULES.items()))},
found AS (SELECT page_id, archive_id, path AS relative_path, (line + shift)::BIGINT AS start_line, 'pydantic_v1_' || category AS rule_id, severity FROM a JOIN l USING (kind) JOIN r USING (category) WHERE {_GOOD})"""


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.archives_from(table(spark, sf_dir, "pages"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.scan(_archives(spark, sf_dir))[0]


@query(f"WITH {_ARCHIVES}, t AS (SELECT archive_id, {_TOTALS} FROM m WHERE kind NOT IN ({', '.join(map(str, _REJECTED))}) GROUP BY archive_id) SELECT a.archive_id, CASE WHEN kind IN ({', '.join(map(str, _REJECTED))}) THEN error END AS error_type, {_TOTAL_NAMES} FROM a LEFT JOIN e USING (kind) LEFT JOIN t USING (archive_id)")
def zip_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archive's totals, or why it is rejected."""
    return archives.validate(_archives(spark, sf_dir))[1]


@query(f"""WITH {_ARCHIVES} SELECT archive_id, ordinal::INT AS ordinal, path AS raw_name, CASE WHEN path NOT LIKE '..%' THEN path END AS path, false AS is_directory, source AND NOT ignored AND path NOT LIKE '..%' AS is_python, ignored AS is_ignored_python,
bytes::BIGINT AS file_size, CASE WHEN path LIKE '..%' THEN 'invalid_member_path' WHEN kind = 6 AND ordinal = 1 THEN 'duplicate_destination'
WHEN kind = 7 AND ordinal = 1 THEN 'compression_ratio_exceeded' WHEN kind = 8 AND ordinal = 0 THEN 'member_too_large' WHEN kind = 9 THEN 'encrypted_member' END AS error_type FROM m
UNION ALL SELECT archive_id, NULL, NULL, NULL, NULL, false, false, NULL, 'invalid_archive' FROM a WHERE kind = 5""")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member and the first check that it fails."""
    checked = archives.checked_members(archives.members(_archives(spark, sf_dir)))
    return checked.select("archive_id", "ordinal", "raw_name", "path", "is_directory", "is_python", "is_ignored_python", "file_size", "error_type")


@query()
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports, bindings, classes, type clues and uses of all accepted files."""
    _, facts, _ = migration.scan(_archives(spark, sf_dir))
    return facts.select("archive_id", "relative_path", "kind", "name", "reference", "scope", "line", "column", "props")


@query(f"WITH {_ARCHIVES}, {_values('c', 'kind, path, line, name', _lines(r'^ *class (\w+)'))} SELECT archive_id, path AS relative_path, name, (line + shift)::BIGINT AS line FROM a JOIN c USING (kind) WHERE {_GOOD}")
def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all accepted files and where they begin."""
    facts = migration.scan(_archives(spark, sf_dir))[1]
    return facts.where("kind = 'class'").select("archive_id", "relative_path", "name", F.col("line").cast("long").alias("line"))


@query(f"WITH {_ARCHIVES}, {_values('c', 'kind, path, line, module', _lines(r'^(?:from|import) ([\w.]+)'))} SELECT DISTINCT archive_id, path AS relative_path, (line + shift)::BIGINT AS line, ltrim(module, '.') AS module FROM a JOIN c USING (kind) WHERE {_GOOD} AND path NOT LIKE 'venv/%'")
def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules that all accepted files import and where."""
    facts = migration.scan(_archives(spark, sf_dir))[1]
    return facts.where("kind = 'import'").select("archive_id", "relative_path", F.col("line").cast("long").alias("line"), F.col("props")["module"].alias("module")).distinct()


@query(f"WITH {_FINDINGS} SELECT archive_id, relative_path, start_line, rule_id, severity FROM found")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings in all accepted files; the sources' own comments say what they are."""
    return _found(spark, sf_dir).select("archive_id", "relative_path", F.col("start_line").cast("long").alias("start_line"), "rule_id", "severity")


@query(f"WITH {_FINDINGS} SELECT rule_id, severity, count(*) AS n, count(DISTINCT archive_id || relative_path) AS files FROM found GROUP BY ALL")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings by rule."""
    return migration.rule_counts(_found(spark, sf_dir))


@query(f"WITH {_FINDINGS} SELECT archive_id, relative_path, start_line, rule_id FROM found WHERE page_id % 3 = 0")
def finding_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that break the contract: those whose severity was altered here, by page_id."""
    altered = F.when(F.substring("archive_id", 2, 20).cast("long") % 3 == 0, "low").otherwise(F.col("severity"))
    return rules.contract_errors(_found(spark, sf_dir).withColumn("severity", altered)).select("archive_id", "relative_path", F.col("start_line").cast("long").alias("start_line"), "rule_id")


@query(f"WITH {_ARCHIVES} SELECT archive_id, 'shop.models' AS module, 'shop.use' AS importer FROM a WHERE kind = 0")
def reverse_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which modules import which, one hop."""
    return rules.reverse_imports(migration.scan(_archives(spark, sf_dir))[1])


@query(f"WITH {_ARCHIVES}, t AS (SELECT archive_id, {_TOTALS} FROM m WHERE kind NOT IN ({', '.join(map(str, _REJECTED))}) GROUP BY archive_id) SELECT a.archive_id, error, {_TOTAL_NAMES} FROM a LEFT JOIN e USING (kind) LEFT JOIN t USING (archive_id)")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each archive's totals or first error, of its members or its sources."""
    return migration.scan(_archives(spark, sf_dir))[2]


from . import contract_queries  # noqa: E402, F401  registers the queries of contracts and stored tables
