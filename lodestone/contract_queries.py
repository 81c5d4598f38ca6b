"""Queries of contracts and stored tables, and the same in SQL.

The driver's tables break no contract, so rows are altered by id: SQL then knows which rules each row breaks.  Documents, labels
and the benchmark stand in for chunks, labels of findings and questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .operators import archives, checks, chunker
from .plans import contracts, index, migration, retrieval
from .queries import _ARCHIVES, _LETTERS, _REJECTED, _SCORES, _archives, _asked, _paired, _points, markdown_of, query, table
from .sources import readers, writers
from .sources.points import PointTable, Properties
from .staging import staged_path


def _told(pairs: list[tuple[str, str]]) -> str:
    """SQL for the names of the rules that a row breaks, comma-joined in order."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {broken} THEN '{name}' END" for name, broken in pairs) + ")"


def _when(condition: str, value, otherwise):
    return F.when(F.expr(condition), value).otherwise(otherwise)


_Q = [
    ("schema_version", "item_id % 5 = 0"), ("question_id", "item_id % 13 = 0"), ("template_family", "item_id % 7 = 0"), ("split", "item_id % 3 = 0"), ("rule_category", "item_id % 11 = 0"),
    ("old_api", "item_id % 2 = 0"), ("ast_context", "item_id % 17 = 0"), ("gold_heading_path", "item_id % 6 < 2"),
]


@query(f"SELECT item_id, {_told(_Q)} AS violations FROM benchmark")
def question_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that questions made of the benchmark's items break."""
    i = F.col("item_id").cast("string")
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", _when("item_id % 5 = 0", 2, 1).alias("schema_version"), F.concat(_when("item_id % 3 = 0", F.lit("locked-"), F.lit("dev-")), _when("item_id % 13 = 0", F.lit("Q"), F.lit("q")), i).alias("question_id"),
        F.lit("dev").alias("split"), _when("item_id % 7 = 0", "Plain", "plain_words").alias("template_family"), _when("item_id % 11 = 0", "other", "config").alias("rule_category"),
        _when("item_id % 2 = 0", "  ", "Config").alias("old_api"), F.expr("if(item_id % 17 = 0, null, '')").alias("ast_context"), F.concat(F.lit("how "), "text").alias("user_question"),
        F.expr("case item_id % 6 when 0 then array() when 1 then array('A', ' ') else array('A') end").cast("array<string>").alias("gold_heading_path"),
    )
    return contracts.questions(rows).select("item_id", F.array_join("violations", ",").alias("violations"))


_CHUNK = "doc_id, doc_id // 4 AS artifact, doc_id % 4 AS chunk_no, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id % 4 * 1000000 END AS begins, length(text) AS n"
_C = [
    ("chunk_id", "doc_id % 21 = 0"), ("char_length", "doc_id % 6 = 0 OR n = 0"), ("content_sha256", "doc_id % 10 = 0"), ("heading_path", "doc_id % 15 = 0"),
    ("first", "doc_id % 14 = 0"), ("overlap", "doc_id % 16 = 0"), ("order", "earlier >= begins"), ("provenance", "doc_id % 8 = 0"),
]


@query(f"SELECT doc_id, {_told(_C)} AS violations FROM (SELECT *, lag(begins) OVER (PARTITION BY artifact ORDER BY chunk_no) AS earlier FROM (SELECT {_CHUNK} FROM documents))")
def chunk_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that chunks break, whose texts are the documents: four of them are an artifact."""
    i, sha = F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256)
    head = {"source_id": "s", "git_ref": "r", "resolved_commit_sha": "a" * 40, "source_path": "p", "source_snapshot_sha256": "b" * 64}
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.expr("cast(doc_id div 4 as string)").alias("artifact"), F.expr("cast(doc_id % 4 as int)").alias("chunk_no"), *[F.lit(v).alias(k) for k, v in head.items()],
        _when("doc_id % 8 = 0", "other", "u").alias("source_url"), F.concat(F.lit("sha256:"), F.sha2(F.concat(i, F.lit("/"), "text"), 256), _when("doc_id % 21 = 0", "0", "")).alias("chunk_id"),
        F.expr("if(doc_id % 15 = 0, array('H', ''), array('H'))").alias("heading_path"), _when("doc_id % 10 = 0", "x", sha).alias("content_sha256"),
        (F.length("text") + _when("doc_id % 6 = 0", 1, 0)).cast("long").alias("char_length"), F.expr("if(doc_id % 9 = 0, 0L, doc_id % 4 * 1000000)").alias("source_start_char"),
        F.lit(0).alias("identity_occurrence"), _when("doc_id % 14 = 0", -1, 1).alias("continuation_index"), _when("doc_id % 16 = 0", 7, 120).alias("overlap_chars"),
    )
    rows = rows.withColumn("source_end_char", F.col("source_start_char") + F.col("char_length"))
    whole = rows.select("artifact", F.lit(120).alias("overlap_chars"), F.lit("u").alias("source_url"), *[F.lit(v).alias(k) for k, v in head.items()]).distinct()
    return contracts.chunks(rows, whole).select("doc_id", F.array_join("violations", ",").alias("violations"))


_MARKDOWN = "CASE doc_id % 4 WHEN 0 THEN '# ' || text WHEN 1 THEN chr(10) || '<HTML>' || text WHEN 2 THEN text ELSE '' END"


_M = [("there", "t = ''"), ("no_html", "doc_id % 4 = 1"), ("heading", r"NOT regexp_matches(t, '(^|[\n\r])#')")]


@query(f"SELECT doc_id, {_told(_M)} AS violations FROM (SELECT doc_id, {_MARKDOWN} AS t FROM documents)")
def markdown_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why raw Markdown would be refused: documents with a heading put before them, with a page's beginning, as they are, and emptied."""
    text = F.expr("case doc_id % 4 when 0 then '# ' || text when 1 then '\\n<HTML>' || text when 2 then text else '' end")
    return checks.markdown(table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query(f"WITH {_ARCHIVES} SELECT archive_id, CASE WHEN page_id % 3 = 0 THEN 'payloads' ELSE '' END AS violations FROM a WHERE kind NOT IN ({', '.join(map(str, _REJECTED))})")
def inventory_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted archives whose files aren't what the inventory says: of every third page the files' bytes are altered."""
    files, summary = archives.validate(_archives(spark, sf_dir))
    altered = F.when(F.substring("archive_id", 2, 20).cast("long") % 3 == 0, F.reverse(F.hex("payload")).cast("binary")).otherwise(F.col("payload"))
    return contracts.inventory(summary, files.withColumn("payload", altered)).select("archive_id", F.array_join("violations", ",").alias("violations"))


_LABELS = """f AS (SELECT 'd' || doc_id AS fixture_id, 'a.py' AS file, doc_id FROM documents),
n AS (SELECT fixture_id, file, doc_id % 250 AS line_count FROM f WHERE doc_id % 11 <> 0),
l AS (SELECT 'd' || doc_id AS fixture_id, CASE WHEN doc_id % 13 = 0 THEN 'b.py' ELSE 'a.py' END AS file, doc_id * 7 % 230 AS start_line, doc_id FROM labels)"""


@query(f"""WITH {_LABELS} SELECT DISTINCT * FROM (
SELECT 'unknown_file' AS problem, fixture_id, file FROM l WHERE doc_id % 13 = 0 OR doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'missing_file', fixture_id, file FROM f WHERE doc_id % 11 = 0
UNION ALL SELECT 'line_count', fixture_id, file FROM n WHERE line_count NOT BETWEEN 30 AND 200
UNION ALL SELECT 'line_outside_file', l.fixture_id, l.file FROM l JOIN n ON n.fixture_id = l.fixture_id AND n.file = l.file WHERE start_line > line_count
UNION ALL SELECT 'repeated_label', fixture_id, file FROM l WHERE doc_id % 19 = 0
UNION ALL SELECT 'unknown_heading', fixture_id, file FROM l WHERE doc_id % 17 = 0)""")
def label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with labels of files: a document is a fixture of one file, and lines, files, headings and repeats follow from ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("fixture_id"), F.array(F.lit("a.py")).alias("python_files"))
    lines = docs.where("doc_id % 11 <> 0").select("fixture_id", F.lit("a.py").alias("file"), (F.col("doc_id") % 250).alias("line_count"))
    labels = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("fixture_id"), _when("doc_id % 13 = 0", "b.py", "a.py").alias("file"), (F.col("doc_id") * 7 % 230).alias("start_line"), F.lit("r").alias("rule_id"),
        F.array(_when("doc_id % 17 = 0", "X", "H")).alias("gold_heading"), F.explode(F.expr("sequence(1, if(doc_id % 19 = 0, 2, 1))")).alias("nth"),
    ).drop("nth")
    headings = spark.createDataFrame([(["H"],)], "heading_path array<string>")
    return migration.label_problems(docs, labels, lines, headings)


_CATEGORIES = list(retrieval.LABELS)
_SPLIT = f"""b AS (SELECT item_id, item_id % 2 = 0 AS dev, {_CATEGORIES}[item_id % {len(_CATEGORIES)} + 1] AS category, 'f' || (item_id % 5) AS family,
CASE WHEN item_id % 10 = 3 THEN 'passage: x' WHEN item_id % 6 IN (0, 1) THEN 'Same  words' || (item_id // 6) ELSE 'own ' || item_id END AS text, CASE WHEN item_id % 7 = 0 THEN 'Lost' ELSE 'H' END AS heading FROM benchmark)"""


@query(f"""WITH {_SPLIT}
SELECT 'invalid_question' AS problem, 'q' || item_id AS detail FROM b WHERE text LIKE 'passage:%'
UNION ALL SELECT 'question_count', want FROM (SELECT count(*) AS n, '12' AS want FROM b WHERE dev UNION ALL SELECT count(*), '20' FROM b WHERE NOT dev) WHERE n <> want::INT
UNION ALL SELECT 'category_count', category FROM (SELECT category, count(b.item_id) AS n FROM (SELECT unnest({_CATEGORIES}) AS category) LEFT JOIN b USING (category) GROUP BY category) WHERE n <> 4
UNION ALL SELECT DISTINCT 'shared_text', lower(replace(x.text, '  ', ' ')) FROM b x JOIN b y ON x.text = y.text AND x.dev AND NOT y.dev
UNION ALL SELECT DISTINCT 'shared_family', x.family FROM b x JOIN b y ON x.family = y.family AND x.dev AND NOT y.dev
UNION ALL SELECT DISTINCT 'unknown_heading', heading FROM b WHERE heading = 'Lost'""")
def benchmark_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the isolation of two question sets made of the benchmark's items: even and odd ids, with texts, families and headings by id."""
    b = table(spark, sf_dir, "benchmark")
    text = F.expr("case when item_id % 10 = 3 then 'passage: x' when item_id % 6 in (0, 1) then 'Same  words' || cast(item_id div 6 as string) else 'own ' || cast(item_id as string) end")
    rows = b.select(
        "item_id", F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"), F.get(F.array(*map(F.lit, _CATEGORIES)), (F.col("item_id") % len(_CATEGORIES)).cast("int")).alias("rule_category"), text.alias("user_question"),
        F.concat(F.lit("f"), (F.col("item_id") % 5).cast("string")).alias("template_family"), F.array(_when("item_id % 7 = 0", "Lost", "H")).alias("gold_heading_path"),
    )
    headings = spark.createDataFrame([(["H"],)], "heading_path array<string>")
    return retrieval.benchmark_problems(rows.where("item_id % 2 = 0").drop("item_id"), rows.where("item_id % 2 = 1").drop("item_id"), headings)


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'late' ELSE 'early' END AS batch, 'source' || (vec_id % 4) AS source_id, len(embedding)::BIGINT AS dimension FROM embeddings WHERE vec_id % 15 <> 7 UNION ALL SELECT -vec_id - 1, 'late', 'source9', len(embedding) FROM embeddings WHERE vec_id % 50 = 0")
def point_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of points after two upserts of the embeddings: the second replaces every tenth point and brings some new ones."""
    e = table(spark, sf_dir, "embeddings")
    # unit vectors, as the table asks for
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / norm).alias("vector"))
    made = lambda df, batch: df.select(F.col("vec_id").cast("string").alias("point_id"), "vector", F.concat(F.lit("source"), (F.col("vec_id") % 4).cast("string")).alias("source_id"), F.lit(batch).alias("batch"))
    size = rows.select(F.size("vector").alias("n")).first()
    points = PointTable(spark, staged_path(spark, "points"), Properties(size.n if size else 1, "stand-in", "1"))
    points.upsert(made(rows.where("vec_id % 15 <> 7"), "early"))
    more = made(rows.where("vec_id % 50 = 0").withColumn("vec_id", -F.col("vec_id") - 1), "late").withColumn("source_id", F.lit("source9"))
    points.upsert(made(rows.where("vec_id % 10 = 0 and vec_id % 15 <> 7"), "late").unionByName(more))
    found = points.read()
    return found.select(F.col("point_id").cast("long").alias("vec_id"), "batch", "source_id", F.size("vector").cast("long").alias("dimension"))


# -- Markdown whose sections, blocks and ids SQL can tell ----------------------------------------------------------------------

_TEXT = f"""replace('pre ' || {_LETTERS} || '~~## Alpha ' || doc_id || '~~' || {_LETTERS} || '~~```py~## no heading~' || doc_id || '~```~~### Beta ##~~tail ' || {_LETTERS} || '~', '~', chr(10))"""
_SECTIONS = f"""t AS (SELECT doc_id, {_TEXT} AS m, 4 + length({_LETTERS}) + 2 AS a FROM documents),
u AS (SELECT doc_id, m, a, strpos(m, '### Beta') - 1 AS b, length(m) AS e FROM t),
s AS (SELECT doc_id, 0 AS chunk_no, [] AS path, 0 AS start, a AS stop, m FROM u UNION ALL SELECT doc_id, 1, ['Alpha ' || doc_id], a, b, m FROM u
  UNION ALL SELECT doc_id, 2, ['Alpha ' || doc_id, 'Beta'], b, e, m FROM u),
c AS (SELECT *, substr(m, start + 1, stop - start) AS own FROM s),
i AS (SELECT *, 'sha256:' || sha256('{{"heading_path":[' || array_to_string(list_transform(path, lambda p: '"' || p || '"'), ',') || '],"identity_schema":"{chunker.SCHEME}","source_id":"documents","source_path":"' || doc_id || '","text":"' || replace(own, chr(10), chr(92) || 'n') || '"}}' || chr(10) || 'occurrence=0') AS chunk_id FROM c)"""
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(('0x' || substr(h, 17, 1))::INT & 3) + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"""WITH {_SECTIONS} SELECT {_UUID} AS point_id, chunk_id, array_to_string(path, ' > ') AS heading, sha256(own) AS content_sha256, start, stop AS "end", 0 AS continuation_index, 0 AS overlap_chars, 0 AS identity_occurrence, 'guide' AS source_id, 'stand-in' AS embedding_model
FROM (SELECT *, sha1(unhex('{text.POINT_NAMESPACE.replace("-", "")}') || encode(chunk_id)) AS h FROM i) WHERE doc_id % 3 <> 1""")
def markdown_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of Markdown chunks with their ids, for those chunks that have a vector: by id every third document has none."""
    found = chunker.chunks(markdown_of(table(spark, sf_dir, "documents")))
    vectors = found.where("doc_id % 3 <> 1").select("chunk_id", F.array(F.lit(1.0)).alias("vector"))
    made = index.points(found, vectors, "guide", "stand-in")
    return made.select("point_id", "chunk_id", F.array_join("heading_path", " > ").alias("heading"), "content_sha256", "start", "end", "continuation_index", "overlap_chars", F.col("identity_occurrence").cast("int").alias("identity_occurrence"), "source_id", "embedding_model")


@query(f"""WITH {_SECTIONS}, k AS (SELECT *, stop - start AS n FROM c WHERE doc_id % 5 <> 0 OR chunk_no <> 1), l AS (SELECT doc_id, count(*) AS chunk_count, min(n) AS low, max(n) AS high, count_if(n BETWEEN 500 AND 1200) AS fit, count_if(n < 500) AS short, count(DISTINCT own) AS contents, sum(n)::BIGINT AS covered FROM k GROUP BY doc_id)
SELECT doc_id, e AS source_chars, chunk_count, low AS min_char_length, high AS max_char_length, fit AS target_range_count, short AS short_count, 0 AS oversized_count, 0 AS continuation_count, 0 AS overlap_count, chunk_count AS unique_ids, contents AS unique_contents, 0 AS id_collisions,
chunk_count - contents AS repeated_contents, covered AS covered_chars, 1 AS fence_count, (doc_id % 5 <> 0)::BIGINT AS preserved_fence_count, 6 AS block_count, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 6 END AS covered_block_count, 0 AS oversized_code_count, (doc_id % 5 = 0)::BIGINT AS gap_count
FROM u JOIN l USING (doc_id)""")
def markdown_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of Markdown chunks, of which every fifth document has lost the one with the fence."""
    docs = markdown_of(table(spark, sf_dir, "documents"))
    return chunker.audit(docs, chunker.chunks(docs).where("doc_id % 5 <> 0 or chunk_no <> 1"))


# -- sources and sinks ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written as a JSON object a line and read with a declared schema."""
    path = staged_path(spark, "lines")
    writers.json_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    return spark.read.schema("doc_id long, text string, lang string, n_chars long").option("mode", "FAILFAST").json(path)


@query("""SELECT coalesce(b.doc_id, s.doc_id)::VARCHAR AS key, CASE WHEN b.doc_id IS NULL OR s.doc_id IS NULL THEN 'incomplete' WHEN s.doc_id % 4 = 0 THEN 'corrupt' ELSE 'hit' END AS state
FROM (SELECT doc_id FROM documents WHERE doc_id % 6 <> 0) b FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) s ON b.doc_id = s.doc_id""")
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a cache of the documents in which, by id, bodies or checksums are missing and checksums are wrong."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("content"))
    sums = docs.where("doc_id % 5 <> 0").select("key", F.concat(F.sha2("content", 256), _when("doc_id % 4 = 0", "0", " ")).alias("sha256"))
    return readers.cache_state(docs.where("doc_id % 6 <> 0"), sums)


@query("SELECT doc_id::VARCHAR AS source_id, sha256(text) AS sha256, strlen(text) AS byte_length, 'MIT' AS license FROM documents")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a snapshot of the documents, but for its time."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").cast("binary").alias("content"))
    return writers.snapshot_manifest(files, license="MIT").drop("retrieved_at_utc")


@query("SELECT page_id, page_id % 6 = 0 AS under FROM pages UNION ALL SELECT -page_id - 1, page_id % 2 = 0 FROM pages WHERE page_id % 5 = 0")
def contained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths, made of page ids, stay under their folder: parents, roots, drives, empty parts and backslashes don't."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    ways = F.expr("case page_id % 6 when 0 then 'a/' || page_id || '.html' when 1 then '../' || page_id when 2 then '/' || page_id when 3 then 'c:' || page_id when 4 then 'a//' || page_id else 'a/./' || page_id end")
    more = pages.where("page_id % 5 = 0").select((-F.col("page_id") - 1).alias("page_id"), F.expr("if(page_id % 2 = 0, '..a/b..', 'a\\\\b')").alias("path"))
    return pages.withColumn("path", ways).unionByName(more).select("page_id", paths.stays_under(F.col("path")).alias("under"))


@query(f"WITH {_SCORES} SELECT * FROM hits")
def system_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankings of all three systems, the hybrid one whole."""
    return retrieval.systems(table(spark, sf_dir, "documents"), _points(spark, sf_dir), _asked(spark, sf_dir), _paired(spark, sf_dir))
