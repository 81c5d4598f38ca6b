"""Search by both rankings, and the evaluation of all three systems, for many questions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import question_key, question_part, query_error
from ..operators import bm25, checks, dense, fusion, metrics, postings
from ..staging import stage

SYSTEMS = ("bm25", "dense", "hybrid")
#: How categories are called in a rendered query.
LABELS = {
    "base_model_methods": "BaseModel method migration",
    "data_loading": "Pydantic model data loading migration",
    "config": "Pydantic model configuration migration",
    "validators": "Pydantic validator migration",
    "field_arguments": "Pydantic Field argument migration",
    "settings": "Pydantic settings migration",
    "generic_model": "Pydantic generic model migration",
    "root_model": "Pydantic root model migration",
}
DEV, LOCKED, A_CATEGORY = 12, 20, 4


def lexical(docs: DataFrame | postings.Index, queries: DataFrame) -> DataFrame:
    """The lexical candidates, from the documents or from an index that was built of them."""
    search = postings.search if isinstance(docs, postings.Index) else bm25.search
    return search(docs, queries, fusion.CANDIDATES)


def hybrid(docs: DataFrame | postings.Index, points: DataFrame, queries: DataFrame, vectors: DataFrame, rrf_k: int = fusion.RRF_K) -> DataFrame:
    """The fused ranking of queries (query_id, text), whose vectors are (query_id, embedding)."""
    return fusion.fuse(lexical(docs, queries), dense.search(points, vectors, fusion.CANDIDATES), rrf_k)


def systems(docs: DataFrame | postings.Index, points: DataFrame, queries: DataFrame, vectors: DataFrame, rrf_k: int = fusion.RRF_K) -> DataFrame:
    """(system, query_id, rank, doc_id): the rankings of the three systems; the hybrid one whole."""
    # both are read twice; they have a few rows a query
    a, b = stage(lexical(docs, queries), "lexical"), stage(dense.search(points, vectors, fusion.CANDIDATES), "dense")
    each = zip(SYSTEMS, (a, b, fusion.fuse(a, b, rrf_k)))
    ranked = [df.select(F.lit(name).alias("system"), "query_id", "rank", "doc_id") for name, df in each]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2])


def evaluate(gold: DataFrame, hits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(scores, aggregates) of every system on every question; gold is (query_id, key), hits the systems' rankings with key."""
    asked = gold.crossJoin(F.broadcast(gold.sparkSession.createDataFrame([(s,) for s in SYSTEMS], "system string")))  # three rows
    scores = metrics.question_scores(asked, hits, key)
    return scores, metrics.aggregates(scores)


def rendered_query(category: Column, old_api: Column, context: Column, question: Column) -> Column:
    """The query that all systems get: fixed order, empty context left out."""
    label = F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), category)
    context = question_part(context)
    return F.concat_ws(
        " ", F.lit("Pydantic v1 to v2 migration."), F.concat(F.lit("Rule category: "), label, F.lit(".")),
        F.concat(F.lit("Legacy API or concept: "), question_part(old_api), F.lit(".")),
        F.when(context != "", F.concat(F.lit("AST context: "), context, F.lit("."))), F.concat(F.lit("Question: "), question_part(question)),
    )


def benchmark_problems(dev: DataFrame, locked: DataFrame, headings: DataFrame) -> DataFrame:
    """(problem, detail): what breaks the isolation of two question sets; no row if nothing does.

    Counts, repeated ids, categories, texts and template families that both have, and gold headings that no chunk has.
    """
    spark = dev.sparkSession
    both = dev.unionByName(locked)
    prefixed = both.where(query_error(F.col("user_question")).isNotNull()).select(F.lit("invalid_question").alias("problem"), F.col("question_id").alias("detail"))
    sizes = dev.agg(F.count("*").alias("n"), F.lit(DEV).alias("want")).unionByName(locked.agg(F.count("*").alias("n"), F.lit(LOCKED).alias("want")))
    counts = sizes.where("n <> want").select(F.lit("question_count").alias("problem"), F.col("want").cast("string").alias("detail"))
    repeated = checks.duplicates(both, ["question_id"]).select(F.lit("question_id").alias("problem"), F.col("question_id").alias("detail"))
    wanted = spark.createDataFrame([(c,) for c in LABELS], "rule_category string")
    per = wanted.join(both.groupBy("rule_category").agg(F.count("*").alias("n")), "rule_category", "full_outer")
    category = per.where(F.coalesce("n", F.lit(0)) != A_CATEGORY).select(F.lit("category_count").alias("problem"), F.col("rule_category").alias("detail"))
    key = lambda df: df.select(question_key(F.col("user_question")).alias("detail"))
    texts = checks.shared(key(dev), key(locked), ["detail"]).select(F.lit("shared_text").alias("problem"), "detail")
    families = checks.shared(dev, locked, ["template_family"]).select(F.lit("shared_family").alias("problem"), F.col("template_family").alias("detail"))
    unknown = checks.missing_from(both.select(F.col("gold_heading_path").alias("heading_path")), headings, ["heading_path"])
    gold = unknown.select(F.lit("unknown_heading").alias("problem"), F.array_join("heading_path", " > ").alias("detail"))
    out = prefixed
    for part in (counts, repeated, category, texts, families, gold):
        out = out.unionByName(part)
    return out
