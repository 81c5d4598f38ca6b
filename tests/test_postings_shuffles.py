"""What the stored index shuffles: tokens once when it is built, postings once (not once a query) when it is searched."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from lodestone.functions.tables import BROADCAST_ROWS
from lodestone.operators import bm25, postings


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 40)))) for i in range(400)]
    queries = [(q, " ".join(f"w{rng.randint(1, 40)}" for _ in range(5))) for q in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache(), spark.createDataFrame(queries, "query_id long, text string")


def ranked(df):
    return {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


def test_a_build_shuffles_tokens_once(corpus, tmp_path, monkeypatch):
    plans, parquet = {}, DataFrameWriter.parquet

    def spy(self, path, *a, **b):
        plans[path.rsplit("/", 1)[-1]] = self._df._jdf.queryExecution().executedPlan().toString()
        return parquet(self, path, *a, **b)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    index = postings.build(corpus[0], str(tmp_path), block=8)
    # beside the one that has dealt out the corpus
    assert plans["postings"].count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plans["postings"]
    assert ranked(postings.search(index, corpus[1])) == ranked(bm25.search(*corpus))


def test_documents_that_share_an_id_are_as_in_the_full_scan(corpus, tmp_path):
    docs, queries = corpus
    twice = docs.union(docs.where("doc_id < 50")).union(docs.where("doc_id < 20").select("doc_id", F.reverse("text")))
    index = postings.build(twice, str(tmp_path), block=8)
    stats = bm25.corpus_stats(twice).first()
    assert (index.n_docs, index.avgdl) == (stats.n_docs, stats.avgdl)
    want = twice.select("doc_id", bm25.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    want = want.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    got = index.read("postings").select("term", F.inline("entries")).select("doc_id", "dl", "term", "tf")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


@pytest.mark.parametrize("top_k", [1, 8])
def test_postings_meet_many_blocks_by_block_alone(spark, corpus, tmp_path, top_k):
    """With more pairs of query and block than are broadcast, no shuffle has a row of postings for each query."""
    docs, queries = corpus
    index = postings.build(docs, str(tmp_path), block=8)
    terms = postings.asked_terms(index, queries)
    _, some, every = postings.plan_blocks(index, terms, top_k, seeds=1)
    for chosen in (some.select("query_id", "block"), every.select("query_id", "block")):
        more = chosen.union(spark.range(BROADCAST_ROWS + 1).selectExpr("id + 1000", "0"))
        plan = postings.scored(index, terms, more)
        assert "hashpartitioning(query_id" not in plan._jdf.queryExecution().executedPlan().toString()
        rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "at", "score").collect()))
        assert rows(plan) == rows(postings.scored(index, terms, chosen)) != []
