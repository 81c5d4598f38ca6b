"""The stored index against the full scan."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, postings


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    words = [f"w{int(rng.paretovariate(0.5)) % 4000}" for _ in range(30_000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "rare.word w1 w1"), (5003, "rare.word w1 w1")]
    queries = [(q, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for q in range(40)] + [(100, "rare word"), (101, "unknown"), (102, "  "), (103, "query: w1"), (104, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache(), spark.createDataFrame(queries, "query_id long, text string")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return postings.build(corpus[0], str(tmp_path_factory.mktemp("index")), block=8)


def ranked(df):
    return {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


@pytest.mark.parametrize(("top_k", "seeds"), [(8, 16), (1, 1), (3, 2)])
def test_search_is_the_full_scan(corpus, index, top_k, seeds):
    docs, queries = corpus
    want = ranked(bm25.search(docs, queries, top_k))
    assert want and ranked(postings.search(index, queries, top_k, seeds)) == want


def test_statistics_are_the_corpus(corpus, index):
    stats = bm25.corpus_stats(corpus[0]).first()
    assert (index.n_docs, index.avgdl) == (stats.n_docs, stats.avgdl)
    assert {(r.term, r.df) for r in index.read("terms").collect()} == {(r.term, r.df) for r in bm25.document_frequencies(corpus[0]).collect()}


def test_blocks_that_cannot_reach_the_top_are_not_read(spark, corpus, index):
    """Passages of documents, as questions about a corpus are: few blocks can reach the first rank."""
    texts = [r.text for r in corpus[0].where("length(text) > 100").orderBy("doc_id").limit(40).collect()]
    queries = spark.createDataFrame([(i, " ".join(t.split()[3:13])) for i, t in enumerate(texts)], "query_id long, text string")
    terms = postings.asked_terms(index, queries)
    rows = terms.join(index.read("postings"), ["bucket", "term"]).select("query_id", "block", "n").cache()
    everything = rows.agg(F.sum("n")).first()[0]
    read = {}
    for top_k in (1, 8):
        first, rest, _ = postings.plan_blocks(index, terms, top_k, seeds=4)
        read[top_k] = rows.join(rest, ["query_id", "block"]).agg(F.sum("n")).first()[0] or 0
        assert first.select("query_id").distinct().count() == 40
    assert read[1] < everything / 4 and read[1] < read[8] < everything, (read, everything)


def test_only_the_terms_buckets_are_read(index, spark):
    terms = postings.asked_terms(index, spark.createDataFrame([(1, "w1")], "query_id long, text string"))
    plan = postings.bounds(index, terms)._jdf.queryExecution().toString()
    buckets = {r.bucket for r in terms.collect()}
    assert len(buckets) == 1 and "PartitionFilters: [isnotnull(bucket" in plan and "entries" not in plan.split("== Physical Plan ==")[1].split("ReadSchema")[1]


def test_a_new_index_counts_once_it_is_whole(spark, corpus, tmp_path, monkeypatch):
    docs, queries = corpus
    path = str(tmp_path / "index")
    old = postings.build(docs, path, block=100)
    broken = postings.weight
    monkeypatch.setattr(postings, "weight", lambda *a: F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        postings.build(docs.limit(5), path)
    monkeypatch.setattr(postings, "weight", broken)
    assert postings.opened(spark, path).version == old.version
    new = postings.build(docs.where("doc_id < 10"), path, k1=1.2, b=0.5)
    assert postings.opened(spark, path).version == new.version != old.version
    assert ranked(postings.search(new, queries)) == ranked(bm25.search(docs.where("doc_id < 10"), queries, k1=1.2, b=0.5))


def test_ties_by_order_and_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 9), (2, "a b", 3), (3, "a b", 5)], "doc_id long, text string, doc_order int")
    queries = spark.createDataFrame([(1, "a")], "query_id long, text string")
    index = postings.build(docs, str(tmp_path / "a"), order="doc_order")
    assert [r.doc_id for r in postings.search(index, queries, 2).orderBy("rank").collect()] == [2, 3]
    none = postings.build(docs.limit(0), str(tmp_path / "b"))
    assert postings.search(none, queries).count() == 0
    assert postings.search(index, queries.limit(0)).count() == 0
