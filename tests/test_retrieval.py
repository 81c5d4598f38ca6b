import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import dot as vectors_dot
from lodestone.operators import bm25, dense, fusion, metrics
from lodestone.plans import retrieval

DOCS = [(1, 0, "apple banana apple"), (2, 1, "banana cherry"), (3, 2, "banana cherry"), (4, 3, "!!!"), (5, 4, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, doc_order int, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def brute_bm25(query, k1=1.5, b=0.75):
    docs = {i: (t or "").replace("!!!", "").split() for i, _, t in DOCS}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    out = []
    for i, words in docs.items():
        score = 0.0
        for term in dict.fromkeys(query.split()):
            df, tf = sum(term in w for w in docs.values()), words.count(term)
            if tf:
                score += math.log1p((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / average))
        if score:
            out.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(out)]


@pytest.mark.parametrize("query", ["apple", "banana cherry", "cherry banana banana", "zebra"])
def test_bm25_equals_brute_force(spark, docs, query):
    rows = bm25.search(docs, asked(spark, query), order="doc_order").orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == brute_bm25(query)
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))


def test_bm25_ties_follow_the_documents_order(spark):
    docs = spark.createDataFrame([(7, 2, "x y"), (9, 1, "x y")], "doc_id long, doc_order int, text string")
    assert [r.doc_id for r in bm25.search(docs, asked(spark, "x"), order="doc_order").orderBy("rank").collect()] == [9, 7]


def test_bm25_refused_queries_have_no_rows(spark, docs):
    assert bm25.search(docs, asked(spark, " ", "query: apple", "!!"), order="doc_order").count() == 0


def test_bm25_without_any_token(spark):
    docs = spark.createDataFrame([(1, "!"), (2, None)], "doc_id long, text string")
    assert bm25.search(docs, asked(spark, "x")).count() == 0


@pytest.mark.parametrize("top_k", [0, 9, True, 1.5])
def test_top_k_bounds(docs, top_k):
    with pytest.raises(ValueError):
        bm25.check_parameters(top_k)


@pytest.mark.parametrize("k1, b", [(0, 0.5), (-1, 0.5), (1, -0.1), (1, 1.1), (float("inf"), 0.5), (True, 0.5)])
def test_weights_bounds(k1, b):
    with pytest.raises(ValueError):
        bm25.check_parameters(1, k1, b)


def test_dense_ties_by_id(spark):
    points = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.doc_id, r.score) for r in dense.search(points, queries, 2).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0)]


def test_dense_search_in_blocks_of_queries(spark):
    points = spark.createDataFrame([(i, [float(i % 7 == k) for k in range(7)]) for i in range(40)] + [(99, [1.0])], "doc_id long, embedding array<double>")
    queries = points.withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, dense.search(points, queries, 3).collect()))
    assert sorted(map(tuple, dense.search(points, queries, 3, most=9).collect())) == want and len(want) == 121


@pytest.mark.parametrize("odd", [False, True])
def test_dense_search_equals_the_plain_one_by_blocks(spark, monkeypatch, odd):
    """Copies, near ties, other sizes and, if odd, vectors with a null, a NaN or a huge number; no row pairs but of odd ones."""
    draw = random.Random(5)
    vectors = [[draw.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    vectors += vectors[:5] * 6 + [[x + draw.choice([0, 1e-13, 1e-9]) for x in vectors[0]] for _ in range(20)] + [[1.0, 2.0], [0.5, 0.25]]
    vectors += [[1.0, None, 0.0, 0.0, 0.0, 1.0], [float("nan")] * 6, [1e200] * 6, [], None] if odd else []
    points = spark.createDataFrame([(1000 - i, v) for i, v in enumerate(vectors)], "doc_id long, embedding array<double>")
    queries = points.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    for name, n in (("PART", 30), ("BLOCK", 7), ("TILE", 2)):
        monkeypatch.setattr(dense, name, n)
    met = points.join(F.broadcast(queries.withColumnRenamed("embedding", "asked")), F.size("embedding") == F.size("asked"))
    met = met.select("query_id", "doc_id", F.round(vectors_dot(F.col("embedding"), F.col("asked")), 9).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    want = met.withColumn("rank", F.row_number().over(by)).where("rank <= 8").selectExpr("query_id", "cast(rank as bigint) rank", "doc_id", "score")
    if not odd:
        monkeypatch.setattr(dense, "dot", lambda *_: pytest.fail("a row-by-row comparison"))
    assert sorted(map(str, dense.search(points, queries).collect())) == sorted(map(str, want.collect()))


def ranking(spark, ids, scores=None, text="t"):
    rows = [(0, i + 1, d, 1.0 - i / 10, text) for i, d in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id long, rank long, doc_id string, score double, text string")


def test_fusion_order_and_tie_breaks(spark):
    rows = fusion.fuse(ranking(spark, ["a", "b", "c"]), ranking(spark, ["b", "a", "d"])).orderBy("rank").collect()
    # a and b tie in score, best rank and sum: the id decides; c and d too
    assert [r.doc_id for r in rows] == ["a", "b", "c", "d"]
    assert rows[0].rrf_score == 1 / 61 + 1 / 62 and rows[2].dense_rank is None and rows[3].bm25_score is None


def test_fusion_of_one_side_and_of_nothing(spark):
    empty = ranking(spark, [])
    assert [r.doc_id for r in fusion.fuse(ranking(spark, list("abcdefgh")), empty).orderBy("rank").collect()] == list("abcdefgh")
    assert fusion.fuse(empty, empty).count() == 0


def test_fusion_of_sixteen(spark):
    rows = fusion.fuse(ranking(spark, list("abcdefgh")), ranking(spark, list("ijklmnop")))
    assert rows.count() == 16 and fusion.top(rows).count() == 3


def test_fusion_refuses_unequal_provenance(spark):
    with pytest.raises(Exception, match="text differs"):
        fusion.fuse(ranking(spark, ["a"]), ranking(spark, ["a"], text="u"), provenance=["text"]).collect()
    assert fusion.fuse(ranking(spark, ["a"]), ranking(spark, ["a"]), provenance=["text"]).first().text == "t"


def test_ranking_errors(spark):
    bad = spark.createDataFrame([(0, 1, "a"), (0, 3, "b"), (1, 1, "a"), (1, 2, "a"), *[(2, i + 1, str(i)) for i in range(9)], (3, 1, "a")], "query_id long, rank long, doc_id string")
    assert {(r.query_id, r.error) for r in fusion.ranking_errors(bad).collect()} == {(0, "rank_gap"), (1, "duplicate"), (2, "too_many")}


@pytest.mark.parametrize("k", [0, 1001, True, 2.0])
def test_rrf_k_bounds(k):
    with pytest.raises(ValueError):
        fusion.check_rrf_k(k)


@pytest.mark.parametrize("place, r1, r3, rr", [(1, 1, 1, 1.0), (2, 0, 1, 0.5), (3, 0, 1, 1 / 3), (5, 0, 0, 0.2), (6, 0, 0, 0.0), (None, 0, 0, 0.0)])
def test_scores_at_rank_boundaries(spark, place, r1, r3, rr):
    hits = spark.createDataFrame([("s", 0, i, ["g"] if i == place else ["x"]) for i in range(1, 9)], "system string, query_id long, rank long, heading_path array<string>")
    gold = spark.createDataFrame([("s", 0, ["g"])], "system string, query_id long, heading_path array<string>")
    row = metrics.question_scores(gold, hits).first()
    assert (row.first_gold_rank, row.recall_at_1, row.recall_at_3, row.reciprocal_rank_at_5, row.returned_count) == (place, r1, r3, rr, 8)


def test_aggregates_count_questions_without_hits(spark):
    gold = spark.createDataFrame([("s", 0, "g"), ("s", 1, "g")], "system string, query_id long, k string")
    hits = spark.createDataFrame([("s", 0, 2, "g")], "system string, query_id long, rank long, k string")
    row = metrics.aggregates(metrics.question_scores(gold, hits, "k")).first()
    assert (row.question_count, row.recall_at_1, row.recall_at_3, row.mrr_at_5) == (2, 0.0, 0.5, 0.25)


def question(i, split="dev", category="config", text="how", family="f", heading=("H",)):
    return (f"{split}-{i}", split, category, "api", "", text, list(heading), family)


QUESTION = "question_id string, split string, rule_category string, old_api string, ast_context string, user_question string, gold_heading_path array<string>, template_family string"


def benchmark(spark):
    categories = [c for c in retrieval.LABELS for _ in range(4)]
    dev = [question(i, "dev", c, f"dev {i}", "a") for i, c in enumerate(categories[:12])]
    locked = [question(i, "locked", c, f"locked {i}", "b") for i, c in enumerate(categories[12:])]
    return dev, locked


def problems(spark, dev, locked, headings=(("H",),)):
    h = spark.createDataFrame([(list(x),) for x in headings], "heading_path array<string>")
    return {(r.problem, r.detail) for r in retrieval.benchmark_problems(spark.createDataFrame(dev, QUESTION), spark.createDataFrame(locked, QUESTION), h).collect()}


def test_isolated_benchmark_has_no_problem(spark):
    assert problems(spark, *benchmark(spark)) == set()


def test_contaminated_benchmark(spark):
    dev, locked = benchmark(spark)
    locked[0] = question(0, "locked", locked[0][2], "DEV  3", "a", ("Other",))
    found = problems(spark, dev, locked)
    assert found == {("shared_text", "dev 3"), ("shared_family", "a"), ("unknown_heading", "Other")}
    locked[0] = (dev[0][0], *locked[0][1:])
    assert ("question_id", dev[0][0]) in problems(spark, dev, locked)
    assert {p for p, _ in problems(spark, dev[1:], locked)} >= {"question_count", "category_count"}


def test_rendered_query(spark):
    row = spark.createDataFrame([("config", " a  b", "", "why"), ("settings", "x", "c", "y")], "c string, o string, a string, q string")
    got = [r.t for r in row.select(retrieval.rendered_query(*[F.col(x) for x in "coaq"]).alias("t")).collect()]
    assert got[0] == "Pydantic v1 to v2 migration. Rule category: Pydantic model configuration migration. Legacy API or concept: a b. Question: why"
    assert "AST context: c. Question: y" in got[1]


def test_scores_are_summed_up_where_a_documents_tokens_are(spark):
    docs = spark.createDataFrame([(i, f"term{i % 7} common word{i}") for i in range(40)] + [(None, "common"), (3, "common term3")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "common term3"), (2, "word5")], "query_id long, text string")
    found = bm25.search(docs, asked)
    # a row for each query and document that has one of its terms was shuffled
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", found._jdf.queryExecution().executedPlan().toString())
    first = [r for r in found.collect() if r.rank == 1]
    assert [(r.query_id, r.doc_id) for r in sorted(first)] == [(1, 3), (2, 5)]
