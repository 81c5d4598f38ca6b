"""Terms are counted where documents are read; only those that share an id meet in a shuffle."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25

ROWS = [(1, "b a b c.d b"), (2, None), (3, ""), (4, "z"), (5, "x " * 3000 + "y"), (6, "été ß ÉTÉ"), (7, "--")]
#: Ids that two rows have, null among them.
SHARED = [(1, "b q"), (None, "n n"), (None, "n m"), (3, "late"), (2, None)]
PARTS = {"c.d": ["c.d", "c", "d"], "ß": ["ss"], "--": []}


def brute(rows):
    found = Counter((i, t) for i, text in rows for w in (text or "").split() for t in PARTS.get(w, [w.lower()]))
    return sorted((*k, n) for k, n in found.items() if k[0] is not None), sorted((*k[1:], n) for k, n in found.items() if k[0] is None)


def found(df):
    rows = [tuple(r) for r in df.collect()]
    return sorted(r for r in rows if r[0] is not None), sorted(r[1:] for r in rows if r[0] is None)


def test_unique_ids_need_no_shuffle(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = bm25.term_frequencies(docs)
    assert out.columns == ["doc_id", "term", "tf"] and out.schema["tf"].dataType.simpleString() == "bigint"
    assert found(out) == brute(ROWS)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [True, False])
def test_shared_ids_are_one_document(spark, monkeypatch, few):
    docs = spark.createDataFrame(ROWS + SHARED, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(bm25, "is_small", lambda df: few)
    assert found(bm25.term_frequencies(docs)) == brute(ROWS + SHARED)


def test_rows_of_one_id_stay_apart_by_more_columns(spark):
    docs = spark.createDataFrame([(1, 2, "a a"), (1, 2, "a b"), (1, 3, "a b c"), (2, 1, "a")], "doc_id long, dl int, text string")
    out = bm25.counted(docs.select("doc_id", "dl", F.split("text", " ").alias("tokens")), ["doc_id"], "dl")
    assert sorted(map(tuple, out.collect())) == [(1, 2, "a", 3), (1, 2, "b", 1), (1, 3, "a", 1), (1, 3, "b", 1), (1, 3, "c", 1), (2, 1, "a", 1)]
