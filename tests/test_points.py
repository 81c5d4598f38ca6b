"""The table of points: properties, partial upserts, pages, and searches that refuse another model."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense
from lodestone.plans import index
from lodestone.sources import points, writers

OWN = points.Properties(2, "m", "r")
SCHEMA = "point_id string, vector array<double>, source_id string, n long"


def rows(spark, ids, n=0, source="s"):
    return spark.createDataFrame([(f"p{i:05d}", [0.6, 0.8], source, n) for i in ids], SCHEMA)


def content(table):
    return {r.point_id: r.n for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return points.PointTable(spark, str(tmp_path / "points"), OWN, buckets=16)


def test_properties_are_checked_on_open(spark, table):
    points.PointTable(spark, table.path, OWN)
    for other in (points.Properties(3, "m", "r"), points.Properties(2, "other", "r"), points.Properties(2, "m", "r2")):
        with pytest.raises(ValueError, match="other properties"):
            points.PointTable(spark, table.path, other)
    with pytest.raises(ValueError):
        points.PointTable(spark, table.path, points.Properties(2, "m", "r", "euclid"))
    assert not table.exists() and table.count("s") == 0
    with pytest.raises(ValueError, match="no points"):
        table.read()


def test_an_upsert_writes_its_buckets_only(spark, table):
    assert table.upsert(rows(spark, range(2000))) == 16
    whole = table.files.size("data")
    before = set(table.files.names("data"))
    assert table.upsert(rows(spark, [3, 5000], 1)) <= 2
    (new,) = set(table.files.names("data")) - before
    assert table.files.size(f"data/{new}") < whole / 4
    found = content(table)
    assert len(found) == 2001 and found["p00003"] == found["p05000"] == 1 and found["p00004"] == 0
    # the same again changes nothing but the version
    table.upsert(rows(spark, [3, 5000], 1))
    assert content(table) == found
    assert table.upsert(rows(spark, [])) == 0
    assert table.vacuum(keep=1) > 0 and content(table) == found


def test_what_is_refused_changes_nothing(spark, table):
    table.upsert(rows(spark, range(10)))
    version, found = table.version, content(table)
    bad = [
        rows(spark, [1, 1]), rows(spark, [1]).withColumn("vector", F.array(F.lit(1.0))), rows(spark, [1]).withColumn("vector", F.array(F.lit(1.0), F.lit(1.0))),
        rows(spark, [1]).withColumn("embedding_model", F.lit("x")), rows(spark, [1]).withColumn("more", F.lit(1)),
    ]
    for new in bad:
        with pytest.raises(ValueError):
            table.upsert(new)
    assert (table.version, content(table)) == (version, found)


def test_failed_and_concurrent_writes_are_not_read(spark, table, monkeypatch):
    table.upsert(rows(spark, range(10)))
    found, commit = content(table), points.PointTable._commit

    def lost(*_):
        raise OSError

    monkeypatch.setattr(points.PointTable, "_commit", lost)
    with pytest.raises(OSError):
        table.upsert(rows(spark, range(10), 9))
    assert content(table) == found

    def late(self, manifest, number):  # another writer commits first
        monkeypatch.setattr(points.PointTable, "_commit", commit)
        table.upsert(rows(spark, [77], 7))
        commit(self, manifest, number)

    monkeypatch.setattr(points.PointTable, "_commit", late)
    with pytest.raises(points.Conflict):
        table.upsert(rows(spark, range(10), 9))
    assert content(table) == found | {"p00077": 7}


def test_pages_together_are_the_set(spark, table):
    table.upsert(rows(spark, range(700)).unionByName(rows(spark, range(1000, 1300), source="t")))
    found = list(table.pages("s", size=64))
    assert [len(p) for p in found[:-1]] == [64] * 10 and len(found[-1]) == 60
    flat = [i for p in found for i in p]
    assert len(flat) == len(set(flat)) == 700 and set(flat) == {r.point_id for r in table.ids("s").collect()}
    assert list(table.pages("none")) == [] and len(list(table.pages("t", size=300))) == 1
    # a page reads from its place on: earlier buckets not at all, and in its own the filter reaches the file
    _, after = table.page("s", size=400)
    read = []
    own = points.PointTable._read

    def seen(self, manifest, buckets=None):
        read.append(buckets)
        return own(self, manifest, buckets)

    points.PointTable._read = seen
    try:
        table.page("s", after, 10)
    finally:
        points.PointTable._read = own
    assert after[0] > 0 and read[0] == [after[0]] and len(read) <= 2


def test_an_index_is_built_in_a_point_table(spark, table, tmp_path):
    status = writers.KeyValue(spark, str(tmp_path / "kv"), {index.STATUS: index.NOT_BUILT})
    assert index.build(table, status, rows(spark, range(5)), "s", 2) == 5 and status.get(index.STATUS) == index.READY
    with pytest.raises(ValueError, match="stale"):
        index.build(table, status, rows(spark, range(4)), "s", 2)
    assert status.get(index.STATUS) == index.NOT_BUILT and table.count("s") == 5


@pytest.mark.parametrize("most", [50_000, 1])
def test_a_search_refuses_points_of_another_model(spark, most):
    made = [(i, [0.6, 0.8] if i % 2 else [1.0, 0.0], "m", "r") for i in range(20)]
    own = spark.createDataFrame(made, "doc_id long, embedding array<double>, embedding_model string, embedding_revision string")
    asked = own.select(F.col("doc_id").alias("query_id"), "embedding").where("query_id < 3")
    want = sorted(map(tuple, dense.search(own, asked, most=most).collect()))
    assert sorted(map(tuple, dense.search(own, asked, most=most, model=("m", "r")).collect())) == want
    for other in (("x", "r"), ("m", "x"), (None, "r")):
        planted = own.withColumn("embedding_model", F.when(F.col("doc_id") == 13, other[0]).otherwise("m")).withColumn("embedding_revision", F.when(F.col("doc_id") == 13, other[1]).otherwise("r"))
        with pytest.raises(Exception, match="another model"):
            dense.search(planted, asked, most=most, model=("m", "r")).collect()
        assert len(dense.search(planted, asked, most=most).collect()) == len(want)
