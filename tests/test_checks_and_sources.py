import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import checks
from lodestone.plans import index, migration
from lodestone.sources import readers, writers


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_set_checks(spark):
    a, b = df(spark, [(1,), (2,), (None,), (2,)], "k int"), df(spark, [(2,), (3,)], "k int")
    assert sorted((r.k is None, r.k) for r in checks.missing_from(a, b, ["k"]).collect()) == [(False, 1), (True, None)]
    assert [r.k for r in checks.shared(a, b, ["k"]).collect()] == [2]
    assert {(r.k, r.side) for r in checks.set_differences(a.na.drop(), b, "k").collect()} == {(1, "left_only"), (3, "right_only")}
    assert [(r.k, r.n) for r in checks.duplicates(a, ["k"]).collect()] == [(2, 2)]
    with pytest.raises(ValueError, match="no"):
        checks.require_empty(a, "no")


def test_windows(spark):
    rows = df(spark, [("a", 1, 5), ("a", 2, 6), ("a", 3, 1), ("b", 1, 20)], "g string, o int, n int")
    out = checks.running_budget(rows, ["g"], ["o"], "n", 11).orderBy("g", "o").collect()
    assert [(r.running_total, r.within_budget) for r in out] == [(5, True), (11, True), (12, False), (20, False)]
    assert [r.o for r in checks.not_increasing(rows, ["g"], ["o"], "n").collect()] == [3]
    checked = rows.withColumn("error_type", F.when(F.col("o") > 1, F.concat("g", F.col("o").cast("string"))))
    assert [(r.g, r.error_type) for r in checks.first_violation(checked, ["g"], ["o"]).collect()] == [("a", "a2")]
    assert [r.identity_occurrence for r in checks.occurrence(rows, ["g"], ["o"]).orderBy("g", "o").collect()] == [0, 1, 2, 0]


def test_spans(spark):
    outer = df(spark, [(1, 0, 5), (1, 5, 9), (1, 12, 20)], "d int, start int, end int")
    inner = df(spark, [(1, 1, 4), (1, 4, 7), (1, 13, 20), (2, 1, 2)], "d int, start int, end int")
    assert sorted((r.start, r.end) for r in checks.covered(inner, outer, ["d"]).collect()) == [(1, 4), (13, 20)]
    assert sorted((r.start, r.end) for r in checks.merged_spans(outer, ["d"]).collect()) == [(0, 9), (12, 20)]
    assert checks.covered(inner, checks.merged_spans(outer, ["d"]), ["d"]).count() == 3


def test_conditions(spark):
    rows = checks.conditions(df(spark, [(1,), (-1,), (None,)], "n int"), positive=F.col("n") > 0, there=F.col("n").isNotNull()).collect()
    assert [r.violations for r in rows] == [[], ["positive"], ["positive", "there"]]


def test_markdown_and_licence(spark):
    texts = ["# Guide", "a\r# b", "\u00a0\n<!DOCTYPE HTML>\n# a", "<html>", "plain # text", "# a\0", "", None]
    got = {r.text: r.violations for r in checks.markdown(df(spark, [(t,) for t in texts], "text string")).collect()}
    every = ["there", "no_nul", "no_html", "heading"]
    assert got == dict(zip(texts, [[], [], ["no_html"], ["no_html", "heading"], ["heading"], ["no_nul"], ["there", "heading"], every]))
    licences = ["MIT License\n\nPermission is hereby granted, free", "Apache License", "MIT License", None]
    got = [r.violations for r in checks.mit_licence(df(spark, [(t,) for t in licences], "text string").coalesce(1)).collect()]
    assert sorted(got) == sorted([[], ["name", "grant"], ["grant"], ["there", "name", "grant"]])


def test_canonical_writers():
    assert writers.canonical_json({"b": "é", "a": [1]}) == '{\n  "a": [\n    1\n  ],\n  "b": "é"\n}\n'.encode()
    rows = [{"system": "s", "question_count": 12, "recall_at_1": 11 / 12, "recall_at_3": 1.0, "mrr_at_5": 17 / 18}]
    assert writers.metrics_csv(rows) == b"system,question_count,recall_at_1,recall_at_3,mrr_at_5\ns,12,0.916666666667,1,0.944444444444\n"


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    folder = (tmp_path / "set").as_uri()
    with pytest.raises(FileNotFoundError):
        writers.published(folder)
    assert writers.publish({"a": b"1", "b": b"2"}, folder) == "published"
    assert writers.publish({"a": b"1", "b": b"2"}, folder) == "unchanged"

    next((tmp_path / "set").glob("*/b")).unlink()
    assert writers.publish({"a": b"1", "b": b"2"}, folder) == "published"  # a lost file comes back
    next((tmp_path / "set").glob("*/a")).write_bytes(b"x")
    assert writers.publish({"a": b"1", "b": b"2"}, folder) == "published"  # and an altered one
    assert writers.published(folder) == {"a": b"1", "b": b"2"} and len(list((tmp_path / "set").glob("current-*"))) == 1
    for name in ("../x", "a/b", "..", "", ".hidden"):
        with pytest.raises(ValueError):
            writers.publish({name: b""}, folder)

    def broken(*_):
        raise OSError

    monkeypatch.setattr(writers.Files, "create", broken)
    with pytest.raises(OSError):
        writers.publish({"a": b"3", "b": b"4"}, folder)
    assert writers.published(folder) == {"a": b"1", "b": b"2"}
    monkeypatch.undo()
    assert writers.publish({"a": b"3"}, str(tmp_path / "set")) == "published" and writers.published(folder) == {"a": b"3"}
    assert not list((tmp_path / "set").glob(".*[!c]"))  # no drafts are left, but for checksums
    assert json.loads(writers.run_manifest({"i": b""}, {"o": b"x"}, {"k": 1}))["outputs"]["o"]["byte_length"] == 1


def test_publishers_at_once_leave_one_whole_set(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "set")
    sets = [{"a": bytes([i]) * 10, "b": bytes([i, i])} for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        assert set(pool.map(lambda s: writers.publish(s, folder, spark), sets)) == {"published"}
    assert writers.published(folder) in sets
    assert len(list((tmp_path / "set").glob("current-*"))) == 6  # no pointer was written over


def test_index_is_ready_only_when_verified(spark, tmp_path):
    table = writers.Versioned(spark, str(tmp_path / "points"))
    status = writers.KeyValue(spark, str(tmp_path / "kv"), {index.STATUS: index.NOT_BUILT})
    points = df(spark, [("p1", [0.6, 0.8], "s"), ("p2", [1.0, 0.0], "s")], "point_id string, vector array<double>, source_id string")
    assert index.build(table, status, points, "s", 2) == 2 and status.get(index.STATUS) == index.READY
    assert index.build(table, status, points, "s", 2) == 2 and writers.count_by_source(table, "s") == 2
    with pytest.raises(ValueError, match="unit"):
        index.build(table, status, points.withColumn("vector", F.array(F.lit(1.0))), "s", 2)
    assert status.get(index.STATUS) == index.NOT_BUILT
    with pytest.raises(ValueError, match="stale"):
        index.build(table, status, points.where("point_id = 'p1'"), "s", 2)
    assert writers.count_by_source(table, "s") == 2
    with pytest.raises(KeyError):
        status.set("other", "x")
    assert status.get("other") is None


def test_points_of_an_artifact_carry_their_provenance_and_one_model(spark, tmp_path):
    known = {"heading_path": ["H"], "overlap_chars": 0, "continuation_index": 0, "identity_occurrence": 0, "source_start_char": 2, "source_end_char": 9}
    chunk = {c: known.get(c, f"{c} x") for c in index.PROVENANCE}
    (tmp_path / "chunks.json").write_text(json.dumps({"schema_version": 1, "source_id": "source_id x", "chunks": [chunk]}))
    found = readers.chunk_artifact(spark, str(tmp_path / "chunks.json"))[1]
    vectors = df(spark, [("chunk_id x", [0.6, 0.8]), ("other", [1.0, 0.0])], "chunk_id string, vector array<double>")
    points = index.artifact_points(found, vectors, "m", "r")
    (row,) = points.collect()
    assert {c: row[c] for c in index.PROVENANCE} == chunk and (row.embedding_model, row.embedding_revision, row.vector) == ("m", "r", [0.6, 0.8])
    assert len(points.columns) == 19 and len(row.point_id) == 36
    table = writers.Versioned(spark, str(tmp_path / "points"))
    status = writers.KeyValue(spark, str(tmp_path / "kv"), {index.STATUS: index.NOT_BUILT})
    with pytest.raises(ValueError, match="another model"):
        index.build(table, status, points, "source_id x", 2, ("m", "other"))
    assert status.get(index.STATUS) == index.NOT_BUILT
    assert index.build(table, status, points, "source_id x", 2, ("m", "r")) == 1 and status.get(index.STATUS) == index.READY


def test_strict_json(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"schema_version": 1, "split": "dev", "gold_source": "g", "questions": [{"question_id": "a", "gold_heading_path": ["H"], "schema_version": 1}]}))
    row = readers.questions(spark, str(tmp_path / "q.json")).first()
    assert (row.artifact_split, row.question_id, row.gold_heading_path) == ("dev", "a", ["H"])
    (tmp_path / "bad.json").write_text('{"schema_version": "x"')
    with pytest.raises(Exception):
        readers.questions(spark, str(tmp_path / "bad.json")).collect()


def test_verified_text(spark, tmp_path):
    import hashlib

    files = {"a.md": b"## A\n", "b.md": b"\xff", "c.md": b" "}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = [(n, n, hashlib.sha256(d).hexdigest(), len(d)) for n, d in files.items()] + [("d", "d.md", "0", 1), ("e", "a.md", "0", 5), ("f", "a.md", "0", 6)]
    got = readers.verified_text(spark, str(tmp_path), df(spark, rows, "source_id string, snapshot_path string, sha256 string, byte_length long")).collect()
    assert {r.source_id: r.error for r in got} == {"a.md": None, "b.md": "not_utf8", "c.md": "empty", "d": "missing", "e": "sha256", "f": "length"}


def test_verified_text_takes_whole_paths(spark, tmp_path):
    import hashlib

    (tmp_path / "in sub%").mkdir()
    for name in ("notes.md", "a_notes.md", "in sub%/notes.md"):
        (tmp_path / name).write_bytes(name.encode())
    rows = [(n, n, hashlib.sha256(n.encode()).hexdigest(), len(n)) for n in ("notes.md", "in sub%/notes.md")]
    rows += [("up", "../notes.md", "0", 1), ("root", "/etc/hosts", "0", 1), ("part", "otes.md", "0", 1)]
    got = readers.verified_text(spark, str(tmp_path), df(spark, rows, "source_id string, snapshot_path string, sha256 string, byte_length long")).collect()
    assert sorted((r.source_id, r.error, r.text) for r in got) == [
        ("in sub%/notes.md", None, "in sub%/notes.md"), ("notes.md", None, "notes.md"), ("part", "missing", None), ("root", "outside", None), ("up", "outside", None),
    ]


def test_cache_state(spark):
    bodies = df(spark, [("a", bytearray(b"x")), ("b", bytearray(b"y")), ("c", bytearray(b"z"))], "key string, content binary")
    import hashlib

    sums = df(spark, [("a", hashlib.sha256(b"x").hexdigest() + "\n".strip()), ("b", "0"), ("d", "0")], "key string, sha256 string")
    assert {r.key: r.state for r in readers.cache_state(bodies, sums).collect()} == {"a": "hit", "b": "corrupt", "c": "incomplete", "d": "incomplete"}


def test_archives_are_read_by_size(spark, tmp_path):
    from lodestone.operators.archives import Limits
    from lodestone.plans.samples import zipped

    (tmp_path / "a.zip").write_bytes(zipped({"a.py": "import pydantic\n"}))
    (tmp_path / "b.zip").write_bytes(b"0" * 500)
    limits = Limits(archive_bytes=400)
    _, _, summary = migration.scan(readers.archives(spark, str(tmp_path), limits), limits)
    assert {r.archive_id.rsplit("/", 1)[1]: r.error for r in summary.collect()} == {"a.zip": None, "b.zip": "archive_too_large"}


def test_arriving_archives(spark, tmp_path):
    from lodestone.plans.samples import PROJECTS, zipped
    from lodestone.streaming.archives import scan_arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "v.zip").write_bytes(zipped(PROJECTS["vendored"]))
    seen = []
    q = scan_arriving(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda f, s, n: seen.append((f.count(), s.count())))
    q.awaitTermination(120)
    assert seen == [(1, 1)]
    (tmp_path / "in" / "large.zip").write_bytes(b"0" * (2 * 1024 * 1024 + 1))
    q = scan_arriving(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda f, s, n: seen.append([r.error for r in s.collect()]))
    q.awaitTermination(120)
    assert seen[1:] == [["archive_too_large"]]


def test_label_checks(spark):
    fixtures = df(spark, [("x", ["a.py", "b.py"])], "fixture_id string, python_files array<string>")
    labels = df(spark, [("x", "a.py", 5, "r", True, ["H"]), ("x", "a.py", 50, "r", False, ["H"]), ("x", "c.py", 1, "r", True, ["No"])], "fixture_id string, file string, start_line int, rule_id string, expected boolean, gold_heading array<string>")
    lines = df(spark, [("x", "a.py", 40)], "fixture_id string, file string, line_count int")
    headings = df(spark, [(["H"],)], "heading_path array<string>")
    got = {(r.problem, r.file) for r in migration.label_problems(fixtures, labels, lines, headings).collect()}
    assert got == {("unknown_file", "c.py"), ("missing_file", "b.py"), ("line_outside_file", "a.py"), ("unknown_heading", "c.py")}
    row = migration.label_summary(labels, lines).first()
    assert (row.positive_label_count, row.negative_label_count, row.gold_heading_count, row.max_python_loc) == (2, 1, 2, 40)


def test_snapshot_manifest(spark):
    import hashlib
    from datetime import datetime, timezone

    row = writers.snapshot_manifest(df(spark, [("s", bytearray(b"abc"))], "source_id string, content binary"), git_ref="v1").first()
    assert (row.sha256, row.byte_length, row.git_ref) == (hashlib.sha256(b"abc").hexdigest(), 3, "v1")
    when = datetime.strptime(row.retrieved_at_utc, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    assert abs((datetime.now(timezone.utc) - when).total_seconds()) < 120
