import hashlib

from lodestone.operators import archives
from lodestone.plans import contracts, samples


def violations(df):
    return [r.violations for r in df.collect()]


def test_questions(spark):
    schema = "schema_version int, question_id string, split string, rule_category string, old_api string, ast_context string, user_question string, gold_heading_path array<string>, template_family string"
    good = (1, "dev-config-1", "dev", "config", "Config", "", "How?", ["A", "B"], "plain_words")
    bad = (1, "locked-x", "dev", "other", " ", None, "\u00a0", ["A", " "], "Upper")
    rows = spark.createDataFrame([good, bad, (2, "dev_x", "locked_candidate", "config", "a", "", "b", [], "a")], schema).coalesce(1)
    assert violations(contracts.questions(rows)) == [
        [], ["template_family", "split", "rule_category", "old_api", "user_question", "ast_context", "gold_heading_path"], ["schema_version", "question_id", "template_family", "split", "gold_heading_path"],
    ]


def test_fixtures_and_labels(spark):
    f = spark.createDataFrame([("day15-a", "x/a", ["a.py", "b.py"]), ("day17-a", "../a", ["b.py", "a.py"]), ("day16-a-b", "x/b", ["a.txt"]), ("day15-b", "x/c", []), ("day15-c", "x/d/e", ["a.py"])], "fixture_id string, relative_directory string, python_files array<string>").coalesce(1)
    assert violations(contracts.fixtures(f, "x")) == [[], ["fixture_id", "relative_directory", "order"], ["python"], ["count"], ["relative_directory"]]
    schema = "fixture_id string, file string, rule_id string, rule_category string, start_line int, expected boolean, severity string, gold_heading array<string>"
    rows = [("day15-a", "a.py", "pydantic_v1_config", "config", 1, True, "high", ["A"]), ("day15-a", "/a.py", "pydantic_v1_field", "config", 0, None, "low", [" A"])]
    assert violations(contracts.labels(spark.createDataFrame(rows, schema).coalesce(1))) == [[], ["file", "start_line", "expected", "rule_id", "severity", "gold_heading"]]


def test_chunks(spark):
    head = ("s", "u", "r", "a" * 40, "p", "b" * 64)
    names = "source_id string, source_url string, git_ref string, resolved_commit_sha string, source_path string, source_snapshot_sha256 string"
    whole = spark.createDataFrame([("f", 120, *head)], f"artifact string, overlap_chars int, {names}")
    row = lambda no, text, start, **to: {
        "artifact": "f", "chunk_no": no, "chunk_id": "sha256:" + hashlib.sha256(f"{no}".encode()).hexdigest(), "text": text, "heading_path": ["H"], "content_sha256": hashlib.sha256(text.encode()).hexdigest(),
        "char_length": len(text), "source_start_char": start, "source_end_char": start + len(text), "continuation_index": 0, "overlap_chars": 0, "identity_occurrence": 0, **dict(zip([n.split()[0] for n in names.split(", ")], head)), **to,
    }
    schema = f"artifact string, chunk_no int, chunk_id string, text string, heading_path array<string>, content_sha256 string, char_length long, source_start_char long, source_end_char long, continuation_index int, overlap_chars int, identity_occurrence int, {names}"
    rows = [row(0, "ab", 0), row(1, "cd", 2, overlap_chars=120), row(2, "ef", 2, char_length=3), row(3, "gh", 9, source_url="v", content_sha256="x")]
    got = contracts.chunks(spark.createDataFrame(rows, schema), whole).orderBy("chunk_no")
    assert violations(got) == [[], ["first"], ["char_length", "span", "order"], ["content_sha256", "provenance"]]


def test_inventory(spark):
    files, summary = archives.validate(samples.archives(spark))
    assert {v for r in contracts.inventory(summary, files).collect() for v in r.violations} == set()
    fewer = contracts.inventory(summary, files.where("relative_path <> 'app.py'")).collect()
    assert {r.archive_id: r.violations for r in fewer if r.violations} == {"negatives": ["python_files", "lines"]}


def test_other_models(spark):
    rows = spark.createDataFrame([(1, "m", "r"), (2, "m", "q"), (3, None, "r")], "point_id int, embedding_model string, embedding_revision string")
    assert sorted(r.point_id for r in contracts.other_models(rows, "m", "r").collect()) == [2, 3]
