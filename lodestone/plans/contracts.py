"""The contracts of artifacts, written down: each function adds violations, the names of the rules that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_python, stays_under
from ..operators.checks import conditions
from ..operators.rules import RULES
from ..operators.symbols import LIBRARY
from .retrieval import LABELS

#: The forms of ids and digests.
QUESTION_ID, FAMILY, FIXTURE_ID = r"\A(dev|locked)-[a-z0-9]+(-[a-z0-9]+)*\z", r"\A[a-z][a-z0-9_]{2,63}\z", r"\Aday1[56]-[a-z0-9]+(-[a-z0-9]+)*\z"
#: Fixed value: the folder of the fixtures.
FIXTURES = "data/evaluation/detection/fixtures"
SHA256, COMMIT, CHUNK_ID = r"\A[0-9a-f]{64}\z", r"\A[0-9a-f]{40}\z", r"\Asha256:[0-9a-f]{64}\z"


def _said(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def questions(df: DataFrame) -> DataFrame:
    """Questions of readers.questions(): ids and families of their form, the id's split, a known category, texts and headings that say something."""
    c = F.col
    prefix = F.when(c("split") == "dev", "dev-").when(c("split") == "locked_candidate", "locked-")
    return conditions(
        df, schema_version=c("schema_version") == 1, question_id=c("question_id").rlike(QUESTION_ID), template_family=c("template_family").rlike(FAMILY),
        split=c("question_id").startswith(prefix), rule_category=c("rule_category").isin(*LABELS), old_api=_said(c("old_api")), user_question=_said(c("user_question")),
        ast_context=c("ast_context").isNotNull(), gold_heading_path=(F.size("gold_heading_path") > 0) & F.forall("gold_heading_path", _said),
    )


def fixtures(df: DataFrame, root: str = FIXTURES) -> DataFrame:
    """Fixtures: an id of its form, a folder right under root, one to four Python files under the fixture, sorted and different."""
    files = F.col("python_files")
    return conditions(
        df, fixture_id=F.col("fixture_id").rlike(FIXTURE_ID), relative_directory=stays_under(F.col("relative_directory")) & (F.regexp_replace("relative_directory", "/[^/]+$", "") == root), count=F.size(files).between(1, 4),
        order=files == F.array_sort(F.array_distinct(files)), python=F.forall(files, lambda f: stays_under(f) & is_python(f)),
    )


def labels(df: DataFrame) -> DataFrame:
    """Labels: an id of its form, a Python file, a line, the rule's own category and severity, trimmed headings."""
    c = F.col
    severity = F.element_at(F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair]), c("rule_category"))
    return conditions(
        df, fixture_id=c("fixture_id").rlike(FIXTURE_ID), file=stays_under(c("file")) & is_python(c("file")), start_line=c("start_line") >= 1, expected=c("expected").isNotNull(),
        rule_id=c("rule_id") == F.concat(F.lit(f"{LIBRARY}_v1_"), c("rule_category")), severity=c("severity") == severity,
        gold_heading=(F.size("gold_heading") > 0) & F.forall("gold_heading", lambda h: _said(h) & ~h.rlike(r"(?U)^\s|\s$")),
    )


def chunks(df: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Chunks of readers.chunk_artifact(): fields that follow from others do, and the artifact's order, provenance and overlap hold.

    Ids are counted and starts compared within an artifact.
    """
    c = F.col
    shared = ("source_id", "source_url", "git_ref", "resolved_commit_sha", "source_path", "source_snapshot_sha256")
    whole = artifacts.select("artifact", F.col("overlap_chars").alias("__overlap"), *[F.col(s).alias(f"__{s}") for s in shared])
    own = Window.partitionBy("artifact").orderBy("chunk_no")
    rows = df.join(whole, "artifact").withColumn("__before", F.lag("source_start_char").over(own)).withColumn("__times", F.count("*").over(Window.partitionBy("artifact", "chunk_id")))
    same = F.lit(True)
    for s in shared:
        same &= c(s) == c(f"__{s}")
    out = conditions(
        rows, chunk_id=c("chunk_id").rlike(CHUNK_ID), unique=c("__times") == 1, char_length=(c("char_length") == F.length("text")) & (c("char_length") > 0),
        span=c("source_end_char") - c("source_start_char") == c("char_length"), content_sha256=F.sha2(c("text").cast("binary"), 256) == c("content_sha256"),
        heading_path=F.forall("heading_path", _said), commit=c("resolved_commit_sha").rlike(COMMIT), snapshot=c("source_snapshot_sha256").rlike(SHA256),
        first=(c("continuation_index") >= 0) & ((c("continuation_index") > 0) | (c("overlap_chars") == 0)), overlap=c("overlap_chars").isin(0, c("__overlap")),
        occurrence=c("identity_occurrence") >= 0, order=(c("source_start_char") >= 0) & (c("__before").isNull() | (c("source_start_char") > c("__before"))), provenance=same,
    )
    return out.select(*df.columns, "violations")


def inventory(summary: DataFrame, files: DataFrame) -> DataFrame:
    """Archives of archives.validate() that were accepted: members add up, and files' counts, lines and bytes are those of the files themselves."""
    c = F.col
    per = files.groupBy("archive_id").agg(
        F.count("*").alias("__files"), F.countDistinct("relative_path").alias("__paths"), F.sum("line_count").alias("__lines"), F.sum("size_bytes").alias("__bytes"),
        F.bool_and((F.octet_length("payload") == c("size_bytes")) & (F.sha2("payload", 256) == c("sha256"))).alias("__whole"),
    )
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    out = conditions(
        summary.where("error_type is null").join(per, "archive_id", "left"), members=c("archive_member_count") == c("regular_file_count") + c("directory_count"),
        python_files=c("python_file_count") == zero("__files"), paths=zero("__paths") == zero("__files"), lines=c("python_total_lines") == zero("__lines"),
        total_bytes=c("total_uncompressed_bytes") >= zero("__bytes"), payloads=F.coalesce("__whole", F.lit(True)),
    )
    return out.select("archive_id", "violations")


def other_models(points: DataFrame, model: str, revision: str) -> DataFrame:
    """The points (embedding_model, embedding_revision) that another model made; a search with vectors of this one must not see any."""
    same = F.col("embedding_model").eqNullSafe(F.lit(model)) & F.col("embedding_revision").eqNullSafe(F.lit(revision))
    return points.where(~same)
