"""Readers: archives, verified text and strict JSON artifacts.  Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.archives import Limits
from ..staging import qualified

QUESTIONS = (
    "schema_version int, split string, gold_source string, questions array<struct<schema_version int, question_id string, split string, rule_category string, "
    "old_api string, ast_context string, user_question string, gold_heading_path array<string>, template_family string>>"
)
DETECTION = (
    "schema_version int, status string, gold_source string, fixtures array<struct<fixture_id string, relative_directory string, python_files array<string>>>, "
    "labels array<struct<fixture_id string, file string, rule_id string, rule_category string, start_line int, expected boolean, severity string, gold_heading array<string>>>"
)
MANIFEST = (
    "source_id string, upstream_repo string, git_ref string, resolved_commit_sha string, path string, source_url string, snapshot_path string, retrieved_at_utc string, "
    "sha256 string, byte_length long, license string, license_source_url string, license_path string, license_sha256 string, license_byte_length long, attribution_path string"
)

CHUNKS = (
    "schema_version int, source_id string, source_url string, git_ref string, resolved_commit_sha string, source_path string, source_snapshot_path string, "
    "source_snapshot_sha256 string, source_snapshot_byte_length long, source_retrieved_at_utc string, min_chars int, max_chars int, overlap_chars int, "
    "chunks array<struct<chunk_id string, text string, heading_path array<string>, content_sha256 string, char_length long, source_id string, source_url string, git_ref string, "
    "resolved_commit_sha string, source_path string, source_snapshot_sha256 string, source_start_char long, source_end_char long, continuation_index int, overlap_chars int, "
    "identity_occurrence int>>"
)


def archives(spark: SparkSession, path: str | list[str], limits: Limits = Limits()) -> DataFrame:
    """(archive_id, content): the archives under path.  The size is checked before contents are read: larger ones have null
    content and `oversized`."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    small = files.where(F.col("length") <= limits.archive_bytes).select(F.col("path").alias("archive_id"), "content", F.lit(False).alias("oversized"))
    large = files.where(F.col("length") > limits.archive_bytes).select(F.col("path").alias("archive_id"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("oversized"))
    return small.unionByName(large)


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file; malformed files and values of another type fail the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each question of the artifacts under path."""
    return strict_json(spark, path, QUESTIONS).select(F.col("split").alias("artifact_split"), F.explode("questions").alias("q")).select("artifact_split", "q.*")


def chunk_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(artifacts, chunks) of the chunk artifacts under path; chunks have their artifact's file and place, artifact and chunk_no."""
    whole = strict_json(spark, path, CHUNKS).withColumn("artifact", F.col("_metadata.file_path"))
    rows = whole.select("artifact", F.posexplode("chunks").alias("chunk_no", "c")).select("artifact", "chunk_no", "c.*")
    return whole.drop("chunks"), rows


def detection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fixtures, labels) of a detection artifact."""
    whole = strict_json(spark, path, DETECTION)
    return whole.select(F.explode("fixtures").alias("f")).select("f.*"), whole.select(F.explode("labels").alias("l")).select("l.*")


def verified_text(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(source_id, text, error): files whose digest and length are those that their manifest row states, decoded strictly.

    manifest has source_id, snapshot_path (the file's path below the folder path), sha256 and byte_length.  A broken file has
    error and no text; a manifest row without a file has the error missing, and one whose path leaves the folder outside.
    """
    top = qualified(spark, path).rstrip("/")
    # file:/x and file:///x are one name
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.load(path).select(plain(F.col("path")).alias("name"), "path", "length", "content")
    wanted = manifest.select("source_id", "snapshot_path", "sha256", "byte_length")
    name = F.concat(plain(F.lit(top)), F.lit("/"), "snapshot_path")
    found = wanted.withColumn("name", name).join(files, "name", "left")
    text = F.col("content").cast("string")
    error = (
        F.when(~paths.stays_under(F.col("snapshot_path")), "outside")
        .when(F.col("path").isNull(), "missing")
        .when(F.col("length") != F.col("byte_length"), "length")
        .when(F.sha2("content", 256) != F.col("sha256"), "sha256")
        .when(~F.is_valid_utf8(text), "not_utf8")
        .when(F.trim(text) == "", "empty")
    )
    return found.select("source_id", F.when(error.isNull(), text).alias("text"), error.alias("error"))


def cache_state(bodies: DataFrame, checksums: DataFrame) -> DataFrame:
    """(key, state) of a checksum-verified cache: hit, corrupt, or incomplete where one of the pair is missing."""
    both = bodies.select("key", "content").join(checksums.select("key", F.trim("sha256").alias("want")), "key", "full_outer")
    state = F.when(F.col("content").isNull() | F.col("want").isNull(), "incomplete").when(F.sha2("content", 256) == F.col("want"), "hit").otherwise("corrupt")
    return both.select("key", state.alias("state"))
