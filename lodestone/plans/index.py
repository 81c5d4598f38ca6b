"""The dense index: points from chunks and vectors, written, verified, and only then called ready."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import uuid5
from ..functions.vectors import vector_error
from ..operators.checks import require_empty, set_differences
from ..sources.points import PointTable
from ..sources.writers import KeyValue, Versioned, ids_of_source, require_no_stale, upsert
from .contracts import other_models

STATUS, NOT_BUILT, READY = "document_index_status", "not_built", "ready"
PAYLOAD = ("chunk_id", "heading_path", "text", "content_sha256", "start", "end", "continuation_index", "overlap_chars", "identity_occurrence")


def points(chunks: DataFrame, vectors: DataFrame, source_id: str, model: str) -> DataFrame:
    """(point_id, vector, source_id, payload columns, embedding_model): each chunk with its vector (chunk_id, vector)."""
    both = chunks.where("error is null").join(vectors.select("chunk_id", "vector"), "chunk_id")
    return both.select(uuid5(F.col("chunk_id")).alias("point_id"), "vector", F.lit(source_id).alias("source_id"), *PAYLOAD, F.lit(model).alias("embedding_model"))


#: What a point carries of a chunk of an artifact, beside the model's name and revision.
PROVENANCE = (
    "chunk_id", "heading_path", "text", "content_sha256", "source_id", "source_url", "git_ref", "resolved_commit_sha", "source_path", "source_snapshot_sha256",
    "source_start_char", "source_end_char", "continuation_index", "overlap_chars", "identity_occurrence",
)


def artifact_points(chunks: DataFrame, vectors: DataFrame, model: str, revision: str) -> DataFrame:
    """(point_id, vector, PROVENANCE, embedding_model, embedding_revision): each chunk of readers.chunk_artifact() with its vector (chunk_id, vector)."""
    both = chunks.join(vectors.select("chunk_id", "vector"), "chunk_id")
    return both.select(uuid5(F.col("chunk_id")).alias("point_id"), "vector", *PROVENANCE, F.lit(model).alias("embedding_model"), F.lit(revision).alias("embedding_revision"))


def build(table: Versioned | PointTable, status: KeyValue, new: DataFrame, source_id: str, dimension: int, model: tuple[str, str] | None = None) -> int:
    """Writes the points of a source; returns their number.

    model, if given, is the name and revision that all points must have; a PointTable has its own, and of it only the buckets that
    points fall into are written.  The status is not_built until the table holds exactly these points, and stays so if any step fails.
    """
    status.set(STATUS, NOT_BUILT)
    require_empty(new.where(vector_error(F.col("vector"), dimension).isNotNull()), "a vector is not a unit vector of the right size")
    if model:
        require_empty(other_models(new, *model), "a point is of another model")
    ids = new.select("point_id")
    require_no_stale(table, source_id, ids)
    if isinstance(table, PointTable):
        table.upsert(new)
    else:
        upsert(table, new)
    require_empty(set_differences(ids_of_source(table, source_id), ids, "point_id"), "the table has other points")
    n = table.read().where(F.col("source_id") == source_id).count()
    if n != ids.count():
        raise ValueError("the table has another number of points")
    status.set(STATUS, READY)
    return n


def ready(checks: DataFrame) -> bool:
    """Whether all components (name, ok) are well; none is not."""
    return bool(checks.agg(F.bool_and("ok")).first()[0])
