"""The table of points: vectors with their payload, in buckets, with properties that are checked when it is opened.

A manifest names the folder of each bucket and the table's properties.  An upsert rewrites the buckets that its points fall into and
then writes the next manifest, which no other writer may have written meanwhile; what a failed write leaves is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vectors import vector_error
from ..operators.checks import duplicates, require_empty
from ..staging import stage
from .files import Files

BUCKETS, PAGE = 64, 256


class Conflict(RuntimeError):
    """Another writer has changed the table meanwhile."""


@dataclass(frozen=True)
class Properties:
    """What all points of a table have in common."""

    dimension: int
    model: str
    revision: str
    metric: str = "cosine"


class PointTable:
    """A table at path, whose properties are expected to be these; it is made if it isn't there."""

    def __init__(self, spark: SparkSession, path: str, properties: Properties, buckets: int = BUCKETS) -> None:
        if properties.dimension < 1 or properties.metric != "cosine" or not properties.model:
            raise ValueError("a table has vectors of one size, compared by cosine, of one model")
        self.spark, self.path, self.files = spark, str(path).rstrip("/"), Files(spark, path)
        manifest = self._manifest()
        if manifest is None:
            self._commit({"properties": asdict(properties), "buckets": buckets, "folders": {}, "schema": None}, 1)
            manifest = self._manifest()
        if manifest["properties"] != asdict(properties):
            raise ValueError(f"the table has other properties: {manifest['properties']}")
        self.properties = properties

    def _manifest(self) -> dict | None:
        names = [n for n in self.files.names("manifests") if not n.startswith(".")]
        return json.loads(self.files.read(f"manifests/{names[-1]}")) if names else None

    def _commit(self, manifest: dict, number: int) -> None:
        data = json.dumps(manifest | {"number": number}, sort_keys=True).encode()
        if not self.files.create(f"manifests/{number:010d}", data) and number > 1:
            raise Conflict(f"version {number} of {self.path} is another writer's")

    @property
    def version(self) -> int:
        return self._manifest()["number"]

    def exists(self) -> bool:
        return bool(self._manifest()["folders"])

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of these buckets, of all by default; None if they have none."""
        wanted = [f"{self.path}/{folder}/bucket={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets]
        schema = manifest["schema"] and StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else None

    def read(self) -> DataFrame:
        """All points; a reader keeps the version that it began with."""
        found = self._read(self._manifest())
        if found is None:
            raise ValueError(f"{self.path} has no points yet")
        return found

    def upsert(self, new: DataFrame) -> int:
        """Rows of new replace those of the same point_id; returns how many buckets were written.

        new needs point_id and vector; a point_id that repeats, or a vector that isn't a unit vector of the table's size, refuses
        all.  So does an embedding_model or embedding_revision other than the table's, where new has those columns.
        """
        manifest = self._manifest()
        own = self.properties
        new = stage(new.withColumn("bucket", self._bucket(F.col("point_id"), manifest["buckets"])), "points")
        require_empty(duplicates(new, ["point_id"]), "point_id repeats")
        require_empty(new.where(vector_error(F.col("vector"), own.dimension).isNotNull()), "a vector is not a unit vector of the right size")
        for column, value in (("embedding_model", own.model), ("embedding_revision", own.revision)):
            if column in new.columns:
                require_empty(new.where(~F.col(column).eqNullSafe(F.lit(value))), "a point is of another model")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many numbers as buckets at most
        if not touched:
            return 0
        schema = new.drop("bucket").schema
        if manifest["schema"] and StructType.fromJson(json.loads(manifest["schema"])).simpleString() != schema.simpleString():
            raise ValueError("points have other columns than the table")
        old, rows = self._read(manifest, touched), new
        if old is not None:
            kept = old.join(new.select("point_id"), "point_id", "left_anti").withColumn("bucket", self._bucket(F.col("point_id"), manifest["buckets"]))
            rows = kept.unionByName(new)
        folder = f"data/{uuid.uuid4().hex}"
        # a bucket's file is sorted by id, so a page reads few of its row groups
        rows.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "point_id").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        folders = manifest["folders"] | {str(b): folder for b in touched}
        self._commit(manifest | {"folders": folders, "schema": schema.json()}, manifest["number"] + 1)
        return len(touched)

    def count(self, source_id: str) -> int:
        found = self._read(self._manifest())
        return found.where(F.col("source_id") == source_id).count() if found is not None else 0

    def ids(self, source_id: str) -> DataFrame:
        """(point_id): the ids of a source, however many."""
        return self.read().where(F.col("source_id") == source_id).select("point_id").distinct()

    def page(self, source_id: str, after: tuple[int, str] | None = None, size: int = PAGE) -> tuple[list[str], tuple[int, str] | None]:
        """Up to size ids of a source behind a place, and the place to go on from, null at the end.

        A place is a bucket and the last id read in it, so each page begins strictly behind the one before, and reads buckets only
        until it is full; in the first of them ids up to the last one are pruned.
        """
        manifest, out = self._manifest(), []
        buckets = sorted(int(b) for b in manifest["folders"] if after is None or int(b) >= after[0])
        for bucket in buckets:
            rows = self._read(manifest, [bucket]).where(F.col("source_id") == source_id)
            if after is not None and bucket == after[0]:
                rows = rows.where(F.col("point_id") > after[1])
            found = [r.point_id for r in rows.select("point_id").orderBy("point_id").limit(size - len(out)).collect()]
            out += found
            if len(out) == size:
                return out, (bucket, found[-1]) if found else after
        return out, None

    def pages(self, source_id: str, size: int = PAGE) -> Iterator[list[str]]:
        """The ids of a source, page by page; together they are ids()."""
        at = None
        while True:
            found, after = self.page(source_id, at, size)
            if found:
                yield found
            if after is None:
                return
            if after == at:
                raise RuntimeError("a page did not advance")
            at = after

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the data that none of the last manifests names, and older manifests; returns how many folders went."""
        names = self.files.names("manifests")
        live = {f for n in names[-keep:] for f in json.loads(self.files.read(f"manifests/{n}"))["folders"].values()}
        gone = [n for n in self.files.names("data") if f"data/{n}" not in live]
        for name in names[:-keep]:
            self.files.delete(f"manifests/{name}")
        for name in gone:
            self.files.delete(f"data/{name}")
        return len(gone)
