"""Writers: canonical artifacts, published sets, the vector table and the key-value table.

Artifacts are a few rows, made on the driver; tables are written by Spark.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import duplicates, missing_from, require_empty
from .files import Files

METRICS = ("system", "question_count", "recall_at_1", "recall_at_3", "mrr_at_5")


def canonical_json(value: Any) -> bytes:
    """Sorted keys, two spaces, UTF-8, a last line break."""
    return (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()


def metrics_csv(rows: Iterable[Mapping[str, Any]]) -> bytes:
    """One line a system; shares with up to twelve digits."""
    out = io.StringIO(newline="")
    table = csv.writer(out, lineterminator="\n")
    table.writerow(METRICS)
    for row in rows:
        table.writerow([format(row[c], ".12g") if c not in METRICS[:2] else row[c] for c in METRICS])
    return out.getvalue().encode()


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def _pointers(files: Files) -> list[str]:
    return [n for n in files.names() if n.startswith("current-")]


def publish(files: Mapping[str, bytes], folder: str | Path, spark: SparkSession | None = None) -> str:
    """Publishes files together; `unchanged` if all are there already, else `published`.

    folder is on any file system that Spark knows.  The set is written to a folder of its own, and then a numbered pointer is made, which
    readers look for last, so they see all or none of it.  A pointer is never written over: of several publishers each
    makes a number of its own, and the last one counts.
    """
    if any(n in ("", ".", "..") or n.startswith(".") or set(n) & set("/\\\0") for n in files):
        raise ValueError("the name of a published file must stay under the folder")
    version = hashlib.sha256(b"".join(name.encode() + hashlib.sha256(data).digest() for name, data in sorted(files.items()))).hexdigest()[:32]
    top = Files(spark or SparkSession.active(), str(folder))
    while True:
        pointers = _pointers(top)
        # a file that is missing or altered is published again
        lost = [n for n, d in files.items() if top.read(f"{version}/{n}") != d]
        if pointers and not lost and top.read(pointers[-1]) == version.encode():
            return "unchanged"
        for name in lost:
            top.replace(f"{version}/{name}", files[name])
        if pointers and top.read(pointers[-1]) == version.encode():
            return "published"
        number = int(pointers[-1].removeprefix("current-")) + 1 if pointers else 1
        if top.create(f"current-{number:010d}", version.encode()):
            return "published"


def published(folder: str | Path, spark: SparkSession | None = None) -> dict[str, bytes]:
    """The files that were published last."""
    top = Files(spark or SparkSession.active(), str(folder))
    pointers = _pointers(top)
    if not pointers:
        raise FileNotFoundError(f"nothing is published at {folder}")
    home = top.read(pointers[-1]).decode()
    return {n: top.read(f"{home}/{n}") for n in top.names(home) if not n.startswith(".")}


def snapshot_manifest(files: DataFrame, **provenance: str) -> DataFrame:
    """A row for each file (source_id, content) with its digest, length, provenance and the time in UTC to the second."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fixed = [F.lit(v).alias(k) for k, v in sorted(provenance.items())]
    return files.select("source_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_length"), now.alias("retrieved_at_utc"), *fixed)


def run_manifest(inputs: Mapping[str, bytes], outputs: Mapping[str, bytes], parameters: Mapping[str, Any]) -> bytes:
    """What a run read and made, by digest, and how."""
    digests = lambda files: {n: {"sha256": hashlib.sha256(d).hexdigest(), "byte_length": len(d)} for n, d in files.items()}
    return canonical_json({"schema_version": 1, "inputs": digests(inputs), "outputs": digests(outputs), "parameters": dict(parameters)})


class Versioned:
    """A table in numbered folders; a pointer row names the one in use, so a failed write is never read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(n for n in names if n.startswith("v") and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._versions()[-1]}")

    def write(self, df: DataFrame) -> None:
        """Writes a new version beside the old one; it counts once it is whole."""
        old = self._versions()
        number = int(old[-1][1:9]) + 1 if old else 1
        df.write.parquet(f"{self.path}/v{number:08d}-{uuid.uuid4().hex}")
        for name in old[:-1]:
            self._fs.delete(self._at(f"{self.path}/{name}"), True)


def upsert(table: Versioned, new: DataFrame, key: str = "point_id") -> None:
    """Rows of new replace those of the same key; equal input gives equal tables."""
    require_empty(duplicates(new, [key]), f"{key} repeats")
    table.write(table.read().join(new.select(key), key, "left_anti").unionByName(new) if table.exists() else new)


def count_by_source(table: Versioned, source_id: str) -> int:
    return table.read().where(F.col("source_id") == source_id).count()


def ids_of_source(table: Versioned, source_id: str) -> DataFrame:
    return table.read().where(F.col("source_id") == source_id).select("point_id").distinct()


class KeyValue:
    """A small table of keys and values; only known keys can be set."""

    def __init__(self, spark: SparkSession, path: str, defaults: Mapping[str, str]) -> None:
        self.spark, self.table = spark, Versioned(spark, path)
        if not self.table.exists():
            self.table.write(spark.createDataFrame(sorted(defaults.items()), "key string, value string"))

    def get(self, key: str) -> str | None:
        found = self.table.read().where(F.col("key") == key).first()
        return found and found.value

    def set(self, key: str, value: str) -> None:
        rows = self.table.read()
        if rows.where(F.col("key") == key).count() != 1:
            raise KeyError(key)
        self.table.write(rows.withColumn("value", F.when(F.col("key") == key, F.lit(value)).otherwise(F.col("value"))))


def require_no_stale(table: Versioned, source_id: str, expected: DataFrame) -> None:
    """Refuses a table that has points of source_id that expected lacks; nothing is deleted."""
    if table.exists():
        require_empty(missing_from(ids_of_source(table, source_id), expected, ["point_id"]), "stale points")
