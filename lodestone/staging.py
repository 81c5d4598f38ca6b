"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of sessions in one JVM that have no spark.checkpoint.dir, by application.
_fallback: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session in one JVM gets a folder of its own where the setting is missing.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # the setting is static: a running session can't be given it
    return _fallback.setdefault(context.applicationId, f"file:///tmp/checkpoints/{uuid.uuid4().hex}")


def session_dir(spark: SparkSession) -> str:
    """Where this session's intermediate tables are, apart from those of all other sessions."""
    return f"{checkpoint_dir(spark)}/lodestone-{spark.sparkContext.applicationId}-{spark._jsparkSession.sessionUUID()}"


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI of the file system that Spark resolves it on; a path without a scheme is on the default one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def staged_path(spark: SparkSession, label: str) -> str:
    """A folder of its own among this session's intermediate tables."""
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, level: int = 1) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage; lost executors lose none of it.

    The write's shuffle files go once it ends; otherwise they stay until the driver happens to collect garbage, and so pile up.
    """
    spark, path = df.sparkSession, staged_path(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": str(level)}).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*staged: DataFrame) -> None:
    """Deletes tables that stage() has returned, which nothing reads any more; others are left alone."""
    for df in staged:
        spark, own = df.sparkSession, session_dir(df.sparkSession)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if qualified(spark, own) == qualified(spark, folder.rsplit("/", 1)[0]):
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(spark: SparkSession) -> None:
    """Deletes what stage() has written in this session; call it when results that read from it are no longer needed."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)
