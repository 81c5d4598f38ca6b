"""The driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents.  Work on texts is done where they are read, so a table of fewer splits than there are cores (one small
    file) is dealt out first; larger ones stay as they are split."""
    df = read(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
