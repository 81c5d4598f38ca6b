"""Archives as they arrive: each micro-batch runs the batch scan, so results are those of one scan of all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.archives import Limits
from ..plans.migration import scan
from ..sources.readers import archives
from ..staging import drop_staged


def scan_arriving(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None], limits: Limits = Limits()) -> StreamingQuery:
    """Scans the archives that appear under path; sink gets findings, summary and the batch's number, and must be idempotent in it."""
    arriving = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)

    def one(batch: DataFrame, number: int) -> None:
        # contents are read by the batch reader, which leaves large files unread; a lost executor loses no part of a batch
        names = [r.path for r in batch.select("path").collect()]
        if not names:
            return
        session = spark.newSession()  # what a batch stages is its own
        findings, _, summary = scan(archives(session, names, limits), limits)
        try:
            sink(findings, summary, number)
        finally:
            drop_staged(session)

    return arriving.select("path").writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
