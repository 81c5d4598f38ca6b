"""Bounded frames for Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: Rows that a worker gets at once; rows, and bytes of their texts and binaries, that it returns at once (one row at least).
READ_ROWS, ROWS, BYTES = 128, 500, 4 * 1024 * 1024


def in_pieces(rows: Iterable[Any], columns: list[str], most: int = ROWS, most_bytes: int = BYTES) -> Iterator[pd.DataFrame]:
    """Frames of a bounded size of the rows, tuples or dicts, which are taken as they are needed; missing values are None."""

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(part, columns=columns).astype(object)
        return out.where(out.notna(), None)

    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in (row.values() if isinstance(row, dict) else row) if isinstance(x, (bytes, str)))
        if len(part) >= most or size >= most_bytes:
            yield frame()
            part, size = [], 0
    if part:
        yield frame()


def map_rows(df: DataFrame, each: Callable[..., Iterable[Any]], schema: str, columns: list[str]) -> DataFrame:
    """The rows that each makes of df's rows, whose columns are its arguments.

    A worker holds READ_ROWS rows and a piece of what they give, whatever its task reads: Spark's own batches have up to 10,000 rows.
    """

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from in_pieces((x for row in zip(*(frame[c] for c in frame.columns)) for x in each(*row)), columns)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", READ_ROWS)
    return df.mapInPandas(made, schema)
