"""Helpers of the operators that run Python inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from parley.session import ship_package

#: Bytes of text worked on at once inside a task; a longer text is its own slice.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of at most ``limit`` bytes in ``column``,
    so that memory does not grow with a batch of very long texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        ends, start, total = np.cumsum(sizes, dtype=np.int64), 0, 0
        while start < len(sizes):
            end = max(start + 1, int(np.searchsorted(ends, total + limit, side="right")))
            yield batch.slice(start, end - start)
            start, total = end, int(ends[end - 1])


def shared_text(spark: SparkSession, text: str):
    """A broadcast of a file of fixed size (a vocabulary), and the package shipped
    to the Python workers that read it."""
    ship_package(spark)
    return spark.sparkContext.broadcast(text)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after the package has been sent to the Python workers."""
    ship_package(df.sparkSession)
    return df
