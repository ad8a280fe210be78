"""Arrow batches of texts as flat byte arrays, shared by the operators.

All functions take texts as UTF-8; a null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolith.shipping import ship

#: Rows and bytes that one Arrow batch holds at most; the second bounds long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: What a worker process does after each task.
AT_TASK_END: list = []


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the lengths of the texts, and let executors import the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that the allocators hold to the system, so that idle workers stay small."""
    for f in AT_TASK_END:
        f()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def returned(function, *values):
    """``function(*values)``, after which unused memory goes back."""
    try:
        return function(*values)
    finally:
        give_back()


def map_batches(df: DataFrame, function, fields: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` over bounded batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    work.__name__ = work.__qualname__ = function.__name__
    bound_batches(df.sparkSession)
    return df.mapInArrow(work, T.StructType(fields))


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    return T.StructField(name or column, df.schema[column].dataType)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; everything else in ``df`` is ignored."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and len + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, or one longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = end


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))
