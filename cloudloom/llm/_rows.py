"""How operators hand rows to Python: packed in a struct, the text once, and memory given back after each task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame, keep: list[str] | None) -> DataFrame:
    """``row``, the struct of the columns ``keep``, and ``t``, the text; all columns by default, and then the text is in ``row`` only."""
    return docs.select(F.struct("*").alias("row")) if keep is None else docs.select(F.struct(*keep).alias("row"), F.col("text").alias("t"))


def texts(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of ``packed`` rows."""
    return batch.column(1) if batch.num_columns > 1 else batch.column(0).field("text")


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, with what a task has freed given back to the system: workers outlive their tasks, and keep it otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a libc without it
                pass

    return run
