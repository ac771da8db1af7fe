"""Memory of Python workers, which stay beside their executor from one task to the next."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch of texts: both the executor and its worker hold whole batches.
BATCH_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def hand_back() -> None:
    """Give memory that is no longer used to the system, as later tasks may need it in the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for `mapInArrow`, handing back memory when its task ends."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return task


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Jobs run inside get Arrow batches of at most about `size` bytes, or one row; results are the same."""
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SETTING)
        else:
            spark.conf.set(_SETTING, before)
