"""Arrow batches in Python workers, a few rows at a time."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch that are Python objects at once; these take several times as many.
SLICE = 1 << 20

#: Bytes of a batch that Spark sends where the work is done at once; a worker holds two of them.
BATCH = 4 << 20

_MOST = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small(spark: SparkSession, size: int | None = None) -> Iterator[None]:
    """What is run inside, and not only planned, gets batches of at most size bytes, or of one row; the session's setting comes back."""
    before = spark.conf.get(_MOST, None) if _MOST in spark.conf.getAll else None
    spark.conf.set(_MOST, str(size or BATCH))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_MOST)
        else:
            spark.conf.set(_MOST, before)


def _cut(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    if len(batch) <= 1 or batch.nbytes <= size:
        yield batch
    else:
        half = len(batch) // 2
        yield from _cut(batch.slice(0, half), size)
        yield from _cut(batch.slice(half), size)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in their order, in batches of at most size bytes, or of one row that has more.

    Spark by itself fills batches with 10,000 rows and up to 64 MB.  Their memory goes back to the system after
    each and at the end, as workers wait for other tasks.
    """
    for batch in batches:
        yield from _cut(batch, size)
        large = batch.nbytes > size
        del batch
        if large:
            release()
    release()


@functools.lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
