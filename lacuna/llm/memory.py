"""Memory that a Python worker has freed, given back to the system.

Workers live on between tasks. What a task has freed stays with them in the pools of Arrow and of the C library, beside the
heap of the executor's JVM, so that an idle worker takes as much as its largest task did.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return freed pages of both pools to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: Rows and bytes of an Arrow batch on its way to a worker, which the JVM holds beside its heap; one row may be larger.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session send batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` to workers, unless it has been given numbers of its own."""
    for name, default, own in ((_ROWS, "10000", BATCH_ROWS), (_BYTES, "67108864b", BATCH_BYTES)):
        if spark.conf.get(name) == default:  # Spark's
            spark.conf.set(name, str(own))


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a partition's batches, giving memory back before it starts, after each of its results and at its end."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        give_back()
        for found in work(batches):
            yield found
            del found
            give_back()
        give_back()

    return run
