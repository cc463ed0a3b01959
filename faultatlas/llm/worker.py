"""The object that a Python worker keeps for all tasks of one kind that it runs."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import SparkSession

_STORE = "faultatlas_worker"


def kept(key: Hashable, make: Callable):
    """The object made for ``key``, made once in a worker and dropped when another key is asked for.

    Task code arrives anew with every task; what is registered under a module name
    stays.  Used for caches of bounded size only, so a worker that has run many stages
    holds the cache of one.
    """
    if key not in _store():
        forget()
        _store()[key] = make()
    return _store()[key]


def forget() -> None:
    """Drop what tasks of another kind kept, and give its memory back to the system.

    Called first by tasks that keep nothing: workers run the tasks of all stages, and
    the pages of a dropped cache stay with the process unless it is asked to trim them.
    """
    store = _store()
    if not store:
        return
    store.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system, which allocators otherwise keep for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a system without this call
        pass


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, where what is made of a row is as large as the row; trims behind each of the given ones."""
    for whole in batches:
        for begin in range(0, whole.num_rows, rows):
            yield whole.slice(begin, rows)
        del whole
        trim()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches of the session have at most ``rows`` rows.

    Where rows are whole texts, Spark's default of 10,000 makes one batch of a whole
    file split, which the executor and its worker then hold several times over.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def _store() -> dict:
    return sys.modules.setdefault(_STORE, ModuleType(_STORE)).__dict__.setdefault("kept", {})
