"""What a Python worker has freed goes back to the machine, as the next stage's tasks run in the same worker."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import cache

import pyarrow as pa


@cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def release() -> None:
    """Hand freed memory of Arrow and of the C library back; results don't depend on it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(make):
    """The batch function `make`, giving memory back when a task has read its last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(batches)
        gc.collect()
        release()

    return run
