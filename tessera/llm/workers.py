"""Memory of Python workers, which live on between tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives freed memory back to the system when its
    task ends; allocators keep it otherwise, for as long as the worker idles."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to give back
            pass

    return run
