"""Things that a Python worker keeps from one task to the next."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable

import pyarrow as pa

_NAME = "_scanhouse_worker_cache"


def kept(key, make: Callable[[], object]):
    """``make()``, kept while a worker process goes on with tasks of the same key (kernels are
    pickled by value, so their own globals start anew with every task). Another key's thing
    replaces it: a worker that serves several operators holds the memory of one."""
    cache = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__.setdefault("things", {})
    if key not in cache:
        forget()
        cache[key] = make()
    return cache[key]


def forget() -> None:
    """Drop what the worker keeps, for kernels that need its memory and keep nothing, and give the
    memory back to the system: the next operator's workers share the executor's limit."""
    things = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__.setdefault("things", {})
    if things:
        things.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):  # another C library than glibc
            pass
