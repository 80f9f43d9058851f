"""Memory of Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa

_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Hand memory that a finished task has freed back to the system: its worker stays, beside stages that need the memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
