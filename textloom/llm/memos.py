"""Memos of the Python workers. Spark keeps workers across stages, so only the operator at work keeps its memo."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_libc = ctypes.CDLL(None)
_memos: dict[str, list[dict]] = {}


def register(owner: str, *memos: dict) -> None:
    _memos.setdefault(owner, []).extend(memos)


def claim(owner: str) -> None:
    """Called as a task of `owner` begins: what other operators remembered in this worker is let go."""
    for name, memos in _memos.items():
        if name != owner:
            for m in memos:
                m.clear()
    release()


def release() -> None:
    """Memory that is free goes back to the system, as the executor's share is counted with that of its workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
