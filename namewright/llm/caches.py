"""What Python workers remember between tasks: of one operator at a time, as Spark uses a worker for one stage after another."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_OWNER: list[str] = [""]
_FORGET: dict[str, Callable[[], None]] = {}


def register(owner: str, forget: Callable[[], None]) -> None:
    _FORGET[owner] = forget


def take(owner: str) -> None:
    """From now on ``owner`` remembers; what others have remembered is dropped, and its memory goes back to the system."""
    if _OWNER[0] == owner:
        return
    _OWNER[0] = owner
    for name, forget in _FORGET.items():
        if name != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of rows whose sizes add up to ``most`` at most; a larger row is a run of its own."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)
