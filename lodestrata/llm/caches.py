"""What a Python worker keeps between tasks: the caches of one operator at a time.

Spark reuses its workers, so a pipeline's stages meet in the same processes.  An operator that asks for its
own cache makes the worker let go of the others' and hand their memory back.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_held: dict[str, object] = {}


def claim(key: str, make: Callable[[], T]) -> T:
    """The value kept under ``key``; where it isn't there, it is made and everything else goes."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass
        _held[key] = make()
    return _held[key]
