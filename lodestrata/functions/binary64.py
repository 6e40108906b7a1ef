"""The bits of doubles: sixteen hexadecimal digits, the way back, and a key whose text order is the doubles' order."""

from __future__ import annotations

import re
import struct

import numpy as np

_DIGITS = re.compile(r"[0-9a-f]{16}")
_SIGN = 1 << 63


def to_hex(v: float | None) -> str | None:
    return None if v is None else struct.pack(">d", v).hex()


def from_hex(digits: str | None) -> float | None:
    if digits is None:
        return None
    if not _DIGITS.fullmatch(digits):
        raise ValueError(f"{digits!r} is not sixteen lower-case hexadecimal digits")
    return struct.unpack(">d", bytes.fromhex(digits))[0]


def order_key(v: float | None) -> str | None:
    """Negative numbers with all bits turned, others with the sign turned; both zeros have one key."""
    if v is None:
        return None
    bits = int.from_bytes(struct.pack(">d", v or 0.0))
    return f"{bits ^ (2 * _SIGN - 1 if bits & _SIGN else _SIGN):016x}"


def bits_of(values: np.ndarray) -> np.ndarray:
    """The bits of many doubles as 64-bit integers."""
    return np.ascontiguousarray(values, "<f8").view("<i8")


def of_bits(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bits, "<i8").view("<f8")
