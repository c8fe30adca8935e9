"""Bit fields, most significant bit first."""

from __future__ import annotations

import numpy as np


def pack(values: list[int] | np.ndarray, widths: list[int] | np.ndarray) -> bytes:
    """Fields of the given widths (0 to 64 bits), one after another, padded to whole bytes."""
    width = np.asarray(widths, np.int64)
    value = np.array(values, np.uint64)
    at = np.repeat(np.arange(len(width)), width)
    place = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
    return np.packbits(((value[at] >> (width[at] - 1 - place).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes()


def unpack(data: bytes, width: int, count: int, start: int = 0) -> np.ndarray:
    """``count`` fields of one width from bit ``start``."""
    if not width:
        return np.zeros(count, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=start + width * count)[start:].reshape(count, width)
    out = np.zeros(count, np.uint64)
    for k in range(width):
        out = out << np.uint64(1) | bits[:, k].astype(np.uint64)
    return out


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + bytes(8), 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        out = int.from_bytes(self.data[first:last], "big") >> ((last << 3) - self.at - n) & (1 << n) - 1
        self.at += n
        return out


class Writer:
    """Collects fields for ``pack``."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.widths: list[int] = []

    def put(self, value: int, width: int) -> None:
        self.values.append(value)
        self.widths.append(width)

    def done(self) -> bytes:
        return pack(self.values, self.widths)


def leading(x: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit integers; 64 for 0."""
    out, x = np.zeros(len(x), np.int64), x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = x < np.uint64(1) << np.uint64(64 - step)
        out += low * step
        x = np.where(low, x << np.uint64(step), x)
    return np.where(x == 0, 64, out)


def trailing(x: np.ndarray) -> np.ndarray:
    """Trailing zeros of 64-bit integers; 64 for 0."""
    return np.where(x == 0, 64, 63 - leading(x & (~x + np.uint64(1))))
