"""Elias-Fano coding of a non-decreasing sequence, with select in constant time.

Each value is cut into low bits, stored in a packed array, and a high part, stored in unary in a bit vector. A
directory of ones counted up to every 512th bit, as 32-bit numbers relative to the sequence, finds the i-th one.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512
HEAD = struct.Struct("<QQQB7xQQQ")  # count, base, largest high part, low bits, then bytes of low, high and directory


def encode(values: np.ndarray) -> bytes:
    """Pack non-decreasing unsigned 64-bit values."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    base = int(values[0]) if n else 0
    rest = values - np.uint64(base)
    top = int(rest[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1) if top else 0
    highs = (rest >> np.uint64(low)).astype(np.int64)
    bits = np.zeros(-(-(n + (int(highs[-1]) if n else 0) + 1) // BLOCK) * BLOCK, dtype=np.uint8)
    bits[highs + np.arange(n)] = 1
    directory = np.concatenate([[0], np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))]).astype("<u4")
    lows = b""
    if low:
        grid = (rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows = np.packbits(grid.astype(np.uint8).ravel(), bitorder="little").tobytes()
    high = np.packbits(bits, bitorder="little").tobytes()
    head = HEAD.pack(n, base, int(highs[-1]) if n else 0, low, len(lows), len(high), directory.nbytes)
    return head + lows + high + directory.tobytes()


class EliasFano:
    """Reads what encode() wrote."""

    def __init__(self, blob: bytes):
        self.count, self.base, _, self.low, a, b, c = HEAD.unpack_from(blob)
        at = HEAD.size
        self._lows = np.frombuffer(blob, np.uint8, a, at)
        self._high = np.frombuffer(blob, np.uint8, b, at + a)
        self._directory = np.frombuffer(blob, "<u4", c // 4, at + a + b)
        self.size = at + a + b + c

    def __len__(self) -> int:
        return self.count

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        block = int(np.searchsorted(self._directory, i, side="right")) - 1
        bits = np.unpackbits(self._high[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        place = block * BLOCK + int(np.flatnonzero(bits)[i - int(self._directory[block])])
        return ((place - i) << self.low | self._low(i, i + 1)[0]) + self.base

    def _low(self, start: int, stop: int) -> list[int]:
        if not self.low:
            return [0] * (stop - start)
        first, last = start * self.low // 8, -(-stop * self.low // 8)
        bits = np.unpackbits(self._lows[first:last], bitorder="little")
        skip = start * self.low - first * 8
        grid = bits[skip : skip + (stop - start) * self.low].reshape(-1, self.low).astype(np.uint64)
        return (grid << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).tolist()

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop, decoding only the blocks that hold them."""
        stop = min(stop, self.count)
        if start >= stop:
            return np.zeros(0, dtype=np.uint64)
        a = int(np.searchsorted(self._directory, start, side="right")) - 1
        b = int(np.searchsorted(self._directory, stop - 1, side="right"))
        bits = np.unpackbits(self._high[a * BLOCK // 8 : b * BLOCK // 8], bitorder="little")
        skip = start - int(self._directory[a])
        places = np.flatnonzero(bits)[skip : skip + stop - start] + a * BLOCK
        highs = (places - np.arange(start, stop)).astype(np.uint64)
        return (highs << np.uint64(self.low) | np.array(self._low(start, stop), dtype=np.uint64)) + np.uint64(self.base)
