"""Vectorised scanning of many byte strings at once with numpy.

Texts of an Arrow batch lie in one buffer; the helpers below hash every k-gram
or token of a slice of that buffer in a few array passes, so the cost is some
tens of nanoseconds a byte and memory is bounded by the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class RangeHash:
    """Hashes of arbitrary ranges of a buffer from one prefix sum.

    H[j] = sum of code[b_i] * B^i (mod 2^64) for i < j; the range hash is
    (H[end] - H[start]) * B^-start, which does not depend on the position.
    """

    def __init__(self, seed: int, size: int):
        base = (0x9E3779B97F4A7C15 + (seed << 17)) | 5
        with np.errstate(over="ignore"):
            self.code = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95) + U(seed))
            self.pow = np.full(size + 1, base % 2**64, dtype=U)
            self.pow[0] = 1
            self.pow = np.multiply.accumulate(self.pow)
            self.inv = np.full(size + 1, pow(base, -1, 2**64), dtype=U)
            self.inv[0] = 1
            self.inv = np.multiply.accumulate(self.inv)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf) + 1, dtype=U)
        np.cumsum(self.code[buf] * self.pow[: len(buf)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inv[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.inv[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[p:p+width]) for every p that leaves a whole window."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets) of a binary Arrow column without nulls."""
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind, count=column.offset + len(column) + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off.astype(np.int64)


def slices(off: np.ndarray, overlap: int = 0, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of about ``size`` bytes.

    Yields (lo, hi, rows, starts, ends): bytes lo..hi of the buffer, and the
    rows in it with their borders relative to lo. A row longer than ``size`` is
    cut into pieces that share ``overlap`` bytes.
    """
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > size:
            for lo in range(int(off[i]), int(off[i + 1]), size):
                hi = min(lo + size + overlap, int(off[i + 1]))
                yield lo, hi, np.array([i]), np.array([0]), np.array([hi - lo])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        j = min(j, n)
        lo = int(off[i])
        yield lo, int(off[j]), np.arange(i, j), off[i:j] - lo, off[i + 1 : j + 1] - lo
        i = j
