"""Golomb coding of sorted 64-bit hashes and bitmaps over them (numpy, no Spark)."""

from __future__ import annotations

import numpy as np


def _bits(quotients: np.ndarray) -> np.ndarray:
    """Unary code: as many ones as the quotient says, then a zero."""
    bits = np.ones(int(quotients.sum()) + len(quotients), np.uint8)
    bits[np.cumsum(quotients + 1) - 1] = 0
    return np.packbits(bits)


def encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted uint64 values as (bits per remainder, code).

    Gaps are divided by 2**width, the power of two next to 0.69 times their mean, for which
    Golomb's code is shortest. Quotients are coded in unary, remainders in ``width`` bits.
    """
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=values[:1])
    mean = max(1.0, 0.69 * float(values[-1] - values[0]) / len(values))
    width = min(63, int(np.log2(mean)))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    rest = gaps & np.uint64((1 << width) - 1)
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    remainders = np.packbits(((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8))
    head = np.array([len(values), int(quotients.sum())], "<u8").tobytes() + values[:1].astype("<u8").tobytes()
    return width, head + _bits(quotients).tobytes() + remainders.tobytes()


def decode(width: int, code: bytes) -> np.ndarray:
    """The values that ``encode`` was given."""
    if not code:
        return np.zeros(0, np.uint64)
    count, ones = (int(x) for x in np.frombuffer(code, "<u8", 2))
    first = np.frombuffer(code, "<u8", 1, 16)
    raw = np.frombuffer(code, np.uint8, offset=24)
    size = (count + ones + 7) // 8
    zeros = np.flatnonzero(np.unpackbits(raw[:size], count=count + ones) == 0)
    quotients = (np.diff(zeros, prepend=-1) - 1).astype(np.uint64)
    gaps = quotients << np.uint64(width)
    if width:
        bits = np.unpackbits(raw[size:], count=count * width).reshape(count, width)
        for k in range(width):
            gaps |= bits[:, k].astype(np.uint64) << np.uint64(width - 1 - k)
    return first[0] + np.cumsum(gaps, dtype=np.uint64)
