"""Small bit-level helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.session import shuffles_freed

FILTER_BITS = 26


def rice_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of sorted distinct unsigned 64-bit values.

    The gaps are written as a unary quotient stream and a stream of fixed-width remainders. Header:
    first value (8 bytes), count (4), remainder width (1), bytes of the quotient stream (4).
    """
    count = len(values)
    if count == 0:
        return b""
    gaps = np.diff(values) - np.uint64(1)
    mean = float(gaps.astype(np.float64).mean()) if count > 1 else 0.0
    width = max(0, int(np.log2(mean))) if mean >= 1 else 0
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if count > 1 else 0, np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    packed = np.packbits(unary).tobytes()
    head = int(values[0]).to_bytes(8, "big") + count.to_bytes(4, "big") + bytes([width]) + len(packed).to_bytes(4, "big")
    return head + packed + np.packbits(remainders).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    """The values of :func:`rice_encode`."""
    if not blob:
        return np.zeros(0, np.uint64)
    first, count = int.from_bytes(blob[:8], "big"), int.from_bytes(blob[8:12], "big")
    width, size = blob[12], int.from_bytes(blob[13:17], "big")
    out = np.empty(count, np.uint64)
    out[0] = first
    if count > 1:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 17)))
        quotients = np.diff(ones[: count - 1], prepend=-1) - 1
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=17 + size), count=(count - 1) * width)
        weights = np.uint64(1) << np.arange(width - 1, -1, -1, dtype=np.uint64)
        remainders = (bits.reshape(count - 1, width).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        gaps = (quotients.astype(np.uint64) << np.uint64(width)) + remainders + np.uint64(1)
        out[1:] = np.uint64(first) + np.cumsum(gaps)
    return out


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A filter of ``2 ** FILTER_BITS`` bits over 64-bit hashes, as an array of 64-bit words.

    Its size is fixed (8 MiB), whatever the input, so it may be sent to every task. The words are
    or-ed in Spark; what reaches the driver is at most ``2 ** (FILTER_BITS - 6)`` rows. A set bit
    only says "maybe": who uses the filter must check what passes it.
    """
    with shuffles_freed(hashes.sparkSession):
        words = (
            hashes.select(F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS).alias("index"))
            .select(
                F.expr("cast(shiftright(index, 6) as int)").alias("word"),
                F.expr("shiftleft(1L, cast(index & 63 as int))").alias("bit"),
            )
            .groupBy("word")
            .agg(F.expr("bit_or(bit)").alias("bits"))
            .toArrow()
        )
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit hashes may be in the filter."""
    index = hashes >> np.uint64(64 - FILTER_BITS)
    return (words[(index >> np.uint64(6)).astype(np.int64)] >> (index & np.uint64(63))) & np.uint64(1) == 1
