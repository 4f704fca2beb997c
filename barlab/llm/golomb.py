"""Golomb-Rice coding of sorted integers, vectorised: a unary stream of quotients beside a stream of fixed-width
remainders."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IB")


def encode(values: np.ndarray, span: int) -> bytes:
    """``values``: distinct, ascending, in ``[0, span)``."""
    n = len(values)
    if n == 0:
        return _HEAD.pack(0, 0)
    k = max(0, (span // n).bit_length() - 1)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients) + np.arange(n)
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    unary_bytes = np.packbits(unary).tobytes()
    return _HEAD.pack(n, k) + struct.pack("<I", len(unary_bytes)) + unary_bytes + np.packbits(rest.ravel()).tobytes()


def decode(block: bytes) -> np.ndarray:
    n, k = _HEAD.unpack_from(block)
    if n == 0:
        return np.empty(0, np.uint64)
    (length,) = struct.unpack_from("<I", block, _HEAD.size)
    at = _HEAD.size + 4
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(block, np.uint8, length, at)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(block, np.uint8, offset=at + length), count=n * k).reshape(n, k)
    rest = np.zeros(n, np.uint64)
    for column in range(k):
        rest = (rest << np.uint64(1)) | bits[:, column]
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) | rest, dtype=np.uint64)


def size_of(block: bytes) -> int:
    return _HEAD.unpack_from(block)[0]
