"""The fingerprint exchange that several operators share: senders cut sorted distinct fingerprints into one Golomb-coded
block for each owner of a range; an owner answers every block with bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import golomb


def span_of(bits: int, owners: int) -> int:
    """Fingerprints of ``bits`` bits in one owner's range."""
    return -(-(1 << bits) // owners)


def by_owner(prints: np.ndarray, span: int) -> Iterator[tuple[int, int, int]]:
    """Of ascending fingerprints: each owner and its slice."""
    owner_of = (prints // np.uint64(span)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner_of, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(prints)]):
        yield int(owner_of[a]), int(a), int(b)


def coded(prints: np.ndarray, owner: int, span: int) -> bytes:
    """One owner's ascending fingerprints as a block."""
    return golomb.encode(prints - np.uint64(owner * span), span)


def decoded(block: bytes, owner: int, span: int) -> np.ndarray:
    return golomb.decode(block) + np.uint64(owner * span)


def size_of(block: bytes) -> int:
    """Fingerprints in a block."""
    return golomb.size_of(block)


def sums_over_blocks(blocks: list[bytes], weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each fingerprint of each block, the sum of its weights in all of them (one weight a fingerprint)."""
    lists = [golomb.decode(b) for b in blocks]
    _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(inverse, np.concatenate(weights))[inverse]
    return np.split(totals, np.cumsum([len(x) for x in lists])[:-1])


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
