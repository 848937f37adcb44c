"""Vectorised 64-bit hashes of many short byte ranges of one buffer."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U), np.cumprod(np.full(n, base, U))])


class _Powers:
    """Powers of the base and of its inverse, as many as the longest buffer needed."""

    up = down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
        return cls.up, cls.down


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[s:e] for each s, e: a polynomial over random byte values, from prefix sums, mixed with the length."""
    up, down = _Powers.to(len(data))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def slices(offsets: np.ndarray, size: int = 1 << 18):
    """(first, past last) rows of runs of texts of about `size` bytes together, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to
