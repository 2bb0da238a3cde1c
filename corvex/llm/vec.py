"""Vectorised hashing of words and windows over bytes (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KEPT_POWERS = 1 << 21
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; kept up to KEPT_POWERS, computed anew for a longer text."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            out = np.full(max(1 << 16, 1 << (n - 1).bit_length()) if n <= KEPT_POWERS else n, U(base))
            out[0] = 1
            made.append(np.multiply.accumulate(out, out=out))
        if n > KEPT_POWERS:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(a: np.ndarray) -> np.ndarray:
    p, _ = powers(len(a) + 1)
    out = np.zeros(len(a) + 1, U)
    np.cumsum((a.astype(U) + U(1)) * p[: len(a)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of a[start:end]; equal bytes have equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


class Words:
    """Words (runs of anything but `[\\x20\\x09-\\x0D]`) of several texts, or runs between other `signs`: starts, ends, text number and hash of each."""

    def __init__(self, texts: list[bytes], lower: bool = True, signs: np.ndarray = IS_WHITE):
        self.bytes = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        white = signs[self.bytes]
        self.starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        self.ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.firsts = 1 + np.cumsum(sizes) - sizes  # where each text starts in bytes
        self.doc = np.searchsorted(self.firsts, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))
        self.hashes = span_hashes(prefix_sums(self.bytes), self.starts, self.ends)
