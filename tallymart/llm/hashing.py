"""Vectorised Rabin-Karp hashes over the bytes of texts, modulo 2^64.

A prefix sum of byte * base^position gives the hash of any span in two
look-ups; multiplying by base^-start makes it independent of the place.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
SECOND = 0xC2B2AE3D27D4EB4F
SLICE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept per worker."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(1 << max(10, int(n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over all 64 (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """prefix[i]: sum of values[j] * base^j over j < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end], from prefix()."""
    inverse = powers(pow(base, -1, 1 << 64), len(sums))
    return (sums[ends] - sums[starts]) * inverse[starts]


_space = np.zeros(256, bool)
_space[list(SPACES)] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^ \\t-\\r]+ in bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_space[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each word; long data goes slice by slice to bound memory."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE, "right")))
        low, high = starts[first], ends[last - 1]
        sums = prefix(data[low:high].astype(np.uint64) + np.uint64(1), base)
        out[first:last] = spans(sums, starts[first:last] - low, ends[first:last] - low, base)
        out[first:last] += (ends[first:last] - starts[first:last]).astype(np.uint64) * np.uint64(SECOND)
        first = last
    return mix(out)


def window_hashes(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Rolling hash of every `width` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mix(spans(prefix(words, base), at, at + width, base))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
