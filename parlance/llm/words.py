"""Words of byte buffers as 64-bit fingerprints, without a Python object per word."""

from __future__ import annotations

import numpy as np

# Odd multipliers and the seed of the byte table.  Any odd multiplier has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TABLE = _TABLE[_LOWER]

#: Bytes that are hashed at a time; a longer word is taken by itself.
HASH_BYTES = 1 << 20

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for exponents below n; tables beyond HASH_BYTES are not kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, HASH_BYTES + 1 if n > HASH_BYTES // 8 else 1 << 16), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if len(made[0]) <= HASH_BYTES + 1:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread fingerprints over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Everything but ASCII letters and bytes of other scripts.
NO_LETTER = np.array([not (chr(c).isalpha() and c < 128 or c >= 128) for c in range(256)])


def word_spans(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words are runs of bytes other than white space within a row."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    word[:n] = ~space[data]
    starts = word[:n].copy()
    starts[1:] &= ~word[: n - 1] if n else starts[1:]
    inner = bounds[(bounds < n) & (bounds > 0)]
    starts[inner] |= word[inner]
    ends = word[:n] & ~word[1:]
    ends[inner - 1] |= word[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints (ASCII letters lower-cased) of spans in order; some HASH_BYTES at a time, so that a long buffer needs no long tables."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + HASH_BYTES, side="right")))
        part = data[base : int(ends[to - 1])]
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LOWER_TABLE[part] * up, out=sums[1:])
        out[at:to] = mix((sums[ends[at:to] - base] - sums[starts[at:to] - base]) * down[starts[at:to] - base])
        at = to
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of each word, in order."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends = word_spans(data, bounds, space)
    return span_hashes(data, starts, ends), np.searchsorted(bounds, starts, side="right") - 1
