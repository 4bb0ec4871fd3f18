"""Suffix arrays by the difference-cover algorithm, on whole arrays at a time.

The suffixes at places 1 and 2 modulo 3 are the sample.  Their triples are sorted and named; if
names repeat, the names are a shorter text whose suffix array, found in the same way, orders the
sample.  The remaining suffixes are ordered by their first symbol and the sample suffix behind
it, and both orders are merged: a sample suffix at place 1 is compared by one symbol and a rank,
one at place 2 by two symbols and a rank, so either class is a sorted list of numbers.
"""

from __future__ import annotations

import numpy as np


def ordered(keys: np.ndarray, size: int) -> np.ndarray:
    """Order of numbers from 0 to below ``size``, equal ones by place where both fit one number: sorting numbers with their places beats sorting places."""
    bits = max(1, len(keys) - 1).bit_length()
    if size << bits < 1 << 63:
        return np.sort((keys << bits) | np.arange(len(keys))) & ((1 << bits) - 1)
    return np.argsort(keys, kind="stable")


def _named(first: np.ndarray, second: np.ndarray, third: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the triples, and their names (from 1, equal for equal triples)."""
    if size**3 < 1 << 62:
        key, most = (first * size + second) * size + third, size**3
    else:
        values, pair = np.unique(first * size + second, return_inverse=True)
        key, most = pair * size + third, len(values) * size
    order = ordered(key, most)
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(np.r_[1, key[order][1:] != key[order][:-1]]) if len(key) else 0
    return order, names


def suffix_array(text: np.ndarray, depth: int = 1 << 62, covered: int = 1) -> np.ndarray:
    """Places of the suffixes in order.  Symbols are positive numbers.

    With ``depth``, only the first ``depth`` symbols count: naming stops once names cover as
    many, and suffixes that agree in them stand together in any order.
    """
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    size = int(text.max()) + 1
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order, names = _named(s[sample], s[sample + 1], s[sample + 2], size)
    covered *= 3
    if names.max() < len(sample) and covered < depth:
        order = suffix_array(names, depth, covered)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    span = len(sample) + 2
    zero = np.arange(0, n, 3)
    zero = zero[ordered(s[zero] * span + rank[zero + 1], size * span)]
    sample = sample[order]
    sample = sample[sample < n]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    if size * size * span < 1 << 62:
        pair, pair_at = s[second] * size + s[second + 1], s[zero] * size + s[zero + 1]
    else:
        both = np.concatenate([s[second] * size + s[second + 1], s[zero] * size + s[zero + 1]])
        both = np.unique(both, return_inverse=True)[1]
        pair, pair_at = both[: len(second)], both[len(second) :]
    # Suffixes that agree to the depth may stand in any order, so the lists are sorted already but for them.
    ahead = np.searchsorted(np.sort(s[first] * span + rank[first + 1]), s[zero] * span + rank[zero + 1])
    ahead += np.searchsorted(np.sort(pair * span + rank[second + 2]), pair_at * span + rank[zero + 2])
    ahead = np.maximum.accumulate(ahead)
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + ahead
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sample
    return out
