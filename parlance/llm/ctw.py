"""Context-tree weighting over bytes, each byte a path of eight binary decisions.

A node of the tree is a context (the last d bytes, d from 0 to DEPTH) together with a place on
the path through the next byte.  It holds how often the next bit was 0 and 1; its
Krichevsky-Trofimov estimate gives the block probability Pe, and weighting gives
Pw = (Pe + product of the children's Pw) / 2.  A bit is predicted from the deepest context up:
at each node by its own estimate with weight Pe / (Pe + product), else by what came from below.

Grams are packed in 48 bits: the context from its most recent byte to its oldest, then the byte
itself, so that sorted grams list the tree in order.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
_HALF_LOG = float(np.log(0.5))


def pad(data: np.ndarray, bounds: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with ``depth`` zeros before each and an end mark, a zero, after it; places of the symbols, and their rows."""
    lengths = np.diff(bounds)
    rows = len(lengths)
    shift = np.arange(rows) * (depth + 1)
    out = np.zeros(len(data) + rows * (depth + 1), np.uint8)
    row = np.repeat(np.arange(rows), lengths)
    place = np.arange(len(data)) + shift[row] + depth
    out[place] = data
    symbols = np.ones(len(out), bool)
    begin = bounds[:-1] + shift
    for k in range(depth):
        symbols[begin + k] = False
    return out, np.flatnonzero(symbols), np.repeat(np.arange(rows), lengths + 1)


def grams(padded: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The packed gram of the symbol at each place."""
    n = len(padded)
    key = np.zeros(n, np.uint64)
    for back in range(1, depth + 1):
        key[depth:] = (key[depth:] << np.uint64(8)) | padded[depth - back : n - back]
    key = (key << np.uint64(8)) | padded
    return key[at]


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their weights (or their number)."""
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1.0
    inv = 1.0 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv / 1260)) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - float(np.log(np.pi))


class Level:
    """The nodes of one depth: keys (context, place on the path), counts and the weight of the own estimate."""

    def __init__(self, grams_: np.ndarray, counts: np.ndarray, below: Level | None):
        keys, zeros, ones = [], [], []
        for bit in range(8):
            group = grams_ >> np.uint64(8 - bit)
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            one = counts * ((grams_ >> np.uint64(7 - bit)) & np.uint64(1))
            total = np.add.reduceat(counts, first) if len(first) else counts[:0]
            upper = np.add.reduceat(one, first) if len(first) else counts[:0]
            byte = (grams_[first] & np.uint64(255)) >> np.uint64(8 - bit)
            keys.append((grams_[first] & ~np.uint64(255)) | np.uint64(1 << bit) | byte)
            zeros.append(total - upper), ones.append(upper)
        self.keys = np.concatenate(keys)
        order = np.argsort(self.keys)
        self.keys, self.zeros, self.ones = self.keys[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]
        self.pw, self.weight = log_kt(self.zeros, self.ones), np.ones(len(self.keys))
        if below is not None:
            self.weigh(*below.products())

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """The nodes above, and for each the logarithm of the product of what its children here have."""
        parent = ((self.keys >> np.uint64(16)) << np.uint64(8)) | (self.keys & np.uint64(255))
        nodes, at = np.unique(parent, return_inverse=True)
        return nodes, np.bincount(at, weights=self.pw, minlength=len(nodes))

    def weigh(self, nodes: np.ndarray, products: np.ndarray) -> None:
        """Mix each node's own estimate with the product of its children."""
        own, product = self.pw, np.zeros(len(self.keys))
        product[np.searchsorted(self.keys, nodes)] = products
        self.pw = _HALF_LOG + np.logaddexp(own, product)
        self.weight = 1.0 / (1.0 + np.exp(np.clip(product - own, -700, 700)))

    def step(self, node: np.ndarray, bit: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Mix p, which came from below, with the estimate of each node; p stays where there is none."""
        if not len(self.keys):
            return p
        at = np.minimum(np.searchsorted(self.keys, node), len(self.keys) - 1)
        found = self.keys[at] == node
        own = (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)
        return np.where(found, self.weight[at] * own + (1.0 - self.weight[at]) * p, p)


class Tree:
    """Levels from ``depth`` up to ``top``, of packed grams with a context of ``depth`` bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.depth, self.top, self.levels = depth, top, {}
        seen = counts > 0
        keys, counts = keys[seen], counts[seen].astype(np.float64)
        below = None
        for d in range(depth, top - 1, -1):
            cut = np.uint64(8 * (depth - d))
            short = (((keys >> np.uint64(8)) >> cut) << np.uint64(8)) | (keys & np.uint64(255))
            level, total = (short, counts) if d == depth else counted(short, counts)
            below = self.levels[d] = Level(level, total, below)

    @classmethod
    def above(cls, keys: np.ndarray, counts: np.ndarray, nodes: np.ndarray, products: np.ndarray) -> Tree:
        """The levels from the grams' depth, that of one byte of context, up to the root; their children's products come from elsewhere."""
        tree = cls(keys[:0], counts[:0], 1, 0)
        lower = Level(keys, counts.astype(np.float64), None)
        lower.weigh(nodes, products)
        short, total = counted(keys & np.uint64(255), counts.astype(np.float64))
        tree.levels = {1: lower, 0: Level(short, total, lower)}
        return tree

    def log10(self, keys: np.ndarray, above: Tree | None = None) -> np.ndarray:
        """log10 of the probability of the byte of each gram in its context."""
        out = np.zeros(len(keys))
        context, byte = keys >> np.uint64(8), keys & np.uint64(255)
        for place in range(8):
            path = np.uint64(1 << place) | (byte >> np.uint64(8 - place))
            bit = ((byte >> np.uint64(7 - place)) & np.uint64(1)).astype(bool)
            p = np.full(len(keys), 0.5)
            for d in range(self.depth, -1, -1):
                levels = self.levels if d >= self.top else above.levels if above is not None else {}
                if d in levels:
                    p = levels[d].step(((context >> np.uint64(8 * (self.depth - d))) << np.uint64(8)) | path, bit, p)
            out += np.log10(p)
        return out
