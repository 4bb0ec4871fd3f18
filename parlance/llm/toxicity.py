"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as words (runs of letters, those beyond WORD_BYTES cut between characters), in
overlapping windows that together cover all of it.  Each word enters as the sum of a hashed word embedding and the mean of its hashed character
trigrams' embeddings; a GRU reads each window in either direction, attention pools its states,
and a linear layer gives the window's logit.  A text is as toxic as its most toxic window; the
logit of that window is scaled to a probability on the training texts.

Labels are of texts, not windows: the first round takes every window of a toxic text as toxic
with little weight, later rounds only those the network itself finds most toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.frames import documents, flat, slices
from parlance.llm.words import NO_LETTER, span_hashes, word_spans

WINDOW, STRIDE = 32, 16
WORD_BUCKETS, CHAR_BUCKETS, EMBED, HIDDEN = 1 << 14, 1 << 11, 12, 8
#: Longer runs of letters, as in scripts without spaces, are cut into words of about so many bytes.
WORD_BYTES = 24
#: About how many toxic and how many other labelled documents are learned from, with all their windows.
TRAIN_TOXIC, TRAIN_OTHER = 1200, 2400
#: One document in so many is not trained on; they tell how large a logit is toxic.
SCALE_PART = 4
#: Windows of a step; fewer where a round would have less than so many steps.
ROUNDS, BATCH, STEPS = 3, 512, 40
#: Text, in bytes, that is scored at a time.
SCORE_BYTES = 1 << 19

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


class Words:
    """Distinct words of a buffer: word bucket, trigram buckets (padded with -1), and which word stands where."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        starts, ends = _cut_runs(data, *word_spans(data, bounds, NO_LETTER)) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.row = np.searchsorted(bounds, starts, side="right") - 1
        hashes, first, self.at = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.word = (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
        start, length = starts[first], ends[first] - starts[first]
        place = np.arange(-1, WORD_BYTES + 4)
        inside = (place >= 0) & (place < length[:, None])
        chars = np.where(inside, _FOLD[data[np.where(inside, start[:, None] + place, 0)]] if len(data) else 0, np.uint32(1)).astype(np.uint32)
        key = (chars[:, :-2] * np.uint32(0x1003F) + chars[:, 1:-1] * np.uint32(0x3FD)) + chars[:, 2:]
        self.chars = (((key * np.uint32(2654435761)) >> np.uint32(21)) % np.uint32(CHAR_BUCKETS)).astype(np.int16)
        self.has = place[1:-1] < length[:, None]


def _cut_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of at most WORD_BYTES + 3 bytes: longer ones are cut behind every WORD_BYTES, not within a character."""
    pieces = (ends - starts - 1) // WORD_BYTES
    if not pieces.any():
        return starts, ends
    run = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
    cut = starts[run] + nth * WORD_BYTES
    for _ in range(3):
        cut += (cut < ends[run]) & ((data[np.minimum(cut, len(data) - 1)] & 0xC0) == 0x80)
    cut = cut[cut < ends[run]]
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


def _summed(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers of ``at``, sorted, and the sums of their rows."""
    order = np.argsort(at, kind="stable")
    ordered = at[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


def windows(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (in words) of all windows, and the row of each, as an array of three columns; rows without words have none."""
    begin = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(begin)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    of = np.repeat(np.arange(rows), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[of] + k * STRIDE
    return np.stack([start, np.minimum(start + WINDOW, begin[of + 1])], axis=1), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 8):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": draw(WORD_BUCKETS, e, scale=0.1), "char": draw(CHAR_BUCKETS, e, scale=0.1),
            "W": draw(e, 6 * h, scale=e**-0.5), "b": np.zeros(6 * h, np.float32),
            "U0": draw(h, 3 * h, scale=h**-0.5), "U1": draw(h, 3 * h, scale=h**-0.5),
            "A": draw(2 * h, h, scale=(2 * h) ** -0.5), "v": draw(h, scale=h**-0.5),
            "w": draw(2 * h, scale=(2 * h) ** -0.5), "c": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.prior = 1.0, 0.0, 0.0
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.steps = 0

    def inputs(self, words: Words) -> np.ndarray:
        """Gate inputs of each distinct word for both directions."""
        x = self.embed(words)
        return x @ self.p["W"] + self.p["b"]

    def embed(self, words: Words) -> np.ndarray:
        n = np.maximum(words.has.sum(axis=1), 1).astype(np.float32)
        chars = np.zeros((len(words.word), EMBED), np.float32)
        for k in range(words.chars.shape[1]):
            some = np.flatnonzero(words.has[:, k])
            chars[some] += self.p["char"][words.chars[some, k]]
        return self.p["word"][words.word] + chars / n[:, None]

    @staticmethod
    def _read(gates: np.ndarray, mask: np.ndarray, U: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
        """States of one direction: gates is [window, step, 3 h]."""
        n, steps, _ = gates.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            g, u = gates[:, t], h @ U
            zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = np.where(m, c + z * (h - c), h)
            if keep is not None:
                keep.append((t, h, z, r, c, u, m))
            h = out[:, t] = new
        return out

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; gates is [window, step, 6 h]."""
        tape0, tape1 = ([], []) if keep is not None else (None, None)
        states = np.concatenate(
            [self._read(gates[:, :, : 3 * HIDDEN], mask, self.p["U0"], False, tape0), self._read(gates[:, :, 3 * HIDDEN :], mask, self.p["U1"], True, tape1)], axis=2
        )
        hidden = np.tanh(states @ self.p["A"])
        weight = np.where(mask, hidden @ self.p["v"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        if keep is not None:
            keep.update(states=states, hidden=hidden, weight=weight, pooled=pooled, tape0=tape0, tape1=tape1, mask=mask)
        return pooled @ self.p["w"] + self.p["c"][0]

    def backward(self, d: np.ndarray, keep: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the gate inputs, for the gradient of the logits."""
        p, g = self.p, {}
        states, hidden, weight = keep["states"], keep["hidden"], keep["weight"]
        g["w"], g["c"] = keep["pooled"].T @ d, np.array([d.sum()], np.float32)
        dpooled = d[:, None] * p["w"]
        dstates = weight[:, :, None] * dpooled[:, None, :]
        dweight = np.einsum("nh,nth->nt", dpooled, states)
        dscore = weight * (dweight - (dweight * weight).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,nth->h", dscore, hidden)
        dpre = dscore[:, :, None] * p["v"] * (1 - hidden * hidden)
        g["A"] = np.einsum("nth,ntk->hk", states, dpre)
        dstates += dpre @ p["A"].T
        dgates = np.zeros((*states.shape[:2], 6 * HIDDEN), np.float32)
        for name, at, tape in (("U0", 0, keep["tape0"]), ("U1", 1, keep["tape1"])):
            U, dU, dh = p[name], np.zeros_like(p[name]), np.zeros((len(d), HIDDEN), np.float32)
            for t, h, z, r, c, u, m in reversed(tape):
                dnew = dh + dstates[:, t, at * HIDDEN : (at + 1) * HIDDEN]
                on = dnew * m
                dc = on * (1 - z) * (1 - c * c)
                dz = on * (h - c) * z * (1 - z)
                dr = dc * u[:, 2 * HIDDEN :] * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dU += h.T @ du
                dgates[:, t, 3 * HIDDEN * at : 3 * HIDDEN * (at + 1)] = np.concatenate([dz, dr, dc], axis=1)
                dh = dnew * ~m + on * z + du @ U.T
            g[name] = dU
        return g, dgates

    def update(self, name: str, grad: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        """A step of Adam, on some rows of an embedding only if they are given."""
        m, v = self.moments.setdefault(name, (np.zeros_like(self.p[name]), np.zeros_like(self.p[name])))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad * grad
        self.p[name][at] -= rate * (m[at] / (1 - 0.9**self.steps)) / (np.sqrt(v[at] / (1 - 0.999**self.steps)) + 1e-8)

    def logits(self, words: Words, spans: np.ndarray) -> np.ndarray:
        gates, out = self.inputs(words), []
        for k in range(0, len(spans), 4096):
            some = spans[k : k + 4096]
            place, mask = _places(some)
            out.append(self.forward(gates[words.at[place]], mask))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each row, and its number of windows."""
        rows = len(bounds) - 1
        words = Words(data, bounds)
        spans, of = windows(words.row, rows)
        top = np.full(rows, -np.inf)
        np.maximum.at(top, of, self.logits(words, spans).astype(np.float64))
        count = np.bincount(of, minlength=rows)
        return np.where(count > 0, _sigmoid(np.where(count > 0, self.scale * np.where(count > 0, top, 0.0) + self.shift, 0.0)), self.prior), count


def _places(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = spans[:, :1] + np.arange(WINDOW)
    mask = place < spans[:, 1:]
    return np.where(mask, place, spans[:, :1]), mask


def fit(data: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 8) -> Network:
    """A network trained on the texts of a buffer, but for every SCALE_PART-th, on which its logit is scaled; ``weights`` restore the shares of the labels there."""
    net, rng = Network(seed), np.random.default_rng(seed)
    rows = len(bounds) - 1
    if not rows:
        return net
    words = Words(data, bounds)
    spans, of = windows(words.row, rows)
    net.prior = float((labels * weights).sum() / weights.sum())
    toxic = labels[of].astype(np.float32)
    aside = np.arange(rows) % SCALE_PART == SCALE_PART - 1
    if len(set(labels[aside])) < 2 or len(set(labels[~aside])) < 2:
        aside[:] = False
    for turn in range(ROUNDS):
        weight = np.where(toxic > 0, 0.3 if turn == 0 else 0.0, 1.0).astype(np.float32)
        if turn:
            order = np.lexsort((-net.logits(words, spans), of))
            place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
            best = order[place < 2]
            weight[best[toxic[best] > 0]] = 1.0
        some = np.flatnonzero((weight > 0) & ~aside[of])
        some = some[rng.permutation(len(some))]
        size = min(BATCH, max(32, len(some) // STEPS))
        for k in range(0, len(some), size):
            batch = some[k : k + size]
            net.steps += 1
            place, mask = _places(spans[batch])
            which, inverse = np.unique(words.at[place], return_inverse=True)
            part = _part(words, which)
            x = net.embed(part)
            gates = x @ net.p["W"] + net.p["b"]
            keep: dict = {}
            logit = net.forward(gates[inverse.reshape(place.shape)], mask, keep)
            d = (weight[batch] * (_sigmoid(logit) - toxic[batch]) / len(batch)).astype(np.float32)
            grads, dgates = net.backward(d, keep)
            dword = _summed(dgates.reshape(-1, 6 * HIDDEN) * mask.reshape(-1, 1), inverse.ravel())[1]
            grads["W"], grads["b"] = x.T @ dword, dword.sum(axis=0)
            dx = dword @ net.p["W"].T
            for name, value in grads.items():
                net.update(name, value, 0.005)
            held, total = _summed(dx, part.word)
            net.update("word", total, 0.02, held)
            share = dx / np.maximum(part.has.sum(axis=1), 1)[:, None]
            where = np.nonzero(part.has)
            held, total = _summed(share[where[0]], part.chars[where])
            net.update("char", total, 0.01, held)
    top = np.full(rows, -np.inf)
    np.maximum.at(top, of, net.logits(words, spans))
    some = np.isfinite(top) & (aside if aside.any() else True)
    net.scale, net.shift = _scaled(top[some], labels[some], weights[some])
    return net


def _part(words: Words, which: np.ndarray) -> Words:
    part = object.__new__(Words)
    part.word, part.chars, part.has = words.word[which], words.chars[which], words.has[which]
    return part


def _scaled(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logit that make the labels likeliest, by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        e, s = weights * (p - y), weights * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(e * x).sum() + 1e-2 * (a - 1.0), e.sum() + 1e-3 * b])
        hess = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.05), b


def learn(docs: DataFrame, labels: DataFrame, held_out) -> Network:
    """A network trained on about TRAIN_TOXIC and TRAIN_OTHER labelled documents, chosen by a hash of doc_id, for which ``held_out`` doesn't hold.

    Null labels are left out; of several labels for a document the largest counts.  Without
    toxic or without other documents the network stays as it was drawn.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {bool(r["t"]): r["n"] for r in marked.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        net = Network()
        net.shift, net.prior = (5.0, 1.0) if sizes.get(True) else (-5.0, 0.0)
        net.scale = 0.0
        return net
    shares = {t: min(1.0, most / sizes[t]) for t, most in ((True, TRAIN_TOXIC), (False, TRAIN_OTHER))}
    place = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000))
    chosen = marked.where(place < F.when(F.col("toxic") > 0, int(1e6 * shares[True])).otherwise(int(1e6 * shares[False])))
    rows = documents(docs).join(chosen, "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    y = (rows.column("toxic").to_numpy() > 0).astype(np.float64)
    return fit(*flat(rows.column("text")), y, np.where(y > 0, 1 / shares[True], 1 / shares[False]))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score, predicted and n_windows for every row of docs.

    Null, empty and letterless texts have no window and get the share of toxic training texts;
    repeated rows each give a row, rows without a doc_id too; an empty table gives an empty result.
    """
    net.moments = {}
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            data, bounds = flat(batch.column("text"))
            parts = [network.scores(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in slices(bounds, SCORE_BYTES)]
            value = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0)
            count = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32)), pa.array(count, pa.int64())], names=["doc_id", "score", "predicted", "n_windows"])

    return documents(docs, unnamed=True).mapInArrow(run, "doc_id long, score double, predicted int, n_windows long")
