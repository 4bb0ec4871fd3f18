"""Alignment of token sequences, one pair of sequences to a row, in Arrow batches."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_OPS = pa.list_(pa.struct([("tag", pa.string()), ("i1", pa.int32()), ("i2", pa.int32()), ("j1", pa.int32()), ("j2", pa.int32())]))
_OPS_SQL = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"


def _numbered(ref: list[str], hyp: list[str], kind) -> tuple[np.ndarray, np.ndarray]:
    names = {t: k for k, t in enumerate(dict.fromkeys([*ref, *hyp]))}
    return np.array([names[t] for t in ref], kind), np.array([names[t] for t in hyp], kind)


#: Cells of two short sequences, of which all rows are kept, and bytes of rows' matches that are kept for the next row of the same token.
SMALL, MATCHES = 1 << 20, 1 << 26


def parts(batches: Iterable[pa.RecordBatch], most: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches, few rows at a time: rows hold whole sequences, and as Python's objects a batch of 10,000 would take gigabytes."""
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield batch.slice(k, most)


#: Tasks that recordings are dealt to at least.
TASKS = 128


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows dealt by recording to a number of tasks of its own: Spark joins tasks by their bytes in the shuffle, which rows that compress well outgrow in memory, as their work does in time."""
    return df.repartition(max(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def _next_row(row: tuple[int, int, int], match: int, ones: int) -> tuple[int, int, int]:
    """A row of distances as bits, a column each: where it is one more and one less than in the column before, and where one more than in the row above."""
    more, less, _ = row
    diagonal = (((match & more) + more) ^ more) | match | less
    down, up = less | (ones & ~(diagonal | more)), diagonal & more
    right, left = down << 1 | 1, up << 1
    return (left | ~(diagonal | right)) & ones, right & diagonal & ones, down


def _matches(hyp: list[str]) -> Callable[[str], int]:
    """Of a token the places in ``hyp`` where it stands, as bits."""
    held: dict[str, int] = {}
    if len(set(hyp)) * len(hyp) <= 8 * MATCHES:
        bit = 1
        for token in hyp:
            held[token] = held.get(token, 0) | bit
            bit <<= 1
        return lambda token: held.get(token, 0)
    places: dict[str, list[int]] = {}
    for j, token in enumerate(hyp):
        places.setdefault(token, []).append(j)

    def match(token: str) -> int:
        bits = held.get(token)
        if bits is None:
            bits = sum(1 << j for j in places.get(token, ()))
            if len(held) * len(hyp) <= 8 * MATCHES:
                held[token] = bits
        return bits

    return match


def edit_distance(ref: list[str], hyp: list[str]) -> int:
    """The number of steps of ``edit_path`` that are no hits, from its last row alone."""
    match, ones = _matches(hyp), (1 << len(hyp)) - 1
    row = (ones, 0, 0)
    for token in ref:
        row = _next_row(row, match(token), ones)
    return len(ref) + row[0].bit_count() - row[1].bit_count()


def edit_path(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int]]:
    """Steps of a shortest edit path, in order: (hit | substitute | delete | insert, i, j).

    A row of distances at a time, as bits of whole numbers: neighbours differ by one at most.
    Walking back, hits go before deletions before insertions before substitutions.  Of n rows every
    sqrt(n)th is kept and those between are made anew when the way back comes there, up to the
    column that it has reached, so memory grows with m sqrt(n) bits and not with n m.  Of short
    sequences all rows are kept.
    """
    n, m = len(ref), len(hyp)
    match = _matches(hyp)
    step = 1 if (n + 1) * (m + 1) <= SMALL else max(1, math.isqrt(n))
    ones = (1 << m) - 1
    kept, row = [(ones, 0, 0)], (ones, 0, 0)
    for i in range(1, n + 1):
        row = _next_row(row, match(ref[i - 1]), ones)
        if i % step == 0:
            kept.append(row)
    out, i, j = [], n, m
    low, rows = (0, kept) if step == 1 else (n + 1, [])
    while i or j:
        if i and i - 1 < low:
            low = (i - 1) // step * step
            ones = (1 << j) - 1
            rows = [tuple(bits & ones for bits in kept[low // step])]
            for k in range(low + 1, i + 1):
                rows.append(_next_row(rows[-1], match(ref[k - 1]) & ones, ones))
            del kept[low // step + 1 :]
        if i and j and ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
            out.append(("hit", i, j))
        elif i and (not j or rows[i - low][2] >> (j - 1) & 1):
            i -= 1
            out.append(("delete", i, j))
        elif j and (not i or rows[i - low][0] >> (j - 1) & 1):
            j -= 1
            out.append(("insert", i, j))
        else:
            i, j = i - 1, j - 1
            out.append(("substitute", i, j))
    return out[::-1]


#: Places where tokens of both sides match, above which they are not listed.
MOST_PLACES = 1 << 22


def _diagonals(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Begin on either side and length of all diagonal runs of matches; None if there are too many places."""
    order = np.argsort(b, kind="stable")
    first = np.searchsorted(b[order], a, "left")
    count = np.searchsorted(b[order], a, "right") - first
    if count.sum() > MOST_PLACES:
        return None
    i = np.repeat(np.arange(len(a)), count)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count - first, count)]
    key = np.sort((j - i + len(a)) * (len(a) + 1) + i)
    begin = np.flatnonzero(np.r_[True, np.diff(key) != 1]) if len(key) else np.zeros(0, np.int64)
    i = key[begin] % (len(a) + 1)
    return i, key[begin] // (len(a) + 1) - len(a) + i, np.diff(np.r_[begin, len(key)])


def _longest_by_rows(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Longest run of matches, of several the first by place; a row of run lengths at a time."""
    best, length = (0, 0, 0), np.zeros(len(b) + 1, np.int64)
    for i, token in enumerate(a.tolist()):
        length[1:] = np.where(b == token, length[:-1] + 1, 0)
        k = int(length.argmax())
        n = int(length[k])
        if n > best[2] or (n == best[2] > 0 and (i - n + 1, k - n) < best[:2]):
            best = (i - n + 1, k - n, n)
    return best


def matching_blocks(ref: list[str], hyp: list[str]) -> list[tuple[int, int, int]]:
    """(i, j, length) of the longest run of tokens that both sides share, then of what lies left and right of it, and so on; neighbours joined.

    Of several longest runs the one that begins first on the reference's side counts, then on the
    other's.  All diagonal runs of matches are listed once and cut down with each range; ranges
    with very many matches are searched row by row until they have fewer.
    """
    a, b = _numbered(ref, hyp, np.int64)
    found, todo = [], [(0, len(a), 0, len(b), None)]
    while todo:
        alo, ahi, blo, bhi, runs = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        if runs is None and (listed := _diagonals(a[alo:ahi], b[blo:bhi])) is not None:
            runs = (listed[0] + alo, listed[1] + blo, listed[2])
        if runs is None:
            x, y, n = _longest_by_rows(a[alo:ahi], b[blo:bhi])
            left = right = None
            x, y = x + alo, y + blo
        else:
            i, j, size = runs
            skip = np.maximum(0, np.maximum(alo - i, blo - j))
            i, j, size = i + skip, j + skip, np.minimum(size, np.minimum(ahi - i, bhi - j)) - skip
            keep = size > 0
            i, j, size = i[keep], j[keep], size[keep]
            if not len(i):
                continue
            longest = np.flatnonzero(size == size.max())
            at = longest[np.lexsort((j[longest], i[longest]))[0]]
            x, y, n = int(i[at]), int(j[at]), int(size[at])
            before, after = (i < x) & (j < y), (i + size > x + n) & (j + size > y + n)
            left, right = (i[before], j[before], size[before]), (i[after], j[after], size[after])
        if n:
            found.append((x, y, n))
            todo += [(alo, x, blo, y, left), (x + n, ahi, y + n, bhi, right)]
    merged: list[list[int]] = []
    for x, y, n in sorted(found):
        if merged and merged[-1][0] + merged[-1][2] == x and merged[-1][1] + merged[-1][2] == y:
            merged[-1][2] += n
        else:
            merged.append([x, y, n])
    return [tuple(m) for m in merged]


def opcodes(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Longest matching blocks, recursively, as edit operations on ranges."""
    out, i, j = [], 0, 0
    for x, y, n in [*matching_blocks(ref, hyp), (len(ref), len(hyp), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out


def project(blocks: list[tuple[int, int, int, int]], start: int, end: int, pad: int = 2) -> tuple[int, int]:
    """Range of the hypothesis that a range of the reference falls on, widened by ``pad``; blocks of equal length map one to one."""
    hit = []
    for i1, i2, j1, j2 in blocks:
        if i2 > start and i1 < end:
            even = i2 - i1 == j2 - j1
            hit.append((j1 + max(0, start - i1), j1 + min(end, i2) - i1) if even else (j1, j2))
    return (max(0, min(lo for lo, _ in hit) - pad), max(hi for _, hi in hit) + pad) if hit else (0, 0)


def similarity(a: str, b: str) -> float:
    """Twice the longest common subsequence of characters over both lengths."""
    if not a and not b:
        return 1.0
    x, row = np.frombuffer(b.encode("utf-32-le"), np.int32), np.zeros(len(b) + 1, np.int32)
    for c in a:
        step = np.r_[0, np.maximum(row[1:], row[:-1] + (x == ord(c)))]
        row = np.maximum.accumulate(step)
    return 2.0 * int(row[-1]) / (len(a) + len(b))


def best_similarity(needle: str, tokens: list[str], slack: int = 1) -> tuple[float, str]:
    """The closest run of tokens, of the needle's number of words give or take ``slack``; the first of several.

    What letters both have, whatever their order, bounds the similarity, so few runs are compared.
    """
    best = (0.0, "")
    n, letters = len(needle.split()), Counter(needle)
    for size in range(max(1, n - slack), n + slack + 1) if needle and tokens else ():
        for k in range(len(tokens) - size + 1):
            run = " ".join(tokens[k : k + size])
            both = len(needle) + len(run)
            if 2.0 * min(len(needle), len(run)) / both <= best[0] or 2.0 * (letters & Counter(run)).total() / both <= best[0]:
                continue
            if (s := similarity(needle, run)) > best[0]:
                best = (s, run)
    return best


def word_errors(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """keys, ref_words, hyp_words, hits, substitutions, deletions, insertions, wer, mer, wil of token arrays; wer is over at least one word."""
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for a, b in zip(batch.column(ref).to_pylist(), batch.column(hyp).to_pylist()):
                a, b = a or [], b or []
                tags = [t for t, _, _ in edit_path(a, b)]
                h, s, d, i = (tags.count(t) for t in ("hit", "substitute", "delete", "insert"))
                kept = (h / len(a)) * (h / len(b)) if a and b else 0.0
                rows.append((len(a), len(b), h, s, d, i, (s + d + i) / max(1, len(a)), (s + d + i) / max(1, h + s + d + i), 1.0 - kept))
            names = ["ref_words", "hyp_words", "hits", "substitutions", "deletions", "insertions", "wer", "mer", "wil"]
            arrays = [pa.array([r[k] for r in rows], pa.int64() if k < 6 else pa.float64()) for k in range(9)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *arrays], names=[*keys, *names])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ref_words long, hyp_words long, hits long, substitutions long, deletions long, insertions long, wer double, mer double, wil double"
    return pairs.select(*keys, ref, hyp).mapInArrow(run, schema)


def edit_steps(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """keys, step, tag, i, j, ref_token, hyp_token: the path of each pair, hits too."""
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for k, (a, b) in enumerate(zip(batch.column(ref).to_pylist(), batch.column(hyp).to_pylist())):
                a, b = a or [], b or []
                path = edit_path(a, b)
                at = pa.array(np.full(len(path), k))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in keys), pa.array(range(len(path)), pa.int32()), pa.array([p[0] for p in path], pa.string()), pa.array([p[1] for p in path], pa.int32()), pa.array([p[2] for p in path], pa.int32()),
                     pa.array([a[p[1]] if p[0] != "insert" else None for p in path], pa.string()), pa.array([b[p[2]] if p[0] != "delete" else None for p in path], pa.string())],
                    names=[*keys, "step", "tag", "i", "j", "ref_token", "hyp_token"],
                )

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", step int, tag string, i int, j int, ref_token string, hyp_token string"
    return pairs.select(*keys, ref, hyp).mapInArrow(run, schema)


def edit_hits(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """keys, i, j: the places, as arrays, of the tokens that the path of each pair has as hits."""
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            hits = [[p[1:] for p in edit_path(a or [], b or []) if p[0] == "hit"] for a, b in zip(batch.column(ref).to_pylist(), batch.column(hyp).to_pylist())]
            places = [pa.array([[p[k] for p in h] for h in hits], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *places], names=[*keys, "i", "j"])

    return pairs.select(*keys, ref, hyp).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i array<int>, j array<int>")


def blocks(pairs: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """keys, ops: the operations of longest matching blocks, and loose_errors, where a replacement counts its longer side; ``keys`` may name more columns to keep, of either side too."""
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ops = [opcodes(a or [], b or []) for a, b in zip(batch.column(ref).to_pylist(), batch.column(hyp).to_pylist())]
            errors = [sum(max(i2 - i1, j2 - j1) for t, i1, i2, j1, j2 in o if t != "equal") for o in ops]
            named = [[dict(zip(("tag", "i1", "i2", "j1", "j2"), x)) for x in o] for o in ops]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(named, _OPS), pa.array(errors, pa.int64())], names=[*keys, "ops", "loose_errors"])

    return pairs.select(*dict.fromkeys([*keys, ref, hyp])).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", ops {_OPS_SQL}, loose_errors long")


def alignment(ref: DataFrame, hyp: DataFrame, by: list[str]) -> DataFrame:
    """by, tag, i1, i2, j1, j2: the operations that lead from one table of tokens (by, place, token) to the other, a row for each.

    Both sides of a visit meet in one task; a visit that only one side knows is one deletion or
    insertion.  Tokens are compared as they are, and numbered by their order of place.
    """
    kinds = dict(ref.dtypes)
    names = [*by, "tag", "i1", "i2", "j1", "j2"]

    def tokens(t: pa.Table) -> list[str]:
        return t.sort_by("place").column("token").to_pylist()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ops = opcodes(tokens(left), tokens(right))
        some = left if len(left) else right
        keys = [some.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * len(ops), pa.int64())) for c in by]
        tags, *ends = zip(*ops) if ops else [()] * 5
        return pa.table([*keys, pa.array(tags, pa.string()), *[pa.array(e, pa.int64()) for e in ends]], names=names)

    columns = [*by, "place", "token"]
    both = ref.select(columns).groupBy(*by).cogroup(hyp.select(columns).groupBy(*by))
    return both.applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", tag string, i1 long, i2 long, j1 long, j2 long")
