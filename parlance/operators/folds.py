"""Greedy packing, where each cut depends on where the group before it began: folds over the ordered rows of one recording."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.operators.align import parts


def _per(df: DataFrame, by: list[str], order: list[str], columns: list[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """A recording's rows, as tuples of ``columns`` in order, handed to ``fold``; what it yields are the rows of ``schema``."""
    kinds = dict(df.dtypes)
    fields = [part.split() for part in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        out = list(fold(zip(*(t.column(c).to_pylist() for c in columns))))
        keys = [t.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * len(out), pa.int64())) for c in by]
        return pa.table([*keys, *[pa.array([r[k] for r in out], types[kind]) for k, (_, kind) in enumerate(fields)]], names=[*by, *[name for name, _ in fields]])

    return df.select(*dict.fromkeys([*by, *order, *columns])).groupBy(*by).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + schema)


def merge_and_split(segments: DataFrame, by: list[str], longest: float = 25.0, gap: float = 1.0) -> DataFrame:
    """Neighbours of one speaker merge while the whole stays within ``longest`` and pauses within ``gap``; longer ones are split into equal pieces."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        out: list[list] = []
        for s, e, who in rows:
            if out and out[-1][2] == who and s - out[-1][1] <= gap and e - out[-1][0] <= longest:
                out[-1][1] = e
            else:
                out.append([s, e, who])
        k = 0
        for s, e, who in out:
            pieces = max(1, math.ceil((e - s) / longest))
            for i in range(pieces):
                yield k, float(s + (e - s) * i / pieces), float(s + (e - s) * (i + 1) / pieces), who
                k += 1

    return _per(segments, by, ["start", "seg_idx"], ["start", "end", "speaker"], fold, "piece int, start double, end double, speaker string")


def speech_windows(spans: DataFrame, by: list[str], longest: float = 25.0) -> DataFrame:
    """Packs spans into windows of at most ``longest``; a longer span is cut."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        begin = end = None
        k = 0
        for s, e in rows:
            if begin is not None and e - begin > longest:
                yield k, float(begin), float(end)
                k, begin = k + 1, None
            if begin is None:
                begin = s
            while e - begin > longest:
                yield k, float(begin), float(begin + longest)
                k, begin = k + 1, begin + longest
            end = e
        if begin is not None and end > begin:
            yield k, float(begin), float(end)

    return _per(spans, by, ["start", "end"], ["start", "end"], fold, "window int, start double, end double")


def caption_cues(words: DataFrame, by: list[str], pause: float = 1.5, longest: float = 6.0, chars: int = 84) -> DataFrame:
    """Captions break on a change of speaker, a pause, their duration or their number of characters.

    A word without an end leaves the cue's end as it is; a cue without a start begins at 0, one
    without any end ends where it began (null if that isn't known).
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        cues: list[list] = []
        for s, e, who, word in rows:
            cue = cues[-1] if cues else None
            fits = cue is not None and who == cue[2] and len(f"{cue[3]} {word}".strip()) <= chars
            fits = fits and (cue[1] is None or s is None or s - cue[1] <= pause) and (cue[0] is None or e is None or e - cue[0] <= longest)
            if fits:
                cue[1], cue[3] = cue[1] if e is None else e, f"{cue[3]} {word}"
            else:
                cues.append([s, e, who, word])
        shown = [c for c in cues if c[3].strip()]
        for k, (s, e, who, text) in enumerate(shown):
            yield k, who, 0.0 if s is None else float(s), s if e is None else e, text.strip()

    return _per(words, by, ["word_idx"], ["start", "end", "speaker", "word"], fold, "cue int, speaker string, start double, end double, text string")


def overlapping_chunks(pieces: DataFrame, by: list[str], size: int = 5000, overlap: int = 1) -> DataFrame:
    """Packs pieces (piece, n_chars, in order) into chunks of at most ``size`` characters; each chunk begins with the last ``overlap`` pieces of the one before."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        k, held, chunk = 0, 0, []
        for piece, n in rows:
            if len(chunk) > (overlap if k else 0) and held + n > size:
                yield k, chunk[0][0], chunk[-1][0], held
                k, chunk = k + 1, chunk[-overlap:] if overlap else []
                held = sum(x for _, x in chunk)
            chunk.append((piece, n))
            held += n
        if chunk:
            yield k, chunk[0][0], chunk[-1][0], held

    return _per(pieces, by, ["piece"], ["piece", "n_chars"], fold, "chunk int, first_piece int, last_piece int, n_chars long")


def best_run(start: np.ndarray, end: np.ndarray, free: np.ndarray, low: float, high: float) -> tuple[float, int, int]:
    """The run of free words with the largest intersection over union with [low, high), and its first and last place; ties to the earlier.

    When starts and ends ascend, only words that overlap the segment count (found by binary
    search), and of each free run of them only few ends can be best: a beginning over ``low`` or
    the first after it, and an end over ``high`` or the last before it.
    """
    best = (0.0, -1, -1)
    if (start[1:] >= start[:-1]).all() and (end[1:] >= end[:-1]).all():
        lo, hi = int(np.searchsorted(end, low, "right")), int(np.searchsorted(start, high, "left"))
        mine = np.flatnonzero(free[lo:hi]) + lo
        cuts = np.flatnonzero(np.diff(mine) > 1) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(mine)].tolist()):
            if a == b:
                continue
            x, y = int(mine[a]), int(mine[b - 1]) + 1
            first = x + int(np.searchsorted(start[x:y], low, "right"))
            begins = [*range(x, first), *([first] if first < y else [])]
            over = x + int(np.searchsorted(end[x:y], high, "left"))
            ends = range(x + int(np.searchsorted(end[x:y], end[over - 1], "left")) if over > x else over, y)
            best = _better(start, end, low, high, ((i, j) for i in begins for j in ends if j >= i), best)
        return best
    for i in range(len(start)):
        if free[i] and end[i] > low:
            stop = next((j for j in range(i, len(start)) if not free[j] or start[j] >= high), len(start))
            best = _better(start, end, low, high, ((i, j) for j in range(i, stop)), best)
    return best


def _better(start: np.ndarray, end: np.ndarray, low: float, high: float, places, best: tuple[float, int, int]) -> tuple[float, int, int]:
    for i, j in places:
        shared = min(end[j], high) - max(start[i], low)
        whole = max(end[j], high) - min(start[i], low)
        if whole > 0 and shared / whole > best[0]:
            best = (shared / whole, i, j)
    return best


def claim_segments(words: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Each segment, from the best fitting on, claims the run of still free words that fits it best by intersection over union; ties to the earlier.

    by, seg_idx, first, last (half-open word indexes), iou.
    """
    from pyspark.sql import functions as F

    w = words.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("word_idx", "start", "end"))).alias("words"))
    s = segments.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("seg_idx", "start", "end"))).alias("segs"))
    kinds = dict(words.dtypes)

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at, out = [], []
            for k in range(batch.num_rows):
                row = batch.column("words")[k].values
                idx, start, end = (row.field(c).to_numpy(zero_copy_only=False) for c in ("word_idx", "start", "end"))
                free = np.ones(len(idx), bool)
                order = sorted(batch.column("segs")[k].as_py(), key=lambda g: (-best_run(start, end, free, g["start"], g["end"])[0], g["seg_idx"]))
                for seg in order:
                    value, i, j = best_run(start, end, free, seg["start"], seg["end"])
                    if value > 0:
                        free[i : j + 1] = False
                        at.append(k), out.append((seg["seg_idx"], int(idx[i]), int(idx[j]) + 1, float(value)))
            columns = [pa.array([r[c] for r in out], pa.float64() if c == 3 else pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in by), *columns], names=[*by, "seg_idx", "first", "last", "iou"])

    return w.join(s, by).mapInArrow(claim, ", ".join(f"{c} {kinds[c]}" for c in by) + ", seg_idx long, first long, last long, iou double")
