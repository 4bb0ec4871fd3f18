"""What one visit is scored by, from its turns and words: the kernel of ``streams.visit_scores``.

Rows are dicts with at (their order), text, speaker, start and end.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

from parlance.functions.text import CUES, FILLED_PAUSES
from parlance.operators.align import edit_distance, edit_path
from parlance.operators.intervals import UNKNOWN, _best, _swept

#: Words, normalized, below which a reference stream counts as a stray line.
LEAST_WORDS = 5


def headline_tokens(text: str) -> list[str]:
    """The words of ``functions.text.headline``."""
    plain = re.sub(r"[^a-z0-9'\s]", " ", re.sub(r"\[[^\]]*\]", " ", text).lower(), flags=re.ASCII)
    return [w for w in plain.split() if w not in FILLED_PAUSES]


def cue_score(reference: list[str], hypothesis: list[str]) -> float:
    """``functions.text.cue_score`` of tokens."""
    a, b = ({f"{family}:{t}" for family, ts in CUES.items() for t in ts if f" {t} " in text} for text in (f" {' '.join(words)} " for words in (reference, hypothesis)))
    return 1.0 if not a and not b else 0.0 if not a else 2 * len(a & b) / (len(a) + len(b))


def overlaps(a: dict[str, list], b: dict[str, list]) -> dict[tuple[str, str], float]:
    """Total overlap of each pair of speakers that has any."""
    sorted_ = [{who: sorted(spans) for who, spans in side.items()} for side in (a, b)]
    return {(p, q): total for p, x in sorted_[0].items() for q, y in sorted_[1].items() if (total := _swept(x, y)) > 0}


def _pooled(rows: list[dict]) -> str:
    return " ".join(r["text"] for r in sorted(rows, key=lambda r: (r["at"], r["text"] or "")) if r["text"] is not None)


def _by_speaker(rows: list[dict]) -> dict[str, list[dict]]:
    out = defaultdict(list)
    for r in rows:
        out[r["speaker"]].append(r)
    return out


def _span(r: dict) -> tuple[float, float]:
    return r["start"], max(r["start"], r["start"] if r["end"] is None else r["end"])


class _Nearest:
    """A matched reference speaker's spans, asked for what they share with a word and how near they are."""

    def __init__(self, spans: list[tuple[float, float]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.reach = list(accumulate((e for _, e in self.spans), max))
        self.edges = sorted(x for span in self.spans for x in span)

    def shared(self, start: float, end: float) -> float:
        """As a sweep in order of starts finds it, which leaves a word at the first span that ends after it."""
        first = bisect_right(self.reach, start)
        last = min(bisect_left(self.starts, end), bisect_right(self.reach, end) + 1)
        return sum(max(0.0, min(end, e) - max(start, s)) for s, e in self.spans[first:last])

    def near(self, start: float) -> float:
        k = bisect_left(self.edges, start)
        return min(abs(start - x) for x in self.edges[max(0, k - 1) : k + 1])


def diarization(reference: list[tuple[str, float, float]], hypothesis: list[tuple[str, float, float]], collar: float) -> tuple[float, float, float, float]:
    """Missed, false, confused and the reference's time, under the assignment with the most overlap; half of ``collar`` on either side of the reference's edges is left out."""
    sides = [defaultdict(list), defaultdict(list)]
    for k, rows in enumerate((reference, hypothesis)):
        for who, s, e in rows:
            sides[k][who].append((s, e))
    named = {b: a for a, b in _best(overlaps(*sides))} if all(sides) else {}
    events = [(t, k, named.get(who, ("unmapped", who)) if k else who, step) for k, rows in enumerate((reference, hypothesis)) for who, s, e in rows if e > s for t, step in ((s, 1), (e, -1))]
    if collar:
        events += [(x + d * collar / 2, 2, "", -d) for _, s, e in reference if e > s for x in (s, e) for d in (-1, 1)]
    active, before = [Counter(), Counter(), Counter()], None
    missed = false = confused = total = 0.0
    for t, k, who, step in sorted(events, key=lambda x: x[0]):
        if before is not None and t > before and not active[2]:
            r, h, length = len(active[0]), len(active[1]), t - before
            missed, false, total = missed + length * max(r - h, 0), false + length * max(h - r, 0), total + length * r
            confused += length * (min(r, h) - len(active[0].keys() & active[1].keys()))
        active[k][who] += step
        if not active[k][who]:
            del active[k][who]
        before = t
    return missed, false, confused, total


class Visit:
    def __init__(self, turns: list[dict], words: list[dict]):
        self.turns, self.words = turns, words
        self.timed = [{**w, "speaker": w["speaker"] or UNKNOWN} for w in words if w["start"] is not None and w["end"] is not None]

    def _means(self, scored: dict[str, list[str]], heard: dict[str, list[str]], matched: dict[str, str]) -> tuple[int, float | None, float | None, float | None]:
        """Streams, mean of their capped and raw error rates and of their cue scores."""
        raw, cues = [], []
        for who, ref in scored.items():
            hyp = heard.get(matched.get(who), [])
            key = (tuple(ref), tuple(hyp))
            if key not in self.known:
                self.known[key] = edit_distance(ref, hyp) / len(ref) if hyp else 1.0
            raw.append(self.known[key]), cues.append(cue_score(ref, hyp))
        n = len(raw)
        return n, *((sum(min(x, 1.0) for x in raw) / n, sum(raw) / n, sum(cues) / n) if n else (None,) * 3)

    def _tiled(self) -> list[tuple[str, float, float]]:
        runs: list[list] = []
        for w in sorted(self.timed, key=lambda w: (w["start"], w["at"])):
            if runs and runs[-1][0] == w["speaker"]:
                runs[-1][2] = max(runs[-1][2], w["end"])
            else:
                runs.append([w["speaker"], w["start"], max(w["start"], w["end"])])
        return [(who, s, max(e, runs[k + 1][1] if k + 1 < len(runs) else e)) for k, (who, s, e) in enumerate(runs)]

    def scores(self, collar: float) -> dict | None:
        """The columns of ``streams.SCORES``; None without words on either side."""
        ref, hyp = headline_tokens(_pooled(self.turns)), headline_tokens(_pooled(self.words))
        if not ref or not hyp:
            return None
        self.known: dict[tuple, float] = {}
        tags = Counter(step[0] for step in edit_path(ref, hyp))
        s, d, i, n = tags["substitute"], tags["delete"], tags["insert"], len(ref)
        out = {"wer": (s + d + i) / n, "wer_sub": s / n, "wer_del": d / n, "wer_ins": i / n, "wer_no_ins": (s + d) / n}
        streams = _by_speaker(self.turns)
        tokens = {who: headline_tokens(_pooled(rows)) for who, rows in streams.items()}
        enough = {who for who, t in tokens.items() if len(t) >= LEAST_WORDS}
        kept = enough or set(tokens)
        heard = _by_speaker(self.timed)
        spans = lambda side, some: {who: [_span(r) for r in rows if r["start"] is not None] for who, rows in side.items() if who in some}
        pairs = overlaps(spans(streams, kept), spans(heard, heard))
        matched = dict(_best(pairs)) if pairs else {}
        scored = {who: tokens[who] for who in kept if tokens[who]}
        _, out["swer_unmatched_dropped"], _, _ = self._means(scored, {who: headline_tokens(_pooled(rows)) for who, rows in heard.items()}, matched)
        asked = sorted((a, b, _Nearest(x)) for a, b in matched.items() if (x := spans(streams, {a})[a]))
        moved = 0
        for w in self.timed:
            if asked and w["speaker"] not in matched.values():
                start, end = _span(w)
                w["speaker"] = min((-near.shared(start, end), near.near(start), a, b) for a, b, near in asked)[3]
                moved += 1
        # Times of the system's own labels tell the diarization error, so the tiling is that of before.
        out["streams"], out["swer"], out["swer_uncapped"], out["qtp"] = self._means(scored, {who: headline_tokens(_pooled(rows)) for who, rows in _by_speaker(self.timed).items()}, matched)
        out["unmatched_hyp_words"], out["phantom_streams"] = moved, len(tokens) - len(kept)
        own = Visit(self.turns, self.words)
        missed, false, confused, total = diarization([(t["speaker"], *_span(t)) for t in self.turns if t["start"] is not None], own._tiled(), collar)
        return out | {"der": (missed + false + confused) / total if total else None, "der_confusion": confused / total if total else None}
