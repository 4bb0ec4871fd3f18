"""Joins and arithmetic on time intervals.

Every join has the recording (``by``) as an equality key, so Spark hashes on it; time buckets
are added where a recording alone may be large.  Ties go to the earliest segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.align import dealt, parts

UNKNOWN = "UNKNOWN"


def bucketed_overlap_join(left: DataFrame, right: DataFrame, by: list[str], bucket: float) -> DataFrame:
    """Pairs of intervals [l_start, l_end) and [r_start, r_end) that overlap.

    Both sides are dealt to the time buckets they touch, and a pair is kept in the bucket where
    its overlap begins; so a long recording is many small hash groups, not one large one.
    """
    spans = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.greatest(F.col(s), F.col(e)) / bucket)))
    pairs = left.withColumn("bucket", spans("l_start", "l_end")).join(right.withColumn("bucket", spans("r_start", "r_end")), [*by, "bucket"])
    begin = F.greatest("l_start", "r_start")
    return pairs.where((F.col("r_end") > F.col("l_start")) & (F.col("r_start") < F.col("l_end")) & (F.floor(begin / bucket) == F.col("bucket"))).drop("bucket")


def assign_speakers(words: DataFrame, segments: DataFrame, by: list[str], nearest: bool = False, bucket: float = 3600.0) -> DataFrame:
    """Speaker of each word: of the segments that overlap it, the speaker with the longest overlap in all; for a word without extent, of the first segment that holds it; with ``nearest``, else of the segment whose middle is nearest; else UNKNOWN.

    words: by, word_idx, start, end.  segments: by, seg_idx (in order of start), start, end, speaker.
    """
    segs = segments.select(*by, F.col("seg_idx"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("speaker").alias("r_speaker"))
    w = words.select(*by, "word_idx", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    most = (
        bucketed_overlap_join(w.where("l_end > l_start"), segs, by, bucket).groupBy(*by, "word_idx", "r_speaker").agg(F.sum(shared).alias("shared"), F.min("seg_idx").alias("at"))
        .groupBy(*by, "word_idx").agg(F.max_by("r_speaker", F.struct("shared", -F.col("at"))).alias("by_overlap"))
    )
    points = w.where("l_end <= l_start").withColumn("bucket", F.floor(F.col("l_start") / bucket))
    held = segs.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("r_start") / bucket), F.floor(F.col("r_end") / bucket))))
    inside = points.join(held, [*by, "bucket"]).where("r_start <= l_start and l_start <= r_end").groupBy(*by, "word_idx").agg(F.min_by("r_speaker", "seg_idx").alias("by_holding"))
    out = words.drop("speaker").join(most, [*by, "word_idx"], "left").join(inside, [*by, "word_idx"], "left").withColumn("speaker", F.coalesce("by_overlap", "by_holding")).drop("by_overlap", "by_holding")
    if nearest:
        rest = out.where("speaker is null").select(*by, "word_idx", ((F.col("start") + F.col("end")) / 2).alias("at"))
        middles = segs.select(*by, ((F.col("r_start") + F.col("r_end")) / 2).alias("at"), "seg_idx", F.col("r_speaker").alias("speaker"))
        near = _nearest(rest, middles, by).select(*by, "word_idx", F.col("near.speaker").alias("by_nearness"))
        out = out.join(near, [*by, "word_idx"], "left").withColumn("speaker", F.coalesce("speaker", "by_nearness")).drop("by_nearness")
    return out.withColumn("speaker", F.coalesce("speaker", F.lit(UNKNOWN)))


def as_of(points: DataFrame, segments: DataFrame, by: list[str], at: str = "t") -> DataFrame:
    """Speaker of the last segment that starts at or before each point, if it hasn't ended: one sort of both sides, no join."""
    p = points.select(*by, "point", F.col(at).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("struct<speaker:string,end:double>").alias("seg"), F.lit(0).alias("ord"))
    s = segments.select(*by, F.lit(None).cast("long").alias("point"), F.col("start").alias("t"), F.lit(0).alias("kind"), F.struct(F.col("speaker").alias("speaker"), F.col("end").cast("double").alias("end")).alias("seg"), F.col("seg_idx").cast("int").alias("ord"))
    w = Window.partitionBy(*by).orderBy("t", "kind", "ord").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt(p.unionByName(s), by).withColumn("last", F.last("seg", ignorenulls=True).over(w)).where("kind = 1")
    return found.select(*by, "point", "t", F.when(F.col("t") <= F.col("last.end"), F.col("last.speaker")).alias("speaker"))


def _nearest(points: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """points with ``near`` (seg_idx, speaker) of the nearest mark: the last before and the first after, from sorts of both sides, no join.

    points: by, at and others.  marks: by, at, seg_idx, speaker.  Points without marks or time have none.
    """
    others = [c for c in points.columns if c not in (*by, "at")]
    once = marks.where("at is not null").groupBy(*by, "at").agg(F.min_by(F.struct("at", "seg_idx", "speaker"), "seg_idx").alias("mark"))
    sides = dealt(once.withColumn("kind", F.lit(0)).unionByName(points.withColumn("kind", F.lit(1)), allowMissingColumns=True), by)
    # Twice a running last, since Spark's frames to the end of a partition are quadratic.
    running = lambda at: F.last("mark", ignorenulls=True).over(Window.partitionBy(*by).orderBy(at, "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = sides.withColumn("before", running(F.col("at").asc())).withColumn("after", running(F.col("at").desc())).where("kind = 1")
    ranked = [F.when(F.col("at").isNotNull() & F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.at")).alias("gap"), F.col(f"{c}.seg_idx").alias("seg_idx"), F.col(f"{c}.speaker").alias("speaker"))) for c in ("before", "after")]
    return found.select(*by, *others, "at", F.least(*ranked).alias("near"))


def nearest_turn(points: DataFrame, turns: DataFrame, by: list[str], bucket: float = 3600.0) -> DataFrame:
    """The first turn that holds each point, else the one whose start is nearest."""
    held = turns.where("end >= start").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)))).select(*by, "bucket", "seg_idx", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "speaker")
    inside = points.withColumn("bucket", F.floor(F.col("t") / bucket)).join(held, [*by, "bucket"]).where("r_start <= t and t <= r_end").groupBy(*by, "point").agg(F.min_by(F.struct("seg_idx", "speaker"), "seg_idx").alias("holds"))
    near = _nearest(points.select(*by, "point", F.col("t").alias("at")), turns.select(*by, F.col("start").alias("at"), "seg_idx", "speaker"), by).where("near is not null")
    return near.join(inside, [*by, "point"], "left").select(*by, "point", *[F.coalesce(f"holds.{c}", f"near.{c}").alias(c) for c in ("seg_idx", "speaker")])


def band_counts(turns: DataFrame, words: DataFrame, by: list[str], bands: tuple[float, ...] = (0.0, 0.5, 3.0), bucket: float = 600.0) -> DataFrame:
    """For each turn the number of words that overlap it, widened by each band: one join at the widest, then conditional counts.

    Also the gap to the nearest word of the recording, however far; null only where there is none.
    """
    far = max(bands)
    left = turns.select(*by, "seg_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"), (F.col("start") - far).alias("l_start"), (F.col("end") + far).alias("l_end"))
    right = words.select(*by, "word_idx", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    pairs = bucketed_overlap_join(left, right, by, bucket)
    names = [f"within_{b:g}".replace(".", "_") for b in bands]
    within = [F.count_if((F.col("r_end") > F.col("t_start") - b) & (F.col("r_start") < F.col("t_end") + b)).alias(n) for b, n in zip(bands, names)]
    found = pairs.groupBy(*by, "seg_idx").agg(*within)
    return nearest_word(turns, words, by).join(found, [*by, "seg_idx"], "left").fillna(0, names).select(*by, "seg_idx", *names, "nearest")


def nearest_word(turns: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """by, seg_idx, nearest: the gap from each turn to the word nearest to it, 0 where one overlaps; from sorts of both sides, no join.

    Of the words that start by the turn's end the one that ends last is nearest, of the others the first.
    """
    w = words.where("start is not null and end is not null").select(*by, F.lit(None).cast("long").alias("seg_idx"), F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("from"), F.greatest("start", "end").alias("ends"))
    t = turns.select(*by, F.col("seg_idx").cast("long").alias("seg_idx"), F.greatest("start", "end").alias("at"), F.lit(1).alias("kind"), F.col("start").cast("double").alias("from"), F.lit(None).cast("double").alias("ends"))
    order = Window.partitionBy(*by)
    so_far = F.max("ends").over(order.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    follows = F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(order.orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0))
    gap = F.least(F.when(F.col("so_far").isNotNull(), F.greatest(F.col("from") - F.col("so_far"), F.lit(0.0))), F.col("follows") - F.col("at"))
    return dealt(w.unionByName(t), by).withColumn("so_far", so_far).withColumn("follows", follows).where("kind = 1").select(*by, "seg_idx", gap.alias("nearest"))


def clip(words: DataFrame, low: Column, high: Column) -> DataFrame:
    """Words that start in [low, high), with ends cut at high; words without a start go, missing ends become high."""
    return words.where((F.col("start") >= low) & (F.col("start") < high)).withColumn("end", F.least(F.coalesce("end", high), high))


def covered_turns(turns: DataFrame, by: list[str], cap: float | None = None) -> DataFrame:
    """Turns (in order of seg_idx) but the last, whose start is where coverage ends; with ``cap`` it ends so many seconds after the first start at most, and turns that start at or beyond that go first.

    The last kept turn ends where the one that went starts, or where coverage ends.  Recordings
    of fewer than two turns, before or after the cap, have none, nor do those whose last turn
    starts no later than the first.
    """
    every = Window.partitionBy(*by).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.least(F.col("to"), F.col("from") + cap) if cap is not None else F.col("to")
    kept = turns.withColumn("from", F.first("start").over(every)).withColumn("to", F.last("start").over(every)).where(F.col("to") > F.col("from"))
    kept = kept.withColumn("limit", ends).where((F.col("limit") == F.col("to")) | (F.col("start") < F.col("limit")))
    w = Window.partitionBy(*by).orderBy("seg_idx")
    kept = kept.withColumn("next", F.lead("start").over(w)).where("next is not null").withColumn("final", F.lead("next").over(w).isNull())
    return kept.withColumn("end", F.when(F.col("final"), F.least("next", "limit")).otherwise(F.col("end"))).drop("from", "to", "limit", "next", "final")


def coverage(turns: DataFrame, by: list[str], duration: Column) -> DataFrame:
    """Share of the recording up to the last turn's start, at most 1."""
    return turns.groupBy(*by).agg(F.max("start").alias("last"), F.max(duration).alias("duration")).select(*by, F.least(F.try_divide("last", "duration"), F.lit(1.0)).alias("coverage"))


def _swept(x, y) -> float:
    """Overlap of two sorted lists of intervals, as a sweep finds it that leaves whichever ends first (the second list's where both do)."""
    total, i, j = 0.0, 0, 0
    while i < len(x) and j < len(y):
        total += max(0.0, min(x[i][1], y[j][1]) - max(x[i][0], y[j][0]))
        ahead = x[i][1] < y[j][1]
        i, j = i + ahead, j + (not ahead)
    return total


def overlap_lengths(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Total overlap of two sides' intervals, for each pair of speakers that has any: by, a_speaker, b_speaker, overlap.

    Intervals of a side that overlap each other count each for themselves, as far as the sweep
    meets them.  A recording is swept in one task.
    """
    spans = lambda df: df.where("start is not null and end is not null").groupBy(*by, "speaker").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.greatest("start", "end").cast("double").alias("end")))).alias("spans"))
    return swept_overlaps(spans(a), spans(b), by)


def swept_overlaps(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """``overlap_lengths`` of speakers (by, speaker) with all their spans (start, end) as one array in order."""
    kinds = dict(a.dtypes)
    side = lambda df, name: df.groupBy(*by).agg(F.collect_list(F.struct("speaker", F.col("spans.start").alias("s"), F.col("spans.end").alias("e"))).alias(name))
    held = side(a, "x").join(side(b, "y"), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at, x, y, value = [], [], [], []
            for k in range(batch.num_rows):
                sides = [[(s["speaker"], list(zip(s["s"], s["e"]))) for s in batch.column(c)[k].as_py()] for c in ("x", "y")]
                for p, one in sides[0]:
                    for q, other in sides[1]:
                        if (total := _swept(one, other)) > 0:
                            at.append(k), x.append(p), y.append(q), value.append(total)
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in by]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(value, pa.float64())], names=[*by, "a_speaker", "b_speaker", "overlap"])

    return held.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", a_speaker string, b_speaker string, overlap double")


def _best(overlaps: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Best one-to-one assignment: exact by dynamic programming over subsets of the smaller side, which speakers of one recording keep small.

    Of assignments with the same total the one whose last first speaker by name comes earliest wins,
    then, from the first speaker on, the one that leaves it out or else gives it the last name.
    """
    rows, cols = sorted({a for a, _ in overlaps}), sorted({b for _, b in overlaps})
    flip, none = len(cols) > len(rows), len(cols)
    ahead = lambda x, y: x[0] > y[0] + 1e-12 or (x[0] >= y[0] - 1e-12 and x[1:] > y[1:])
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, (none,) * len(rows))}
    top = (0.0, 0, best[0][1])
    for k in range(len(cols) if flip else len(rows)):
        gains = [(1 << (i if flip else j), i, j, v) for i, j in ([(i, k) for i in range(len(rows))] if flip else [(k, j) for j in range(none)]) if (v := overlaps.get((rows[i], cols[j]), 0.0)) > 0]
        step = dict(best)
        for used, (value, chosen) in best.items():
            for bit, i, j, v in gains:
                if not used & bit:
                    new = (value + v, (*chosen[:i], j, *chosen[i + 1 :]))
                    if used | bit not in step or ahead(new, step[used | bit]):
                        step[used | bit] = new
        best = step
        for value, chosen in best.values():
            if value >= top[0] - 1e-12:
                last = max((i + 1 for i, j in enumerate(chosen) if j < none), default=0)
                if ahead(found := (value, -last, chosen), top):
                    top = found
    return [(rows[i], cols[j]) for i, j in enumerate(top[2]) if j < none]


def assign_labels(overlaps: DataFrame, by: list[str]) -> DataFrame:
    """The one-to-one assignment of speakers with the largest total overlap; pairs without overlap are not assigned.

    A recording's pairs of speakers are few and travel as one row, many recordings to a batch.
    """
    kinds = dict(overlaps.dtypes)
    held = overlaps.groupBy(*by).agg(F.collect_list(F.struct(F.col("a_speaker").alias("a"), F.col("b_speaker").alias("b"), F.col("overlap").cast("double").alias("v"))).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at, a, b, value = [], [], [], []
            for k, pairs in enumerate(batch.column("pairs").to_pylist()):
                known = {(p["a"], p["b"]): p["v"] for p in pairs}
                for x, y in _best(known):
                    at.append(k), a.append(x), b.append(y), value.append(known[x, y])
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in by]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.float64())], names=[*by, "a_speaker", "b_speaker", "overlap"])

    return held.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", a_speaker string, b_speaker string, overlap double")


def named_speakers(hypothesis: DataFrame, by: list[str], mapping: DataFrame) -> DataFrame:
    """by, speaker, start, end of the hypothesis under the reference's names that ``mapping`` (by, a_speaker, b_speaker) gives; those without one are unmapped."""
    keys = [*by, "b_speaker"]
    hyp = hypothesis.select(*by, F.col("speaker").alias("b_speaker"), "start", "end").where("end > start")
    names = dealt(mapping.select(*by, "a_speaker", "b_speaker"), keys)
    return dealt(hyp, keys).join(names, keys, "left").select(*by, F.coalesce("a_speaker", F.concat(F.lit("unmapped "), "b_speaker")).alias("speaker"), "start", "end")


def error_rate(reference: DataFrame, hypothesis: DataFrame, by: list[str], mapping: DataFrame, collar: float | Column = 0.0, skip_overlap: bool | Column = False) -> DataFrame:
    """Missed, false and confused time and the total of the reference, from a sweep over the boundaries of both sides.

    ``mapping`` (by, a_speaker, b_speaker) says which hypothesis speaker stands for which
    reference speaker.  ``collar`` takes out half of it on either side of each reference boundary, ``skip_overlap`` where several
    reference speakers talk at once.  Either may be a column of ``by``'s.
    """
    return swept_errors(reference, named_speakers(hypothesis, by, mapping), by, collar, skip_overlap)


def swept_errors(reference: DataFrame, hypothesis: DataFrame, by: list[str], collar: float | Column = 0.0, skip_overlap: bool | Column = False, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``error_rate`` of a hypothesis under the reference's names.

    Boundaries are steps up and down, a running sum of which tells for each speaker, and a second
    one for the recording, who talks until the next boundary: two sorts in one shuffle, no join.
    ``each`` may repeat boundaries under columns that ``by`` names.
    """
    collar = collar if isinstance(collar, Column) else F.lit(float(collar))
    step = lambda t, side, up: F.struct(t.cast("double").alias("t"), *[F.lit(up if side == s else 0).alias(s) for s in ("r", "h", "c")])
    edges = lambda side: [step(F.col("start"), side, 1), step(F.col("end"), side, -1)]
    keys = [c for c in by if c in reference.columns]
    ref = reference.where("end > start").select(*keys, "speaker", "start", "end", F.lit(True).alias("real"))
    hyp = hypothesis.where("end > start").select(*keys, "speaker", "start", "end", F.lit(False).alias("real"))
    both = each(dealt(ref.unionByName(hyp), keys))
    # Around the reference's boundaries, without a speaker.
    cut = F.when(F.col("real") & (collar > 0), F.array(*[step(F.col(x) + d * collar / 2, "c", -d) for x in ("start", "end") for d in (-1, 1)])).otherwise(F.array().cast("array<struct<t:double,r:int,h:int,c:int>>"))
    own = F.when(F.col("real"), F.array(*edges("r"))).otherwise(F.array(*edges("h")))
    tagged = F.concat(F.transform(own, lambda e: F.struct(F.lit(True).alias("own"), e.alias("e"))), F.transform(cut, lambda e: F.struct(F.lit(False).alias("own"), e.alias("e"))))
    steps = both.select(*by, F.col("speaker").alias("who"), F.explode(tagged).alias("x")).select(*by, F.col("x.own").alias("own"), F.when(F.col("x.own"), F.col("who")).alias("who"), "x.e.*")
    summed = steps.groupBy(*by, "own", "who", "t").agg(*[F.sum(c).alias(c) for c in ("r", "h", "c")])
    talks = Window.partitionBy(*by, "own", "who").orderBy("t")
    on = {c: (F.sum(c).over(talks) > 0).cast("int") for c in ("r", "h", "c")}
    state = summed.select(*by, "own", "who", "t", *[v.alias(c) for c, v in on.items()])
    # A side without a name is somebody, but nobody's speaker.
    known = F.col("who").isNotNull().cast("int")
    state = state.select(*by, "own", "who", "t", F.greatest("r", "h").alias("any"), (F.col("r") * known).alias("r"), (F.col("h") * known).alias("h"), (F.col("r") * F.col("h") * known).alias("both"), "c")
    names = ("any", "r", "h", "both", "c")
    changes = state.select(*by, "t", *[(F.col(c) - F.coalesce(F.lag(c).over(talks), F.lit(0))).alias(c) for c in names])
    at = Window.partitionBy(*by).orderBy("t")
    cells = changes.groupBy(*by, "t").agg(*[F.sum(c).alias(c) for c in names]).select(*by, (F.lead("t").over(at) - F.col("t")).alias("length"), *[F.sum(c).over(at).alias(c) for c in names])
    kept = cells.where("length is not null and any > 0 and c = 0")
    if isinstance(skip_overlap, Column) or skip_overlap:
        kept = kept.where(~(skip_overlap if isinstance(skip_overlap, Column) else F.lit(True)) | (F.col("r") < 2))
    length, r, h = F.col("length"), F.col("r"), F.col("h")
    return kept.groupBy(*by).agg(
        F.sum(length * F.greatest(r - h, F.lit(0))).alias("missed"), F.sum(length * F.greatest(h - r, F.lit(0))).alias("false_alarm"),
        F.sum(length * (F.least(r, h) - F.col("both"))).alias("confusion"), F.sum(length * r).alias("total"),
    )


def exposed(spans: DataFrame, covers: DataFrame, by: list[str], bucket: int = 512) -> DataFrame:
    """Spans (first, last: half-open) that no cover overlaps: a range anti-join by recording and bucket of places, so that a long recording is many small groups."""
    touched = lambda first, last: F.explode(F.sequence(F.floor(F.col(first) / bucket), F.floor(F.greatest(F.col(first), F.col(last) - 1) / bucket)))
    c = covers.where("last > first").select(*by, F.col("first").alias("c_first"), F.col("last").alias("c_last")).withColumn("bucket", touched("c_first", "c_last"))
    hit = spans.select(*by, "first", "last").withColumn("bucket", touched("first", "last")).join(c, [*by, "bucket"]).where("c_first < last and c_last > first").select(*by, "first", "last").distinct()
    return spans.join(hit, [*by, "first", "last"], "left_anti")
