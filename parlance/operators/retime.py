"""Times of words: anchored to another hearing, fitted between anchors, cut into windows; and who spoke by content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import islands
from parlance.operators.intervals import UNKNOWN


def anchored(words: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Words with the times of their anchors (by, word_idx, a_start, a_end), the others fitted between them, and starts that never fall back.

    Words before the first anchor end by its start, those after the last begin at its end.  A run
    between two anchors stays if it lies between them and its starts ascend, else it is spread
    evenly.  Without anchors, and where all words have one, only the order of starts is mended.
    """
    timed = anchors.where("a_start is not null and a_end is not null").select(*by, "word_idx", F.round("a_start", 3).alias("a_start"), F.round(F.greatest("a_start", "a_end"), 3).alias("a_end"))
    w = Window.partitionBy(*by).orderBy("word_idx")
    before, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    rows = words.join(timed, [*by, "word_idx"], "left").withColumn("hit", F.col("a_start").isNotNull())
    rows = rows.withColumn("run", F.count_if("hit").over(before)).withColumn("anchors", F.count_if("hit").over(whole))
    rows = rows.withColumn("t0", F.last("a_end", ignorenulls=True).over(before)).withColumn("t1", F.last("a_start", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc("word_idx")).rowsBetween(Window.unboundedPreceding, 0)))
    gap = Window.partitionBy(*by, "run", "hit")
    behind = F.lag("start").over(gap.orderBy("word_idx"))
    fits = (F.col("t1") >= F.col("t0")) & (F.col("t0") <= F.col("start")) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("t1")) & F.coalesce(behind <= F.col("start"), F.lit(True))
    rows = rows.withColumn("fits", fits).withColumn("stays", F.coalesce(F.bool_and(F.coalesce("fits", F.lit(False))).over(gap), F.lit(True))).withColumn("n", F.count("*").over(gap)).withColumn("k", F.row_number().over(gap.orderBy("word_idx")) - 1)
    step = F.when(F.col("t1") > F.col("t0"), (F.col("t1") - F.col("t0")) / F.col("n")).otherwise(0.0)
    first, last = F.col("t0").isNull(), F.col("t1").isNull()

    def placed(own: str, at: str, early, late, spread):
        return F.when(F.col("hit"), F.col(at)).when(F.col("anchors") == 0, F.col(own)).when(first, early).when(last, late).when(F.col("stays"), F.col(own)).otherwise(spread)

    start = placed("start", "a_start", F.least("start", "t1"), F.greatest("start", "t0"), F.round(F.col("t0") + step * F.col("k"), 3))
    end = placed("end", "a_end", F.least("end", "t1"), F.greatest("end", F.greatest("start", "t0")), F.round(F.col("t0") + step * (F.col("k") + 1), 3))
    fitted = rows.withColumn("new_start", start).withColumn("new_end", end)
    rising = F.round(F.greatest(F.max("new_start").over(before), F.lit(0.0)), 3)
    out = fitted.withColumn("start", rising).withColumn("end", F.round(F.greatest("new_end", "start"), 3)).withColumn("anchored", F.col("hit"))
    return out.select(*words.columns, "anchored")


def windows(words: DataFrame, by: list[str], duration: str, longest: float = 26.0, most: int = 90, split: float = 2.0, least: float = 3.0, pad: float = 0.25) -> DataFrame:
    """by, window, first, last (half-open word places), word_start, word_end, audio_start, audio_end: windows that each word is in once, cut when they are full or at a pause.

    The sound of a window reaches to the middle of the silence around it, at most ``pad`` beyond
    its words and within the recording.  Where a window ends depends on where it began, so a
    recording is folded in one task; the sound's bounds need the neighbours only.
    """
    kinds = dict(words.dtypes)

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("word_idx")
        start, end = t.column("start").to_pylist(), t.column("end").to_pylist()
        cuts = [0]
        for k in range(1, len(start)):
            at = cuts[-1]
            full = k - at >= most or end[k] - start[at] > longest
            if full or (start[k] - end[k - 1] >= split and end[k - 1] - start[at] >= least):
                cuts.append(k)
        stops = [*cuts[1:], len(start)]
        ids = t.column("word_idx").to_pylist()
        columns = {c: pa.array([t.column(c)[0].as_py()] * len(cuts), t.column(c).type) for c in [*by, duration]}
        return pa.table(columns | {"window": pa.array(range(len(cuts)), pa.int64()), "first": pa.array([ids[a] for a in cuts], pa.int64()), "last": pa.array([ids[b - 1] + 1 for b in stops], pa.int64()), "word_start": pa.array([start[a] for a in cuts], pa.float64()), "word_end": pa.array([end[b - 1] for b in stops], pa.float64())})

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, duration]) + ", window long, first long, last long, word_start double, word_end double"
    found = words.select(*by, duration, "word_idx", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")).groupBy(*by).applyInArrow(fold, schema)
    w = Window.partitionBy(*by).orderBy("window")
    low = F.greatest(F.col("word_start") - pad, (F.coalesce(F.lag("word_end").over(w), F.lit(0.0)) + F.col("word_start")) / 2)
    high = F.least(F.col("word_end") + pad, (F.col("word_end") + F.coalesce(F.lead("word_start").over(w), F.col(duration))) / 2)
    return found.select(*by, "window", "first", "last", "word_start", "word_end", F.greatest(F.lit(0.0), F.least(low, "word_start")).alias("audio_start"), F.least(F.col(duration), F.greatest(high, "word_end")).alias("audio_end"))


def verbatim_stats(words: DataFrame, windows: DataFrame, sources: DataFrame, by: list[str]) -> DataFrame:
    """Of each recording its windows, the words of the source and of the verbatim text, those inserted and dropped, and the share inserted.

    words: by, origin (``matched`` or ``inserted``).  windows: by.  sources: by, source_words, dropped_words.
    """
    w = words.groupBy(*by).agg(F.count("*").alias("verbatim_words"), F.count_if(F.col("origin") == "inserted").alias("inserted_words"))
    v = windows.groupBy(*by).agg(F.count("*").alias("windows"))
    return sources.join(v, by, "left").join(w, by, "left").fillna(0, ["windows", "verbatim_words", "inserted_words"]).withColumn("insertion_rate", F.round(F.coalesce(F.try_divide("inserted_words", "verbatim_words"), F.lit(0.0)), 4))


def _pairs(blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, i, j: places that matching blocks pair."""
    return blocks.where("i2 - i1 = j2 - j1").select(*by, F.explode(F.sequence(F.col("i1"), F.col("i2") - 1)).alias("i"), F.col("i1"), F.col("j1")).select(*by, F.col("i").cast("long").alias("i"), (F.col("j1") + F.col("i") - F.col("i1")).cast("long").alias("j"))


def anchors(blocks: DataFrame, heard: DataFrame, by: list[str]) -> DataFrame:
    """by, word_idx, a_start, a_end: the times that another hearing (by, j, start, end) gives to the words that equal blocks pair with it."""
    same = _pairs(blocks.where("tag = 'equal'"), by).select(*by, F.col("i").alias("word_idx"), "j")
    return same.join(heard.select(*by, "j", F.col("start").alias("a_start"), F.col("end").alias("a_end")), [*by, "j"]).select(*by, "word_idx", "a_start", "a_end")


def refined_turns(turns: DataFrame, words: DataFrame, by: list[str], max_drift: float, strict: bool = True) -> DataFrame:
    """Turns with the start of their first word and the end of their last, and outcome: refined, fallback_drift or fallback_empty.

    turns: by, seg_idx (order), start, end, text.  words: by, word_idx (from 0), start, end, one for
    each word between white space of all turns in order.  Turns whose start would move by more than
    ``max_drift``, or end before it, and turns without words keep their times.  Where a visit has
    more or fewer words than its turns an error is raised, or, unless ``strict``, outcome is
    word_count_mismatch and its turns keep their times.
    """
    w = Window.partitionBy(*by).orderBy("seg_idx")
    counted = turns.withColumn("n", F.size(T.words_of(F.col("text"))).cast("long")).withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    placed = counted.withColumn("from", F.col("upto") - F.col("n")).withColumn("whole", F.sum("n").over(Window.partitionBy(*by)))
    first = words.select(*by, F.col("word_idx").alias("from"), F.col("start").alias("new_start"))
    last = words.select(*by, (F.col("word_idx") + 1).alias("upto"), F.col("end").alias("new_end"))
    sizes = words.groupBy(*by).agg(F.count("*").alias("given"))
    timed = placed.join(sizes, by, "left").join(first, [*by, "from"], "left").join(last, [*by, "upto"], "left")
    given = F.coalesce("given", F.lit(0))
    mismatch = F.raise_error(F.concat(F.lit("word count mismatch: transcript "), F.col("whole").cast("string"), F.lit(" vs aligned "), given.cast("string"))).cast("string") if strict else F.lit("word_count_mismatch")
    drifts = (F.abs(F.col("new_start") - F.col("start")) > max_drift) | (F.col("new_end") <= F.col("new_start"))
    outcome = F.when(F.col("whole") != given, mismatch).when(F.col("n") == 0, "fallback_empty").when(drifts, "fallback_drift").otherwise("refined")
    judged = timed.withColumn("outcome", outcome)
    new = F.col("outcome") == "refined"
    return judged.withColumn("start", F.when(new, F.col("new_start")).otherwise(F.col("start"))).withColumn("end", F.when(new, F.col("new_end")).otherwise(F.col("end"))).select(*turns.columns, "outcome")


def anchor_errors(turns: DataFrame, words: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, seg_idx, error: how far the word that matches a turn's first token is from the turn's start; turns without a match have none.

    turns: by, seg_idx, start, n_tokens in order.  words: by, j (place), start.  blocks: equal ones.
    """
    opens = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*by).orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    first = turns.withColumn("i", opens).where("n_tokens > 0").select(*by, "seg_idx", "i", F.col("start").alias("t_start"))
    return first.join(_pairs(blocks, by), [*by, "i"]).join(words.select(*by, "j", F.col("start").alias("w_start")), [*by, "j"]).select(*by, "seg_idx", F.abs(F.col("w_start") - F.col("t_start")).alias("error"))


def truth_by_content(tokens: DataFrame, owners: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """by, word_idx, truth: the reference speaker of the first of a word's tokens that matches; words without a match have no row.

    tokens: by, i, speaker.  owners: by, j, word_idx.  blocks: equal ones.
    """
    met = owners.join(_pairs(blocks, by), [*by, "j"]).join(tokens.select(*by, "i", "speaker"), [*by, "i"])
    return met.groupBy(*by, "word_idx").agg(F.min_by("speaker", "j").alias("truth"))


def relabelled(words: DataFrame, truth: DataFrame, mapping: DataFrame, by: list[str], longest: int | None = None) -> DataFrame:
    """Words under the reference's names, with true speakers in runs of at most ``longest`` words; was (the name before), is_anchored, is_changed.

    mapping: by, speaker, name; labels without a counterpart keep their own.
    """
    label = F.coalesce(F.nullif("speaker", F.lit("")), F.lit(UNKNOWN))
    named = words.withColumn("speaker", label).join(mapping.select(*by, "speaker", "name"), [*by, "speaker"], "left").withColumn("speaker", F.coalesce("name", "speaker")).drop("name")
    w = Window.partitionBy(*by).orderBy("word_idx")
    starts = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    runs = islands.islands(named, by, ["word_idx"], starts, "run").withColumn("n", F.count("*").over(Window.partitionBy(*by, "run")))
    short = F.lit(True) if longest is None else F.col("n") <= longest
    joined = runs.join(truth, [*by, "word_idx"], "left").withColumn("is_anchored", F.col("truth").isNotNull() & short)
    return joined.withColumn("was", F.col("speaker")).withColumn("is_changed", F.col("is_anchored") & (F.col("truth") != F.col("speaker"))).withColumn("speaker", F.when(F.col("is_anchored"), F.col("truth")).otherwise(F.col("speaker"))).drop("run", "n", "truth")


def word_accuracy(words: DataFrame, turns: DataFrame, by: list[str]) -> DataFrame:
    """by, correct, scored: words whose middle a turn holds (the last that starts by it), and how many have its speaker."""
    from parlance.operators.intervals import as_of

    points = words.select(*by, F.col("word_idx").alias("point"), ((F.col("start") + F.col("end")) / 2).alias("t"))
    held = as_of(points, turns, by).where("speaker is not null").select(*by, F.col("point").alias("word_idx"), F.col("speaker").alias("truth"))
    return words.join(held, [*by, "word_idx"]).groupBy(*by).agg(F.count_if(F.col("speaker") == F.col("truth")).alias("correct"), F.count("*").alias("scored"))


def dominant_timeline(left: DataFrame, right: DataFrame, levels: DataFrame, by: list[str], bucket: float = 600.0) -> DataFrame:
    """by, start, end, speaker: elementary intervals of two channels' speech; where both speak, the louder one (the left if equal).

    left and right: by, start, end.  levels: by, t, left_power, right_power of short frames;
    between interval ends the sums of power decide, as mean levels in decibels would.
    """
    from parlance.operators.intervals import bucketed_overlap_join

    sides = left.select(*by, F.lit("LEFT").alias("side"), "start", "end").unionByName(right.select(*by, F.lit("RIGHT").alias("side"), "start", "end"))
    edges = sides.select(*by, F.explode(F.array("start", "end")).alias("l_start")).distinct()
    cells = edges.withColumn("l_end", F.lead("l_start").over(Window.partitionBy(*by).orderBy("l_start"))).where("l_end - l_start >= 1e-6")
    held = bucketed_overlap_join(cells, sides.select(*by, "side", F.col("start").alias("r_start"), F.col("end").alias("r_end")), by, bucket)
    active = held.groupBy(*by, "l_start", "l_end").agg(F.bool_or(F.col("side") == "LEFT").alias("on_left"), F.bool_or(F.col("side") == "RIGHT").alias("on_right"))
    both = active.where("on_left and on_right").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("l_start") / bucket), F.floor(F.col("l_end") / bucket))))
    loud = both.join(levels.withColumn("bucket", F.floor(F.col("t") / bucket)), [*by, "bucket"]).where("t >= l_start and t < l_end").groupBy(*by, "l_start", "l_end").agg((F.sum("left_power") >= F.sum("right_power")).alias("left_wins"))
    out = active.join(loud, [*by, "l_start", "l_end"], "left")
    who = F.when(F.col("on_left") & (~F.col("on_right") | F.coalesce("left_wins", F.lit(True))), "LEFT").otherwise("RIGHT")
    return out.select(*by, F.col("l_start").alias("start"), F.col("l_end").alias("end"), who.alias("speaker"))


def insertion_blocks(steps: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """by, block, first, last (half-open places of the hypothesis), ref_at, category, counts: runs of inserted tokens of at least ``least``, with the commonest kind (ties to the one that comes first).

    steps: by, step, tag, i, j, kind (of inserted tokens), in order of step.
    """
    w = Window.partitionBy(*by).orderBy("step")
    starts = (F.col("tag") == "insert") & ~F.col("tag").eqNullSafe(F.lag("tag").over(w))
    each = islands.islands(steps, by, ["step"], starts, "block").where("tag = 'insert'")
    kinds = each.groupBy(*by, "block", "kind").agg(F.count("*").alias("n"), F.min("j").alias("at"), F.max("j").alias("to"), F.min("i").alias("ref_at"))
    return kinds.groupBy(*by, "block").agg(
        F.min("at").cast("long").alias("first"), (F.max("to") + 1).cast("long").alias("last"), F.min("ref_at").cast("long").alias("ref_at"), F.max_by("kind", F.struct(F.col("n"), -F.col("at"))).alias("category"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), " ").alias("counts"),
    ).where(F.col("last") - F.col("first") >= least).drop("block")
