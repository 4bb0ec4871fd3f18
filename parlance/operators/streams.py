"""Speaker streams of a visit and what they are scored by: who matches whom, word errors by speaker, attribution, diarization variants.

Reference turns: by, seg_idx, speaker, start, end, text.  Words: by, word_idx, word, start, end,
speaker.  ``by`` names the columns of one visit, the equality key of every join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import align, intervals, visit
from parlance.operators.intervals import UNKNOWN
from parlance.operators.visit import Visit

#: Words, normalized, below which a reference stream counts as a stray line.
LEAST_WORDS = visit.LEAST_WORDS
#: Collar in seconds and whether overlapped speech is left out, by the name of the variant.
VARIANTS = {"der": (0.0, False), "der_collar0.25": (0.25, False), "der_skipoverlap": (0.0, True), "der_collar0.25_skipoverlap": (0.25, True)}


def _stream(df: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    span = F.struct(F.col("start").cast("double").alias("start"), F.greatest("start", F.coalesce("end", "start")).cast("double").alias("end"))
    # Collected apart, so that who asks for one of them doesn't gather the other.
    held = lambda what: F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("at"), what.alias("x"))))["x"]
    return df.groupBy(*by, "speaker").agg(F.array_join(held(F.col(text)), " ").alias("text"), held(span).alias("spans"))


def reference_streams(turns: DataFrame, by: list[str]) -> DataFrame:
    """by, speaker, text (all turns in order) and spans; a turn without an end ends where it starts."""
    return _stream(turns, by, "seg_idx", "text")


def word_streams(words: DataFrame, by: list[str]) -> DataFrame:
    """The same of timed words; those without a speaker are UNKNOWN's."""
    timed = words.where("start is not null and end is not null").withColumn("speaker", F.coalesce(F.nullif("speaker", F.lit("")), F.lit(UNKNOWN)))
    return _stream(timed, by, "word_idx", "word")


def without_strays(streams: DataFrame, by: list[str], least: int = LEAST_WORDS) -> DataFrame:
    """Streams of at least ``least`` normalized words, with ``strays``, the number left out; all where none would be left."""
    w = Window.partitionBy(*by)
    enough = F.size(T.words_of(T.headline(F.col("text")))) >= least
    marked = streams.withColumn("enough", enough).withColumn("any", F.max("enough").over(w)).withColumn("strays", F.when(F.col("any"), F.count_if(~F.col("enough")).over(w)).otherwise(0).cast("long"))
    return marked.where("enough or not any").drop("enough", "any")


def matched_streams(reference: DataFrame, hypothesis: DataFrame, by: list[str]) -> DataFrame:
    """by, a_speaker, b_speaker: the assignment of streams with the most overlap, each at most once."""
    timed = lambda df: df.select(*by, "speaker", F.sort_array(F.filter("spans", lambda s: s["start"].isNotNull())).alias("spans"))
    return intervals.assign_labels(intervals.swept_overlaps(timed(reference), timed(hypothesis), by), by).select(*by, "a_speaker", "b_speaker")


def stream_scores(reference: DataFrame, hypothesis: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """by, speaker, matched, raw (word error rate; 1 if unmatched or without words), capped (at most 1) and cues of each reference stream that has words."""
    ref = reference.select(*by, "speaker", T.headline(F.col("text")).alias("ref_text")).where("ref_text <> ''")
    hyp = hypothesis.select(*by, F.col("speaker").alias("b_speaker"), T.headline(F.col("text")).alias("hyp_text"))
    paired = ref.join(mapping.withColumnRenamed("a_speaker", "speaker"), [*by, "speaker"], "left").join(hyp, [*by, "b_speaker"], "left").withColumn("hyp_text", F.coalesce("hyp_text", F.lit("")))
    keyed = paired.select(*by, "speaker", F.col("b_speaker").alias("matched"), "ref_text", "hyp_text", T.cue_score(F.col("ref_text"), F.col("hyp_text")).alias("cues"))
    errors = align.word_errors(keyed.select(*by, "speaker", T.words_of(F.col("ref_text")).alias("ref"), T.words_of(F.col("hyp_text")).alias("hyp")), [*by, "speaker"]).select(*by, "speaker", "wer")
    raw = F.when(F.col("hyp_text") == "", 1.0).otherwise(F.col("wer"))
    return keyed.join(errors, [*by, "speaker"]).select(*by, "speaker", "matched", raw.alias("raw"), F.least(raw, F.lit(1.0)).alias("capped"), "cues")


def stream_means(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, streams, swer (mean of capped rates), swer_uncapped, qtp."""
    return scores.groupBy(*by).agg(F.count("*").alias("streams"), F.avg("capped").alias("swer"), F.avg("raw").alias("swer_uncapped"), F.avg("cues").alias("qtp"))


def reassigned(words: DataFrame, reference: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """Words with ``moved``: timed words of speakers that match nobody go to the match of the reference speaker they overlap most, as a sweep in order of starts finds it, else of the one with the nearest boundary (ties by name).

    Visits in which nothing is matched stay as they are.
    """
    who = F.coalesce(F.nullif("speaker", F.lit("")), F.lit(UNKNOWN))
    known = mapping.select(*by, F.col("b_speaker").alias("who")).distinct().withColumn("known", F.lit(True))
    orphans = words.where("start is not null and end is not null").withColumn("who", who).join(known, [*by, "who"], "left").where("known is null")
    orphans = orphans.select(*by, "word_idx", F.col("start").cast("double").alias("w_start"), F.greatest("start", "end").cast("double").alias("w_end"))
    spans = reference.join(mapping, [*(reference[c] == mapping[c] for c in by), reference["speaker"] == mapping["a_speaker"]]).select(*(reference[c] for c in by), "a_speaker", "b_speaker", F.explode("spans").alias("s")).select(*by, "a_speaker", "b_speaker", "s.*")
    # The sweep leaves a word at the first span that ends after it; what stands before that ended earlier.
    reach = F.max("end").over(Window.partitionBy(*by, "a_speaker").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    timed = spans.withColumn("reach", reach).withColumnsRenamed({"start": "r_start", "end": "r_end"})
    met = intervals.bucketed_overlap_join(orphans.withColumnsRenamed({"w_start": "l_start", "w_end": "l_end"}), timed, by, 600.0)
    counts = F.col("reach").isNull() | (F.col("reach") <= F.col("l_end"))
    shared = met.groupBy(*by, "word_idx", "a_speaker").agg(F.sum(F.when(counts, F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).otherwise(0.0)).alias("shared"))
    # Nearest boundaries from a sorted union of a speaker's boundaries and the words; a visit has few matched speakers.
    asked = orphans.join(mapping.select(*by, "a_speaker", "b_speaker"), by).select(*by, "a_speaker", "b_speaker", "word_idx", F.col("w_start").alias("x"), F.lit(None).cast("double").alias("edge"))
    edges = spans.select(*by, "a_speaker", "b_speaker", F.lit(None).cast("long").alias("word_idx"), F.explode(F.array("start", "end")).alias("x")).withColumn("edge", F.col("x"))
    line = Window.partitionBy(*by, "a_speaker").orderBy("x")
    before = F.last("edge", ignorenulls=True).over(line.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("edge", ignorenulls=True).over(line.rangeBetween(0, Window.unboundedFollowing))
    near = align.dealt(asked.withColumn("word_idx", F.col("word_idx").cast("long")).unionByName(edges), by).withColumn("near", F.least(F.col("x") - before, after - F.col("x"))).where("word_idx is not null and near is not null")
    each = near.join(shared.withColumn("word_idx", F.col("word_idx").cast("long")), [*by, "word_idx", "a_speaker"], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    best = each.groupBy(*by, "word_idx").agg(F.min_by("b_speaker", F.struct(-F.col("shared"), F.col("near"), F.col("a_speaker"))).alias("new"))
    return words.join(best, [*by, "word_idx"], "left").withColumn("moved", F.col("new").isNotNull()).withColumn("speaker", F.coalesce("new", "speaker")).drop("new")


def relabelled_word_errors(ref: DataFrame, hyp: DataFrame, by: list[str]) -> DataFrame:
    """by, der, speaker_errors, total_correct_words, shift: how many of the words that both sides share have another speaker, under the best cyclic renaming of the hypothesis's speakers.

    ref and hyp: by, place, token, speaker; speakers of the hypothesis are numbers, with or without
    an S before them, and ``shift`` is added to them (S1 to S2, the last to S1); the least shift of
    the best wins.  Where every shared word is wrong under all of them, or the hypothesis has no
    words, the rate is 1, and the names stay (shift is null, no word is counted).  Speakers travel
    beside the tokens, so words never meet one by one.
    """
    listed = lambda df: df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("place", "token", "speaker"))).alias("x"))
    side = lambda df, tokens, speaker: listed(df).select(*by, F.col("x.token").alias(tokens), F.col("x.speaker").alias(speaker))
    both = side(ref, "ref", "r").join(side(hyp, "hyp", "h"), by, "left").withColumn("speakers", F.size(F.array_distinct(F.array_compact("h"))).cast("long"))
    met = F.zip_with("i", "j", lambda i, j: F.struct(F.get("r", i).alias("r"), F.get("h", j).alias("h")))
    paired = align.edit_hits(both, [*by, "r", "h", "speakers"]).select(*by, F.when(F.col("h").isNotNull(), F.col("speakers")).alias("speakers"), F.explode_outer(met).alias("x"))
    counts = paired.groupBy(*by, "speakers", F.col("x.r").alias("r"), F.col("x.h").alias("h")).agg(F.count("x").alias("n"))
    number = F.regexp_extract("h", "^S?(.*)$", 1).cast("int")
    shifted = counts.withColumn("shift", F.explode_outer(F.sequence(F.lit(0), F.col("speakers").cast("int") - 1)))
    named = F.concat(F.lit("S"), (F.pmod(number - 1 + F.col("shift"), F.col("speakers")) + 1).cast("string"))
    each = shifted.groupBy(*by, "speakers", "shift").agg(F.coalesce(F.sum(F.when(F.col("r") != named, F.col("n"))), F.lit(0)).alias("errors"), F.sum("n").alias("total"))
    best = each.groupBy(*by, "speakers").agg(F.min(F.when(F.col("total") > 0, F.struct("errors", "shift", "total"))).alias("b"))
    kept = F.col("b.errors") < F.col("b.total")
    spoken = F.col("speakers").isNotNull()
    return best.select(
        *by, F.when(kept, F.col("b.errors") / F.col("b.total")).when(spoken & F.col("b").isNull(), 0.0).otherwise(1.0).alias("der"), F.coalesce(F.when(kept, F.col("b.errors")), F.lit(0)).alias("speaker_errors"),
        F.coalesce(F.when(kept, F.col("b.total")), F.lit(0)).alias("total_correct_words"), F.when(kept, F.col("b.shift")).when(spoken & F.col("b").isNull(), 0).alias("shift"),
    )


SCORES = (
    "wer double, wer_sub double, wer_del double, wer_ins double, wer_no_ins double, streams long, swer double, swer_uncapped double, qtp double, swer_unmatched_dropped double, "
    "unmatched_hyp_words long, phantom_streams long, der double, der_confusion double"
)


def visit_scores(turns: DataFrame, words: DataFrame, by: list[str], collar: float = 0.25) -> DataFrame:
    """One row for each visit that has words on both sides: pooled word errors and their kinds, errors by stream before and after words of unmatched speakers are charged, cues, diarization error.

    Text is pooled in order of time, whoever speaks.  Turns and words of a visit meet once, in one
    task, where ``Visit`` does for it what the operators above do for tables.
    """
    kinds = dict(turns.dtypes)
    fields = [f.split()[0] for f in SCORES.split(", ")]
    seconds = lambda c: F.col(c).cast("double").alias(c)
    said = turns.select(*by, F.col("seg_idx").cast("long").alias("at"), F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker"), seconds("start"), seconds("end"), "text")
    heard = words.select(*by, F.col("word_idx").cast("long").alias("at"), "speaker", seconds("start"), seconds("end"), F.col("word").alias("text"))
    types = [pa.int64() if f.split()[1] == "long" else pa.float64() for f in SCORES.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [t.select(["at", "text", "speaker", "start", "end"]).to_pylist() for t in (left, right)]
        row = Visit(*rows).scores(collar) if rows[0] and rows[1] else None
        keys = [left.column(c).slice(0, 1 if row else 0) for c in by]
        return pa.table([*keys, *[pa.array([row[f]] if row else [], t) for f, t in zip(fields, types)]], names=[*by, *fields])

    return align.dealt(said, by).groupBy(*by).cogroup(align.dealt(heard, by).groupBy(*by)).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + SCORES)


def diarization(turns: DataFrame, words: DataFrame, by: list[str], collar: float = 0.25) -> DataFrame:
    """by, der, der_confusion: the system's words tiled as the reference is, so that pauses cost neither side."""
    from parlance.operators.islands import tiled_spans

    tiled = tiled_spans(words, by)
    ref = turns.select(*by, "speaker", "start", F.greatest("start", F.coalesce("end", "start")).alias("end"))
    mapping = intervals.assign_labels(intervals.overlap_lengths(ref, tiled, by), by)
    return rates(intervals.error_rate(ref, tiled, by, mapping, collar=collar)).select(*by, "der", F.try_divide("confusion", "total").alias("der_confusion"))


def rates(times: DataFrame) -> DataFrame:
    """With der: missed, false and confused time over the reference's; null where that is empty."""
    return times.withColumn("der", F.try_divide(F.col("missed") + F.col("false_alarm") + F.col("confusion"), F.col("total")))


def diarization_variants(reference: DataFrame, hypothesis: DataFrame, by: list[str], mapping: DataFrame, variants: dict[str, tuple[float, bool]] = VARIANTS) -> DataFrame:
    """Times and rate of each visit under each variant of collar and overlap; one sweep with the variant as a key, repeated after rows are dealt."""
    pick = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("variant")]
    collar, skip = pick({name: c for name, (c, _) in variants.items()}), pick({name: s for name, (_, s) in variants.items()})
    each = lambda df: df.withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    times = intervals.swept_errors(reference, intervals.named_speakers(hypothesis, by, mapping), ["variant", *by], collar, skip, each)
    return rates(times).select("variant", *by, "missed", "false_alarm", "confusion", "total", "der")


def _agreed(counts: dict[tuple[str, str], int]) -> tuple[int, int]:
    """Most words that agree under a one-to-one reading of the first labels, and all words."""
    pred, gold = sorted({p for p, _ in counts})[:6], {g for _, g in counts}
    first = set(pred[: min(len(pred), len(gold))])
    held = {k: float(n) for k, n in counts.items() if k[0] in first}
    return int(sum(held[k] for k in intervals._best(held))), sum(counts.values())


def attribution(words: DataFrame, segments: DataFrame, by: list[str], bucket: float = 3600.0) -> DataFrame:
    """by, correct, scored: words whose middle a segment (the first that does) holds, and how many of them have its speaker under the best one-to-one reading of labels.

    Of more predicted labels than true ones only the first by name can be read as any, and of
    more than six the first six.
    """
    points = words.select(*by, "word_idx", F.coalesce(F.nullif("speaker", F.lit("")), F.lit(UNKNOWN)).alias("pred"), ((F.col("start") + F.col("end")) / 2).alias("at")).where("at is not null")
    held = segments.select(*by, "seg_idx", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("speaker").alias("gold")).where("r_end >= r_start").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("r_start") / bucket), F.floor(F.col("r_end") / bucket))))
    inside = points.withColumn("bucket", F.floor(F.col("at") / bucket)).join(held, [*by, "bucket"]).where("r_start <= at and at <= r_end")
    gold = inside.groupBy(*by, "word_idx", "pred").agg(F.min_by("gold", "seg_idx").alias("gold"))
    counts = gold.groupBy(*by, "pred", "gold").agg(F.count("*").alias("n"))
    kinds = dict(words.dtypes)

    held = counts.groupBy(*by).agg(F.collect_list(F.struct("pred", "gold", "n")).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [_agreed({(x["pred"], x["gold"]): x["n"] for x in row}) for row in batch.column("held").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *[pa.array([b[k] for b in best], pa.int64()) for k in (0, 1)]], names=[*by, "correct", "scored"])

    return held.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", correct long, scored long")
