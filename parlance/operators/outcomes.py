"""What became of each human turn in a system's transcript: heard at all, recovered in words, and under the right speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import intervals, streams

#: Seconds by which times may be off, narrowly and widely.
TOLERANCE, WIDE = 0.5, 3.0
#: Names of roles; turns of any other speaker are unnamed.
ROLES = ("INTERVIEWER", "PARTICIPANT")
#: Upper edges, in seconds, of the lengths of turns and of the turns before them.
LENGTHS, PREVIOUS = [1, 2, 5, 15], [1, 2, 5, 15]


def turn_outcomes(turns: DataFrame, words: DataFrame, by: list[str], lengths: list[float] = LENGTHS, previous: list[float] = PREVIOUS, roles: tuple[str, ...] = ROLES) -> DataFrame:
    """One row for each turn of a visit that has both sides.

    inside: words that overlap the turn.  recovered and recovered_wide: the share of the turn's
    content tokens, each as often as it stands there, that words within the tolerances have; null
    for turns without any.  speaker: the name in capitals without its colon if it is a role's, else
    ``unnamed (NAME)``.  nearest_word: the gap to the nearest word where none is inside.  One
    join at the widest tolerance serves all of it.
    """
    whole = turns.withColumn("end", F.greatest("start", F.coalesce("end", "start")))
    mapping = streams.matched_streams(streams.reference_streams(turns, by), streams.word_streams(words, by), by).withColumnRenamed("a_speaker", "speaker")
    heard = words.where("start is not null").select(*by, F.col("start").alias("r_start"), F.greatest("start", F.coalesce("end", "start")).alias("r_end"), F.col("end").isNotNull().alias("timed"), F.coalesce(F.nullif("speaker", F.lit("")), F.lit(intervals.UNKNOWN)).alias("who"), "word")
    left = whole.join(mapping, [*by, "speaker"], "left").select(*by, "seg_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "b_speaker", (F.col("start") - WIDE).alias("l_start"), (F.col("end") + WIDE).alias("l_end"))
    pairs = intervals.bucketed_overlap_join(left, heard, by, 600.0)
    inside = F.col("timed") & (F.col("r_end") > F.col("t_start")) & (F.col("r_start") < F.col("t_end"))
    counts = pairs.groupBy(*by, "seg_idx").agg(F.count_if(inside).alias("hyp_words"), F.count_if(inside & (F.col("who") == F.col("b_speaker"))).alias("speaker_words"))
    near = (F.col("r_start") < F.col("t_end") + TOLERANCE) & (F.col("r_end") > F.col("t_start") - TOLERANCE)
    have = pairs.select(*by, "seg_idx", near.alias("near"), F.explode(T.content_tokens(F.col("word"))).alias("token")).groupBy(*by, "seg_idx", "token").agg(F.count_if("near").alias("have"), F.count("*").alias("have_wide"))
    need = whole.select(*by, "seg_idx", F.explode(T.content_tokens(F.col("text"))).alias("token")).groupBy(*by, "seg_idx", "token").agg(F.count("*").alias("need"))
    found = lambda c: F.sum(F.least("need", F.coalesce(c, F.lit(0)))) / F.sum("need")
    recovered = need.join(have, [*by, "seg_idx", "token"], "left").groupBy(*by, "seg_idx").agg(found("have").alias("recovered"), found("have_wide").alias("recovered_wide"))
    gaps = intervals.nearest_word(whole, words, by)
    both = whole.join(heard.where("timed").select(*by).distinct(), by, "left_semi")
    rows = both.join(counts, [*by, "seg_idx"], "left").join(recovered, [*by, "seg_idx"], "left").join(gaps, [*by, "seg_idx"], "left").fillna(0, ["hyp_words", "speaker_words"])
    length = F.col("end") - F.col("start")
    before = F.lag(length).over(Window.partitionBy(*by).orderBy("seg_idx"))
    lost, alone = F.col("hyp_words") == 0, F.col("speaker_words") == 0
    gap = F.when(lost, F.round("nearest", 3))
    name = F.rtrim(F.upper("speaker"), F.lit(":"))
    speaker = F.when(name.isin(*roles), name).otherwise(F.concat(F.lit("unnamed ("), F.coalesce(name, F.lit("NONE")), F.lit(")")))
    return rows.select(
        *by, "seg_idx", speaker.alias("speaker"), F.round("recovered", 4).alias("recovered"), F.coalesce(F.col("recovered") == 0, F.lit(False)).alias("content_lost"), F.coalesce(F.col("recovered") < 0.5, F.lit(False)).alias("content_mostly_lost"),
        F.round("recovered_wide", 4).alias("recovered_wide"), F.coalesce(F.col("recovered_wide") == 0, F.lit(False)).alias("content_lost_wide"), F.round(length, 3).alias("length"),
        T.length_bucket(length, lengths).alias("length_bucket"), F.coalesce(T.length_bucket(before, previous), F.lit("first turn")).alias("previous_bucket"), F.size(T.words_of(F.col("text"))).cast("long").alias("ref_words"), "hyp_words",
        lost.alias("lost_entirely"), (lost & (gap.isNull() | (gap > TOLERANCE))).alias("lost_beyond_tolerance"), alone.alias("lost_to_speaker"), (~lost & alone).alias("wrong_speaker"), gap.alias("nearest_word"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 4)


def summary(rows: DataFrame, shortest: str = f"<{LENGTHS[0]:g}s") -> DataFrame:
    """Counts and rates of all turns, by length, by the turn before, by speaker, and of the shortest by the turn before, from one pass over grouping sets; ``-`` where a column isn't split by.

    Misattributed turns have their words in the transcript, so they and lost ones can be stacked.
    """
    scored = F.col("recovered").isNotNull()
    keys = ["length_bucket", "previous_bucket", "speaker"]
    sets = [[], ["length_bucket"], ["previous_bucket"], ["speaker"], ["length_bucket", "previous_bucket"]]
    far = F.when(F.col("lost_entirely"), F.col("nearest_word"))
    sums = rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, keys)).agg(
        F.grouping_id().alias("g"), F.count("*").alias("turns"), F.count_if(scored).alias("content_scored"), F.count_if("content_lost").alias("content_lost"), F.count_if("content_mostly_lost").alias("content_mostly_lost"),
        F.count_if("content_lost_wide").alias("content_lost_wide"), F.count_if(scored & F.col("wrong_speaker") & ~F.col("content_lost")).alias("misattributed"), F.avg("recovered").alias("recovered_mean"),
        F.count_if("lost_entirely").alias("lost_entirely"), F.count_if("lost_beyond_tolerance").alias("lost_beyond_tolerance"), F.count_if("lost_to_speaker").alias("lost_to_speaker"),
        F.count(far).alias("far"), F.count_if(far <= 0.25).alias("far_quarter"), F.count_if(far <= 1.0).alias("far_one"), F.count_if(far > 5.0).alias("far_five"),
    )
    kept = sums.where((F.col("g") != 1) | (F.col("length_bucket") == shortest))
    rate = lambda c, of: _share(F.col(c), F.col(of)).alias(f"{c}_rate")
    return kept.select(
        *[F.coalesce(c, F.lit("-")).alias(c) for c in keys], "turns", "content_scored", "content_lost", "content_mostly_lost", "content_lost_wide", "misattributed", "lost_entirely", "lost_beyond_tolerance", "lost_to_speaker",
        *[rate(c, "content_scored") for c in ("content_lost", "content_mostly_lost", "content_lost_wide", "misattributed")], F.round("recovered_mean", 4).alias("recovered_mean"),
        rate("lost_entirely", "turns"), _share(F.col("lost_beyond_tolerance"), F.col("turns")).alias("lost_rate"), rate("lost_to_speaker", "turns"),
        F.col("far").alias("lost_with_distance"), _share(F.col("far_quarter"), F.col("far")).alias("within_quarter"), _share(F.col("far_one"), F.col("far")).alias("within_one"), _share(F.col("far_five"), F.col("far")).alias("over_five"),
    )


def distance_bins(summary: DataFrame, by: list[str]) -> DataFrame:
    """Shares of lost turns by the distance of the nearest word, made disjoint and never below 0."""
    part = lambda c: F.greatest(F.round(c, 4), F.lit(0.0))
    near, one, far = F.col("within_quarter"), F.col("within_one"), F.col("over_five")
    return summary.where("lost_with_distance > 0").select(*by, near.alias("to_quarter"), part(one - near).alias("to_one"), part(1 - one - far).alias("to_five"), far.alias("beyond"))


def outcome_shares(summary: DataFrame, by: list[str]) -> DataFrame:
    """Shares of turns whose words are lost, stand under another speaker, or neither."""
    lost, wrong = F.col("content_lost_rate"), F.col("misattributed_rate")
    return summary.where("content_scored > 0").select(*by, lost.alias("lost"), wrong.alias("misattributed"), F.round(1 - lost - wrong, 4).alias("kept"))
