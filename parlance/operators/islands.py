"""Runs, turns and merged intervals: gaps-and-islands over ordered rows.

``by`` names the columns of one recording; every window is partitioned by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list, starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: ``starts`` (may use lag over the order) is true where a run begins; its first row always does."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _changes(by: list[str], order: list, column: str) -> Column:
    w = Window.partitionBy(*by).orderBy(*order)
    return ~F.col(column).eqNullSafe(F.lag(column).over(w)) | (F.row_number().over(w) == 1)


def speaker_runs(words: DataFrame, by: list[str]) -> DataFrame:
    """by, run, speaker, first, last (half-open word indexes) and n of consecutive words of one speaker."""
    return (
        islands(words, by, ["word_idx"], _changes(by, ["word_idx"], "speaker"), "run").groupBy(*by, "run")
        .agg(F.first("speaker").alias("speaker"), F.min("word_idx").alias("first"), (F.max("word_idx") + 1).alias("last"), F.count("*").alias("n"))
    )


def group_into_turns(words: DataFrame, by: list[str]) -> DataFrame:
    """Consecutive words of a speaker as a turn: from the first word's start to the last word's end."""
    return (
        islands(words, by, ["word_idx"], _changes(by, ["word_idx"], "speaker"), "turn").groupBy(*by, "turn")
        .agg(F.first("speaker").alias("speaker"), F.min_by("start", "word_idx").alias("start"), F.max_by("end", "word_idx").alias("end"),
             F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias("text"), F.count("*").alias("n_words"))
    )


def paused_turns(words: DataFrame, by: list[str], pause: float = 2.0) -> DataFrame:
    """Turns that also break where a word starts more than ``pause`` after the last end known of the turn itself.

    Of the words behind a known end, up to and with the next word that has one, only the first
    that begins a turn can be held against that end: later ones belong to a turn that began after it.
    """
    w = Window.partitionBy(*by).orderBy("word_idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    changes = _changes(by, ["word_idx"], "speaker")
    marked = words.withColumn("changes", changes).withColumn("known", F.last("end", ignorenulls=True).over(before)).withColumn("behind", F.count("end").over(before))
    marked = marked.withColumn("late", F.coalesce(F.col("start") - F.col("known") > pause, F.lit(False)))
    earlier = F.max(F.col("changes") | F.col("late")).over(Window.partitionBy(*by, "behind").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("breaks", F.col("changes") | (F.col("late") & ~F.coalesce(earlier, F.lit(False))))
    return (
        islands(marked, by, ["word_idx"], F.col("breaks"), "turn").groupBy(*by, "turn")
        .agg(F.first("speaker").alias("speaker"), F.min_by("start", "word_idx").alias("start"), F.max_by("end", F.when(F.col("end").isNotNull(), F.col("word_idx"))).alias("end"), F.count("*").alias("n_words"))
    )


def short_run_rule(words: DataFrame, by: list[str], longest: int = 3) -> DataFrame:
    """Runs of at most ``longest`` words whose speaker gives way to the longer neighbour's (a tie to the previous one's), read from the original layout.

    by, run, first, last, old, new.
    """
    w = Window.partitionBy(*by).orderBy("run")
    runs = speaker_runs(words, by).withColumn("pn", F.lag("n").over(w)).withColumn("ps", F.lag("speaker").over(w)).withColumn("nn", F.lead("n").over(w)).withColumn("ns", F.lead("speaker").over(w))
    new = F.when(F.col("nn").isNull() | (F.col("pn") >= F.col("nn")), F.col("ps")).otherwise(F.col("ns"))
    left = runs.where((F.col("n") <= longest) & (F.col("pn").isNotNull() | F.col("nn").isNotNull())).withColumn("new", new)
    return left.where(F.col("new").isNotNull() & (F.col("new") != F.col("speaker"))).select(*by, "run", "first", "last", F.col("speaker").alias("old"), "new")


def merge_close(turns: DataFrame, by: list[str], gap: float = 0.5, order: tuple[str, ...] = ("start", "seg_idx")) -> DataFrame:
    """Consecutive segments of a speaker that start less than ``gap`` after the furthest end before them; empty ones left out."""
    runs = islands(turns.where("end > start"), by, list(order), _changes(by, list(order), "speaker"), "run")
    reach = F.max("end").over(Window.partitionBy(*by, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    starts = reach.isNull() | (F.col("start") - reach >= gap)
    return islands(runs, by, list(order), starts, "seg").groupBy(*by, "seg").agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def merge_touching(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of intervals: those that overlap or touch are one."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    return islands(spans, by, [start, end], reach.isNull() | (F.col(start) > reach), "piece").groupBy(*by, "piece").agg(F.min(start).alias(start), F.max(end).alias(end))


def union_length(spans: DataFrame, by: list[str]) -> DataFrame:
    return merge_touching(spans, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def tiled_spans(words: DataFrame, by: list[str]) -> DataFrame:
    """Runs of a speaker, each reaching to the start of the next run's first word: a tiling like that of a reference whose ends are the next starts."""
    timed = words.where("start is not null and end is not null").withColumn("speaker", F.coalesce(F.nullif("speaker", F.lit("")), F.lit("UNKNOWN")))
    runs = (
        islands(timed, by, ["start", "word_idx"], _changes(by, ["start", "word_idx"], "speaker"), "run").groupBy(*by, "run")
        .agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.greatest(F.max("end"), F.min("start")).alias("end"))
    )
    follows = F.lead("start").over(Window.partitionBy(*by).orderBy("run"))
    return runs.select(*by, "run", "speaker", "start", F.greatest("end", F.coalesce(follows, F.col("end"))).alias("end"))


def sentence_words(words: DataFrame, by: list[str], longest: int = 120) -> DataFrame:
    """Words with part and piece, which tell their sentence: it ends at closing punctuation or after ``longest`` words."""
    w = Window.partitionBy(*by).orderBy("word_idx")
    ended = F.coalesce(F.lag("word").over(w).rlike(r"""[.!?]+["')\]]*$"""), F.lit(True))
    cut = islands(words, by, ["word_idx"], ended, "part")
    place = F.row_number().over(Window.partitionBy(*by, "part").orderBy("word_idx")) - 1
    return cut.withColumn("piece", F.floor(place / longest))


def sentences(words: DataFrame, by: list[str], longest: int = 120) -> DataFrame:
    """by, part, piece, first, last (half-open), n_words of each sentence."""
    each = sentence_words(words, by, longest).groupBy(*by, "part", "piece")
    return each.agg(F.min("word_idx").alias("first"), (F.max("word_idx") + 1).alias("last"), F.count("*").alias("n_words"))


def turn_spans(words: DataFrame, by: list[str], bridge: bool = False) -> DataFrame:
    """by, run, speaker, start, end: timed words' runs of a speaker, in order of word_idx, to the last word's end; bridged, at least to the next run's first start."""
    timed = words.where("start is not null and end is not null")
    runs = (
        islands(timed, by, ["word_idx"], _changes(by, ["word_idx"], "speaker"), "run").groupBy(*by, "run")
        .agg(F.first("speaker").alias("speaker"), F.min_by("start", "word_idx").alias("start"), F.max_by("end", "word_idx").alias("end"))
    )
    follows = F.lead("start").over(Window.partitionBy(*by).orderBy("run"))
    return runs.withColumn("end", F.greatest("end", F.coalesce(follows, "end"))) if bridge else runs


def collapse_placeholders(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring ``[LABEL]`` tokens of one label as one span: by, first, last (half-open), label."""
    label = F.regexp_extract("word", r"\[([A-Z_]+)\]", 1)
    marked = tokens.withColumn("label", label).where("label <> ''")
    w = Window.partitionBy(*by).orderBy("word_idx")
    starts = (F.row_number().over(w) == 1) | (F.col("word_idx") != F.lag("word_idx").over(w) + 1) | (F.col("label") != F.lag("label").over(w))
    return islands(marked, by, ["word_idx"], starts, "span").groupBy(*by, "span").agg(F.min("word_idx").alias("first"), (F.max("word_idx") + 1).alias("last"), F.first("label").alias("label"))


def insertion_kind(words: DataFrame, by: list[str], backchannels: list[str], discourse: list[str]) -> DataFrame:
    """What an inserted word would be: a repetition of one of its two neighbours on either side, a backchannel, a discourse marker or another word."""
    w = Window.partitionBy(*by).orderBy("word_idx")
    word = F.col("word")
    again = F.lit(False)
    for k in (1, 2):
        again = again | F.coalesce(F.lag("word", k).over(w) == word, F.lit(False)) | F.coalesce(F.lead("word", k).over(w) == word, F.lit(False))
    return words.withColumn("kind", F.when(again, "repetition").when(word.isin(backchannels), "backchannel").when(word.isin(discourse), "discourse marker").otherwise("other insertion"))


def monotone_starts(words: DataFrame, by: list[str]) -> DataFrame:
    """Starts raised to the largest start so far."""
    w = Window.partitionBy(*by).orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("start", F.max("start").over(w)).withColumn("end", F.greatest("end", "start"))


def unknown_runs(words: DataFrame, by: list[str]) -> DataFrame:
    """Runs of words without a speaker, as turns of UNKNOWN."""
    plain = words.withColumn("speaker", F.coalesce(F.nullif("speaker", F.lit("")), F.lit("UNKNOWN")))
    return group_into_turns(plain, by).where("speaker = 'UNKNOWN'")


def fill_speakers(words: DataFrame, by: list[str]) -> DataFrame:
    """Missing speakers from the word before, else from the word after."""
    w = Window.partitionBy(*by).orderBy("word_idx")
    before = F.last("speaker", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("speaker", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return words.withColumn("speaker", F.coalesce(before, after, F.lit("UNKNOWN")))
