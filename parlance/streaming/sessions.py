"""Turns of a live transcript, and incremental scoring of finished files.  Beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_turns(words: DataFrame, gap: str = "2 seconds", late: str = "30 seconds") -> DataFrame:
    """Turns of each visit and speaker from words with an event time ``ts``: a pause of ``gap`` ends one.

    Words later than the watermark are dropped; state is kept for open turns only.
    """
    return (
        words.withWatermark("ts", late).groupBy("visit", "speaker", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n_words")).select("visit", "speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_words")
    )


def score_each(batch_scores, sink: str):
    """A foreachBatch function: scores each batch of new files and appends the result under its epoch, so that a repeated epoch overwrites itself."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch_scores(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return run
