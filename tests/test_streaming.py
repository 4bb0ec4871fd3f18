"""Streams: turns, windows and scores of live visits."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import retime
from parlance.streaming import folds
from parlance.streaming.sessions import live_turns, score_each

SCHEMA = "visit string, word_idx long, speaker string, ts timestamp, ts_end timestamp"


def streamed(spark, tmp_path, batches, make, name):
    """What the stream has said once all batches are in, each a file of its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.PROVIDER)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "visit string, word_idx long, speaker string, s double, e double").select(
            "visit", "word_idx", "speaker", F.timestamp_micros((F.col("s") * 1000000).cast("long")).alias("ts"), F.timestamp_micros((F.col("e") * 1000000).cast("long")).alias("ts_end")
        ).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(name).collect()


def spoken(seed, n=160):
    """Words of two visits with pauses, in nearly the order of time, in batches; at last one that moves the watermark."""
    rng = random.Random(seed)
    words = []
    for visit in ("v", "w"):
        at, who = 1000.0, "A"
        for k in range(n):
            at += rng.choice([0.25, 0.5, 0.5, 1.0, 4.0])
            who = rng.choice([who, who, who, "A", "B"])
            words.append((visit, k, who, at, at + 0.25))
    words.sort(key=lambda w: w[3] + rng.random() * 8)
    batches = [words[k : k + 60] for k in range(0, len(words), 60)]
    return sorted(words, key=lambda w: (w[0], w[3], w[1])), [*batches, [("z", 0, "A", 5000.0, 5000.5)], [("z", 1, "A", 5001.0, 5001.5)]]


@pytest.mark.parametrize("rule, make, name", [(folds.Turns(2.0), lambda s: folds.turns_across_speakers(s, 2.0), "live_turn_fold"), (folds.Windows(9.0, 7, 2.0, 3.0), lambda s: folds.limited_windows(s, 9.0, 7, 2.0, 3.0), "live_window_fold")])
def test_folds_equal_those_of_the_whole(spark, tmp_path, rule, make, name):
    words, batches = spoken(4)
    want, held = [], None
    for visit, _, who, s, e in words:
        if held is None or held[0] != visit or rule.closes(folds.Open(0, held[1], held[2], held[3], held[4]), s, e, who):
            held = [visit, who, s, e, 1]
            want.append(held)
        else:
            held[3], held[4] = max(held[3], e), held[4] + 1
    got = streamed(spark, tmp_path, batches, make, name)
    assert {r["visit"] for r in got} == {"v", "w"}
    assert sorted((r["visit"], r["speaker"], round(r["start"], 6), round(r["end"], 6), r["n_words"]) for r in got) == sorted(tuple(w) for w in want)
    assert sorted((r["visit"], r["number"]) for r in got) == sorted((v, k) for v in "vw" for k in range(sum(w[0] == v for w in want)))
    if isinstance(rule, folds.Windows):
        table = spark.createDataFrame([(v, k, s, e, 9999.0) for v in "vw" for k, (_, _, _, s, e) in enumerate(w for w in words if w[0] == v)], "visit string, word_idx long, start double, end double, d double")
        assert sorted((r["visit"], r["word_start"], r["word_end"]) for r in retime.windows(table, ["visit"], "d", 9.0, 7, 2.0, 3.0).collect()) == sorted((w[0], w[2], w[3]) for w in want)


def test_late_words_are_dropped(spark, tmp_path):
    batches = [[("v", 0, "A", 100.0, 100.5)], [("v", 1, "A", 200.0, 200.5)], [("z", 9, "A", 201.0, 201.5)], [("v", 2, "A", 101.0, 101.5), ("v", 3, "A", 201.0, 201.5)], [("z", 0, "A", 500.0, 500.5)], [("z", 1, "A", 501.0, 501.5)]]
    got = streamed(spark, tmp_path, batches, lambda s: folds.turns_across_speakers(s, 2.0), "late_words")
    assert sorted((r["start"], r["end"], r["n_words"]) for r in got if r["visit"] == "v") == [(100.0, 100.5, 1), (200.0, 201.5, 2)]


def test_live_turns(spark, tmp_path):
    """The first turn is over once the watermark has passed it; the second one may still go on."""
    words = spark.range(20).select(F.lit("v").alias("visit"), F.lit("A").alias("speaker"), F.timestamp_seconds(F.col("id") + F.when(F.col("id") >= 10, 100).otherwise(0)).alias("ts"))
    words.write.parquet(f"{tmp_path}/in")
    query = live_turns(spark.readStream.schema(words.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert [r["n_words"] for r in spark.table("turns").collect()] == [10]


def test_an_epoch_overwrites_itself(spark, tmp_path):
    run = score_each(lambda batch: batch.groupBy("visit").agg(F.count("*").alias("n")), f"{tmp_path}/scores")
    for epoch, rows in ((0, ["a", "a"]), (1, ["b"]), (1, ["b"])):
        run(spark.createDataFrame([(x,) for x in rows], "visit string"), epoch)
    assert sorted((r["epoch"], r["visit"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/scores").collect()) == [(0, "a", 2), (1, "b", 1)]
