"""Queries on corrected transcripts and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import repair
from parlance.plans import derived as D
from parlance.plans.derived import ALIGN_SQL, BY, SEGMENTS_SQL, WORDS_SQL


def applied_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.words(spark, sf_dir)
    labels = w.where("word_idx % 9 = 0").select("conv_id", "word_idx", F.lit("DATE").alias("label"))
    return repair.apply_labels(w, labels, BY).select("conv_id", "word_idx", "word", F.coalesce("redacted_from", F.lit("-")).alias("redacted_from"))


def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.words(spark, sf_dir)
    changes = w.where("word_idx % 6 = 0").select("conv_id", "word_idx", F.lit("user").alias("new"))
    after = repair.apply_changes(w, changes, BY, "rule")
    return after.groupBy("conv_id", "speaker").agg(F.count("*").alias("n"), F.count("speaker_by").alias("moved"))


def intact_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = D.words(spark, sf_dir), D.system_words(spark, sf_dir)
    return repair.differences(w, h, BY).groupBy("conv_id").agg(F.count_if(F.col("b").isNull()).alias("lost"), F.count_if(F.col("b").isNotNull()).alias("changed"))


def attached_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gather = lambda df: df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("word_idx", T.token(F.col("word")).alias("t"), "speaker"))).alias("x"))
    a, b = gather(D.words(spark, sf_dir)), gather(D.system_words(spark, sf_dir)).withColumnRenamed("x", "y")
    pairs = a.join(b, "conv_id").select("conv_id", F.col("x.t").alias("ref"), F.col("x.speaker").alias("speakers"), F.col("y.t").alias("hyp"))
    return repair.attach_speakers(pairs, BY).where("word_idx is not null").drop("dropped")


def cohort_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").select("o_custkey", repair.split_by_key(F.col("o_custkey"), {"train": 0.5, "development": 0.25, "test": 0.25}, 7).alias("part"))
    return o.groupBy("part").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))


def others_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repair.ranges_of_others(D.segments(spark, sf_dir), ["room"], "speaker", ["S0", "S1", "S2", "S3"])
    return r.groupBy("room", "left_out").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("pieces"))


QUERIES = {
    "applied_labels": (applied_labels, f"""WITH {WORDS_SQL} SELECT conv_id, i AS word_idx, CASE WHEN i % 9 = 0 THEN '[DATE]' || regexp_extract(word, '(?:[''’]s)?[.,!?;:]*$', 0) ELSE word END AS word,
        CASE WHEN i % 9 = 0 THEN word ELSE '-' END AS redacted_from FROM w"""),
    "applied_changes": (applied_changes, f"""WITH {WORDS_SQL} SELECT conv_id, CASE WHEN i % 6 = 0 THEN 'user' ELSE speaker END AS speaker, count(*) AS n, count_if(i % 6 = 0 AND speaker <> 'user') AS moved FROM w GROUP BY 1, 2"""),
    "intact_words": (intact_words, f"""WITH {WORDS_SQL}, d AS (SELECT w.conv_id, h.i IS NULL AS gone FROM w LEFT JOIN h ON w.conv_id = h.conv_id AND w.i = h.i WHERE h.i IS NULL OR w.word <> h.word)
        SELECT conv_id, count_if(gone) AS lost, count_if(NOT gone) AS changed FROM d GROUP BY conv_id"""),
    "cohort_split": (cohort_split, """WITH a AS (SELECT o_custkey, CAST('0x' || substr(md5('7:' || o_custkey), 1, 8) AS BIGINT) / 4294967296.0 AS x FROM orders)
        SELECT CASE WHEN x < 0.5 THEN 'train' WHEN x < 0.75 THEN 'development' ELSE 'test' END AS part, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM a GROUP BY 1"""),
    "others_ranges": (others_ranges, f"""WITH {SEGMENTS_SQL}, n AS (SELECT DISTINCT speaker AS left_out FROM seg), x AS (SELECT room, left_out, s, e FROM seg JOIN n ON speaker <> left_out),
        a AS (SELECT *, max(e) OVER (PARTITION BY room, left_out ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM x),
        b AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY room, left_out ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a),
        c AS (SELECT room, left_out, min(s) AS s, max(e) AS e FROM b GROUP BY room, left_out, g) SELECT room, left_out, sum(e - s) AS covered, count(*) AS pieces FROM c GROUP BY 1, 2"""),
    "attached_speakers": (attached_speakers, f"""WITH RECURSIVE {WORDS_SQL}, {ALIGN_SQL}, mt AS (SELECT conv_id, j1 + k AS j, least(i1 + k, i2 - 1) AS i FROM (SELECT *, unnest(range(j2 - j1)) AS k FROM bl WHERE i2 > i1)),
        sp AS (SELECT hj.conv_id, hj.j, w.speaker FROM hj LEFT JOIN mt ON mt.conv_id = hj.conv_id AND mt.j = hj.j LEFT JOIN w ON w.conv_id = mt.conv_id AND w.i = mt.i)
        SELECT conv_id, j AS word_idx, coalesce(last_value(speaker IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY j), first_value(speaker IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker,
          CASE WHEN speaker IS NULL THEN 'inserted' ELSE 'matched' END AS origin FROM sp"""),
}
