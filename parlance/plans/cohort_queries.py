"""Queries on cohorts: completeness, samples, leaders and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import cohort, reports
from parlance.plans import derived as D
from parlance.plans.derived import SEGMENTS_SQL, WORDS_SQL
from parlance.plans.report_queries import _metrics


def complete_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as visits, return flags as the categories of their files."""
    l = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("visit"), F.col("l_returnflag").alias("category"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("name"))  # noqa: E741
    return cohort.complete(l, ["visit"], "category", ["A", "N", "R"])


def discovered_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit"), (F.col("o_orderkey") % 3 > 0).alias("has_human"), (F.col("o_custkey") % 5 > 0).alias("has_audio"))
    subset = D.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("visit"))
    return cohort.discovered(o, ["visit"], subset, limit=500).select("visit")


def visit_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with conversations taken as visits."""
    w = D.words(spark, sf_dir).withColumn("start", F.when(F.col("word_idx") % 40 == 39, F.col("start") - F.col("conv_id") % 3).otherwise(F.col("start")))
    facts = w.groupBy("conv_id").agg(F.count("*").alias("human_words"), F.max("end").alias("last_start")).join(cohort.ascends(w, ["conv_id"], "word_idx", "start").withColumnRenamed("ascends", "human_ascends"), "conv_id")
    facts = facts.withColumn("seconds", F.when(F.col("conv_id") % 7 > 0, F.col("conv_id") % 100 + 20.0)).withColumn("vendor_words", F.when(F.col("conv_id") % 5 > 0, F.col("conv_id") % 4)).withColumn("vendor_seconds", F.col("seconds") + F.col("conv_id") % 9).withColumn("vendor_ascends", F.col("conv_id") % 6 > 0)
    return cohort.problems(facts).select("conv_id", F.array_join("problems", "; ").alias("problems"))


def truncated_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("hyp_words", F.col("words") * (1 + F.col("visit") % 4)).withColumn("ref_words", F.col("words"))
    return cohort.truncated(m, ["visit"], "system")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments(spark, sf_dir)
    return cohort.corpus_stats(s.select("room").distinct().withColumn("seconds", F.lit(86400.0)), s, ["room"])


def channel_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = D.segments(spark, sf_dir).select("room", F.when(F.col("room") % 4 == 0, 1).otherwise(2).alias("channels"), F.when(F.col("seg_idx") % 5 > 0, -(F.col("seg_idx") % 11) * 1.0).alias("left_db"), (-(F.col("seg_idx") % 7) * 1.0).alias("right_db"))
    return cohort.channel_separation(e, ["room"])


def better_or_worse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.changes(_metrics(spark, sf_dir), ["visit"], "system", "errors", "sys0")


def leading_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("rate", (F.col("errors") * 1000 + F.col("visit") % 97) / F.col("words"))
    q = reports.quartiles_exclusive(m, ["system"], "rate").select("system", "q1", "q3")
    means = m.groupBy("system").agg(F.sum("errors").alias("errors"), F.sum("words").alias("words")).select("system", (F.col("errors") / F.col("words")).alias("mean"))
    return cohort.leaders(means.join(q, "system"), "system", "mean", "q1", "q3")


def subset_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    subset = D.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("visit"))
    return cohort.subset_mean(_metrics(spark, sf_dir), subset, ["visit"], ["system"], "errors")


def commonest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as they are, the three commonest of each conversation."""
    return cohort.most_common(D.words(spark, sf_dir), ["conv_id"], "word", "word_idx", 3)


def means_without_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.without_worst(_metrics(spark, sf_dir), ["visit"], "system", "errors")


def pilot_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit"))
    return cohort.sampled(o, F.col("visit"), {"pilot": 8, "validation": 24}, 20260821)


def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit"), "o_custkey", (F.col("o_orderkey") % 1009).alias("words"))
    from parlance.operators.places import spread_sample

    return spread_sample(o, "words", "o_custkey", ["visit"], 24, 2)


def validation_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.words(spark, sf_dir)
    spans = w.where("word rlike '^[A-Z]'").select("conv_id", F.when(F.col("word_idx") % 3 == 0, " ").otherwise(F.col("word")).alias("surface"), (F.col("word_idx") % 5 < 4).alias("scrubbed"))
    return cohort.survey(spans, w, ["conv_id"])


def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.totals(_metrics(spark, sf_dir).drop("visit", "system"))


def session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers under one key, where it is unique on either side."""
    from parlance.sources import transcripts

    left = D.table(spark, sf_dir, "orders").select((F.col("o_custkey") * 7 + F.col("o_orderkey") % 7).alias("key"), "o_orderkey")
    right = D.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("key"), "c_nationkey")
    return transcripts.unique_pairs(left, right, "key")


def first_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer the rows of the first priority class that has any."""
    from parlance.sources import transcripts

    o = D.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    trees = [o.where(F.col("o_orderpriority").startswith(str(k))) for k in (2, 4, 1, 5, 3)]
    return transcripts.first_tree(trees, ["o_custkey"]).groupBy("o_custkey").agg(F.min("o_orderpriority").alias("tree"), F.count("*").alias("n"))


def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.sources import transcripts

    o = D.table(spark, sf_dir, "orders").select("o_custkey", F.format_string("run_%010d/transcript.json", F.col("o_orderkey")).alias("path"), "o_orderkey")
    return transcripts.newest_run(o, ["o_custkey"])


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.sources import transcripts

    path = F.format_string("/data/Site%d/S%05d/day%04d_session%03d/human.txt", F.col("c_nationkey"), F.col("c_custkey"), F.col("c_custkey") % 90, F.col("c_custkey") % 4)
    return D.table(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in transcripts.visit_of(path).items()])


_M = "m AS (SELECT l_orderkey AS visit, 'sys' || (l_suppkey % 5) AS system, count(*) AS words, count_if(l_returnflag = 'R') AS errors, count_if(l_returnflag = 'A') AS others FROM lineitem GROUP BY 1, 2)"

QUERIES = {
    "complete_visits": (complete_visits, "SELECT l_orderkey AS visit, min(l_linestatus || l_linenumber) FILTER (l_returnflag = 'A') AS \"A\", min(l_linestatus || l_linenumber) FILTER (l_returnflag = 'N') AS \"N\", min(l_linestatus || l_linenumber) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3"),
    "discovered_visits": (discovered_visits, "SELECT o_orderkey AS visit FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey % 5 > 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY 1 LIMIT 500"),
    "visit_problems": (visit_problems, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, i, e, CASE WHEN i % 40 = 39 THEN s - conv_id % 3 ELSE s END AS s FROM w), b AS (SELECT *, s < lag(s) OVER (PARTITION BY conv_id ORDER BY i) AS falls FROM a),
        c AS (SELECT conv_id, count(*) AS n, max(e) AS last, bool_or(coalesce(falls, false)) AS falls, CASE WHEN conv_id % 7 > 0 THEN conv_id % 100 + 20.0 END AS sec, CASE WHEN conv_id % 5 > 0 THEN conv_id % 4 END AS v FROM b GROUP BY conv_id)
        SELECT conv_id, concat_ws('; ', CASE WHEN sec IS NULL THEN 'missing audio' END, CASE WHEN sec < 60 THEN 'audio too short' END, CASE WHEN v IS NULL THEN 'missing vendor transcript' END, CASE WHEN v = 0 THEN 'vendor has no words' END, CASE WHEN conv_id % 6 = 0 THEN 'vendor offsets not monotonic' END,
          CASE WHEN sec IS NOT NULL AND conv_id % 9 > 5 THEN 'vendor duration differs' END, CASE WHEN n < 50 THEN 'human transcript too short' END, CASE WHEN falls THEN 'human times not monotonic' END, CASE WHEN last > sec + 5 THEN 'human turn past the end' END) AS problems FROM c"""),
    "truncated_visits": (truncated_visits, f"WITH {_M} SELECT visit, CAST(min(1 + visit % 4) AS DOUBLE) AS least_ratio, count(DISTINCT system) AS systems FROM m GROUP BY 1 HAVING min(1 + visit % 4) > 2 AND count(DISTINCT system) >= 2"),
    "corpus_stats": (corpus_stats, f"""WITH {SEGMENTS_SQL}, a AS (SELECT room, sum(e - s) AS d, count(DISTINCT speaker) AS n FROM seg GROUP BY 1)
        SELECT count(*) AS files, CAST(count(*) * 24 AS DOUBLE) AS hours, CAST(sum(d) / 3600 AS DOUBLE) AS speech_hours, min(n) AS least_speakers, max(n) AS most_speakers FROM a"""),
    "channel_separation": (channel_separation, f"""WITH {SEGMENTS_SQL}, a AS (SELECT room, CASE WHEN room % 4 > 0 THEN avg(abs(k % 7 - k % 11)) FILTER (k % 5 > 0) END AS m FROM seg GROUP BY room)
        SELECT room, m AS separation, CASE WHEN room % 4 = 0 THEN 'one speaker model' WHEN m >= 3 THEN 'channel dominance' ELSE 'no real separation' END AS method, coalesce(abs(m - 3) < 1, false) AS borderline FROM a"""),
    "better_or_worse": (better_or_worse, f"""WITH {_M}, n AS (SELECT count(DISTINCT visit) AS n FROM m) SELECT a.system, count_if(a.errors < b.errors) AS better, count_if(a.errors > b.errors) AS worse, any_value(n) - count_if(a.errors < b.errors) - count_if(a.errors > b.errors) AS unchanged
        FROM m a LEFT JOIN m b ON a.visit = b.visit AND b.system = 'sys0', n WHERE a.system <> 'sys0' GROUP BY 1"""),
    "leading_systems": (leading_systems, f"""WITH {_M}, a AS (SELECT system, sum(errors) / sum(words) AS v, list_sort(list((errors * 1000 + visit % 97) / words)) AS x, count(*) AS n FROM m GROUP BY 1),
        b AS (SELECT system, v, (x[greatest(1, least(n - 1, (n + 1) // 4))] * (4 - ((n + 1) - greatest(1, least(n - 1, (n + 1) // 4)) * 4)) + x[greatest(1, least(n - 1, (n + 1) // 4)) + 1] * ((n + 1) - greatest(1, least(n - 1, (n + 1) // 4)) * 4)) / 4 AS lo,
          (x[greatest(1, least(n - 1, 3 * (n + 1) // 4))] * (4 - (3 * (n + 1) - greatest(1, least(n - 1, 3 * (n + 1) // 4)) * 4)) + x[greatest(1, least(n - 1, 3 * (n + 1) // 4)) + 1] * (3 * (n + 1) - greatest(1, least(n - 1, 3 * (n + 1) // 4)) * 4)) / 4 AS hi, row_number() OVER (ORDER BY v, system) AS r FROM a)
        SELECT p.system AS best, CAST(p.v AS DOUBLE) AS best_value, q.system AS runner_up, CAST(q.v AS DOUBLE) AS runner_up_value, NOT (p.hi < q.lo OR q.hi < p.lo) AS overlap FROM b p, b q WHERE p.r = 1 AND q.r = 2"""),
    "subset_means": (subset_means, f"WITH {_M} SELECT system, avg(errors) AS mean, count(errors) AS visits FROM m WHERE visit IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"),
    "commonest_tokens": (commonest_tokens, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, word, count(*) AS n, min(i) AS f FROM w GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS place FROM a) SELECT conv_id, word, n, CAST(place AS INTEGER) AS place FROM b WHERE place <= 3"""),
    "means_without_worst": (means_without_worst, f"WITH {_M}, g AS (SELECT visit FROM m GROUP BY 1 ORDER BY max(errors) DESC, visit LIMIT 10) SELECT system, avg(errors) AS mean, avg(errors) FILTER (visit NOT IN (SELECT visit FROM g)) AS mean_without FROM m GROUP BY 1"),
    "pilot_sample": (pilot_sample, "WITH a AS (SELECT o_orderkey AS visit, row_number() OVER (ORDER BY md5('20260821:' || o_orderkey)) AS r FROM orders) SELECT visit, CASE WHEN r <= 8 THEN 'pilot' ELSE 'validation' END AS part FROM a WHERE r <= 32"),
    "validation_sample": (validation_sample, """WITH RECURSIVE a AS (SELECT o_orderkey AS visit, o_custkey, o_orderkey % 1009 AS words, row_number() OVER (ORDER BY o_orderkey % 1009, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders),
        wk AS (SELECT 0 AS step, CAST([] AS BIGINT[]) AS places, CAST([] AS BIGINT[]) AS subjects UNION ALL
          SELECT step + 1, list_append(any_value(places), arg_min(place, ahead)), list_append(any_value(subjects), arg_min(o_custkey, ahead)) FROM (SELECT wk.*, a.place, a.o_custkey, (a.place - least(CAST(floor(step * greatest(n / 24, 1.0)) AS BIGINT), n - 1) + n) % n AS ahead FROM wk, a
            WHERE step < 24 AND NOT list_contains(places, a.place) AND len(list_filter(subjects, lambda x: x = a.o_custkey)) < 2) GROUP BY step)
        SELECT visit, o_custkey, words FROM a WHERE place IN (SELECT unnest(places) FROM wk WHERE step = 24)"""),
    "validation_survey": (validation_survey, f"WITH {WORDS_SQL}, a AS (SELECT conv_id, count(*) AS words, count_if(regexp_matches(word, '^[A-Z]')) AS gold, count_if(regexp_matches(word, '^[A-Z]') AND i % 5 = 4 AND i % 3 > 0) AS testable FROM w GROUP BY 1) SELECT * FROM a WHERE testable > 0"),
    "counter_totals": (counter_totals, f"WITH {_M} SELECT CAST(sum(words) AS BIGINT) AS words, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(others) AS BIGINT) AS others FROM m"),
    "session_pairs": (session_pairs, "WITH a AS (SELECT o_custkey * 7 + o_orderkey % 7 AS key, any_value(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 HAVING count(*) = 1) SELECT key, o_orderkey, c_nationkey FROM a JOIN customer ON c_custkey * 7 = key"),
    "first_trees": (first_trees, "WITH a AS (SELECT o_custkey, o_orderpriority AS tree, count(*) AS n, strpos('24153', o_orderpriority[1]) AS r FROM orders GROUP BY ALL) SELECT o_custkey, arg_min(tree, r) AS tree, arg_min(n, r) AS n FROM a GROUP BY 1"),
    "newest_runs": (newest_runs, "SELECT o_custkey, printf('run_%010d/transcript.json', max(o_orderkey)) AS path, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1"),
    "path_parts": (path_parts, "SELECT c_custkey, 'Site' || c_nationkey AS site, printf('S%05d', c_custkey) AS subject, printf('day%04d_session%03d', c_custkey % 90, c_custkey % 4) AS session, printf('day%04d_session%03d', c_custkey % 90, c_custkey % 4) AS timepoint FROM customer"),
}
