"""Queries that report on visits and systems, and on the files of a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators import places, reports
from parlance.plans import derived as D
from parlance.sources import transcripts


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as visits, suppliers (modulo 5) as systems, late or returned lines as errors."""
    l = D.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("system"), "l_returnflag")  # noqa: E741
    return l.groupBy(F.col("l_orderkey").alias("visit"), F.concat(F.lit("sys"), F.col("system").cast("string")).alias("system")).agg(F.count("*").alias("words"), F.count_if(F.col("l_returnflag") == "R").alias("errors"), F.count_if(F.col("l_returnflag") == "A").alias("others"))


def system_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.summary(_metrics(spark, sf_dir), ["system"], "errors", "words")
    return s.select("system", "visits", F.round("mean_rate", 6).alias("mean_rate"), "median_rate", "pooled_rate")


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.head_to_head(_metrics(spark, sf_dir), ["visit"], "system", "errors", "sys1", "sys2")


def common_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.common_visits(_metrics(spark, sf_dir).where("system in ('sys1', 'sys2', 'sys3')"), ["visit"], "system", 3).groupBy("system").agg(F.count("*").alias("visits"), F.sum("errors").alias("errors"))


def error_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("cost", (F.col("visit") % 97 * F.col("words")).cast("double"))
    return reports.spread(m, ["system"], "cost", 50.0)


def exclusive_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_orderkey") % 1009).cast("double").alias("x"))
    return reports.quartiles_exclusive(m, ["grp"], "x")


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_orderkey") % 1009).alias("x"))
    return reports.upper_median(m, ["grp"], "x")


def cumulative_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(_metrics(spark, sf_dir), ["system"], "errors").select("system", "errors", "n", "share")


def worst_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.worst(_metrics(spark, sf_dir), ["visit"], "errors", 25)


def dominant_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).withColumn("kind", reports.dominant({"errors": F.col("errors"), "others": F.col("others"), "rest": F.col("words") - F.col("errors") - F.col("others")}))
    return m.groupBy("system", "kind").agg(F.count("*").alias("n"))


def condition_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rates under two conditions and their difference, in one pivot."""
    m = _metrics(spark, sf_dir).withColumn("condition", F.when(F.col("visit") % 4 == 0, "stereo").otherwise("mono"))
    p = m.groupBy("system").pivot("condition", ["mono", "stereo"]).agg((F.sum("errors") / F.sum("words")).alias("rate"))
    return p.select("system", "mono", "stereo", F.round(100 * (F.col("stereo") - F.col("mono")), 6).alias("shift"))


def ranked_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that two systems have, by the rate of the second."""
    m = _metrics(spark, sf_dir).withColumn("rest", F.col("words") - F.col("errors") - F.col("others"))
    return reports.ranked_visits(m, ["visit"], "system", ["sys1", "sys2"], {"deletion": "errors", "substitution": "others", "insertion": "rest"}, "words", "sys2")


def pooled_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pooled_deltas(_metrics(spark, sf_dir), "system", "errors", "words", "sys0")


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of one label as a prediction of the other."""
    s = D.table(spark, sf_dir, "labels").agg(*[F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(n) for n, q, t in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1))])
    return s.select("tp", "fp", "fn", *[F.round(v, 6).alias(k) for k, v in reports.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the first priority that has an order, and its orders: the first tree that holds a visit wins."""
    o = D.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    trees = [o.where(F.col("o_orderpriority").startswith(str(k))) for k in range(1, 6)]
    return transcripts.first_tree(trees, ["o_custkey"]).groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth visit in order, of those of all but one kind, without those that are done."""
    o = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit"), "o_orderstatus")
    done = D.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("visit"))
    left = places.pending(places.round_robin(o, ["visit"], 4), done, ["visit"], F.col("o_orderstatus") != "P")
    return left.groupBy("shard").agg(F.count("*").alias("visits"), F.sum("visit").alias("checksum"))


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as time-stamped lines and read again."""
    t = D.table(spark, sf_dir, "conversations").where("text is not null")
    line = F.format_string("%s 00:%02d:%02d.500 %s", "role", F.floor(F.col("turn") * 20 / 60), F.col("turn") * 20 % 60, F.regexp_replace(F.trim("text"), r"\s*\n\s*", "\n"))
    raw = t.groupBy(F.col("conv_id").alias("visit")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
    got = transcripts.parse_turns(raw, ["visit"], F.lit(150.0))
    return got.select("visit", "turn_idx", "speaker", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "text")


def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as lines of an RTTM file."""
    from parlance.sources.sinks import rttm

    s = D.segments(spark, sf_dir).withColumn("room", F.concat(F.lit("room"), F.col("room").cast("string")))
    return rttm(s.withColumn("start", F.col("start") - 1704067200).withColumn("end", F.col("end") - 1704067200), "room")


def reply_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of an injected model, fenced, cut or malformed, read into rows."""
    body = F.concat(F.lit('[{"turn": '), F.col("turn").cast("string"), F.lit(', "text": "a b", "speaker": "'), F.col("role"), F.lit('", "action": "'), F.when(F.col("turn") % 2 == 0, "reassign").otherwise("shout"), F.lit('"}]'))
    reply = F.when(F.col("turn") % 5 == 3, F.lit("none")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    t = D.table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"))
    rows = transcripts.parse_corrections(t, ["conv_id", "turn"])
    return rows.groupBy("conv_id").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("malformed"), F.count_if("unreadable").alias("unreadable"))


_M = "WITH m AS (SELECT l_orderkey AS visit, 'sys' || CAST(l_suppkey % 5 AS VARCHAR) AS system, count(*) AS words, count_if(l_returnflag = 'R') AS errors, count_if(l_returnflag = 'A') AS others FROM lineitem GROUP BY 1, 2)"

QUERIES = {
    "system_summary": (system_summary, _M + " SELECT system, count(*) AS visits, round(avg(errors / words), 6) AS mean_rate, median(errors / words) AS median_rate, sum(errors) / sum(words) AS pooled_rate FROM m GROUP BY system"),
    "head_to_head": (head_to_head, _M + """, b AS (SELECT x.errors AS a, y.errors AS b FROM m x JOIN m y ON x.visit = y.visit AND x.system = 'sys1' AND y.system = 'sys2')
        SELECT count(*) AS visits, count_if(a < b) AS a_better, count_if(b < a) AS b_better, median(a - b) AS median_difference, avg(a) AS a_mean, avg(b) AS b_mean FROM b"""),
    "common_visits": (common_visits, _M + ", x AS (SELECT * FROM m WHERE system IN ('sys1', 'sys2', 'sys3')) SELECT system, count(*) AS visits, CAST(sum(errors) AS BIGINT) AS errors FROM x WHERE visit IN (SELECT visit FROM x GROUP BY visit HAVING count(DISTINCT system) = 3) GROUP BY system"),
    "error_spread": (error_spread, _M + """, c AS (SELECT system, CAST(visit % 97 * words AS DOUBLE) AS x FROM m)
        SELECT system, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95, count_if(x > 50) AS above FROM c GROUP BY system"""),
    "exclusive_quartiles": (exclusive_quartiles, """WITH a AS (SELECT o_orderpriority AS grp, list_sort(list(CAST(o_orderkey % 1009 AS DOUBLE))) AS v FROM orders GROUP BY 1), b AS (SELECT grp, v, len(v) AS n FROM a)
        SELECT grp, CAST(n AS INTEGER) AS n, """ + ", ".join(f"(v[{k} * (n + 1) // 4] * (4 - {k} * (n + 1) % 4) + v[{k} * (n + 1) // 4 + 1] * ({k} * (n + 1) % 4)) / 4 AS q{k}" for k in (1, 2, 3)) + " FROM b"),
    "upper_medians": (upper_medians, "WITH a AS (SELECT o_orderpriority AS grp, list_sort(list(o_orderkey % 1009)) AS v FROM orders GROUP BY 1) SELECT grp, v[len(v) // 2 + 1] AS median, v[9 * (len(v) - 1) // 10 + 1] AS p90 FROM a"),
    "cumulative_shares": (cumulative_shares, _M + ", c AS (SELECT system, errors, count(*) AS n FROM m GROUP BY 1, 2) SELECT system, errors, n, CAST(sum(n) OVER (PARTITION BY system ORDER BY errors) AS DOUBLE) / sum(n) OVER (PARTITION BY system) AS share FROM c"),
    "worst_visits": (worst_visits, _M + " SELECT visit, max(errors) AS worst FROM m GROUP BY visit ORDER BY worst DESC, visit LIMIT 25"),
    "dominant_errors": (dominant_errors, _M + " SELECT system, CASE greatest(errors, others, words - errors - others) WHEN errors THEN 'errors' WHEN others THEN 'others' ELSE 'rest' END AS kind, count(*) AS n FROM m GROUP BY 1, 2"),
    "condition_shift": (condition_shift, _M + ", c AS (SELECT system, sum(errors) FILTER (WHERE visit % 4 <> 0) / sum(words) FILTER (WHERE visit % 4 <> 0) AS mono, sum(errors) FILTER (WHERE visit % 4 = 0) / sum(words) FILTER (WHERE visit % 4 = 0) AS stereo FROM m GROUP BY 1) SELECT system, mono, stereo, round(100 * (stereo - mono), 6) AS shift FROM c"),
    "ranked_visits": (ranked_visits, _M + f""", t AS (SELECT *, words - errors - others AS rest FROM m), x AS (SELECT visit, system, (errors + others + rest) / words AS wer, CASE WHEN errors >= others AND errors >= rest THEN 'deletion' WHEN others >= rest THEN 'substitution' ELSE 'insertion' END AS shape, greatest(errors, others, rest) / words AS shape_rate FROM t)
        SELECT row_number() OVER (ORDER BY b.wer DESC, visit) AS rank, visit, {", ".join(f"{k}.{c} AS sys{n}_{c}" for n, k in ((1, "a"), (2, "b")) for c in ("wer", "shape", "shape_rate"))} FROM x a JOIN x b USING (visit) WHERE a.system = 'sys1' AND b.system = 'sys2'"""),
    "pooled_deltas": (pooled_deltas, _M + ", p AS (SELECT system, sum(errors) / sum(words) AS pooled FROM m GROUP BY 1) SELECT system, pooled, pooled - (SELECT pooled FROM p WHERE system = 'sys0') AS delta FROM p"),
    "label_scores": (label_scores, """WITH s AS (SELECT count_if(quality = 1 AND toxic = 1) AS tp, count_if(quality = 1 AND toxic = 0) AS fp, count_if(quality = 0 AND toxic = 1) AS fn FROM labels)
        SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1,
          round(fn / (tp + fn), 6) AS under, round(fp / (tp + fn), 6) AS over, round((fp - fn) / (tp + fn), 6) AS net FROM s"""),
    "first_source": (first_source, "SELECT o_custkey, min(o_orderpriority) AS o_orderpriority, count(*) FILTER (WHERE o_orderpriority = p) AS n FROM (SELECT *, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS p FROM orders) GROUP BY o_custkey"),
    "shards": (shards, """WITH a AS (SELECT o_orderkey AS visit, o_orderstatus, (row_number() OVER (ORDER BY o_orderkey) - 1) % 4 + 1 AS shard FROM orders)
        SELECT shard, count(*) AS visits, CAST(sum(visit) AS BIGINT) AS checksum FROM a WHERE o_orderstatus <> 'P' AND visit NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY shard"""),
    "turn_lines": (turn_lines, r"""WITH a AS (SELECT conv_id AS visit, role AS speaker, turn, CAST(turn * 20 + 0.5 AS DOUBLE) AS t_start, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations WHERE text IS NOT NULL)
        SELECT visit, CAST(row_number() OVER q - 1 AS BIGINT) AS turn_idx, speaker, t_start, coalesce(lead(t_start) OVER q, greatest(150.0::DOUBLE, t_start)) AS t_end, text FROM a WINDOW q AS (PARTITION BY visit ORDER BY turn)"""),
    "annotation_lines": (annotation_lines, f"WITH {D.SEGMENTS_SQL} SELECT printf('SPEAKER room%d 1 %.3f %.3f <NA> <NA> %s <NA> <NA>', room, s - 1704067200, e - s, speaker) AS value FROM seg"),
    "reply_counts": (reply_counts, "SELECT conv_id, count_if(turn % 5 <> 3 AND turn % 2 = 0) AS valid, count_if(turn % 5 <> 3 AND turn % 2 = 1) AS malformed, count_if(turn % 5 = 3) AS unreadable FROM conversations GROUP BY conv_id"),
}
