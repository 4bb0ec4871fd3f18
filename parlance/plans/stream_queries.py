"""Queries on speaker streams, visits' scores and the outcomes of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import outcomes, streams
from parlance.plans import derived as D
from parlance.plans.derived import BY, SEGMENTS_SQL, TURNS_SQL, WORDS_SQL, assignment_sql, distance_sql
from parlance.plans.word_queries import word_errors


def word_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance and rate of each turn."""
    return word_errors(spark, sf_dir).select("conv_id", "turn", "ref_words", "hyp_words", (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("errors"), "wer")


def reference_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.reference_streams(D.turns(spark, sf_dir), BY)
    return s.select("conv_id", "speaker", "text", F.size("spans").cast("long").alias("spans"), F.aggregate("spans", F.lit(0.0), lambda a, x: a + x["end"] - x["start"]).alias("seconds"))


def word_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.word_streams(D.heard_words(spark, sf_dir), BY)
    return s.select("conv_id", "speaker", "text", F.size("spans").cast("long").alias("spans"))


def _with_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of which some are a third speaker's, who often has few words."""
    t = D.turns(spark, sf_dir)
    return t.withColumn("speaker", F.when((F.col("seg_idx") + F.col("conv_id")) % 7 == 2, "guest").otherwise(F.col("speaker"))).withColumn("text", F.when(F.col("speaker") == "guest", F.substring_index("text", " ", 6)).otherwise(F.col("text")))


def kept_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.without_strays(streams.reference_streams(_with_strays(spark, sf_dir), BY), BY).select("conv_id", "speaker", "strays")


def matched_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.matched_streams(streams.reference_streams(D.turns(spark, sf_dir), BY), streams.word_streams(D.heard_words(spark, sf_dir), BY), BY)


def _stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, hyp = streams.reference_streams(D.turns(spark, sf_dir), BY), streams.word_streams(D.heard_words(spark, sf_dir), BY)
    return streams.stream_scores(ref, hyp, streams.matched_streams(ref, hyp, BY), BY)


def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate of each reference stream against the stream it is matched with."""
    return _stream_scores(spark, sf_dir).select("conv_id", "speaker", "matched", "raw", "capped")


def stream_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stream_means(_stream_scores(spark, sf_dir), BY).drop("qtp")


def reassigned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, words = streams.reference_streams(D.turns(spark, sf_dir), BY), D.heard_words(spark, sf_dir)
    return streams.reassigned(words, ref, streams.matched_streams(ref, streams.word_streams(words, BY), BY), BY).select("conv_id", "word_idx", "speaker", "moved")


def visit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline scores of each visit."""
    return streams.visit_scores(D.turns(spark, sf_dir), D.heard_words(spark, sf_dir), BY)


def cohort_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the visits' scores, and how often each score is there."""
    v = visit_scores(spark, sf_dir)
    names = [c for c in v.columns if c != "conv_id"]
    return v.agg(F.count("*").alias("visits"), *[F.avg(c).alias(c) for c in names], *[F.count(c).alias(f"n_{c}") for c in ("swer", "der")])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.points(spark, sf_dir).withColumn("speaker", F.concat(F.lit("P"), (F.col("word_idx") % 3).cast("string")))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.attribution(_labelled(spark, sf_dir), D.segments(spark, sf_dir), ["room"])


def diarization_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later starts under four variants of collar and overlap, labels as they are."""
    s = D.segments(spark, sf_dir)
    same = s.select("room", F.col("speaker").alias("a_speaker"), F.col("speaker").alias("b_speaker")).distinct()
    hyp = s.where("seg_idx % 7 <> 0").withColumn("start", F.col("start") + 30).withColumn("speaker", F.when(F.col("seg_idx") % 5 == 0, "S0").otherwise(F.col("speaker")))
    variants = {"plain": (0.0, False), "collar": (120.0, False), "alone": (0.0, True), "alone_collar": (120.0, True)}
    return streams.diarization_variants(s, hyp, ["room"], same, variants)


def turn_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.turn_outcomes(D.turns(spark, sf_dir), D.heard_words(spark, sf_dir), BY, [10, 20, 30], [10, 20, 30], ("USER", "ASSISTANT"))


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.summary(turn_outcomes(spark, sf_dir), "<10s")


def distance_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes.distance_bins(outcome_summary(spark, sf_dir), ["length_bucket", "previous_bucket", "speaker"])


def outcome_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By role."""
    return outcomes.outcome_shares(outcome_summary(spark, sf_dir).where("speaker <> '-'"), ["speaker"])


_T = f"WITH RECURSIVE {WORDS_SQL}, {TURNS_SQL}"
_TOKENS = "list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9''\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND NOT list_contains(['" + "', '".join(T.FILLED_PAUSES) + "'], x))"
_MAP = f"""ov AS (SELECT tr.conv_id AS p, tr.speaker AS a, hh.speaker AS b, sum(least(tr.e, hh.e) - greatest(tr.s, hh.s)) AS v FROM tr JOIN hh ON tr.conv_id = hh.conv_id AND hh.e > tr.s AND hh.s < tr.e GROUP BY 1, 2, 3), {assignment_sql('ov', 'mp')}"""
_STREAMS = f"""{_T}, {_MAP}, rs AS (SELECT conv_id, speaker, string_agg(text, ' ' ORDER BY k) AS t FROM tr GROUP BY 1, 2), hs AS (SELECT conv_id, speaker, string_agg(word, ' ' ORDER BY i) AS t FROM hh GROUP BY 1, 2),
  pr AS (SELECT rs.conv_id || '|' || rs.speaker AS p, rs.conv_id, rs.speaker, mp.b AS matched, {_TOKENS.format('rs.t')} AS r, coalesce({_TOKENS.format('hs.t')}, []) AS q FROM rs LEFT JOIN mp ON mp.p = rs.conv_id AND mp.a = rs.speaker LEFT JOIN hs ON hs.conv_id = rs.conv_id AND hs.speaker = mp.b),
  {distance_sql('pr', 'di')}, sc AS (SELECT conv_id, speaker, matched, CASE WHEN len(q) = 0 THEN 1.0 ELSE errors / len(r) END::DOUBLE AS raw FROM pr JOIN di USING (p) WHERE len(r) > 0)"""
_CONTENT = "regexp_extract_all(regexp_replace(regexp_replace(lower({}), '\\[[^\\]]*\\]', ' ', 'g'), '[{{}}]', ' ', 'g'), '[a-z0-9'']+')"
_BUCKET = "CASE WHEN {0} < 10 THEN '<10s' WHEN {0} < 20 THEN '<20s' WHEN {0} < 30 THEN '<30s' ELSE '30s+' END"
_OUTCOMES = f"""{_T}, {_MAP},
  x AS (SELECT tr.conv_id, tr.k, count_if(hh.e > tr.s AND hh.s < tr.e) AS inside, count_if(hh.e > tr.s AND hh.s < tr.e AND hh.speaker = mp.b) AS own, min(greatest(0, tr.s - hh.e, hh.s - tr.e)) AS gap
        FROM tr JOIN hh ON tr.conv_id = hh.conv_id LEFT JOIN mp ON mp.p = tr.conv_id AND mp.a = tr.speaker GROUP BY 1, 2),
  ne AS (SELECT conv_id, k, t, count(*) AS need FROM (SELECT conv_id, k, unnest({_CONTENT.format('text')}) AS t FROM tr) GROUP BY 1, 2, 3),
  ha AS (SELECT conv_id, k, t, count_if(near) AS have, count(*) AS wide FROM (SELECT tr.conv_id, tr.k, hh.s < tr.e + 0.5 AND hh.e > tr.s - 0.5 AS near, unnest({_CONTENT.format('hh.word')}) AS t FROM tr JOIN hh ON tr.conv_id = hh.conv_id AND hh.s < tr.e + 3 AND hh.e > tr.s - 3) GROUP BY 1, 2, 3),
  rc AS (SELECT conv_id, k, sum(least(need, coalesce(have, 0))) / sum(need) AS rec, sum(least(need, coalesce(wide, 0))) / sum(need) AS recw FROM ne LEFT JOIN ha USING (conv_id, k, t) GROUP BY 1, 2),
  y AS (SELECT tr.*, x.*, rec, recw, e - s AS len, lag(e - s) OVER (PARTITION BY tr.conv_id ORDER BY tr.k) AS prev FROM tr JOIN x ON tr.conv_id = x.conv_id AND tr.k = x.k LEFT JOIN rc ON rc.conv_id = tr.conv_id AND rc.k = tr.k),
  z AS (SELECT conv_id, k AS seg_idx, CASE WHEN speaker IN ('user', 'assistant') THEN upper(speaker) ELSE 'unnamed (' || upper(speaker) || ')' END AS speaker, CAST(round(rec, 4) AS DOUBLE) AS recovered, coalesce(round(rec, 4) = 0, false) AS content_lost, coalesce(round(rec, 4) < 0.5, false) AS content_mostly_lost, CAST(round(recw, 4) AS DOUBLE) AS recovered_wide, coalesce(round(recw, 4) = 0, false) AS content_lost_wide,
        CAST(round(len, 3) AS DOUBLE) AS length, {_BUCKET.format('len')} AS length_bucket, CASE WHEN prev IS NULL THEN 'first turn' ELSE {_BUCKET.format('prev')} END AS previous_bucket, len(list_filter(string_split_regex(text, '\\s+'), lambda v: v <> '')) AS ref_words, CAST(inside AS BIGINT) AS hyp_words,
        inside = 0 AS lost_entirely, inside = 0 AND round(gap, 3) > 0.5 AS lost_beyond_tolerance, own = 0 AS lost_to_speaker, inside > 0 AND own = 0 AS wrong_speaker, CAST(CASE WHEN inside = 0 THEN round(gap, 3) END AS DOUBLE) AS nearest_word FROM y)"""
_RATE = lambda a, b: f"CAST(round(CASE WHEN {b} > 0 THEN {a} / {b} END, 4) AS DOUBLE)"
_SUMMARY = f"""{_OUTCOMES}, g AS (SELECT grouping(length_bucket, previous_bucket, speaker) AS gr, length_bucket, previous_bucket, speaker, count(*) AS turns, count(recovered) AS content_scored, count_if(content_lost) AS content_lost, count_if(content_mostly_lost) AS content_mostly_lost, count_if(content_lost_wide) AS content_lost_wide,
    count_if(recovered IS NOT NULL AND wrong_speaker AND NOT content_lost) AS misattributed, avg(recovered) AS rm, count_if(lost_entirely) AS lost_entirely, count_if(lost_beyond_tolerance) AS lost_beyond_tolerance, count_if(lost_to_speaker) AS lost_to_speaker,
    count_if(lost_entirely AND nearest_word IS NOT NULL) AS far, count_if(lost_entirely AND nearest_word <= 0.25) AS f1, count_if(lost_entirely AND nearest_word <= 1) AS f2, count_if(lost_entirely AND nearest_word > 5) AS f3 FROM z
    GROUP BY GROUPING SETS ((), (length_bucket), (previous_bucket), (speaker), (length_bucket, previous_bucket))),
  su AS (SELECT coalesce(length_bucket, '-') AS length_bucket, coalesce(previous_bucket, '-') AS previous_bucket, coalesce(speaker, '-') AS speaker, turns, content_scored, content_lost, content_mostly_lost, content_lost_wide, misattributed, lost_entirely, lost_beyond_tolerance, lost_to_speaker,
    {_RATE('content_lost', 'content_scored')} AS content_lost_rate, {_RATE('content_mostly_lost', 'content_scored')} AS content_mostly_lost_rate, {_RATE('content_lost_wide', 'content_scored')} AS content_lost_wide_rate, {_RATE('misattributed', 'content_scored')} AS misattributed_rate, CAST(round(rm, 4) AS DOUBLE) AS recovered_mean,
    {_RATE('lost_entirely', 'turns')} AS lost_entirely_rate, {_RATE('lost_beyond_tolerance', 'turns')} AS lost_rate, {_RATE('lost_to_speaker', 'turns')} AS lost_to_speaker_rate, far AS lost_with_distance, {_RATE('f1', 'far')} AS within_quarter, {_RATE('f2', 'far')} AS within_one, {_RATE('f3', 'far')} AS over_five
    FROM g WHERE gr <> 1 OR length_bucket = '<10s')"""

QUERIES = {
    "word_distances": (word_distances, f"""WITH RECURSIVE {WORDS_SQL}, a AS (SELECT conv_id, turn, list(t ORDER BY i) FILTER (t <> '') AS r FROM (SELECT conv_id, turn, i, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS t FROM w) GROUP BY 1, 2),
        b AS (SELECT conv_id, turn, list(t ORDER BY i) FILTER (t <> '') AS q FROM (SELECT conv_id, turn, i, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS t FROM h) GROUP BY 1, 2),
        pr AS (SELECT a.conv_id || '|' || a.turn AS p, a.conv_id, a.turn, coalesce(r, []) AS r, coalesce(q, []) AS q FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn), {distance_sql('pr', 'di')}
        SELECT conv_id, turn, CAST(len(r) AS BIGINT) AS ref_words, CAST(len(q) AS BIGINT) AS hyp_words, CAST(errors AS BIGINT) AS errors, CAST(errors / greatest(1, len(r)) AS DOUBLE) AS wer FROM pr JOIN di USING (p)"""),
    "reference_streams": (reference_streams, f"{_T} SELECT conv_id, speaker, string_agg(text, ' ' ORDER BY k) AS text, count(*) AS spans, sum(e - s) AS seconds FROM tr GROUP BY 1, 2"),
    "word_streams": (word_streams, f"{_T} SELECT conv_id, speaker, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS spans FROM hh GROUP BY 1, 2"),
    "kept_streams": (kept_streams, f"""{_T}, a AS (SELECT conv_id, k, CASE WHEN (k + conv_id) % 7 = 2 THEN 'guest' ELSE speaker END AS speaker, text FROM tr),
        b AS (SELECT conv_id, k, speaker, CASE WHEN speaker = 'guest' THEN array_to_string(string_split(text, ' ')[1:6], ' ') ELSE text END AS text FROM a),
        c AS (SELECT conv_id, speaker, len({_TOKENS.format("string_agg(text, ' ' ORDER BY k)")}) >= 5 AS enough FROM b GROUP BY 1, 2), d AS (SELECT *, bool_or(enough) OVER (PARTITION BY conv_id) AS many, sum(CASE WHEN enough THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS n FROM c)
        SELECT conv_id, speaker, CAST(CASE WHEN many THEN n ELSE 0 END AS BIGINT) AS strays FROM d WHERE enough OR NOT many"""),
    "matched_streams": (matched_streams, f"{_T}, {_MAP} SELECT p AS conv_id, a AS a_speaker, b AS b_speaker FROM mp"),
    "stream_errors": (stream_errors, f"{_STREAMS} SELECT conv_id, speaker, matched, raw, least(raw, 1.0) AS capped FROM sc"),
    "stream_means": (stream_means, f"{_STREAMS} SELECT conv_id, count(*) AS streams, avg(least(raw, 1.0)) AS swer, avg(raw) AS swer_uncapped FROM sc GROUP BY 1"),
    "reassigned_words": (reassigned_words, f"""{_T}, {_MAP}, orp AS (SELECT hh.* FROM hh WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.p = hh.conv_id AND mp.b = hh.speaker)),
        c AS (SELECT orp.conv_id, orp.i, tr.speaker AS a, mp.b, sum(greatest(0, least(orp.e, tr.e) - greatest(orp.s, tr.s))) AS o, min(least(abs(orp.s - tr.s), abs(orp.s - tr.e))) AS d FROM orp JOIN tr ON tr.conv_id = orp.conv_id JOIN mp ON mp.p = tr.conv_id AND mp.a = tr.speaker GROUP BY 1, 2, 3, 4),
        n AS (SELECT conv_id, i, b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, i ORDER BY o DESC, d, a) AS r FROM c) WHERE r = 1)
        SELECT hh.conv_id, hh.i AS word_idx, CASE WHEN n.b IS NOT NULL THEN n.b WHEN hh.speaker = 'UNKNOWN' THEN NULL ELSE hh.speaker END AS speaker, n.b IS NOT NULL AS moved FROM hh LEFT JOIN n ON n.conv_id = hh.conv_id AND n.i = hh.i"""),
    "attribution": (attribution, f"""WITH RECURSIVE {SEGMENTS_SQL}, a AS (SELECT pt.room, i, 'P' || (i % 3) AS pred, arg_min(seg.speaker, seg.k) AS gold FROM pt JOIN seg ON pt.room = seg.room AND seg.s <= (pt.s + pt.e) / 2 AND (pt.s + pt.e) / 2 <= seg.e GROUP BY 1, 2, 3),
        c AS (SELECT room, pred, gold, count(*) AS v FROM a GROUP BY 1, 2, 3), g AS (SELECT room, gold, 1 << (dense_rank() OVER (PARTITION BY room ORDER BY gold) - 1) AS bit FROM (SELECT DISTINCT room, gold FROM c)),
        q AS (SELECT room, pred, dense_rank() OVER (PARTITION BY room ORDER BY pred) AS n FROM (SELECT DISTINCT room, pred FROM c)), m AS (SELECT room, least((SELECT count(*) FROM q q2 WHERE q2.room = g.room), count(*)) AS sides FROM g GROUP BY room),
        x AS (SELECT DISTINCT room, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS total FROM c UNION ALL SELECT x.room, x.n + 1, x.used | g.bit, x.total + coalesce(c.v, 0) FROM x JOIN m ON m.room = x.room AND x.n < m.sides JOIN q ON q.room = x.room AND q.n = x.n + 1 JOIN g ON g.room = x.room AND x.used & g.bit = 0 LEFT JOIN c ON c.room = x.room AND c.pred = q.pred AND c.gold = g.gold)
        SELECT room, max(total) AS correct, (SELECT CAST(sum(v) AS BIGINT) FROM c WHERE c.room = x.room) AS scored FROM x GROUP BY room"""),
    "diarization_variants": (diarization_variants, f"""WITH {SEGMENTS_SQL}, hy AS (SELECT room, CASE WHEN k % 5 = 0 THEN 'S0' ELSE speaker END AS speaker, s + 30 AS s, e FROM seg WHERE k % 7 <> 0),
        v AS (SELECT * FROM (VALUES ('plain', 0, false), ('collar', 120, false), ('alone', 0, true), ('alone_collar', 120, true)) t(variant, col, alone)),
        b AS (SELECT DISTINCT room, unnest([s, e]) AS x FROM seg), t AS (SELECT room, variant, x + d * col / 2 AS x FROM b, v, (SELECT unnest([-1, 0, 1]) AS d) UNION SELECT room, variant, unnest([s, e]) FROM hy, v),
        ce AS (SELECT room, variant, x AS lo, lead(x) OVER (PARTITION BY room, variant ORDER BY x) AS hi FROM t),
        r AS (SELECT ce.room, ce.variant, lo, hi, list(DISTINCT seg.speaker) AS sp FROM ce JOIN seg ON seg.room = ce.room AND seg.s < hi AND seg.e > lo GROUP BY ALL), q AS (SELECT ce.room, ce.variant, lo, hi, list(DISTINCT hy.speaker) AS sp FROM ce JOIN hy ON hy.room = ce.room AND hy.s < hi AND hy.e > lo GROUP BY ALL),
        known AS (SELECT room, list(DISTINCT speaker) AS sp FROM seg GROUP BY room),
        f AS (SELECT room, variant, hi - lo AS d, coalesce(r.sp, []) AS r, coalesce(q.sp, []) AS q FROM ce LEFT JOIN r USING (room, variant, lo, hi) LEFT JOIN q USING (room, variant, lo, hi) JOIN v USING (variant)
          WHERE hi IS NOT NULL AND (r.sp IS NOT NULL OR q.sp IS NOT NULL) AND NOT (alone AND len(coalesce(r.sp, [])) > 1) AND NOT EXISTS (SELECT 1 FROM b WHERE b.room = ce.room AND b.x - col / 2 < hi AND b.x + col / 2 > lo AND col > 0)),
        o AS (SELECT variant, room, sum(d * greatest(len(r) - len(q), 0))::DOUBLE AS missed, sum(d * greatest(len(q) - len(r), 0))::DOUBLE AS false_alarm, sum(d * (least(len(r), len(q)) - len(list_intersect(r, q))))::DOUBLE AS confusion, sum(d * len(r))::DOUBLE AS total FROM f GROUP BY 1, 2)
        SELECT *, CASE WHEN total > 0 THEN (missed + false_alarm + confusion) / total END AS der FROM o"""),
    "turn_outcomes": (turn_outcomes, f"{_OUTCOMES} SELECT * FROM z"),
    "outcome_summary": (outcome_summary, f"{_SUMMARY} SELECT * FROM su"),
    "distance_bins": (distance_bins, f"{_SUMMARY} SELECT length_bucket, previous_bucket, speaker, within_quarter AS to_quarter, CAST(greatest(round(within_one - within_quarter, 4), 0) AS DOUBLE) AS to_one, CAST(greatest(round(1 - within_one - over_five, 4), 0) AS DOUBLE) AS to_five, over_five AS beyond FROM su WHERE lost_with_distance > 0"),
    "outcome_shares": (outcome_shares, f"{_SUMMARY} SELECT speaker, content_lost_rate AS lost, misattributed_rate AS misattributed, CAST(round(1 - content_lost_rate - misattributed_rate, 4) AS DOUBLE) AS kept FROM su WHERE speaker <> '-' AND content_scored > 0"),
    "visit_scores": (visit_scores, None),
    "cohort_scores": (cohort_scores, None),
}
