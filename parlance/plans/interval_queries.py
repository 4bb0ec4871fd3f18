"""Queries on segments and points in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import intervals, islands
from parlance.plans import derived as D
from parlance.plans.derived import SEGMENTS_SQL, assignment_sql

BY = ["room"]


def assign_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.assign_speakers(D.points(spark, sf_dir), D.segments(spark, sf_dir), BY).select("room", "word_idx", "speaker")


def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, words without a segment to the nearest one."""
    return intervals.assign_speakers(D.points(spark, sf_dir), D.segments(spark, sf_dir), BY, nearest=True).select("room", "word_idx", "speaker")


def as_of_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.points(spark, sf_dir).select("room", F.col("word_idx").alias("point"), F.col("start").alias("t"))
    return intervals.as_of(p, D.segments(spark, sf_dir), BY).select("room", "point", F.coalesce("speaker", F.lit("none")).alias("speaker"))


def nearest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.points(spark, sf_dir).select("room", F.col("word_idx").alias("point"), F.col("start").alias("t"))
    return intervals.nearest_turn(p, D.segments(spark, sf_dir), BY).select("room", "point", "seg_idx")


def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.band_counts(D.segments(spark, sf_dir), D.points(spark, sf_dir), BY, bands=(0.0, 60.0, 300.0), bucket=3600.0).select("room", "seg_idx", "within_0", "within_60", "within_300", F.coalesce("nearest", F.lit(-1.0)).alias("nearest"))


def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.merge_touching(D.segments(spark, sf_dir), BY).select("room", F.col("start").alias("t_start"), F.col("end").alias("t_end"))


def union_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.union_length(D.segments(spark, sf_dir), ["room", "speaker"])


def close_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = islands.merge_close(D.segments(spark, sf_dir), BY, gap=900.0)
    return s.select("room", "speaker", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "n")


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two speakers, many without an end."""
    return D.points(spark, sf_dir).withColumn("speaker", F.when(F.col("word_idx") % 9 < 6, "A").otherwise("B")).withColumn("end", F.when(F.col("word_idx") % 4 > 1, F.lit(None)).otherwise(F.col("end")))


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a room that also end at a pause of more than an hour."""
    return islands.paused_turns(_gapped(spark, sf_dir), BY, pause=3600.0).select("room", "speaker", F.col("start").alias("t_start"), F.coalesce("end", F.lit(-1.0)).alias("t_end"), "n_words")


def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments(spark, sf_dir)
    return intervals.overlap_lengths(s.where("seg_idx % 2 = 0"), s.where("seg_idx % 2 = 1"), BY)


def assigned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best total overlap of a one-to-one assignment of speakers."""
    return intervals.assign_labels(overlap_matrix(spark, sf_dir), BY).groupBy("room").agg(F.sum("overlap").alias("total"))


def clipped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.lit(1704153600.0), F.lit(1704240000.0)
    w = D.points(spark, sf_dir).withColumn("end", F.when(F.col("word_idx") % 4 == 0, F.lit(None)).otherwise(F.col("end")))
    return intervals.clip(w, low, high).select("room", "word_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"))


def covered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.covered_turns(D.segments(spark, sf_dir), BY, cap=43200.0).select("room", "seg_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"))


def coverage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments(spark, sf_dir).select("room", (F.col("start") - 1704067200).alias("start"))
    return intervals.coverage(s, BY, F.lit(2592000.0))


def diarization_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed, false and confused time when one speaker's segments are taken for another's, with the best assignment."""
    s = D.segments(spark, sf_dir)
    hyp = s.where("seg_idx % 7 <> 0").withColumn("speaker", F.when(F.col("seg_idx") % 5 == 0, "S0").otherwise(F.col("speaker"))).withColumn("end", F.col("end") - 60)
    mapping = intervals.assign_labels(intervals.overlap_lengths(s, hyp, BY), BY)
    return intervals.error_rate(s, hyp, BY, mapping)


def diarization_errors_collar(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments(spark, sf_dir)
    same = s.select("room", F.col("speaker").alias("a_speaker"), F.col("speaker").alias("b_speaker")).distinct()
    return intervals.error_rate(s, s.withColumn("start", F.col("start") + 30), BY, same, collar=120.0)


def outcome_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by their length, the previous turn's length and the speaker, and as a whole, in one pass."""
    from parlance.operators.reports import outcome_sets as sets

    w = D.Window.partitionBy("room").orderBy("start", "seg_idx")
    s = D.segments(spark, sf_dir).withColumn("length", T.length_bucket(F.col("end") - F.col("start"), [900, 1900, 3100]))
    s = s.withColumn("before", F.coalesce(T.length_bucket(F.lag(F.col("end") - F.col("start")).over(w), [900, 1900, 3100]), F.lit("first")))
    out = sets(s, [[], ["length"], ["before"], ["speaker"], ["length", "before"]], [F.count("*").alias("turns"), F.count_if(F.col("end") - F.col("start") > 2000).alias("long")])
    return out.select(F.coalesce("length", F.lit("-")).alias("length"), F.coalesce("before", F.lit("-")).alias("before"), F.coalesce("speaker", F.lit("-")).alias("speaker"), "turns", "long")


_MERGE = "SELECT {k}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {t})) GROUP BY {k}, g"
_S = f"WITH {SEGMENTS_SQL}"
_OVERLAPS = f"""WITH RECURSIVE {SEGMENTS_SQL}, sides AS (SELECT room, k % 2 AS side, speaker, s, e, row_number() OVER (PARTITION BY room, k % 2, speaker ORDER BY s, e) AS r FROM seg),
  sweep AS (SELECT DISTINCT a.room, a.speaker AS x, b.speaker AS y, 1::BIGINT AS i, 1::BIGINT AS j, 0.0::DOUBLE AS total FROM sides a JOIN sides b ON a.room = b.room AND a.side = 0 AND b.side = 1 UNION ALL
    SELECT w.room, x, y, CASE WHEN a.e < b.e THEN i + 1 ELSE i END, CASE WHEN a.e < b.e THEN j ELSE j + 1 END, total + greatest(0, least(a.e, b.e) - greatest(a.s, b.s))
    FROM sweep w JOIN sides a ON a.room = w.room AND a.side = 0 AND a.speaker = x AND a.r = i JOIN sides b ON b.room = w.room AND b.side = 1 AND b.speaker = y AND b.r = j),
  o AS (SELECT room, x AS a_speaker, y AS b_speaker, max(total) AS overlap FROM sweep GROUP BY 1, 2, 3 HAVING max(total) > 0)"""
_SWEEP = _OVERLAPS[_OVERLAPS.index("sweep AS") : _OVERLAPS.index(",\n  o AS")]


def _errors_sql(collar: int) -> str:
    """CTEs over seg and hy (whose speakers are seg's) and the final selection of missed, false and confused time and the reference's."""
    return f"""eb AS (SELECT DISTINCT room, unnest([s, e]) AS x FROM seg), et AS (SELECT room, x + d * {collar} / 2 AS x FROM eb, (SELECT unnest([-1, 0, 1]) AS d) UNION SELECT room, unnest([s, e]) FROM hy),
        ce AS (SELECT room, x AS lo, lead(x) OVER (PARTITION BY room ORDER BY x) AS hi FROM et),
        er AS (SELECT ce.room, lo, list(DISTINCT seg.speaker) AS sp FROM ce JOIN seg ON seg.room = ce.room AND seg.s < hi AND seg.e > lo GROUP BY ALL), eq AS (SELECT ce.room, lo, list(DISTINCT hy.speaker) AS sp FROM ce JOIN hy ON hy.room = ce.room AND hy.s < hi AND hy.e > lo GROUP BY ALL),
        ef AS (SELECT ce.room, hi - lo AS d, coalesce(er.sp, []) AS r, coalesce(eq.sp, []) AS q FROM ce LEFT JOIN er USING (room, lo) LEFT JOIN eq USING (room, lo)
          WHERE hi IS NOT NULL AND (er.sp IS NOT NULL OR eq.sp IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM eb WHERE {collar} > 0 AND eb.room = ce.room AND eb.x - {collar} / 2 < hi AND eb.x + {collar} / 2 > lo))
        SELECT room, sum(d * greatest(len(r) - len(q), 0))::DOUBLE AS missed, sum(d * greatest(len(q) - len(r), 0))::DOUBLE AS false_alarm, sum(d * (least(len(r), len(q)) - len(list_intersect(r, q))))::DOUBLE AS confusion, sum(d * len(r))::DOUBLE AS total FROM ef GROUP BY 1"""


_BY_OVERLAP = """x AS (SELECT pt.room, i, speaker, sum(least(pt.e, seg.e) - greatest(pt.s, seg.s)) AS o, min(k) AS k FROM pt JOIN seg ON pt.room = seg.room AND seg.e > pt.s AND seg.s < pt.e AND least(pt.e, seg.e) > greatest(pt.s, seg.s) GROUP BY 1, 2, 3),
  y AS (SELECT room, i, speaker FROM (SELECT *, row_number() OVER (PARTITION BY room, i ORDER BY o DESC, k) AS n FROM x) WHERE n = 1),
  z AS (SELECT pt.room, i, arg_min(speaker, k) AS speaker FROM pt JOIN seg ON pt.room = seg.room AND pt.e <= pt.s AND seg.s <= pt.s AND pt.s <= seg.e GROUP BY 1, 2)"""

QUERIES = {
    "assign_speakers": (assign_speakers, f"{_S}, {_BY_OVERLAP} SELECT pt.room, pt.i AS word_idx, coalesce(y.speaker, z.speaker, 'UNKNOWN') AS speaker FROM pt LEFT JOIN y USING (room, i) LEFT JOIN z USING (room, i)"),
    "assign_nearest": (assign_nearest, f"""{_S}, {_BY_OVERLAP},
        u AS (SELECT pt.*, coalesce(y.speaker, z.speaker) AS speaker FROM pt LEFT JOIN y USING (room, i) LEFT JOIN z USING (room, i)),
        v AS (SELECT room, i, speaker FROM (SELECT u.room, i, seg.speaker, row_number() OVER (PARTITION BY u.room, i ORDER BY abs((u.s + u.e) / 2 - (seg.s + seg.e) / 2), k) AS n FROM u JOIN seg ON u.room = seg.room WHERE u.speaker IS NULL) WHERE n = 1)
        SELECT u.room, u.i AS word_idx, coalesce(u.speaker, v.speaker, 'UNKNOWN') AS speaker FROM u LEFT JOIN v USING (room, i)"""),
    "as_of_speaker": (as_of_speaker, f"""{_S}, x AS (SELECT pt.room, i, pt.s, max_by(struct_pack(sp := speaker, e := seg.e), struct_pack(s := seg.s, k := k)) AS m FROM pt LEFT JOIN seg ON pt.room = seg.room AND seg.s <= pt.s GROUP BY 1, 2, 3)
        SELECT room, i AS point, coalesce(CASE WHEN s <= m.e THEN m.sp END, 'none') AS speaker FROM x"""),
    "nearest_turn": (nearest_turn, f"""{_S}, x AS (SELECT pt.room, i, k, CASE WHEN seg.s <= pt.s AND pt.s <= seg.e THEN 0 ELSE 1 END AS outside, abs(seg.s - pt.s) AS d FROM pt JOIN seg ON pt.room = seg.room)
        SELECT room, i AS point, k AS seg_idx FROM (SELECT *, row_number() OVER (PARTITION BY room, i ORDER BY outside, CASE WHEN outside = 1 THEN d ELSE 0 END, k) AS n FROM x) WHERE n = 1"""),
    "band_counts": (band_counts, f"""{_S}, x AS (SELECT seg.room, k, count_if(pt.e > seg.s AND pt.s < seg.e) AS a, count_if(pt.e > seg.s - 60 AND pt.s < seg.e + 60) AS b, count_if(pt.e > seg.s - 300 AND pt.s < seg.e + 300) AS c, min(greatest(0, seg.s - pt.e, pt.s - seg.e)) AS d
          FROM seg JOIN pt ON seg.room = pt.room GROUP BY 1, 2)
        SELECT room, k AS seg_idx, coalesce(a, 0) AS within_0, coalesce(b, 0) AS within_60, coalesce(c, 0) AS within_300, coalesce(CAST(d AS DOUBLE), -1.0) AS nearest FROM seg LEFT JOIN x USING (room, k)"""),
    "merged_ranges": (merged_ranges, f"{_S}, a AS ({_MERGE.format(k='room', t='seg')}) SELECT room, s AS t_start, e AS t_end FROM a"),
    "union_lengths": (union_lengths, f"{_S}, a AS ({_MERGE.format(k='room, speaker', t='seg')}) SELECT room, speaker, sum(e - s) AS covered FROM a GROUP BY 1, 2"),
    "close_segments": (close_segments, f"""WITH RECURSIVE {SEGMENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY s, k) AS r FROM seg),
        f AS (SELECT room, r, speaker, e AS reach, 1 AS g, s, e FROM n WHERE r = 1 UNION ALL
          SELECT n.room, n.r, n.speaker, CASE WHEN n.speaker = f.speaker AND n.s - f.reach < 900 THEN greatest(f.reach, n.e) ELSE n.e END, f.g + CASE WHEN n.speaker = f.speaker AND n.s - f.reach < 900 THEN 0 ELSE 1 END, n.s, n.e FROM f JOIN n ON n.room = f.room AND n.r = f.r + 1)
        SELECT room, any_value(speaker) AS speaker, min(s) AS t_start, max(e) AS t_end, count(*) AS n FROM f GROUP BY room, g"""),
    "gap_sessions": (gap_sessions, f"""WITH RECURSIVE {SEGMENTS_SQL}, n AS (SELECT room, s, CASE WHEN i % 9 < 6 THEN 'A' ELSE 'B' END AS sp, CASE WHEN i % 4 > 1 THEN NULL ELSE e END AS e, row_number() OVER (PARTITION BY room ORDER BY i) AS r FROM pt),
        f AS (SELECT room, r, sp, s AS began, e AS known, 1 AS g FROM n WHERE r = 1 UNION ALL
          SELECT n.room, n.r, n.sp, CASE WHEN n.sp <> f.sp OR coalesce(n.s - f.known > 3600, false) THEN n.s ELSE f.began END, CASE WHEN n.sp <> f.sp OR coalesce(n.s - f.known > 3600, false) THEN n.e ELSE coalesce(n.e, f.known) END,
            f.g + CASE WHEN n.sp <> f.sp OR coalesce(n.s - f.known > 3600, false) THEN 1 ELSE 0 END FROM f JOIN n ON n.room = f.room AND n.r = f.r + 1)
        SELECT room, any_value(sp) AS speaker, min(began) AS t_start, coalesce(arg_max(known, r), -1.0) AS t_end, count(*) AS n_words FROM f GROUP BY room, g"""),
    "overlap_matrix": (overlap_matrix, _OVERLAPS + " SELECT room, a_speaker, b_speaker, overlap FROM o"),
    "assigned_labels": (assigned_labels, _OVERLAPS + """, n AS (SELECT *, dense_rank() OVER (PARTITION BY room ORDER BY a_speaker) AS i, 1 << (dense_rank() OVER (PARTITION BY room ORDER BY b_speaker) - 1) AS bit FROM o),
        pick AS (SELECT DISTINCT room, 0 AS i, 0::BIGINT AS used, 0.0::DOUBLE AS total FROM n UNION ALL
          SELECT p.room, p.i + 1, p.used | z.bit, p.total + z.v FROM pick p JOIN (SELECT room, i, bit::BIGINT AS bit, overlap AS v FROM n UNION ALL SELECT DISTINCT room, i, 0::BIGINT, 0.0::DOUBLE FROM n) z ON z.room = p.room AND z.i = p.i + 1 AND p.used & z.bit = 0)
        SELECT room, max(total) AS total FROM pick GROUP BY room"""),
    "clipped_words": (clipped_words, f"{_S} SELECT room, i AS word_idx, s AS t_start, least(CASE WHEN i % 4 = 0 THEN 1704240000.0::DOUBLE ELSE e END, 1704240000.0::DOUBLE) AS t_end FROM pt WHERE s >= 1704153600 AND s < 1704240000"),
    "covered_turns": (covered_turns, f"""{_S}, a AS (SELECT *, arg_min(s, k) OVER (PARTITION BY room) AS f, arg_max(s, k) OVER (PARTITION BY room) AS t FROM seg),
        b AS (SELECT *, CASE WHEN t - f > 43200 THEN f + 43200 ELSE t END AS lim FROM a WHERE t > f), c AS (SELECT * FROM b WHERE t - f <= 43200 OR s < lim),
        d AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY k DESC) AS back, arg_max(s, k) OVER (PARTITION BY room) AS gone FROM c)
        SELECT room, k AS seg_idx, s AS t_start, CASE WHEN back = 2 THEN least(gone, lim) ELSE e END AS t_end FROM d WHERE back > 1"""),
    "coverage_shares": (coverage_shares, f"{_S} SELECT room, least(max(s - 1704067200) / 2592000.0::DOUBLE, 1.0) AS coverage FROM seg GROUP BY room"),
    "outcome_sets": (outcome_sets, f"""{_S}, a AS (SELECT *, e - s AS d, lag(e - s) OVER (PARTITION BY room ORDER BY s, k) AS pd FROM seg),
        b AS (SELECT speaker, d, CASE WHEN d < 900 THEN '<900s' WHEN d < 1900 THEN '<1900s' WHEN d < 3100 THEN '<3100s' ELSE '3100s+' END AS length,
          CASE WHEN pd IS NULL THEN 'first' WHEN pd < 900 THEN '<900s' WHEN pd < 1900 THEN '<1900s' WHEN pd < 3100 THEN '<3100s' ELSE '3100s+' END AS before FROM a)
        SELECT coalesce(length, '-') AS length, coalesce(before, '-') AS before, coalesce(speaker, '-') AS speaker, count(*) AS turns, count_if(d > 2000) AS long FROM b GROUP BY GROUPING SETS ((), (length), (before), (speaker), (length, before))"""),
    "diarization_errors": (diarization_errors, f"""WITH RECURSIVE {SEGMENTS_SQL}, h0 AS (SELECT room, CASE WHEN k % 5 = 0 THEN 'S0' ELSE speaker END AS speaker, s, e - 60 AS e FROM seg WHERE k % 7 <> 0),
        sides AS (SELECT *, row_number() OVER (PARTITION BY room, side, speaker ORDER BY s, e) AS r FROM (SELECT room, 0 AS side, speaker, s, e FROM seg UNION ALL SELECT room, 1, speaker, s, e FROM h0)), {_SWEEP},
        ov AS (SELECT room AS p, x AS a, y AS b, max(total) AS v FROM sweep GROUP BY 1, 2, 3 HAVING max(total) > 0), {assignment_sql('ov', 'mp')},
        hy AS (SELECT h0.room, coalesce(mp.a, 'unmapped ' || h0.speaker) AS speaker, s, e FROM h0 LEFT JOIN mp ON mp.p = h0.room AND mp.b = h0.speaker), {_errors_sql(0)}"""),
    "diarization_errors_collar": (diarization_errors_collar, f"WITH {SEGMENTS_SQL}, hy AS (SELECT room, speaker, s + 30 AS s, e FROM seg), {_errors_sql(120)}"),
}
