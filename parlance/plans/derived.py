"""Transcript tables derived from the driver's tables, and the same as SQL.

Words get a clock of half a second each (exact in binary).  A second system's transcript drops,
replaces and relabels words by their index.  Events become the segments and words of rooms: ten users on one day, so that their number grows
with the users and no room is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import FILLED_PAUSES, token, words_of
from parlance.operators import align

BY = ["conv_id"]
#: Bytes of the table of conversations a task: half a million words, which an operator sorts in about 50 MB.
TASK_BYTES = 2 << 20
#: Whole seconds since 1970 of a time without a zone, whatever the session's zone; before 1970 too the last that has begun.
SECONDS = "floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz)) / 1000000)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(turns: DataFrame) -> DataFrame:
    """Turns dealt by conversation to tasks whose number grows with the table: Spark joins tasks by their bytes in the shuffle, which as words take many times as much."""
    size = int(str(turns._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return turns.repartition(max(turns.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), *BY)


def _counted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, speaker, ws (words), before (words of earlier turns), places (of ws behind these, where several rows share the turn); turns are dealt, sorted and counted, not words.

    Rows that share a turn give their words by turns: every first word, then every second, and so on.
    """
    said = _dealt(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("role").alias("speaker"), "text").withColumn("ws", words_of(F.col("text"))).withColumn("n", F.size("ws"))
    same = Window.partitionBy("conv_id", "turn").orderBy("speaker", "text")
    shared = said.withColumn("nth", F.row_number().over(same) - 1).withColumn("sizes", F.collect_list("n").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    up_to = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    added = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, n: a + n)
    place = lambda p: added(F.transform("sizes", lambda n, k: F.least(n, p + F.when(k < F.col("nth"), 1).otherwise(0))))
    places = F.when((F.size("sizes") > 1) & (F.col("n") > 0), F.transform(F.sequence(F.lit(0), F.col("n") - 1), place))
    return shared.withColumn("before", up_to - added(F.col("sizes"))).select("conv_id", "turn", "speaker", "ws", "before", places.alias("places"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, speaker, word, word_idx (from 0 within the conversation), start, end."""
    each = _counted_turns(spark, sf_dir).select("conv_id", "turn", "speaker", "before", "places", F.posexplode("ws").alias("pos", "word"))
    idx = F.col("before") + F.coalesce(F.get("places", F.col("pos")), F.col("pos"))
    return each.select("conv_id", "turn", "speaker", "word", idx.alias("word_idx")).select("*", (F.col("word_idx") * 0.5).alias("start"), (F.col("word_idx") * 0.5 + 0.25).alias("end"))


def system_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another system might have heard: every 11th word lost, every 7th another, every 17th by the other speaker."""
    w = words(spark, sf_dir).where("word_idx % 11 <> 0")
    other = F.when(F.col("speaker") == "user", "assistant").otherwise("user")
    return w.withColumn("word", F.when(F.col("word_idx") % 7 == 0, "zz").otherwise(F.col("word"))).withColumn("speaker", F.when(F.col("word_idx") % 17 == 0, other).otherwise(F.col("speaker")))


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, speaker, before, ws: the words of each turn that has any, in order, of which the first is the conversation's word ``before``; words are not rows."""
    each = _counted_turns(spark, sf_dir).where("size(ws) > 0").groupBy("conv_id", "turn").agg(F.first("speaker").alias("speaker"), F.first("before").alias("before"), F.collect_list(F.struct("places", "ws")).alias("rows"))
    listed = F.flatten(F.transform("rows", lambda r: F.arrays_zip(r["places"].alias("at"), r["ws"].alias("w"))))
    return each.select("conv_id", "turn", "speaker", "before", F.when(F.size("rows") > 1, F.sort_array(listed)["w"]).otherwise(F.col("rows")[0]["ws"]).alias("ws"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, seg_idx, speaker, start, end, text: the human turns."""
    start, end = F.col("before") * 0.5, (F.col("before") + F.size("ws") - 1) * 0.5 + 0.25
    return turn_words(spark, sf_dir).select("conv_id", F.col("turn").cast("long").alias("seg_idx"), "speaker", start.alias("start"), end.alias("end"), F.array_join("ws", " ").alias("text"))


def heard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other system's words without every fifth turn, under its own labels, every 23rd word without one."""
    label = F.when(F.col("word_idx") % 23 == 0, F.lit(None)).when(F.col("speaker") == "user", "X").otherwise("Y")
    return system_words(spark, sf_dir).where("turn % 5 <> 3").withColumn("speaker", label)


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, tag, i1, i2, j1, j2: matching blocks of both transcripts' tokens and what lies between them."""
    tokens = lambda df, place: df.select("conv_id", F.col(place).alias("place"), token(F.col("word")).alias("token"))
    return align.alignment(tokens(words(spark, sf_dir), "word_idx"), tokens(placed_words(spark, sf_dir), "j"), BY)


def placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System words with j, their place among the words that are kept."""
    return system_words(spark, sf_dir).withColumn("j", F.col("word_idx") - F.floor(F.col("word_idx") / 11) - 1)


def marked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with placeholders, events and fillers at fixed indexes."""
    i = F.col("word_idx")
    word = F.when(i % 19 < 2, "[DATE].").when(i % 23 == 5, "[UM]").when(i % 13 == 4, "um").when(i % 29 == 7, "yeah").when(i % 31 == 8, "like").when(i % 37 == 9, "maybe").otherwise(F.col("word"))
    return words(spark, sf_dir).withColumn("word", word)


def _room(start):
    """As SQL's //, div rounds toward zero and stays a whole number."""
    return (F.expr("user_id div 10") * 1000 + F.floor(start / 86400) - 19723).cast("long")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room, seg_idx, speaker, start, end: events as stretches of talk."""
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0")
    start = F.expr(SECONDS).cast("double")
    return e.select(_room(start).alias("room"), F.col("event_id").alias("seg_idx"), F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("speaker"), start.alias("start"), (start + (F.col("event_id") % 7 + 1) * 600).alias("end"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """room, word_idx, start, end: the other events as words, every fifth without extent."""
    e = table(spark, sf_dir, "events").where("event_id % 3 <> 0")
    start = F.expr(SECONDS).cast("double")
    return e.select(_room(start).alias("room"), F.col("event_id").alias("word_idx"), start.alias("start"), (start + F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") % 400)).alias("end"), F.lit(None).cast("string").alias("speaker"))


WORDS_SQL = r"""
t0 AS (SELECT conv_id, turn, role, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations),
t1 AS (SELECT conv_id, turn, role AS speaker, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM t0),
t2 AS (SELECT conv_id, turn, speaker, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS i FROM t1),
w AS (SELECT conv_id, turn, speaker, word, i, CAST(i AS DOUBLE) * 0.5 AS s, CAST(i AS DOUBLE) * 0.5 + 0.25 AS e FROM t2),
h AS (SELECT conv_id, turn, CASE WHEN i % 17 = 0 THEN CASE WHEN speaker = 'user' THEN 'assistant' ELSE 'user' END ELSE speaker END AS speaker,
             CASE WHEN i % 7 = 0 THEN 'zz' ELSE word END AS word, i, s, e FROM w WHERE i % 11 <> 0),
m AS (SELECT conv_id, turn, speaker, CASE WHEN i % 19 < 2 THEN '[DATE].' WHEN i % 23 = 5 THEN '[UM]' WHEN i % 13 = 4 THEN 'um' WHEN i % 29 = 7 THEN 'yeah'
             WHEN i % 31 = 8 THEN 'like' WHEN i % 37 = 9 THEN 'maybe' ELSE word END AS word, i, s, e FROM w)"""

#: The headline's tokens (t) of items (keys, i, word) with their places and owners.
TOKENS_SQL = """{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i, pos) - 1 AS place FROM (SELECT {keys}, i, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (
  SELECT {keys}, i, list_filter(string_split_regex(regexp_replace(lower(regexp_replace(word, '\\[[^\\]]*\\]', ' ', 'g')), '[^a-z0-9''\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND NOT list_contains([""" + ", ".join(f"'{p}'" for p in FILLED_PAUSES) + """], x)) AS ts FROM {items})))"""
TOKEN_SQL = "regexp_replace(lower({}), '[^a-z0-9'']', '', 'g')"


def blocks_sql(ref: str, hyp: str, name: str) -> str:
    """CTEs that end in ``name`` (p, tag, i1, i2, j1, j2): matching blocks of the tokens of ``ref`` (p, i, t) and ``hyp`` (p, j, t), the longest first and then on either side of it, and what lies between them.  Needs WITH RECURSIVE."""
    skip = "greatest(0, g.alo - d.i, g.blo - d.j)"
    return f"""
{name}_run AS (SELECT p, min(i) AS i, min(j) AS j, count(*) AS n FROM (SELECT p, i, j, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS g FROM {ref} JOIN {hyp} USING (p, t)) GROUP BY p, i - j, g),
{name}_len AS (SELECT p, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT p, count(*) AS n FROM {ref} GROUP BY p) FULL JOIN (SELECT p, count(*) AS m FROM {hyp} GROUP BY p) USING (p)),
{name}_cut AS (SELECT p, 0 AS kind, 0::BIGINT AS alo, n::BIGINT AS ahi, 0::BIGINT AS blo, m::BIGINT AS bhi FROM {name}_len UNION ALL
  SELECT p, k, CASE k WHEN 0 THEN alo WHEN 1 THEN x ELSE x + n END, CASE k WHEN 0 THEN x WHEN 1 THEN x + n ELSE ahi END, CASE k WHEN 0 THEN blo WHEN 1 THEN y ELSE y + n END, CASE k WHEN 0 THEN y WHEN 1 THEN y + n ELSE bhi END
  FROM (SELECT * FROM (SELECT g.*, d.i + {skip} AS x, d.j + {skip} AS y, least(d.n - {skip}, g.ahi - d.i - {skip}, g.bhi - d.j - {skip}) AS n FROM {name}_cut g JOIN {name}_run d ON g.p = d.p AND g.kind <> 1 AND d.i < g.ahi AND d.j < g.bhi AND d.i + d.n > g.alo AND d.j + d.n > g.blo) WHERE n > 0
        QUALIFY row_number() OVER (PARTITION BY p, alo, ahi, blo, bhi ORDER BY n DESC, x, y) = 1), (VALUES (0), (1), (2)) v(k)),
{name}_one AS (SELECT p, alo AS i1, ahi AS i2, blo AS j1, bhi AS j2, CASE WHEN lag(ahi) OVER q = alo AND lag(bhi) OVER q = blo THEN 0 ELSE 1 END AS opens FROM {name}_cut WHERE kind = 1 WINDOW q AS (PARTITION BY p ORDER BY alo)),
{name}_eq AS (SELECT p, min(i1) AS i1, max(i2) AS i2, min(j1) AS j1, max(j2) AS j2 FROM (SELECT *, sum(opens) OVER (PARTITION BY p ORDER BY i1) AS g FROM {name}_one) GROUP BY p, g),
{name}_gap AS (SELECT p, lag(i2, 1, 0) OVER q AS i1, i1 AS i2, lag(j2, 1, 0) OVER q AS j1, j1 AS j2 FROM (SELECT * FROM {name}_eq UNION ALL SELECT p, n, n, m, m FROM {name}_len) WINDOW q AS (PARTITION BY p ORDER BY i1, i2, j1)),
{name} AS (SELECT p, 'equal' AS tag, i1, i2, j1, j2 FROM {name}_eq UNION ALL
  SELECT p, CASE WHEN i1 = i2 THEN 'insert' WHEN j1 = j2 THEN 'delete' ELSE 'replace' END, i1, i2, j1, j2 FROM {name}_gap WHERE i1 < i2 OR j1 < j2)"""


#: The other's words with their places (hj), and blocks of both transcripts (bl).
ALIGN_SQL = f"""
hj AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS j FROM h),
ra AS (SELECT conv_id AS p, i, {TOKEN_SQL.format('word')} AS t FROM w), qa AS (SELECT conv_id AS p, j, {TOKEN_SQL.format('word')} AS t FROM hj),
{blocks_sql('ra', 'qa', 'ba')}, bl AS (SELECT p AS conv_id, tag, i1, i2, j1, j2 FROM ba)"""

#: Human turns (tr) and what the other system heard of them (hh).
TURNS_SQL = r"""
tr AS (SELECT conv_id, CAST(turn AS BIGINT) AS k, any_value(speaker) AS speaker, min(s) AS s, max(e) AS e, string_agg(word, ' ' ORDER BY i) AS text FROM w GROUP BY conv_id, turn),
hh AS (SELECT conv_id, CASE WHEN i % 23 = 0 THEN 'UNKNOWN' WHEN speaker = 'user' THEN 'X' ELSE 'Y' END AS speaker, word, i, s, e FROM h WHERE turn % 5 <> 3)"""


def assignment_sql(overlaps: str, name: str) -> str:
    """CTEs that end in ``name`` (p, a, b): the one-to-one assignment with the largest total of ``overlaps`` (p, a, b, v).  Needs WITH RECURSIVE."""
    return f"""
{name}_n AS (SELECT *, dense_rank() OVER (PARTITION BY p ORDER BY a) AS i, 1 << (dense_rank() OVER (PARTITION BY p ORDER BY b) - 1) AS bit FROM {overlaps}),
{name}_pick AS (SELECT DISTINCT p, 0 AS i, 0::BIGINT AS used, 0.0::DOUBLE AS total, CAST([] AS VARCHAR[]) AS chosen FROM {name}_n UNION ALL
  SELECT x.p, x.i + 1, x.used | z.bit, x.total + z.v, CASE WHEN z.bit = 0 THEN x.chosen ELSE list_append(x.chosen, z.a || '|' || z.b) END
  FROM {name}_pick x JOIN (SELECT p, i, bit::BIGINT AS bit, v, a, b FROM {name}_n UNION ALL SELECT DISTINCT p, i, 0::BIGINT, 0.0::DOUBLE, '', '' FROM {name}_n) z ON z.p = x.p AND z.i = x.i + 1 AND x.used & z.bit = 0),
{name}_best AS (SELECT p, unnest(arg_max(chosen, total)) AS c FROM {name}_pick GROUP BY p),
{name} AS (SELECT p, split_part(c, '|', 1) AS a, split_part(c, '|', 2) AS b FROM {name}_best)"""


def distance_sql(pairs: str, name: str) -> str:
    """CTEs that end in ``name`` (p, errors): the edit distance of the token lists r and q of ``pairs`` (p, r, q), a row of distances at a time.  Needs WITH RECURSIVE."""
    return f"""
{name}_r AS (SELECT p, unnest(range(1, len(r) + 1)) AS i, unnest(r) AS t FROM {pairs}), {name}_q AS (SELECT p, unnest(range(1, len(q) + 1)) AS j, unnest(q) AS t FROM {pairs}),
{name}_dp AS (SELECT p, 0::BIGINT AS i, j, j AS v FROM (SELECT p, unnest(range(0, len(q) + 1)) AS j FROM {pairs}) UNION ALL
  SELECT p, i, j, j + min(t - j) OVER (PARTITION BY p ORDER BY j ROWS UNBOUNDED PRECEDING) FROM (
    SELECT d.p, x.i, d.j, least(d.v + 1, coalesce(lag(d.v) OVER (PARTITION BY d.p ORDER BY d.j) + CASE WHEN x.t = y.t THEN 0 ELSE 1 END, d.v + 1)) AS t
    FROM {name}_dp d JOIN {name}_r x ON d.p = x.p AND x.i = d.i + 1 LEFT JOIN {name}_q y ON d.p = y.p AND y.j = d.j)),
{name} AS (SELECT d.p, d.v AS errors FROM {name}_dp d JOIN {pairs} x ON d.p = x.p AND d.i = len(x.r) AND d.j = len(x.q))"""


def path_sql(pairs: str, name: str) -> str:
    """CTEs that end in ``name`` (p, path): a shortest edit path of the token lists r and q of ``pairs`` (p, r, q), a letter (h, s, d, i) for each step.  Needs WITH RECURSIVE.

    A row of distances at a time, each cell with the path to it; walking back, hits go before deletions before insertions before substitutions.
    """
    return f"""
{name}_r AS (SELECT p, unnest(range(1, len(r) + 1)) AS i, unnest(r) AS t FROM {pairs}), {name}_q AS (SELECT p, unnest(range(1, len(q) + 1)) AS j, unnest(q) AS t FROM {pairs}),
{name}_dp(p, j, i, v, path) USING KEY (p, j) AS (SELECT p, j, 0::BIGINT, j, repeat('i', j::INT) FROM (SELECT p, unnest(range(0, len(q) + 1)) AS j FROM {pairs}) UNION
  SELECT p, j, i, v, CASE WHEN kind = 'i' THEN last_value(CASE WHEN kind <> 'i' THEN path END IGNORE NULLS) OVER o || repeat('i', (j - last_value(CASE WHEN kind <> 'i' THEN j END IGNORE NULLS) OVER o)::INT) ELSE path END
  FROM (SELECT p, j, i, v, CASE WHEN same AND v = diag THEN 'h' WHEN v = up + 1 THEN 'd' WHEN v = lag(v) OVER o + 1 THEN 'i' ELSE 's' END AS kind, CASE WHEN same AND v = diag THEN before || 'h' WHEN v = up + 1 THEN path || 'd' ELSE before || 's' END AS path
        FROM (SELECT *, j + min(t - j) OVER o AS v FROM (SELECT d.p, x.i, d.j, d.v AS up, lag(d.v) OVER o AS diag, d.path, lag(d.path) OVER o AS before, coalesce(x.t = y.t, false) AS same, least(d.v + 1, coalesce(lag(d.v) OVER o + CASE WHEN x.t = y.t THEN 0 ELSE 1 END, d.v + 1)) AS t
              FROM {name}_dp d JOIN {name}_r x ON d.p = x.p AND x.i = d.i + 1 LEFT JOIN {name}_q y ON d.p = y.p AND y.j = d.j WINDOW o AS (PARTITION BY d.p ORDER BY d.j))
              WINDOW o AS (PARTITION BY p ORDER BY j ROWS UNBOUNDED PRECEDING)) WINDOW o AS (PARTITION BY p ORDER BY j)) WINDOW o AS (PARTITION BY p ORDER BY j ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT d.p, d.path FROM {name}_dp d JOIN {pairs} x ON d.p = x.p AND d.j = len(x.q))"""


SEGMENTS_SQL = r"""
seg AS (SELECT user_id // 10 * 1000 + CAST(floor(floor(epoch_us(ts) / 1000000) / 86400) AS BIGINT) - 19723 AS room, event_id AS k, 'S' || CAST(user_id % 4 AS VARCHAR) AS speaker, CAST(floor(epoch_us(ts) / 1000000) AS DOUBLE) AS s,
               CAST(floor(epoch_us(ts) / 1000000) AS DOUBLE) + (event_id % 7 + 1) * 600 AS e FROM events WHERE event_id % 3 = 0),
pt AS (SELECT user_id // 10 * 1000 + CAST(floor(floor(epoch_us(ts) / 1000000) / 86400) AS BIGINT) - 19723 AS room, event_id AS i, CAST(floor(epoch_us(ts) / 1000000) AS DOUBLE) AS s,
              CAST(floor(epoch_us(ts) / 1000000) AS DOUBLE) + CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 400 END AS e FROM events WHERE event_id % 3 <> 0)"""
