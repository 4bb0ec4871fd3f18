"""Queries on times of words, windows and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import align, corrections, islands, retime, tokens
from parlance.plans import derived as D
from parlance.plans.derived import ALIGN_SQL, BY, SEGMENTS_SQL, TOKENS_SQL, TURNS_SQL, WORDS_SQL, path_sql


def retimed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words anchored to those that another hearing has of them, some of these far from where the words stood."""
    w = D.words(spark, sf_dir).select("conv_id", "word_idx", "start", "end")
    shift = F.when(F.col("word_idx") % 3 == 0, 1.5).when(F.col("word_idx") % 5 == 0, -4.0).otherwise(0.125)
    heard = D.placed_words(spark, sf_dir).select("conv_id", "j", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
    return retime.anchored(w, retime.anchors(D.alignment(spark, sf_dir), heard, BY), BY).select("conv_id", "word_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "anchored")


def _paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with pauses between turns and a recording's duration."""
    shift = F.col("turn") * 2.5
    w = D.words(spark, sf_dir).withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift)
    return w.withColumn("duration", F.max("end").over(D.Window.partitionBy("conv_id")) + 1)


def asr_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retime.windows(_paced(spark, sf_dir), BY, "duration")


def verbatim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.system_words(spark, sf_dir).select("conv_id", F.when(F.col("word_idx") % 7 == 0, "inserted").otherwise("matched").alias("origin"))
    sources = D.words(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("source_words"), F.count_if(F.col("word_idx") % 11 == 0).alias("dropped_words"))
    return retime.verbatim_stats(w, asr_windows(spark, sf_dir), sources, BY)


def anchor_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the other system's word is from each turn's start."""
    w = D.words(spark, sf_dir)
    t = w.groupBy("conv_id", "turn").agg(F.min("start").alias("start"), F.count("*").alias("n_tokens")).withColumnRenamed("turn", "seg_idx")
    h = D.placed_words(spark, sf_dir).select("conv_id", "j", (F.col("start") + F.col("word_idx") % 5 * 0.25).alias("start"))
    return retime.anchor_errors(t, h, D.alignment(spark, sf_dir).where("tag = 'equal'"), BY)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each two neighbouring places of the other system are one word."""
    tokens = D.words(spark, sf_dir).select("conv_id", F.col("word_idx").alias("i"), "speaker")
    owners = D.placed_words(spark, sf_dir).select("conv_id", "j", F.floor(F.col("j") / 2).alias("word_idx"))
    return retime.truth_by_content(tokens, owners, D.alignment(spark, sf_dir).where("tag = 'equal'"), BY)


def content_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir)


def _relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = D.heard_words(spark, sf_dir).select("conv_id", "word_idx", "speaker", "start", "end")
    truth = D.words(spark, sf_dir).where("word_idx % 4 <> 1").select("conv_id", "word_idx", F.col("speaker").alias("truth"))
    mapping = h.select("conv_id").distinct().select("conv_id", F.lit("X").alias("speaker"), F.lit("user").alias("name"))
    return retime.relabelled(h, truth, mapping, BY, longest=12)


def oracle_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relabelled(spark, sf_dir).select("conv_id", "word_idx", "speaker", "is_anchored", "is_changed")


def word_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retime.word_accuracy(_relabelled(spark, sf_dir), D.turns(spark, sf_dir), BY)


def dominant_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.segments(spark, sf_dir)
    levels = D.points(spark, sf_dir).select("room", F.col("start").alias("t"), (F.col("word_idx") % 7).alias("left_power"), (F.col("word_idx") % 5).alias("right_power"))
    out = retime.dominant_timeline(s.where("seg_idx % 2 = 0"), s.where("seg_idx % 2 = 1"), levels, ["room"], 3600.0)
    return out.select("room", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "speaker")


def insertion_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of tokens that one transcript of a turn has and the other, of half as many turns' words, has not."""
    by = ["conv_id", "turn"]
    i = F.col("word_idx")
    ref = tokens.tracked_tokens(D.words(spark, sf_dir).where(i % 9 >= 1 + i % 4), by)
    hyp = tokens.tracked_tokens(D.words(spark, sf_dir), by)
    pairs = tokens.listed(ref, by, "ref").join(tokens.listed(hyp, by, "hyp"), by)
    said = hyp.select(*by, F.col("place").alias("word_idx"), F.col("token").alias("word"))
    kinds = islands.insertion_kind(said, by, T.BACKCHANNELS, T.DISCOURSE).select(*by, F.col("word_idx").alias("j"), "kind")
    steps = align.edit_steps(pairs, by).join(kinds, [*by, "j"], "left")
    return retime.insertion_blocks(steps, by, least=2)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.shown_turns(_paced(spark, sf_dir), BY)


def shown_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("conv_id", "run", "first", "last", "speaker", "line")


def _measure(text: F.Column) -> F.Column:
    """A tokenizer's stand-in: a token for every four characters."""
    return F.ceil(F.length(text) / 4)


def request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of at most 400 tokens, each of which shows the last four turns of the one before again."""
    return corrections.requests(_lines(spark, sf_dir), BY, _measure, budget=400)


def _ask(prompt: str) -> str:
    """A model's stand-in: quotes the second and third word of each turn of an even number of words, for another speaker who is shown; fails on prompts of a multiple of seven characters."""
    import json

    if len(prompt) % 7 == 0:
        raise TimeoutError
    lines = [(k, who, rest.split("]  ", 1)[1].split()) for k, who, rest in (line.split("  ", 2) for line in prompt.split("\n"))]
    labels = sorted({who for _, who, _ in lines})
    found = [{"turn": int(k), "text": " ".join(ws[1:3]), "speaker": labels[labels.index(who) - 1], "action": "split"} for k, who, ws in lines if len(ws) % 2 == 0]
    return "Here:\n```json\n" + json.dumps(found, ensure_ascii=False) + "\n```"


def reviewed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of a review, from words to requests, prompts, answers and what of them holds."""
    got = corrections.reviewed(_paced(spark, sf_dir), BY, _ask, _measure, budget=400)
    return got.where("word_idx is null").select("conv_id", *[F.col("report")[c].alias(c) for c in corrections.COUNTERS])


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corrections.prompts(_lines(spark, sf_dir), BY)
    return p.select("conv_id", F.length("prompt").cast("long").alias("chars"), F.array_join("labels", ",").alias("labels"))


def located_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three words of each turn, or words that aren't there, stand in it."""
    t = D.turns(spark, sf_dir).select("conv_id", "seg_idx", F.transform(T.words_of(F.col("text")), T.token).alias("tokens"))
    quote = F.when(F.col("seg_idx") % 3 == 0, F.array(F.lit("qq"), F.lit("zz"))).otherwise(F.slice("tokens", 4, 3))
    return corrections.located(t.withColumn("quote", quote), BY).select("conv_id", "seg_idx", F.coalesce("found", F.lit(-1)).cast("long").alias("found"))


def flagged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir).withColumnRenamed("seg_idx", "turn_idx")
    flags = t.where("turn_idx % 4 = 1").select("conv_id", F.col("turn_idx").alias("flag"), F.when(F.col("turn_idx") % 8 == 1, F.concat(F.lit(" "), "text", F.lit(" "))).otherwise("not said").alias("turn_text"))
    return corrections.flagged_turns(t, flags, BY, ("user", "assistant")).select("conv_id", "flag", "turn_idx")


def flipped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.turns(spark, sf_dir).withColumnRenamed("seg_idx", "turn_idx")
    flagged = t.where("turn_idx % 4 = 1").select("conv_id", "turn_idx")
    return corrections.flipped_words(D.system_words(spark, sf_dir), t, flagged, BY, ("user", "assistant")).groupBy("conv_id", "speaker").agg(F.count("*").alias("n"), F.count_if("flipped").alias("flipped"))


def short_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.short_turns(D.words(spark, sf_dir), BY, most=150)


def corrected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that quote three words of every other run: some name nobody who was shown, some a turn that wasn't."""
    w = D.words(spark, sf_dir)
    t = D.turns(spark, sf_dir)
    other = F.when(F.col("seg_idx") % 5 == 4, "nobody").when(F.col("speaker") == "user", "assistant").otherwise("user")
    entries = t.where("seg_idx % 2 = 0").select(
        "conv_id", F.lit(0).alias("request"), F.lit(0).alias("first_run"), F.lit(1000).alias("runs"), F.col("seg_idx").alias("place"), F.col("seg_idx").cast("int").alias("turn"), F.array_join(F.slice(T.words_of(F.col("text")), 2, 3), " ").alias("text"),
        other.alias("speaker"), F.lit("split").alias("action"), F.lit(True).alias("valid"), F.lit(False).alias("unreadable"),
    )
    got = corrections.corrected(w, entries, BY)
    return got.where("word_idx is null").select("conv_id", *[F.col("report")[c].alias(c) for c in corrections.COUNTERS])


_W = f"WITH {WORDS_SQL}"
_EQUAL = f"WITH RECURSIVE {WORDS_SQL}, {ALIGN_SQL}, eq AS (SELECT conv_id, i1 + k AS i, j1 + k AS j FROM (SELECT conv_id, i1, j1, unnest(range(i2 - i1)) AS k FROM bl WHERE tag = 'equal'))"
_PACED = f"WITH RECURSIVE {WORDS_SQL}, pc AS (SELECT conv_id, turn, speaker, word, i, s + 2.5 * turn AS s, e + 2.5 * turn AS e, max(e + 2.5 * turn) OVER (PARTITION BY conv_id) + 1 AS d FROM w)"
_WINDOWS = f"""{_PACED}, fw AS (SELECT conv_id, i, 0::BIGINT AS win, i AS at, s AS began, e AS last FROM pc WHERE i = 0 UNION ALL
  SELECT p.conv_id, p.i, CASE WHEN p.i - f.at >= 90 OR p.e - f.began > 26 OR (p.s - f.last >= 2 AND f.last - f.began >= 3) THEN f.win + 1 ELSE f.win END, CASE WHEN p.i - f.at >= 90 OR p.e - f.began > 26 OR (p.s - f.last >= 2 AND f.last - f.began >= 3) THEN p.i ELSE f.at END,
    CASE WHEN p.i - f.at >= 90 OR p.e - f.began > 26 OR (p.s - f.last >= 2 AND f.last - f.began >= 3) THEN p.s ELSE f.began END, p.e FROM fw f JOIN pc p ON p.conv_id = f.conv_id AND p.i = f.i + 1),
  gw AS (SELECT fw.conv_id, win AS "window", min(i) AS first, max(i) + 1 AS last, min(began) AS word_start, max(fw.last) AS word_end FROM fw GROUP BY 1, 2),
  dw AS (SELECT gw.*, (SELECT max(d) FROM pc WHERE pc.conv_id = gw.conv_id) AS d, coalesce(lag(word_end) OVER q, 0) AS pe, lead(word_start) OVER q AS ns FROM gw WINDOW q AS (PARTITION BY conv_id ORDER BY "window")),
  ww AS (SELECT conv_id, "window", first, last, word_start, word_end, greatest(0.0, least(greatest(word_start - 0.25, (pe + word_start) / 2), word_start))::DOUBLE AS audio_start, least(d, greatest(least(word_end + 0.25, (word_end + coalesce(ns, d)) / 2), word_end))::DOUBLE AS audio_end FROM dw)"""
_RUN = "SELECT *, sum(CASE WHEN speaker IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM {})"
_CLOCK = "format('{{:02d}}:{{:02d}}:{{:02d}}.{{:d}}', CAST(round_even({0} * 10, 0) AS BIGINT) // 36000, CAST(round_even({0} * 10, 0) AS BIGINT) // 600 % 60, CAST(round_even({0} * 10, 0) AS BIGINT) // 10 % 60, CAST(round_even({0} * 10, 0) AS BIGINT) % 10)"
_SHOWN = f"""{_PACED}, rr AS ({_RUN.format('pc')}), rg AS (SELECT conv_id, run, any_value(speaker) AS speaker, min(i) AS first, max(i) + 1 AS last, min(s) AS s, max(e) AS e, string_agg(word, ' ' ORDER BY i) AS t FROM rr GROUP BY 1, 2),
  rl AS (SELECT *, row_number() OVER q - 1 AS n, s - lag(e) OVER q AS gap FROM rg WINDOW q AS (PARTITION BY conv_id ORDER BY first)),
  sh AS (SELECT conv_id, n AS run, first, last, speaker, n || '  ' || speaker || '  [' || {_CLOCK.format('s')} || CASE WHEN gap IS NULL THEN '  ----' ELSE ' +' || format('{{:.1f}}', greatest(gap, 0)) || 's' END || ']  ' || t AS line FROM rl)"""
_LABELS = f"""{_W}, {TURNS_SQL}, a AS (SELECT conv_id, i, s, e, CASE WHEN speaker = 'X' THEN 'user' ELSE speaker END AS speaker FROM hh), b AS ({_RUN.format('a')}), c AS (SELECT *, count(*) OVER (PARTITION BY conv_id, run) AS n FROM b),
  ol AS (SELECT c.conv_id, c.i, c.s, c.e, c.speaker AS was, n <= 12 AND c.i % 4 <> 1 AS hit, w.speaker AS truth FROM c JOIN w ON w.conv_id = c.conv_id AND w.i = c.i)"""

QUERIES = {
    "retimed_words": (retimed_words, f"""{_EQUAL}, sh AS (SELECT eq.conv_id, eq.i, s + CASE WHEN hj.i % 3 = 0 THEN 1.5 WHEN hj.i % 5 = 0 THEN -4.0 ELSE 0.125 END AS x, e + CASE WHEN hj.i % 3 = 0 THEN 1.5 WHEN hj.i % 5 = 0 THEN -4.0 ELSE 0.125 END AS y FROM eq JOIN hj USING (conv_id, j)),
        a AS (SELECT w.conv_id, w.i, s, e, round(x, 3) AS x, round(greatest(x, y), 3) AS y FROM w LEFT JOIN sh ON sh.conv_id = w.conv_id AND sh.i = w.i), b AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS t0, first_value(x IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1, count(x) OVER (PARTITION BY conv_id ORDER BY i) AS run, x IS NOT NULL AS hit FROM a),
        c AS (SELECT *, bool_and(coalesce(t1 >= t0 AND t0 <= s AND e <= t1, false)) FILTER (NOT hit) OVER (PARTITION BY conv_id, run) AS stays, count(*) FILTER (NOT hit) OVER (PARTITION BY conv_id, run) AS n, row_number() OVER (PARTITION BY conv_id, run, hit ORDER BY i) - 1 AS k, count(x) OVER (PARTITION BY conv_id) AS anchors FROM b),
        d AS (SELECT *, CASE WHEN hit THEN round(x, 3) WHEN anchors = 0 THEN s WHEN t0 IS NULL THEN least(s, t1) WHEN t1 IS NULL THEN greatest(s, t0) WHEN stays THEN s ELSE round(t0 + CASE WHEN t1 > t0 THEN (t1 - t0) / n ELSE 0 END * k, 3) END AS p,
          CASE WHEN hit THEN round(y, 3) WHEN anchors = 0 THEN e WHEN t0 IS NULL THEN least(e, t1) WHEN t1 IS NULL THEN greatest(e, s, t0) WHEN stays THEN e ELSE round(t0 + CASE WHEN t1 > t0 THEN (t1 - t0) / n ELSE 0 END * (k + 1), 3) END AS q FROM c),
        f AS (SELECT conv_id, i, hit, q, round(greatest(max(p) OVER (PARTITION BY conv_id ORDER BY i), 0), 3) AS p FROM d) SELECT conv_id, i AS word_idx, CAST(p AS DOUBLE) AS t_start, CAST(round(greatest(q, p), 3) AS DOUBLE) AS t_end, hit AS anchored FROM f"""),
    "asr_windows": (asr_windows, f"{_WINDOWS} SELECT * FROM ww"),
    "verbatim_stats": (verbatim_stats, f"""{_WINDOWS}, a AS (SELECT conv_id, count(*) AS verbatim_words, count_if(i % 7 = 0) AS inserted_words FROM h GROUP BY 1), b AS (SELECT conv_id, count(*) AS source_words, count_if(i % 11 = 0) AS dropped_words FROM w GROUP BY 1), c AS (SELECT conv_id, count(*) AS windows FROM ww GROUP BY 1)
        SELECT conv_id, source_words, dropped_words, windows, coalesce(verbatim_words, 0) AS verbatim_words, coalesce(inserted_words, 0) AS inserted_words, CAST(coalesce(round(inserted_words / verbatim_words, 4), 0) AS DOUBLE) AS insertion_rate FROM b JOIN c USING (conv_id) LEFT JOIN a USING (conv_id)"""),
    "anchor_errors": (anchor_errors, f"{_EQUAL}, t AS (SELECT conv_id, turn, min(i) AS i, min(s) AS s FROM w GROUP BY 1, 2) SELECT t.conv_id, t.turn AS seg_idx, abs(hj.s + hj.i % 5 * 0.25 - t.s) AS error FROM t JOIN eq ON eq.conv_id = t.conv_id AND eq.i = t.i JOIN hj ON hj.conv_id = eq.conv_id AND hj.j = eq.j"),
    "content_truth": (content_truth, f"{_EQUAL} SELECT eq.conv_id, j // 2 AS word_idx, arg_min(w.speaker, j) AS truth FROM eq JOIN w ON w.conv_id = eq.conv_id AND w.i = eq.i GROUP BY 1, 2"),
    "oracle_labels": (oracle_labels, f"{_LABELS} SELECT conv_id, i AS word_idx, CASE WHEN hit THEN truth ELSE was END AS speaker, hit AS is_anchored, hit AND truth <> was AS is_changed FROM ol"),
    "word_accuracy": (word_accuracy, f"""{_LABELS}, z AS (SELECT ol.conv_id, ol.i, CASE WHEN hit THEN ol.truth ELSE was END AS speaker, max_by(struct_pack(sp := tr.speaker, e := tr.e), tr.s) AS t, any_value((ol.s + ol.e) / 2) AS mid FROM ol JOIN tr ON tr.conv_id = ol.conv_id AND tr.s <= (ol.s + ol.e) / 2 GROUP BY 1, 2, 3)
        SELECT conv_id, count_if(speaker = t.sp) AS correct, count(*) AS scored FROM z WHERE mid <= t.e GROUP BY 1"""),
    "dominant_timeline": (dominant_timeline, f"""WITH {SEGMENTS_SQL}, b AS (SELECT DISTINCT room, unnest([s, e]) AS x FROM seg), c AS (SELECT room, x AS lo, lead(x) OVER (PARTITION BY room ORDER BY x) AS hi FROM b),
        d AS (SELECT c.room, lo, hi, bool_or(k % 2 = 0) AS l, bool_or(k % 2 = 1) AS r FROM c JOIN seg ON seg.room = c.room AND seg.s < hi AND seg.e > lo GROUP BY 1, 2, 3)
        SELECT room, lo AS t_start, hi AS t_end, CASE WHEN l AND (NOT r OR coalesce((SELECT sum(i % 7) >= sum(i % 5) FROM pt WHERE pt.room = d.room AND pt.s >= lo AND pt.s < hi), true)) THEN 'LEFT' ELSE 'RIGHT' END AS speaker FROM d"""),
    "insertion_blocks": (insertion_blocks, f"""WITH RECURSIVE {WORDS_SQL}, {TOKENS_SQL.format(name='rt', items="(SELECT conv_id, turn, i, word FROM w WHERE i % 9 >= 1 + i % 4)", keys='conv_id, turn')}, {TOKENS_SQL.format(name='qt', items="(SELECT conv_id, turn, i, word FROM w)", keys='conv_id, turn')},
        pr AS (SELECT conv_id || '|' || turn AS p, conv_id, turn, r, q FROM (SELECT conv_id, turn, list(t ORDER BY place) AS r FROM rt GROUP BY 1, 2) JOIN (SELECT conv_id, turn, list(t ORDER BY place) AS q FROM qt GROUP BY 1, 2) USING (conv_id, turn)), {path_sql('pr', 'pa')},
        st AS (SELECT p, k, tag, sum((tag <> 'i')::INT) OVER o - (tag <> 'i')::INT AS i, sum((tag <> 'd')::INT) OVER o - (tag <> 'd')::INT AS j FROM (SELECT p, unnest(range(1, length(path) + 1)) AS k, unnest(string_split(path, '')) AS tag FROM pa) WINDOW o AS (PARTITION BY p ORDER BY k)),
        kd AS (SELECT conv_id || '|' || turn AS p, place AS j, CASE WHEN coalesce(t = lag(t) OVER o, false) OR coalesce(t = lag(t, 2) OVER o, false) OR coalesce(t = lead(t) OVER o, false) OR coalesce(t = lead(t, 2) OVER o, false) THEN 'repetition' WHEN t IN ('{"', '".join(T.BACKCHANNELS)}') THEN 'backchannel'
               WHEN t IN ('{"', '".join(T.DISCOURSE)}') THEN 'discourse marker' ELSE 'other insertion' END AS kind FROM qt WINDOW o AS (PARTITION BY conv_id, turn ORDER BY place)),
        a AS (SELECT st.*, kind, k - row_number() OVER (PARTITION BY st.p ORDER BY k) AS g FROM st JOIN kd ON kd.p = st.p AND kd.j = st.j AND tag = 'i'), b AS (SELECT p, g, kind, count(*) AS n, min(j) AS lo, max(j) AS hi, min(i) AS ra FROM a GROUP BY 1, 2, 3)
        SELECT conv_id, turn, CAST(min(lo) AS BIGINT) AS first, CAST(max(hi) + 1 AS BIGINT) AS last, CAST(min(ra) AS BIGINT) AS ref_at, (list(kind ORDER BY n DESC, lo))[1] AS category, string_agg(kind || '=' || n, ' ' ORDER BY kind) AS counts FROM b JOIN pr USING (p) GROUP BY conv_id, turn, g HAVING max(hi) - min(lo) >= 1"""),
    "shown_turns": (shown_turns, f"{_SHOWN} SELECT conv_id, run, first, last, speaker, line FROM sh"),
    "prompts": (prompts, f"{_SHOWN} SELECT conv_id, CAST(length(string_agg(line, chr(10) ORDER BY run)) AS BIGINT) AS chars, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS labels FROM sh GROUP BY 1"),
    "located_quotes": (located_quotes, f"""{_W}, {TURNS_SQL}, a AS (SELECT conv_id, k, list_transform(string_split_regex(text, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9'']', '', 'g')) AS t FROM tr),
        b AS (SELECT *, list_filter(CASE WHEN k % 3 = 0 THEN ['qq', 'zz'] ELSE t[4:6] END, lambda x: x <> '') AS q FROM a), c AS (SELECT conv_id, k, t, q, unnest(range(0, len(t) + 1)) AS p FROM b)
        SELECT conv_id, k AS seg_idx, coalesce(min(p) FILTER (len(q) > 0 AND t[p + 1:p + len(q)] = q), -1) AS found FROM c GROUP BY 1, 2"""),
    "flagged_turns": (flagged_turns, f"""{_W}, {TURNS_SQL}, f AS (SELECT conv_id, k AS flag, CASE WHEN k % 8 = 1 THEN text ELSE 'not said' END AS t FROM tr WHERE k % 4 = 1) SELECT f.conv_id, flag, min(tr.k) AS turn_idx FROM f LEFT JOIN tr ON tr.conv_id = f.conv_id AND tr.text = f.t GROUP BY 1, 2"""),
    "flipped_words": (flipped_words, f"""{_W}, {TURNS_SQL}, x AS (SELECT h.conv_id, h.i, h.speaker, bool_or(tr.k IS NOT NULL) AS flip FROM h LEFT JOIN tr ON tr.conv_id = h.conv_id AND tr.k % 4 = 1 AND h.s >= tr.s - 1e-6 AND h.s <= tr.e + 1e-6 AND h.speaker = tr.speaker GROUP BY 1, 2, 3)
        SELECT conv_id, CASE WHEN flip THEN CASE WHEN speaker = 'user' THEN 'assistant' ELSE 'user' END ELSE speaker END AS speaker, count(*) AS n, count_if(flip) AS flipped FROM x GROUP BY 1, 2"""),
    "short_turns": (short_turns, f"""WITH RECURSIVE {WORDS_SQL}, rr AS ({_RUN.format('w')}), a AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, run) AS whole, sum(CASE WHEN coalesce(q, true) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, run ORDER BY i) AS part
          FROM (SELECT *, regexp_matches(lag(word) OVER (PARTITION BY conv_id, run ORDER BY i), '[.!?]+["'')\\]]*$') AS q FROM rr)), a2 AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, run, part ORDER BY i) - 1) // 120 AS piece FROM a),
        b AS (SELECT conv_id, run, min(i) AS f, max(i) + 1 AS l, sum(length(word) + 1) AS n, any_value(whole) AS whole FROM a2 GROUP BY conv_id, run, part, piece), c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY f) AS r FROM b),
        d AS (SELECT conv_id, r, run, f, l, n AS size, 1::BIGINT AS g FROM c WHERE r = 1 UNION ALL SELECT c.conv_id, c.r, c.run, c.f, c.l, CASE WHEN c.run = d.run AND (c.whole <= 150 OR d.size + c.n <= 150) THEN d.size + c.n ELSE c.n END, d.g + CASE WHEN c.run = d.run AND (c.whole <= 150 OR d.size + c.n <= 150) THEN 0 ELSE 1 END FROM d JOIN c ON c.conv_id = d.conv_id AND c.r = d.r + 1)
        SELECT conv_id, min(f) AS first, max(l) AS last FROM d GROUP BY conv_id, g"""),
    "corrected_words": (corrected_words, None),
    "request_windows": (request_windows, f"""{_SHOWN}, sz AS (SELECT conv_id, n AS run, CAST(ceil(length('0  ' || speaker || '  [' || {_CLOCK.format('s')} || ' +0.0s]  ' || t) / 4) AS BIGINT) AS size FROM rl), su AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY run) - size AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM sz),
        rq AS (SELECT conv_id, 0::BIGINT AS run, 0::BIGINT AS first, 0::BIGINT AS request, NULL::BIGINT AS closed FROM su WHERE run = 0 UNION ALL
          SELECT x.conv_id, x.run, CASE WHEN x.before + x.size - y.before > 400 THEN greatest(rq.first, x.run - 4) ELSE rq.first END, rq.request + CASE WHEN x.before + x.size - y.before > 400 THEN 1 ELSE 0 END, CASE WHEN x.before + x.size - y.before > 400 THEN rq.first END
          FROM rq JOIN su x ON x.conv_id = rq.conv_id AND x.run = rq.run + 1 JOIN su y ON y.conv_id = rq.conv_id AND y.run = rq.first)
        SELECT conv_id, request - 1 AS request, closed AS first_run, run - closed AS runs FROM rq WHERE closed IS NOT NULL UNION ALL SELECT rq.conv_id, request, first, su.n - first FROM rq JOIN su ON su.conv_id = rq.conv_id AND su.run = rq.run AND su.run = su.n - 1"""),
    "reviewed_words": (reviewed_words, None),
}
