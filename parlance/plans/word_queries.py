"""Queries on words and turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import align, folds, islands
from parlance.plans import derived as D
from parlance.plans.derived import BY, TOKEN_SQL, WORDS_SQL, blocks_sql, path_sql


def turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = islands.group_into_turns(D.words(spark, sf_dir), BY)
    return turns.groupBy("conv_id", "speaker").agg(F.count("*").alias("turns"), F.sum("n_words").alias("words"), F.sum(F.col("end") - F.col("start")).alias("seconds"))


def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.speaker_runs(D.system_words(spark, sf_dir), BY).select("conv_id", "speaker", "first", "last", "n")


def grouped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.group_into_turns(D.system_words(spark, sf_dir), BY).select("conv_id", "speaker", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "text", "n_words")


def short_run_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.short_run_rule(D.system_words(spark, sf_dir), BY).select("conv_id", "first", "last", "old", "new")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.sentences(D.words(spark, sf_dir), BY, longest=20).select("conv_id", "first", "last", "n_words")


def insertion_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = islands.insertion_kind(D.marked_words(spark, sf_dir), BY, T.BACKCHANNELS, T.DISCOURSE)
    return kinds.groupBy("conv_id", "kind").agg(F.count("*").alias("n"))


def placeholder_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.collapse_placeholders(D.marked_words(spark, sf_dir), BY).select("conv_id", "first", "last", "label")


def tiled_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.tiled_spans(D.system_words(spark, sf_dir), BY).select("conv_id", "speaker", F.col("start").alias("t_start"), F.col("end").alias("t_end"))


def monotone_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts disturbed backwards every tenth word, then repaired."""
    w = D.words(spark, sf_dir).withColumn("start", F.when(F.col("word_idx") % 10 == 0, F.col("start") - 2).otherwise(F.col("start")))
    return islands.monotone_starts(w, BY).select("conv_id", "word_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"))


def filled_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.words(spark, sf_dir).withColumn("speaker", F.when(F.col("word_idx") % 5 < 2, F.lit(None)).otherwise(F.col("speaker")))
    return islands.fill_speakers(w, BY).groupBy("conv_id", "speaker").agg(F.count("*").alias("n"))


def unknown_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.words(spark, sf_dir).withColumn("speaker", F.when(F.col("word_idx") % 5 < 2, F.lit("")).otherwise(F.col("speaker")))
    return islands.unknown_runs(w, BY).select("conv_id", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "n_words")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays of both transcripts of each turn."""
    gather = lambda df, name: df.groupBy("conv_id", "turn").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", T.token(F.col("word")).alias("t")))), lambda x: x["t"]).alias(name))
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t != "")
    both = gather(D.words(spark, sf_dir), "ref").join(gather(D.system_words(spark, sf_dir), "hyp"), ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", some(F.col("ref")).alias("ref"), some(F.col("hyp")).alias("hyp"))


def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.word_errors(_pairs(spark, sf_dir), ["conv_id", "turn"])


def word_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parlance.operators.reports import dominant, summary

    e = word_errors(spark, sf_dir)
    total = e.withColumn("errors", F.col("substitutions") + F.col("deletions") + F.col("insertions")).withColumn("worst", dominant({c: F.col(c) for c in ("substitutions", "deletions", "insertions")}))
    return summary(total, ["worst"], "errors", "ref_words")


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the edit paths by kind; their sum over the reference's words is the pooled error rate."""
    pairs = _pairs(spark, sf_dir)
    steps = align.edit_steps(pairs, ["conv_id", "turn"]).where("tag <> 'hit'").join(pairs.select("conv_id", "turn", "hyp"), ["conv_id", "turn"])
    again = F.lit(False)
    for k in (-2, -1, 1, 2):
        again = again | F.coalesce(F.get("hyp", F.col("j") + k) == F.col("hyp_token"), F.lit(False))
    kind = F.when(F.col("tag") == "delete", "deletion").when(F.col("tag") == "insert", F.when(again, "repetition").when(F.col("hyp_token").isin(T.BACKCHANNELS), "backchannel").when(F.col("hyp_token").isin(T.DISCOURSE), "discourse marker").otherwise("other insertion"))
    return steps.groupBy(F.when(F.col("tag") == "substitute", F.when(T.near_miss(F.col("ref_token"), F.col("hyp_token")), "near-miss").otherwise("different word")).otherwise(kind).alias("kind")).agg(F.count("*").alias("n"))


def loose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.blocks(_pairs(spark, sf_dir), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "loose_errors", F.size("ops").cast("long").alias("n_ops"))


def caption_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.caption_cues(D.words(spark, sf_dir), BY).withColumnsRenamed({"start": "t_start", "end": "t_end"})


def subtitle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues as the blocks of WebVTT and SubRip files."""
    from parlance.sources.sinks import srt, vtt

    cues = folds.caption_cues(D.words(spark, sf_dir), BY)
    both = vtt(cues, BY).withColumnRenamed("value", "vtt").join(srt(cues, BY).withColumnRenamed("value", "srt"), BY)
    return both.select("conv_id", "vtt", "srt")


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of seven words, in every third turn of 120, put together again up to 25 seconds."""
    w = D.words(spark, sf_dir)
    pieces = w.groupBy("conv_id", "turn", F.floor(F.col("word_idx") / F.when(F.col("turn") % 3 == 0, 120).otherwise(7)).alias("piece")).agg(F.first("speaker").alias("speaker"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("word_idx").alias("seg_idx"))
    return folds.merge_and_split(pieces, BY).withColumnsRenamed({"start": "t_start", "end": "t_end"})


def speech_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.speech_windows(islands.group_into_turns(D.words(spark, sf_dir), BY), BY).withColumnsRenamed({"start": "t_start", "end": "t_end"})


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.words(spark, sf_dir)
    s = islands.sentences(w, BY).join(w.select("conv_id", "word_idx", F.length("word").alias("len")), "conv_id").where("word_idx >= first and word_idx < last")
    pieces = s.groupBy("conv_id", "first").agg(F.sum(F.col("len") + 1).alias("n_chars")).select("conv_id", F.col("first").cast("int").alias("piece"), "n_chars")
    return folds.overlapping_chunks(pieces, BY, size=600)


def claimed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = islands.group_into_turns(D.words(spark, sf_dir), BY).select("conv_id", F.col("turn").cast("long").alias("seg_idx"), "start", "end")
    return folds.claim_segments(D.system_words(spark, sf_dir), ref, BY)


def multiset_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a turn's tokens that the other transcript of the turn has, each as often as it stands there."""
    count = lambda df, name: df.withColumn("t", T.token(F.col("word"))).where("t <> ''").groupBy("conv_id", "turn", "t").agg(F.count("*").alias(name))
    both = count(D.words(spark, sf_dir), "need").join(count(D.system_words(spark, sf_dir), "have"), ["conv_id", "turn", "t"], "left")
    return both.groupBy("conv_id", "turn").agg((F.sum(F.least("need", F.coalesce("have", F.lit(0)))) / F.sum("need")).alias("recall"))


_RUNS = "SELECT *, sum(CASE WHEN speaker IS DISTINCT FROM p OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY i) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS rn FROM {})"
_R = f"WITH {WORDS_SQL}, r AS (SELECT conv_id, run, any_value(speaker) AS speaker, min(i) AS first, max(i) + 1 AS last, count(*) AS n, min(s) AS s, max(e) AS e, string_agg(word, ' ' ORDER BY i) AS text FROM ({_RUNS.format('h')}) GROUP BY conv_id, run)"

_WR = f"WITH RECURSIVE {WORDS_SQL}"
_LIST = lambda values: ", ".join(f"'{v}'" for v in values)
_TURNS = f"""{_WR}, ta AS (SELECT conv_id, turn, list(t ORDER BY i) FILTER (t <> '') AS r FROM (SELECT conv_id, turn, i, {TOKEN_SQL.format('word')} AS t FROM w) GROUP BY 1, 2),
  tb AS (SELECT conv_id, turn, list(t ORDER BY i) FILTER (t <> '') AS q FROM (SELECT conv_id, turn, i, {TOKEN_SQL.format('word')} AS t FROM h) GROUP BY 1, 2),
  pr AS (SELECT ta.conv_id || '|' || ta.turn AS p, ta.conv_id, ta.turn, coalesce(r, []) AS r, coalesce(q, []) AS q FROM ta LEFT JOIN tb ON ta.conv_id = tb.conv_id AND ta.turn = tb.turn)"""
_EDITS = f"""{_TURNS}, {path_sql('pr', 'pa')}, ed AS (SELECT pr.*, path, len(r) AS n, len(q) AS m, {", ".join(f"length(path) - length(replace(path, '{c}', '')) AS {c}" for c in "hsdi")} FROM pr JOIN pa USING (p))"""
_PARTS = ", ".join(f"CAST({c} AS BIGINT) AS {name}" for c, name in zip(("n", "m", "h", "s", "d", "i"), ("ref_words", "hyp_words", "hits", "substitutions", "deletions", "insertions")))
_SHORT, _LONGER = ("CASE WHEN length(a) <= length(b) THEN {} ELSE {} END".format(*x) for x in (("a", "b"), ("b", "a")))
_NEAR = f"(a IN ({_LIST(T.NUMBER_WORDS)}) AND b IN ({_LIST(T.NUMBER_WORDS)})) OR regexp_matches(a, '^[0-9]+$') OR regexp_matches(b, '^[0-9]+$') OR (length({_SHORT}) >= 4 AND starts_with({_LONGER}, {_SHORT}) AND abs(length(a) - length(b)) <= 3) OR levenshtein(a, b) <= CASE WHEN length({_SHORT}) <= 4 THEN 1 ELSE 2 END"
_CUES = f"""{_WR}, cf AS (SELECT conv_id, i, 0::BIGINT AS k, s AS b, e, speaker, length(word) AS n, word FROM w WHERE i = 0 UNION ALL
  SELECT conv_id, i, CASE WHEN fits THEN k ELSE k + 1 END, CASE WHEN fits THEN b ELSE s END, e, speaker, CASE WHEN fits THEN n + 1 ELSE 0 END + length(word), word FROM (
    SELECT w.conv_id, w.i, c.k, c.b, w.s, w.e, w.speaker, c.n, w.word, w.speaker = c.speaker AND c.n + 1 + length(w.word) <= 84 AND w.s - c.e <= 1.5 AND w.e - c.b <= 6 AS fits FROM cf c JOIN w ON w.conv_id = c.conv_id AND w.i = c.i + 1)),
  cu AS (SELECT conv_id, k, any_value(speaker) AS speaker, min(b) AS t_start, max(e) AS t_end, string_agg(word, ' ' ORDER BY i) AS text FROM cf GROUP BY 1, 2)"""
_STAMP = "format('{{:02d}}:{{:02d}}:{{:02d}}{1}{{:03d}}', CAST(round_even({0} * 1000, 0) AS BIGINT) // 3600000, CAST(round_even({0} * 1000, 0) AS BIGINT) // 60000 % 60, CAST(round_even({0} * 1000, 0) AS BIGINT) // 1000 % 60, CAST(round_even({0} * 1000, 0) AS BIGINT) % 1000)"

QUERIES = {
    "turn_stats": (turn_stats, f"""WITH {WORDS_SQL}, r AS (SELECT conv_id, run, any_value(speaker) AS speaker, count(*) AS n, max(e) - min(s) AS d FROM ({_RUNS.format('w')}) GROUP BY conv_id, run)
        SELECT conv_id, speaker, count(*) AS turns, CAST(sum(n) AS BIGINT) AS words, sum(d) AS seconds FROM r GROUP BY conv_id, speaker"""),
    "speaker_runs": (speaker_runs, _R + " SELECT conv_id, speaker, first, last, n FROM r"),
    "grouped_turns": (grouped_turns, _R + " SELECT conv_id, speaker, s AS t_start, e AS t_end, text, n AS n_words FROM r"),
    "short_run_rule": (short_run_rule, _R + """, x AS (SELECT *, lag(n) OVER q AS pn, lag(speaker) OVER q AS ps, lead(n) OVER q AS nn, lead(speaker) OVER q AS ns FROM r WINDOW q AS (PARTITION BY conv_id ORDER BY run)),
        y AS (SELECT *, CASE WHEN nn IS NULL OR pn >= nn THEN ps ELSE ns END AS new FROM x WHERE n <= 3)
        SELECT conv_id, first, last, speaker AS old, new FROM y WHERE new <> speaker"""),
    "sentence_split": (sentence_split, f"""WITH {WORDS_SQL}, a AS (SELECT *, sum(CASE WHEN coalesce(p, true) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS part
          FROM (SELECT *, regexp_matches(lag(word) OVER (PARTITION BY conv_id ORDER BY i), '[.!?]+["'')\\]]*$') AS p FROM w)),
        b AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY i) - 1) // 20 AS piece FROM a)
        SELECT conv_id, min(i) AS first, max(i) + 1 AS last, count(*) AS n_words FROM b GROUP BY conv_id, part, piece"""),
    "insertion_kinds": (insertion_kinds, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, word, coalesce(word = lag(word) OVER q, false) OR coalesce(word = lag(word, 2) OVER q, false) OR coalesce(word = lead(word) OVER q, false) OR coalesce(word = lead(word, 2) OVER q, false) AS again FROM m WINDOW q AS (PARTITION BY conv_id ORDER BY i))
        SELECT conv_id, CASE WHEN again THEN 'repetition' WHEN word IN ('{"', '".join(T.BACKCHANNELS)}') THEN 'backchannel' WHEN word IN ('{"', '".join(T.DISCOURSE)}') THEN 'discourse marker' ELSE 'other insertion' END AS kind, count(*) AS n FROM a GROUP BY 1, 2"""),
    "placeholder_spans": (placeholder_spans, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, i, regexp_extract(word, '\\[([A-Z_]+)\\]', 1) AS label FROM m), b AS (SELECT * FROM a WHERE label <> ''),
        c AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, label ORDER BY i) AS grp FROM b)
        SELECT conv_id, min(i) AS first, max(i) + 1 AS last, label FROM c GROUP BY conv_id, label, grp"""),
    "tiled_spans": (tiled_spans, _R + " SELECT conv_id, speaker, s AS t_start, greatest(e, coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY run), e)) AS t_end FROM r"),
    "monotone_starts": (monotone_starts, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, i, e, max(CASE WHEN i % 10 = 0 THEN s - 2 ELSE s END) OVER (PARTITION BY conv_id ORDER BY i) AS s FROM w)
        SELECT conv_id, i AS word_idx, s AS t_start, greatest(e, s) AS t_end FROM a"""),
    "filled_speakers": (filled_speakers, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, i, CASE WHEN i % 5 < 2 THEN NULL ELSE speaker END AS sp FROM w),
        b AS (SELECT conv_id, coalesce(last_value(sp IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          first_value(sp IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'UNKNOWN') AS speaker FROM a)
        SELECT conv_id, speaker, count(*) AS n FROM b GROUP BY 1, 2"""),
    "unknown_turns": (unknown_turns, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, i, s, e, i - row_number() OVER (PARTITION BY conv_id ORDER BY i) AS grp FROM w WHERE i % 5 < 2)
        SELECT conv_id, min(s) AS t_start, max(e) AS t_end, count(*) AS n_words FROM a GROUP BY conv_id, grp"""),
    "multiset_recall": (multiset_recall, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, turn, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS t, count(*) AS need FROM w GROUP BY 1, 2, 3),
        b AS (SELECT conv_id, turn, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS t, count(*) AS have FROM h GROUP BY 1, 2, 3)
        SELECT conv_id, turn, sum(least(need, coalesce(have, 0))) / sum(need) AS recall FROM a LEFT JOIN b USING (conv_id, turn, t) WHERE t <> '' GROUP BY 1, 2"""),
    "word_errors": (word_errors, f"{_EDITS} SELECT conv_id, turn, {_PARTS}, (s + d + i) / greatest(1, n) AS wer, (s + d + i) / greatest(1, h + s + d + i) AS mer, 1 - CASE WHEN n > 0 AND m > 0 THEN (h / n) * (h / m) ELSE 0 END AS wil FROM ed"),
    "word_error_summary": (word_error_summary, f"""{_EDITS}, x AS (SELECT CASE WHEN s >= d AND s >= i THEN 'substitutions' WHEN d >= i THEN 'deletions' ELSE 'insertions' END AS worst, s + d + i AS errors, n FROM ed)
        SELECT worst, count(*) AS visits, avg(errors / n) FILTER (n > 0) AS mean_rate, median(errors / n) FILTER (n > 0) AS median_rate, sum(errors) / sum(n) AS pooled_rate FROM x GROUP BY worst"""),
    "error_taxonomy": (error_taxonomy, f"""{_EDITS}, st AS (SELECT p, tag, CAST(sum((tag <> 'i')::INT) OVER o AS BIGINT) AS i, CAST(sum((tag <> 'd')::INT) OVER o AS BIGINT) AS j FROM (SELECT p, unnest(range(1, length(path) + 1)) AS k, unnest(string_split(path, '')) AS tag FROM pa) WINDOW o AS (PARTITION BY p ORDER BY k)),
        tk AS (SELECT tag, CASE WHEN tag <> 'i' THEN r[st.i] END AS a, CASE WHEN tag <> 'd' THEN q[st.j] END AS b, q[st.j - 2] AS b1, q[st.j - 1] AS b2, q[st.j + 1] AS b3, q[st.j + 2] AS b4 FROM st JOIN pr USING (p) WHERE tag <> 'h'),
        nm AS (SELECT *, {_NEAR} AS near FROM tk)
        SELECT CASE tag WHEN 's' THEN CASE WHEN near THEN 'near-miss' ELSE 'different word' END WHEN 'd' THEN 'deletion' ELSE CASE WHEN b IN (b1, b2, b3, b4) THEN 'repetition' WHEN b IN ({_LIST(T.BACKCHANNELS)}) THEN 'backchannel' WHEN b IN ({_LIST(T.DISCOURSE)}) THEN 'discourse marker' ELSE 'other insertion' END END AS kind, count(*) AS n FROM nm GROUP BY 1"""),
    "loose_errors": (loose_errors, f"""{_TURNS}, ra AS (SELECT p, unnest(range(len(r))) AS i, unnest(r) AS t FROM pr), qa AS (SELECT p, unnest(range(len(q))) AS j, unnest(q) AS t FROM pr), {blocks_sql('ra', 'qa', 'ba')}
        SELECT conv_id, turn, CAST(coalesce(sum(CASE WHEN tag <> 'equal' THEN greatest(i2 - i1, j2 - j1) END), 0) AS BIGINT) AS loose_errors, CAST(count(tag) AS BIGINT) AS n_ops FROM pr LEFT JOIN ba USING (p) GROUP BY 1, 2"""),
    "caption_cues": (caption_cues, f"{_CUES} SELECT conv_id, CAST(k AS INTEGER) AS cue, speaker, t_start, t_end, text FROM cu"),
    "subtitle_lines": (subtitle_lines, f"""{_CUES} SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_STAMP.format('t_start', '.')} || ' --> ' || {_STAMP.format('t_end', '.')} || chr(10) || speaker || ': ' || text, chr(10) || chr(10) ORDER BY k) || chr(10) AS vtt,
        string_agg((k + 1) || chr(10) || {_STAMP.format('t_start', ',')} || ' --> ' || {_STAMP.format('t_end', ',')} || chr(10) || speaker || ': ' || text, chr(10) || chr(10) ORDER BY k) || chr(10) AS srt FROM cu GROUP BY 1"""),
    "merged_segments": (merged_segments, f"""{_WR}, pc AS (SELECT conv_id, turn, any_value(speaker) AS speaker, min(s) AS s, max(e) AS e, min(i) AS i FROM w GROUP BY conv_id, turn, i // CASE WHEN turn % 3 = 0 THEN 120 ELSE 7 END), nu AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, i) AS r FROM pc),
        fo AS (SELECT conv_id, r, 1 AS g, s, e, speaker FROM nu WHERE r = 1 UNION ALL SELECT x.conv_id, x.r, CASE WHEN f.speaker = x.speaker AND x.s - f.e <= 1 AND x.e - f.s <= 25 THEN f.g ELSE f.g + 1 END, CASE WHEN f.speaker = x.speaker AND x.s - f.e <= 1 AND x.e - f.s <= 25 THEN f.s ELSE x.s END, x.e, x.speaker
          FROM fo f JOIN nu x ON x.conv_id = f.conv_id AND x.r = f.r + 1), gr AS (SELECT conv_id, g, min(s) AS s, max(e) AS e, any_value(speaker) AS speaker, greatest(1, ceil((max(e) - min(s)) / 25)) AS n FROM fo GROUP BY 1, 2),
        pi AS (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM gr) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY g, k) - 1 AS INTEGER) AS piece, s + (e - s) * k / n AS t_start, s + (e - s) * (k + 1) / n AS t_end, speaker FROM pi"""),
    "speech_windows": (speech_windows, f"""{_WR}, ru AS (SELECT conv_id, min(s) AS s, max(e) AS e FROM ({_RUNS.format('w')}) GROUP BY conv_id, run), nu AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, e) AS r FROM ru),
        st AS (SELECT conv_id, 0::BIGINT AS r, 0::BIGINT AS k, NULL::DOUBLE AS b, NULL::DOUBLE AS e, NULL::DOUBLE AS fb, NULL::DOUBLE AS fe, NULL::DOUBLE AS cb, 0::BIGINT AS n FROM nu WHERE r = 1 UNION ALL
          SELECT conv_id, r, k + CASE WHEN flush THEN 1 ELSE 0 END + n, cb + 25 * n, xe, CASE WHEN flush THEN b END, CASE WHEN flush THEN e END, cb, n FROM (SELECT *, greatest(0, CAST(ceil((xe - cb) / 25) AS BIGINT) - 1) AS n FROM (
            SELECT t.conv_id, x.r, t.k, t.b, t.e, x.e AS xe, coalesce(x.e - t.b > 25, false) AS flush, CASE WHEN t.b IS NULL OR x.e - t.b > 25 THEN x.s ELSE t.b END AS cb FROM st t JOIN nu x ON x.conv_id = t.conv_id AND x.r = t.r + 1)))
        SELECT conv_id, CAST(k - n - 1 AS INTEGER) AS "window", fb AS t_start, fe AS t_end FROM st WHERE fb IS NOT NULL UNION ALL SELECT conv_id, CAST(k - n + c AS INTEGER), cb + 25 * c, cb + 25 * (c + 1) FROM (SELECT *, unnest(range(n)) AS c FROM st)
        UNION ALL SELECT conv_id, CAST(k AS INTEGER), b, e FROM st WHERE e > b AND NOT EXISTS (SELECT 1 FROM nu WHERE nu.conv_id = st.conv_id AND nu.r > st.r)"""),
    "sentence_chunks": (sentence_chunks, f"""{_WR}, pa AS (SELECT *, sum(CASE WHEN coalesce(p, true) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS part FROM (SELECT *, regexp_matches(lag(word) OVER (PARTITION BY conv_id ORDER BY i), '[.!?]+["'')\\]]*$') AS p FROM w)),
        pb AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY i) - 1) // 120 AS piece FROM pa), se AS (SELECT conv_id, min(i) AS f, sum(length(word) + 1) AS n FROM pb GROUP BY conv_id, part, piece),
        nu AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS r, sum(n) OVER (PARTITION BY conv_id ORDER BY f) - n AS b FROM se),
        fo AS (SELECT conv_id, r, 0::BIGINT AS k, 0::BIGINT AS first, NULL::BIGINT AS closed FROM nu WHERE r = 0 UNION ALL
          SELECT conv_id, r, CASE WHEN cut THEN k + 1 ELSE k END, CASE WHEN cut THEN r - 1 ELSE first END, CASE WHEN cut THEN first END FROM (SELECT fo.conv_id, x.r, fo.k, fo.first, x.r - fo.first > CASE WHEN fo.k > 0 THEN 1 ELSE 0 END AND x.b + x.n - y.b > 600 AS cut
            FROM fo JOIN nu x ON x.conv_id = fo.conv_id AND x.r = fo.r + 1 JOIN nu y ON y.conv_id = fo.conv_id AND y.r = fo.first)),
        ch AS (SELECT conv_id, k - 1 AS k, closed AS a, r - 1 AS z FROM fo WHERE closed IS NOT NULL UNION ALL SELECT conv_id, k, first, r FROM fo QUALIFY r = max(r) OVER (PARTITION BY conv_id))
        SELECT ch.conv_id, CAST(k AS INTEGER) AS chunk, CAST(x.f AS INTEGER) AS first_piece, CAST(y.f AS INTEGER) AS last_piece, CAST(y.b + y.n - x.b AS BIGINT) AS n_chars FROM ch JOIN nu x ON x.conv_id = ch.conv_id AND x.r = a JOIN nu y ON y.conv_id = ch.conv_id AND y.r = z"""),
    "claimed_segments": (claimed_segments, None),
}
