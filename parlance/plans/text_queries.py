"""Queries on the text of turns and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import intervals
from parlance.plans import derived as D
from parlance.plans.derived import BY, WORDS_SQL


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with brackets, braces and fillers put in."""
    text = F.concat(F.lit("[UM?] Um, don't "), F.regexp_replace("text", r"\bthe\b", "{the}'s [x] "))
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text"))


def normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _marked(spark, sf_dir).select(
        "conv_id", "turn", T.unwrap_brackets(t).alias("unwrapped"), T.headline(t).alias("headline"), T.headline_with_pauses(t).alias("with_pauses"), T.alnum_only(t).alias("alnum"),
        F.array_join(T.loose_tokens(t), " ").alias("loose"), F.array_join(T.content_tokens(t), " ").alias("content"),
    )


def filler_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = D.marked_words(spark, sf_dir)
    return w.groupBy("conv_id").agg(
        F.count("*").alias("words"), F.count_if(T.token(F.col("word")).isin(T.FILLERS)).alias("fillers"), F.count_if(T.is_event(F.col("word"))).alias("events"),
        F.count_if(T.is_filler(F.col("word"))).alias("filler_tokens"), (F.count_if(T.token(F.col("word")).isin(T.FILLERS)) / F.count("*")).alias("rate"),
    )


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = D.words(spark, sf_dir).select("conv_id", "word_idx", T.format_clock(F.col("start") * 7.5).alias("shown"))
    return shown.withColumn("seconds", T.parse_clock(F.col("shown")))


def cue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue scores of the two transcripts of each speaker's text."""
    put = lambda df, every, cue: df.withColumn("word", F.when(F.col("word_idx") % every == 3, cue).otherwise(F.col("word")))
    join = lambda df, name: df.groupBy("conv_id", "speaker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias(name))
    a = join(put(put(D.words(spark, sf_dir), 40, "maybe"), 90, "don't"), "a")
    b = join(put(put(D.system_words(spark, sf_dir), 60, "maybe"), 70, "today"), "b")
    scored = a.join(b, ["conv_id", "speaker"], "left").select("conv_id", "speaker", T.headline(F.col("a")).alias("a"), T.headline(F.coalesce("b", F.lit(""))).alias("b"))
    return scored.select("conv_id", "speaker", F.size(T.cues(F.col("a"))).alias("a_cues"), F.size(T.cues(F.col("b"))).alias("b_cues"), T.cue_score(F.col("a"), F.col("b")).alias("score"))


def question_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speaker with the larger share of questions interviews; a single one takes part."""
    t = D.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when((F.col("turn") + F.col("conv_id")) % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))
    rates = t.groupBy("conv_id", "role").agg(F.count_if(T.is_question(F.col("text"))).alias("questions"), F.count("*").alias("turns"), F.min("turn").alias("first"))
    rank = F.row_number().over(D.Window.partitionBy("conv_id").orderBy(F.desc(F.col("questions") / F.col("turns")), "first"))
    n = F.count("*").over(D.Window.partitionBy("conv_id"))
    label = F.when(n == 1, "PARTICIPANT").when(F.col("rank") == 1, "INTERVIEWER").when(F.col("rank") == 2, "PARTICIPANT").otherwise(F.col("role"))
    return rates.withColumn("rank", rank).select("conv_id", "role", "questions", "turns", label.alias("label"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.preview(F.col("text"), 12).alias("shown"))


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring words that would pass as the same."""
    w = D.words(spark, sf_dir).withColumn("a", T.token(F.col("word")))
    pairs = w.withColumn("b", F.lead("a").over(D.Window.partitionBy("conv_id").orderBy("word_idx"))).where("a <> '' and b <> ''")
    return pairs.where(T.near_miss(F.col("a"), F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))


def leak_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the capitalised phrases of documents, as if each were a readable identifier."""
    found = D.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+(?: [A-Z0-9][a-z0-9]*)*|[0-9]+(?:[-/.][0-9]+)*)"), F.lit(1))).alias("surface"))
    return found.groupBy(T.leak_kind(F.col("surface")).alias("kind"), F.coalesce(T.lexical_type(F.col("surface")), F.lit("none")).alias("type")).agg(F.count("*").alias("n"))


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold spans (words with a capital and the word after) and predicted ones (every second of them, and some others)."""
    w = D.words(spark, sf_dir)
    gold = w.where(F.col("word").rlike("^[A-Z]")).select("conv_id", F.col("word_idx").alias("first"), (F.col("word_idx") + 2).alias("last"), T.token(F.col("word")).alias("surface"))
    pred = w.where("word_idx % 4 = 0 and length(word) > 3 or word_idx % 9 = 0").select("conv_id", F.col("word_idx").alias("first"), (F.col("word_idx") + 1).alias("last"))
    return gold, pred


def redaction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that a prediction overlaps are found; predictions that overlap none are false."""
    from parlance.operators.reports import precision_recall

    gold, pred = _spans(spark, sf_dir)
    missed = intervals.exposed(gold, pred, BY).groupBy("conv_id").agg(F.count("*").alias("fn"))
    false = intervals.exposed(pred, gold, BY).groupBy("conv_id").agg(F.count("*").alias("fp"))
    total = gold.groupBy("conv_id").agg(F.count("*").alias("gold"))
    sums = total.join(missed, "conv_id", "left").join(false, "conv_id", "left").fillna(0, ["fn", "fp"]).agg(F.sum(F.col("gold") - F.col("fn")).alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return sums.select("tp", "fp", "fn", *[F.round(v, 6).alias(k) for k, v in precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposed spans of each conversation and whether it is clean."""
    gold, pred = _spans(spark, sf_dir)
    left = intervals.exposed(gold, pred, BY).groupBy("conv_id").agg(F.count("*").alias("exposed"))
    return gold.groupBy("conv_id").agg(F.count("*").alias("locations")).join(left, "conv_id", "left").fillna(0, ["exposed"]).withColumn("clean", F.col("exposed") == 0)


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier is readable if any of its occurrences is."""
    gold, pred = _spans(spark, sf_dir)
    left = intervals.exposed(gold, pred, BY).select("conv_id", "first", F.lit(True).alias("open"))
    each = gold.join(left, ["conv_id", "first"], "left").groupBy("conv_id", "surface").agg(F.bool_or(F.coalesce("open", F.lit(False))).alias("open"))
    return each.groupBy("conv_id").agg(F.count("*").alias("identifiers"), F.count_if("open").alias("readable"))


def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Site_"), F.col("conv_id").cast("string"), F.lit("_interviewAudioTranscript_day0001_session00"), (F.col("turn") % 3).cast("string"))
    t = D.table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("stem"))
    return t.select("conv_id", "turn", T.session_stem(F.col("stem")).alias("stem"), T.session_name(F.concat("stem", F.lit("_REDACTED.txt"))).alias("name"), F.regexp_extract("stem", r"(day\d+_session\d+)", 1).alias("timepoint"))


def replaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word, case-sensitive replacement and how often it was made."""
    t = D.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.regexp_count("text", F.lit(r"(?<!\w)the(?!\w)")).alias("hits"), F.length(T.whole_word_replace(F.col("text"), "the", "one two")).alias("chars"))


_TEXT = r"(SELECT conv_id, turn, '[UM?] Um, don''t ' || regexp_replace(text, '\bthe\b', '{the}''s [x] ', 'g') AS t FROM conversations)"
_BRACKET = r"regexp_replace(lower(regexp_replace(t, '\[[^\]]*\]', ' ', 'g')), '[^a-z0-9''\s]', ' ', 'g')"
_PAUSES = "['" + "', '".join(T.FILLED_PAUSES) + "']"
_LIST = lambda xs: "('" + "', '".join(x.replace("'", "''") for x in xs) + "')"
_CUES = "[" + ", ".join("'" + x.replace("'", "''") + "'" for ts in T.CUES.values() for x in ts) + "]"
_FAMILIES = "[" + ", ".join("'" + f + ":" + x.replace("'", "''") + "'" for f, ts in T.CUES.items() for x in ts) + "]"
_QUESTION = "^(" + "|".join(T.QUESTION_OPENERS) + ")"
_NEAR = f"""((a IN {_LIST(T.NUMBER_WORDS)} AND b IN {_LIST(T.NUMBER_WORDS)}) OR regexp_matches(a, '^[0-9]+$') OR regexp_matches(b, '^[0-9]+$')
  OR (length(lo) >= 4 AND starts_with(hi, lo) AND length(hi) - length(lo) <= 3) OR levenshtein(a, b) <= CASE WHEN length(lo) <= 4 THEN 1 ELSE 2 END)"""
_SPANS = f"""WITH {WORDS_SQL}, gold AS (SELECT conv_id, i AS f, i + 2 AS l, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS surface FROM w WHERE regexp_matches(word, '^[A-Z]')),
  pred AS (SELECT conv_id, i AS f, i + 1 AS l FROM w WHERE (i % 4 = 0 AND length(word) > 3) OR i % 9 = 0),
  g AS (SELECT gold.*, NOT EXISTS (SELECT 1 FROM pred p WHERE p.conv_id = gold.conv_id AND p.f < gold.l AND p.l > gold.f) AS open FROM gold),
  p AS (SELECT pred.*, NOT EXISTS (SELECT 1 FROM gold x WHERE x.conv_id = pred.conv_id AND x.f < pred.l AND x.l > pred.f) AS alone FROM pred)"""
_MONTHS = "(" + "|".join(T.MONTHS) + ")"

QUERIES = {
    "normalizers": (normalizers, f"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '\\[([^\\]]*?)\\??\\]', '\\1', 'g'), '\\s+', ' ', 'g')) AS unwrapped,
        array_to_string(list_filter(string_split_regex({_BRACKET}, '\\s+'), lambda x: x <> '' AND NOT list_contains({_PAUSES}, x)), ' ') AS headline,
        array_to_string(list_filter(string_split_regex({_BRACKET}, '\\s+'), lambda x: x <> ''), ' ') AS with_pauses,
        lower(trim(regexp_replace(regexp_replace(regexp_replace(t, '\\[.*?\\]', '', 'g'), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS alnum,
        array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(t, '\\[[^\\]]*\\](\\S*)', '\\1', 'g'), '\\{{[^\\}}]*\\}}(\\S*)', '\\1', 'g'), '\\s+'), lambda x: x <> ''), ' ') AS loose,
        array_to_string(regexp_extract_all(regexp_replace(regexp_replace(lower(t), '\\[[^\\]]*\\]', ' ', 'g'), '[{{}}]', ' ', 'g'), '[a-z0-9'']+'), ' ') AS content FROM {_TEXT}"""),
    "filler_counts": (filler_counts, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, word, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') IN {_LIST(T.FILLERS)} AS f FROM m)
        SELECT conv_id, count(*) AS words, count_if(f) AS fillers, count_if(regexp_matches(trim(word), '^\\[.+\\]$')) AS events,
        count_if(regexp_matches(lower(word), '{T.FILLER_PATTERN}')) AS filler_tokens, count_if(f) / count(*) AS rate FROM a GROUP BY conv_id"""),
    "clocks": (clocks, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, i AS word_idx, CAST(round_even(s * 7.5 * 1000, 0) AS BIGINT) AS ms FROM w)
        SELECT conv_id, word_idx, printf('%02d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS shown, ms / 1000 AS seconds FROM a"""),
    "cue_scores": (cue_scores, f"""WITH {WORDS_SQL}, a AS (SELECT conv_id, speaker, string_agg(CASE WHEN i % 90 = 3 THEN 'don''t' WHEN i % 40 = 3 THEN 'maybe' ELSE word END, ' ' ORDER BY i) AS t FROM w GROUP BY 1, 2),
        b AS (SELECT conv_id, speaker, string_agg(CASE WHEN i % 70 = 3 THEN 'today' WHEN i % 60 = 3 THEN 'maybe' ELSE word END, ' ' ORDER BY i) AS t FROM h GROUP BY 1, 2),
        n AS (SELECT conv_id, speaker, side, ' ' || array_to_string(list_filter(string_split_regex({_BRACKET}, '\\s+'), lambda x: x <> '' AND NOT list_contains({_PAUSES}, x)), ' ') || ' ' AS t
              FROM (SELECT *, 'a' AS side FROM a UNION ALL SELECT a.conv_id, a.speaker, coalesce(b.t, ''), 'b' FROM a LEFT JOIN b USING (conv_id, speaker))),
        c AS (SELECT conv_id, speaker, side, list_filter(range(1, {sum(map(len, T.CUES.values())) + 1}), lambda k: contains(t, ' ' || {_CUES}[k] || ' ')) AS c FROM n),
        d AS (SELECT x.conv_id, x.speaker, x.c AS a, y.c AS b FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.speaker = y.speaker AND x.side = 'a' AND y.side = 'b')
        SELECT conv_id, speaker, CAST(len(a) AS INTEGER) AS a_cues, CAST(len(b) AS INTEGER) AS b_cues,
          CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 THEN 0.0 ELSE CAST(2 * len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b)) END AS score FROM d"""),
    "question_roles": (question_roles, f"""WITH a AS (SELECT conv_id, turn, role, CASE WHEN (turn + conv_id) % 3 = 0 THEN text || '?' ELSE text END AS t FROM conversations),
        b AS (SELECT conv_id, role, count_if(ends_with(lower(trim(t)), '?') OR regexp_matches(lower(trim(t)), '{_QUESTION}')) AS questions, count(*) AS turns, min(turn) AS first FROM a GROUP BY 1, 2),
        c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY questions / turns DESC, first) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM b)
        SELECT conv_id, role, questions, turns, CASE WHEN n = 1 THEN 'PARTICIPANT' WHEN rank = 1 THEN 'INTERVIEWER' WHEN rank = 2 THEN 'PARTICIPANT' ELSE role END AS label FROM c"""),
    "previews": (previews, f"""WITH {WORDS_SQL} SELECT conv_id, turn, array_to_string(ws[1:12], ' ') || CASE WHEN len(ws) > 12 THEN printf(' [+%d more words]', len(ws) - 12) ELSE '' END AS shown FROM t0"""),
    "near_misses": (near_misses, f"""WITH {WORDS_SQL}, x AS (SELECT conv_id, i, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS a FROM w), y AS (SELECT a, lead(a) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM x),
        z AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS lo, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS hi FROM y WHERE a <> '' AND b <> '')
        SELECT a, b, count(*) AS n FROM z WHERE {_NEAR} GROUP BY 1, 2"""),
    "leak_kinds": (leak_kinds, f"""WITH a AS (SELECT lower(trim(unnest(regexp_extract_all(text, '([A-Z][a-z]+(?: [A-Z0-9][a-z0-9]*)*|[0-9]+(?:[-/.][0-9]+)*)', 1)))) AS x FROM documents),
        b AS (SELECT x, list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '') AS ws FROM a), c AS (SELECT *, list_filter(list_transform(ws, lambda y: regexp_replace(y, '[^a-z0-9'']', '', 'g')), lambda y: y <> '') AS ts FROM b)
        SELECT CASE WHEN regexp_matches(x, '^[0-9\\s\\-/.]+$') THEN 'number' WHEN regexp_matches(x, '{_MONTHS}') OR regexp_matches(x, '\\b[0-9]{{1,2}}(st|nd|rd|th)\\b') THEN 'month or date'
          WHEN len(ws) = 1 THEN 'single word' WHEN len(ws) <= 3 THEN 'two or three words' ELSE 'longer phrase' END AS kind,
          CASE WHEN len(ts) > 0 AND (len(list_filter(ts, lambda y: regexp_matches(y, '^({"|".join(T.MONTHS)})$|^[0-9]{{1,2}}(st|nd|rd|th)$|^(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth)$'))) > 0
            OR len(list_filter(ts, lambda y: NOT regexp_matches(y, '^[0-9]+$'))) = 0) THEN 'date' ELSE 'none' END AS type, count(*) AS n FROM c GROUP BY 1, 2"""),
    "redaction_scores": (redaction_scores, _SPANS + """, s AS (SELECT (SELECT count_if(NOT open) FROM g) AS tp, (SELECT count_if(alone) FROM p WHERE conv_id IN (SELECT conv_id FROM gold)) AS fp, (SELECT count_if(open) FROM g) AS fn)
        SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1,
          round(fn / (tp + fn), 6) AS under, round(fp / (tp + fn), 6) AS over, round((fp - fn) / (tp + fn), 6) AS net FROM s"""),
    "exposures": (exposures, _SPANS + " SELECT conv_id, count(*) AS locations, count_if(open) AS exposed, count_if(open) = 0 AS clean FROM g GROUP BY conv_id"),
    "identifiers": (identifiers, _SPANS + ", s AS (SELECT conv_id, surface, bool_or(open) AS open FROM g GROUP BY 1, 2) SELECT conv_id, count(*) AS identifiers, count_if(open) AS readable FROM s GROUP BY conv_id"),
    "session_names": (session_names, """WITH a AS (SELECT conv_id, turn, 'Site_' || conv_id || '_interviewAudioTranscript_day0001_session00' || (turn % 3) AS stem FROM conversations)
        SELECT conv_id, turn, lower(replace(stem, '_interviewAudioTranscript', '')) AS stem, replace(stem, '_interviewAudioTranscript', '') AS name, regexp_extract(stem, '(day\\d+_session\\d+)', 1) AS timepoint FROM a"""),
    "replaced_words": (replaced_words, r"""WITH a AS (SELECT conv_id, turn, text FROM conversations)
        SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\bthe\b')) AS INTEGER) AS hits, CAST(length(regexp_replace(text, '\bthe\b', 'one two', 'g')) AS INTEGER) AS chars FROM a"""),
}
