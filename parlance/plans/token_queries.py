"""Queries on tokens and their owners, rewritten turns, renamed speakers and turns with forced times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import align, corrections, privacy, retime, streams, tokens
from parlance.plans import derived as D
from parlance.plans.derived import BY, TOKEN_SQL, TOKENS_SQL, WORDS_SQL, blocks_sql, path_sql

TURN = ["conv_id", "turn"]


def _bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of which some are events, some fall into several tokens, and some brackets go over two words."""
    i = F.col("word_idx")
    word = F.when(i % 19 == 2, "[UM]").when(i % 13 == 4, "um").when(i % 11 == 3, F.concat(F.col("word"), F.lit("-"), F.col("word"))).when(i % 997 == 450, "[so").when(i % 997 == 451, "on]").otherwise(F.col("word"))
    return D.words(spark, sf_dir).withColumn("word", word)


def tracked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of visits whose tokens can be told apart."""
    w = _bracketed(spark, sf_dir)
    whole = tokens.intact_visits(w, BY).where("intact")
    return tokens.tracked_tokens(w, BY).join(whole.select("conv_id"), "conv_id", "left_semi").select("conv_id", "place", "token", "owner")


def intact_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.intact_visits(_bracketed(spark, sf_dir), BY)


def _named(df: DataFrame, speaker) -> DataFrame:
    return tokens.tracked_tokens(df, TURN).withColumn("speaker", speaker)


def relabelled_word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as conversations of three who take five words each, heard under other numbers and with some words given to others."""
    o = F.col("owner")
    ref = _named(D.words(spark, sf_dir), F.concat(F.lit("S"), (F.floor(o / 5) % 3 + 1).cast("string")))
    heard = (F.floor(o / 5) + F.col("conv_id") + F.when(o % 6 == 0, 1).otherwise(0)) % 3 + 1
    hyp = _named(D.system_words(spark, sf_dir), F.concat(F.when(F.col("turn") % 2 == 0, "S").otherwise(""), heard.cast("string")))
    return streams.relabelled_word_errors(ref, hyp, TURN)


def rewritten_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a model writes them back, with placeholders for some words, others lost or changed; every fifth it makes up."""
    def said(word, k):
        i = F.col("before") + k
        return F.when(i % 23 == 5, "[DATE].").when(i % 29 < 2, "[PERSON_NAME],").when(i % 31 == 7, "[HOSPITAL]").when(i % 37 == 8, F.concat(word, F.lit(" [AGE]"))).when(i % 41 == 9, "").when(i % 17 == 4, "zz").otherwise(word)

    t = D.turn_words(spark, sf_dir).select(*TURN, F.col("ws").alias("words"), F.array_join(F.transform("ws", said), " ").alias("reply"))
    made_up = t.withColumn("reply", F.when(F.col("turn") % 5 == 4, "I can't help with that.").otherwise(F.col("reply")))
    found = privacy.rewritten_turns(made_up, TURN)
    return found.select(*TURN, "accepted", "unmatched", F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["place"].cast("string"), x["label"])), " ").alias("labels"))


def refined_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose words a forced alignment has moved, some of them far; every seventh turn is empty."""
    t = D.turns(spark, sf_dir)
    empty = t.where("seg_idx % 7 = 3").select("conv_id", (F.col("seg_idx") + 100).alias("seg_idx"), "speaker", (F.col("end") + 0.25).alias("start"), (F.col("end") + 0.25).alias("end"), F.lit(" ").alias("text"))
    shift = F.when(F.col("turn") % 4 == 2, 3.5).otherwise(0.125 * (F.col("word_idx") % 3))
    w = D.words(spark, sf_dir).select("conv_id", "word_idx", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
    out = retime.refined_turns(align.dealt(t.unionByName(empty), BY), w, BY, max_drift=2.0)
    return out.select("conv_id", "seg_idx", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "outcome")


def corrected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's own corrections: the word at the third place becomes another, which a later one changes again; some match nothing."""
    w = D.words(spark, sf_dir)
    texts = D.turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seg_idx", "text")))["text"], " ").alias("text"))
    plain = w.withColumn("plain", F.regexp_replace("word", "[.,]", "")).where("word_idx < 6 and plain <> ''")
    first = F.when(F.col("word_idx") == 4, F.concat("plain", F.lit("qq"))).otherwise(F.col("plain"))
    suggested = F.when(F.col("word_idx") == 2, "$new\\").when(F.col("word_idx") == 3, " ").otherwise(F.concat(F.lit("x"), F.col("word_idx").cast("string")))
    one = F.struct(F.col("word_idx").alias("place"), first.alias("original"), suggested.alias("suggested"))
    again = F.struct(F.lit(9).cast("long").alias("place"), F.lit("$new\\").alias("original"), F.lit("newer word").alias("suggested"))
    given = plain.select("conv_id", F.inline(F.when(F.col("word_idx") == 2, F.array(one, again)).otherwise(F.array(one))))
    changed, spoken, report = corrections.with_corrections(texts, w.select("conv_id", "word_idx", "word"), given, BY)
    counts = spoken.groupBy("conv_id").agg(F.count_if(F.col("word") == "newer word").alias("newer"))
    return report.join(changed.select("conv_id", F.md5("text").alias("digest")), "conv_id").join(counts, "conv_id")


_BRACKETED = "(SELECT conv_id, i, CASE WHEN i % 19 = 2 THEN '[UM]' WHEN i % 13 = 4 THEN 'um' WHEN i % 11 = 3 THEN word || '-' || word WHEN i % 997 = 450 THEN '[so' WHEN i % 997 = 451 THEN 'on]' ELSE word END AS word FROM w)"
_OWN = f"WITH {WORDS_SQL}, br AS {_BRACKETED}, {TOKENS_SQL.format(name='tk', items='br', keys='conv_id')}, po AS (SELECT conv_id, 0 AS i, string_agg(word, ' ' ORDER BY i) AS word FROM br GROUP BY 1), {TOKENS_SQL.format(name='pt', items='po', keys='conv_id')}, it AS (SELECT conv_id, coalesce(n, 0) AS n_tokens, coalesce(a = b, n IS NULL AND b IS NULL) AS intact FROM (SELECT DISTINCT conv_id FROM br) LEFT JOIN (SELECT conv_id, count(*) AS n, list(t ORDER BY place) AS a FROM tk GROUP BY 1) USING (conv_id) LEFT JOIN (SELECT conv_id, list(t ORDER BY place) AS b FROM pt GROUP BY 1) USING (conv_id))"
_HOLDER = privacy.PLACEHOLDER.replace("'", "''")
_NUMBERED = "(place_owner // 5 + conv_id + CASE WHEN place_owner % 6 = 0 THEN 1 ELSE 0 END) % 3 + 1"

QUERIES = {
    "tracked_tokens": (tracked_tokens, f"{_OWN} SELECT conv_id, place, t AS token, i AS owner FROM tk SEMI JOIN (SELECT conv_id FROM it WHERE intact) USING (conv_id)"),
    "intact_visits": (intact_visits, f"{_OWN} SELECT conv_id, n_tokens, intact FROM it"),
    "relabelled_word_errors": (relabelled_word_errors, f"""WITH RECURSIVE {WORDS_SQL}, {TOKENS_SQL.format(name='rt', items='w', keys='conv_id, turn')}, {TOKENS_SQL.format(name='qt', items='h', keys='conv_id, turn')},
        pr AS (SELECT conv_id || '|' || turn AS p, conv_id, turn, r, q FROM (SELECT conv_id, turn, list(t ORDER BY place) AS r FROM rt GROUP BY 1, 2) JOIN (SELECT conv_id, turn, list(t ORDER BY place) AS q FROM qt GROUP BY 1, 2) USING (conv_id, turn)), {path_sql('pr', 'pa')},
        st AS (SELECT p, tag, CAST(sum((tag <> 'i')::INT) OVER o AS BIGINT) - 1 AS i, CAST(sum((tag <> 'd')::INT) OVER o AS BIGINT) - 1 AS j FROM (SELECT p, unnest(range(1, length(path) + 1)) AS k, unnest(string_split(path, '')) AS tag FROM pa) WINDOW o AS (PARTITION BY p ORDER BY k)),
        sp AS (SELECT conv_id, turn, count(DISTINCT {_NUMBERED.replace('place_owner', 'i')}) AS n FROM qt GROUP BY 1, 2),
        hi AS (SELECT pr.conv_id, pr.turn, rt.i // 5 % 3 + 1 AS r, {_NUMBERED.replace('place_owner', 'qt.i').replace('conv_id', 'qt.conv_id')} AS h FROM st JOIN pr USING (p) JOIN rt ON rt.conv_id = pr.conv_id AND rt.turn = pr.turn AND rt.place = st.i JOIN qt ON qt.conv_id = pr.conv_id AND qt.turn = pr.turn AND qt.place = st.j WHERE tag = 'h'),
        er AS (SELECT hi.conv_id, hi.turn, s, count_if(r <> (h - 1 + s) % n + 1) AS errors, count(*) AS total FROM hi JOIN sp ON sp.conv_id = hi.conv_id AND sp.turn = hi.turn, range(3) AS x(s) WHERE s < n GROUP BY 1, 2, 3),
        be AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY errors, s) = 1)
        SELECT v.conv_id, v.turn, CASE WHEN errors < total THEN errors / total WHEN n IS NOT NULL AND total IS NULL THEN 0 ELSE 1 END::DOUBLE AS der, coalesce(CASE WHEN errors < total THEN errors END, 0)::BIGINT AS speaker_errors, coalesce(CASE WHEN errors < total THEN total END, 0)::BIGINT AS total_correct_words,
          (CASE WHEN errors < total THEN s WHEN n IS NOT NULL AND total IS NULL THEN 0 END)::INT AS shift FROM (SELECT DISTINCT conv_id, turn FROM rt) v LEFT JOIN sp ON sp.conv_id = v.conv_id AND sp.turn = v.turn LEFT JOIN be ON be.conv_id = v.conv_id AND be.turn = v.turn"""),
    "rewritten_turns": (rewritten_turns, f"""WITH RECURSIVE {WORDS_SQL}, sa AS (SELECT conv_id, turn, list(word ORDER BY i) AS src, string_agg(CASE WHEN i % 23 = 5 THEN '[DATE].' WHEN i % 29 < 2 THEN '[PERSON_NAME],' WHEN i % 31 = 7 THEN '[HOSPITAL]' WHEN i % 37 = 8 THEN word || ' [AGE]' WHEN i % 41 = 9 THEN '' WHEN i % 17 = 4 THEN 'zz' ELSE word END, ' ' ORDER BY i) AS reply FROM w GROUP BY 1, 2),
        tu AS (SELECT conv_id || '|' || turn AS p, conv_id, turn, src, list_filter(string_split_regex(CASE WHEN turn % 5 = 4 THEN 'I can''t help with that.' ELSE reply END, '\\s+'), lambda x: x <> '') AS said FROM sa),
        ke AS (SELECT *, list_transform(src, lambda x: {TOKEN_SQL.format('x')}) AS ref, list_transform(said, lambda x: CASE WHEN regexp_matches(x, '{_HOLDER}') THEN '[' || regexp_extract(x, '{_HOLDER}', 1) ELSE {TOKEN_SQL.format('x')} END) AS hyp FROM tu),
        ra AS (SELECT p, unnest(range(len(ref))) AS i, unnest(ref) AS t FROM ke), qa AS (SELECT p, unnest(range(len(hyp))) AS j, unnest(hyp) AS t FROM ke), {blocks_sql('ra', 'qa', 'ba')},
        la AS (SELECT ba.*, i2 - i1 AS n, ref, said[j1 + 1:j2] AS got, list_filter(list_transform(said[j1 + 1:j2], lambda x: regexp_extract(x, '{_HOLDER}', 1)), lambda x: x <> '') AS held FROM ba JOIN ke USING (p)),
        kn AS (SELECT *, list_filter(held, lambda x: list_contains(['{"', '".join(privacy.LABELS)}'], x)) AS known FROM la),
        fi AS (SELECT *, tag <> 'equal' AND len(known) > 0 AND n BETWEEN 1 AND {privacy.MOST_AMBIGUOUS} AS fits FROM kn),
        su AS (SELECT p, sum(CASE WHEN tag = 'equal' OR fits THEN n ELSE 0 END) AS accounted, count_if(tag <> 'equal' AND CASE WHEN len(known) > 0 THEN NOT fits ELSE len(list_filter(got, lambda x: regexp_matches(x, '{privacy.BRACKETED}'))) > 0 END) AS unmatched FROM fi GROUP BY 1),
        lb AS (SELECT p, string_agg((i1 + k) || ':' || CASE WHEN len(known) = len(held) AND len(known) = n AND n > 1 THEN known[k + 1] ELSE known[1] END, ' ' ORDER BY i1 + k) AS labels FROM (SELECT *, unnest(range(n)) AS k FROM fi WHERE fits) WHERE ref[i1 + k + 1] <> '' GROUP BY 1),
        ac AS (SELECT tu.*, unmatched, labels, coalesce(accounted >= {privacy.LEAST_VERBATIM} * len(src), false) AS accepted FROM tu LEFT JOIN su USING (p) LEFT JOIN lb USING (p))
        SELECT conv_id, turn, accepted, CASE WHEN accepted THEN unmatched ELSE 0 END AS unmatched, CASE WHEN accepted THEN coalesce(labels, '') ELSE '' END AS labels FROM ac"""),
    "corrected_texts": (corrected_texts, None),
    "refined_turns": (refined_turns, f"""WITH {WORDS_SQL}, x AS (SELECT conv_id, turn, i, s, e, CASE WHEN turn % 4 = 2 THEN 3.5 ELSE 0.125 * (i % 3) END AS d FROM w),
        t AS (SELECT conv_id, turn::BIGINT AS k, min(s) AS s, max(e) AS e, arg_min(s + d, i) AS a, arg_max(e + d, i) AS b FROM x GROUP BY 1, 2),
        o AS (SELECT *, CASE WHEN abs(a - s) > 2.0 OR b <= a THEN 'fallback_drift' ELSE 'refined' END AS outcome FROM t)
        SELECT conv_id, k AS seg_idx, CASE WHEN outcome = 'refined' THEN a ELSE s END::DOUBLE AS t_start, CASE WHEN outcome = 'refined' THEN b ELSE e END::DOUBLE AS t_end, outcome FROM o
        UNION ALL SELECT conv_id, k + 100, e + 0.25, e + 0.25, 'fallback_empty' FROM t WHERE k % 7 = 3"""),
}
