"""Queries that write transcripts in one of their forms and read them again, and joins of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import align, islands, reports
from parlance.plans import derived as D
from parlance.plans.derived import BY, SEGMENTS_SQL, WORDS_SQL, blocks_sql, distance_sql
from parlance.plans.report_queries import _metrics
from parlance.sources import sinks, transcripts


def _joined(df: DataFrame, by: list[str], order: str, value, sep: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), sep).alias("value"))


def tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under tags, every third without one."""
    t = D.turns(spark, sf_dir)
    tag = F.when(F.col("seg_idx") % 3 == 2, "").otherwise(F.format_string("S%d: 00:%02d:00.000 ", F.when(F.col("speaker") == "user", 1).otherwise(2), F.col("seg_idx") % 60))
    return transcripts.tagged_words(_joined(t, BY, "seg_idx", F.concat(tag, "text"), "\n"), BY)


def json_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as JSON, either a list or an object that holds it."""
    w = D.words(spark, sf_dir)
    each = w.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word", "start", "end", "speaker"))), lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"), x["speaker"].alias("speaker"))).alias("ws"))
    texts = each.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.to_json("ws")).otherwise(F.to_json(F.struct(F.col("ws").alias("words")))).alias("value"))
    got = transcripts.read_systems({"own": ("words", texts)}, BY)
    return got.select("system", "conv_id", "word_idx", "word", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "speaker")


def system_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two systems from their trees of files: runs of a visit of which the newest counts, a file in the visit's own folder, and a second tree for visits that the first has not."""
    i = F.col("word_idx")
    run = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(""))).when(F.col("conv_id") % 3 == 1, F.array(F.lit("run_1/"), F.lit("run_2/"))).otherwise(F.array(F.lit("run_3/"), F.lit("")))
    each = D.words(spark, sf_dir).withColumn("run", F.explode(run)).where(i % 3 < F.when(F.col("run") == "", 3).when(F.col("run") == "run_2/", 2).otherwise(1))
    one = F.struct("word", "start", "end", "speaker")
    texts = each.groupBy("conv_id", "run").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", one.alias("w")))), lambda x: x["w"])).alias("value"))
    folder = F.format_string("site/subject_%d/day1_session%03d", F.col("conv_id") % 7, F.col("conv_id"))
    visits = D.table(spark, sf_dir, "conversations").select("conv_id", folder.alias("folder")).distinct()
    files = texts.select(F.concat(folder, F.lit("/"), "run", F.lit("transcript.json")).alias("path"), "value")
    others = texts.where("run = ''").select(F.concat(folder, F.lit("/a_words.json")).alias("path"), "value")
    trees = {"ours": [files], "baseline_mono": [others.where("path like '%subject_3%'"), files.where("path like '%run_2%'").select(F.replace("path", F.lit("run_2/transcript.json"), F.lit("b_words.json")).alias("path"), "value")]}
    got = transcripts.read_visits(trees, visits, BY)
    return got.select("system", "conv_id", "word_idx", "word", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "speaker")


def vendor_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in a vendor's form: some blank, speakers numbered, ends missing."""
    w = D.words(spark, sf_dir)
    one = F.struct(F.col("start").alias("startOffset"), F.when(F.col("word_idx") % 5 > 0, F.col("end")).alias("endOffset"), F.when(F.col("word_idx") % 8 == 7, " ").otherwise(F.col("word")).alias("word"), F.when(F.col("speaker") == "user", "1").otherwise("host").alias("speakerLabel"))
    texts = w.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", one.alias("w")))), lambda x: x["w"]).alias("words"))).alias("value"))
    return transcripts.parse_vendor(texts, BY).select("conv_id", F.col("word_idx").cast("long").alias("word_idx"), "word", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "speaker")


def rendered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written with their roles as lines and read again."""
    t = D.turns(spark, sf_dir).withColumnRenamed("seg_idx", "turn")
    roles = t.select("conv_id").distinct().select("conv_id", F.lit("user").alias("speaker"), F.lit("PARTICIPANT").alias("role"))
    got = transcripts.parse_rendered(sinks.role_lines(t, roles, BY), BY)
    return got.select("conv_id", F.col("turn_idx").cast("long").alias("turn_idx"), "speaker", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "text")


def loaded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in any of three forms."""
    t = D.turns(spark, sf_dir)
    lines = _joined(t, BY, "seg_idx", F.concat("speaker", F.lit(" "), T.format_clock(F.col("start")), F.lit(" "), "text"), "\n").where("conv_id % 3 = 0")
    fields = F.struct("speaker", "start", "end", "text")
    turns = t.where("conv_id % 3 = 1").groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", fields.alias("f")))), lambda x: x["f"])).alias("value"))
    w = D.words(spark, sf_dir).where("conv_id % 3 = 2")
    words = w.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", F.struct("word", "start", "end", "speaker").alias("f")))), lambda x: x["f"]).alias("words"))).alias("value"))
    got = transcripts.load_turns(align.dealt(lines.unionByName(turns).unionByName(words), BY), BY, F.lit(0.0))
    return got.select("conv_id", "turn_idx", "speaker", F.col("start").alias("t_start"), F.length("text").cast("long").alias("chars"))


def reread_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as JSON of each visit and read again."""
    texts = sinks.results(_metrics(spark, sf_dir), "visit", "system")
    return transcripts.parse_results(texts, "visit")


def formatted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).select("visit", "system", "words", (F.col("errors") / F.col("words")).alias("rate"), (F.col("visit") / 4).alias("share"), (F.col("errors") / 7).alias("ratio"))
    return sinks.shown_table(m, {"words": "int", "rate": "pct", "share": "raw_pct", "ratio": "ratio"})


def indexed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of files by session and category."""
    c = D.table(spark, sf_dir, "customer").select(F.format_string("b/x/S%05d/day%04d_session%03d/%s.%s", F.col("c_custkey") % 100, F.col("c_custkey") % 30, F.lit(1), F.element_at(F.array(*map(F.lit, ["audio/a", "human/h", "chirp/c", "misc/m"])), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit("bin")).alias("value"))
    return transcripts.index_objects(c, {"audio": "/audio/", "human": "/human/", "chirp": "/chirp/"}).groupBy("session", "category").agg(F.count("*").alias("n"))


def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of suppliers as stems, of customers as the names that may hold them."""
    a = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("stem"))
    b = D.table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), (F.col("c_custkey") * 7).cast("string"), F.lit("_x")).alias("stem"))
    return transcripts.contained_names(a, b)


def three_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human, vendor and candidate of a session: orders of three kinds under a customer's key."""
    o = D.table(spark, sf_dir, "orders")
    side = lambda p, name: o.where(F.col("o_orderpriority").startswith(p)).groupBy("o_custkey").agg(F.min("o_orderkey").alias(name))
    named = {"human": "1", "vendor": "2", "candidate": "3"}
    held = reports.sides({name: side(p, name) for name, p in named.items()}, ["o_custkey"])
    return held.select("o_custkey", *[F.col(f"{name}.{name}").alias(name) for name in named])


def folded_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another scorer's measure beside each visit's and system's own."""
    m = _metrics(spark, sf_dir).select("visit", "system", "errors")
    other = m.where("visit % 3 = 0").select("visit", "system", (F.col("errors") * 2).alias("partner"))
    return reports.folded(m, {"p": other}, ["visit", "system"]).withColumn("partner", F.col("p.partner")).groupBy("system").agg(F.count("*").alias("visits"), F.count("partner").alias("both"), F.sum("errors").alias("errors"), F.sum("partner").alias("partner"))


def bridged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.points(spark, sf_dir).withColumn("speaker", F.when(F.col("word_idx") % 9 < 6, "A").otherwise("B"))
    one = lambda b: islands.turn_spans(p, ["room"], b).select("room", F.lit(b).alias("bridged"), "speaker", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    return one(False).unionByName(one(True))


def partner_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose error rates of each turn in percent, of tokens as they are, normalized, and with fillers as one token."""
    turn = lambda df, name: _joined(df, ["conv_id", "turn"], "word_idx", F.col("word"), " ").withColumnRenamed("value", name)
    both = turn(D.marked_words(spark, sf_dir), "a").join(turn(D.system_words(spark, sf_dir), "b"), ["conv_id", "turn"], "left")
    filled = lambda c: F.transform(T.loose_tokens(c, True), lambda t: F.when(T.is_filler(t), F.lit("<filler>")).otherwise(t))
    out = both.select("conv_id", "turn")
    for name, tokens in (("raw", T.loose_tokens), ("normalized", lambda c: T.loose_tokens(c, True)), ("filler_normalized", filled)):
        pairs = both.select("conv_id", "turn", tokens(F.col("a")).alias("ref"), F.coalesce(tokens(F.col("b")), F.array().cast("array<string>")).alias("hyp"))
        found = align.blocks(pairs, ["conv_id", "turn"]).join(pairs.select("conv_id", "turn", F.size("ref").alias("n")), ["conv_id", "turn"])
        out = out.join(found.select("conv_id", "turn", F.when(F.col("n") > 0, 100.0 * F.col("loose_errors") / F.col("n")).alias(name)), ["conv_id", "turn"])
    return out


def symmetric_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each turn without fillers on either side."""
    turn = lambda df, name: _joined(df, ["conv_id", "turn"], "word_idx", F.col("word"), " ").withColumnRenamed("value", name)
    both = turn(D.marked_words(spark, sf_dir), "a").join(turn(D.system_words(spark, sf_dir), "b"), ["conv_id", "turn"], "left")
    plain = lambda c: F.filter(T.words_of(T.alnum_only(F.coalesce(F.col(c), F.lit("")))), lambda t: ~T.is_filler(t))
    e = align.word_errors(both.select("conv_id", "turn", plain("a").alias("ref"), plain("b").alias("hyp")), ["conv_id", "turn"])
    return e.select("conv_id", "turn", "ref_words", (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("errors"))


_W = f"WITH {WORDS_SQL}"
_TR = "tr AS (SELECT conv_id, CAST(turn AS BIGINT) AS k, any_value(speaker) AS speaker, min(s) AS s, max(e) AS e, string_agg(word, ' ' ORDER BY i) AS text FROM w GROUP BY conv_id, turn)"
_M = "m AS (SELECT l_orderkey AS visit, 'sys' || (l_suppkey % 5) AS system, count(*) AS words, count_if(l_returnflag = 'R') AS errors, count_if(l_returnflag = 'A') AS others FROM lineitem GROUP BY 1, 2)"
_ALNUM = lambda t: "list_filter(string_split_regex(lower(trim(regexp_replace(regexp_replace(regexp_replace(" + t + ", '\\[.*?\\]', '', 'g'), '[^a-zA-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))), ' '), lambda x: x <> '' AND NOT regexp_matches(x, '" + T.FILLER_PATTERN + "'))"
_PLAIN = "list_filter(string_split_regex(CASE WHEN l = 'raw' THEN {0} ELSE lower(regexp_replace({0}, '[.,?!\\-—;:\"''()]', '', 'g')) END, '\\s+'), lambda x: x <> '')"
_LOOSE = "list_transform(" + _PLAIN + ", lambda x: CASE WHEN l = 'filler_normalized' AND regexp_matches(x, '" + T.FILLER_PATTERN.replace("{", "{{").replace("}", "}}") + "') THEN '<filler>' ELSE x END)"

QUERIES = {
    "tagged_words": (tagged_words, f"""{_W}, x AS (SELECT conv_id, i, word, CASE WHEN turn % 3 = 2 THEN NULL WHEN speaker = 'user' THEN 'S1' ELSE 'S2' END AS sp FROM w)
        SELECT conv_id, i AS word_idx, last_value(sp IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY i) AS speaker, word FROM x"""),
    "json_words": (json_words, f"{_W} SELECT 'own' AS system, conv_id, i AS word_idx, word, s AS t_start, e AS t_end, speaker FROM w"),
    "system_words": (system_words, f"""WITH {WORDS_SQL}, a AS (SELECT 'ours' AS system, *, i % 3 AS m FROM w WHERE conv_id % 3 <> 1 UNION ALL SELECT 'ours', *, i % 3 FROM w WHERE conv_id % 3 = 1 AND i % 3 < 2
          UNION ALL SELECT 'baseline_mono', *, 0 FROM w WHERE (conv_id % 3 <> 1 AND conv_id % 7 = 3) OR (conv_id % 3 = 1 AND i % 3 < 2))
        SELECT system, conv_id, row_number() OVER (PARTITION BY system, conv_id ORDER BY i) - 1 AS word_idx, word, s AS t_start, e AS t_end, speaker FROM a"""),
    "vendor_words": (vendor_words, f"""{_W} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS word_idx, word, s AS t_start, CASE WHEN i % 5 > 0 THEN e ELSE s END AS t_end, CASE WHEN speaker = 'user' THEN 'SPEAKER_01' ELSE 'host' END AS speaker FROM w WHERE i % 8 <> 7"""),
    "rendered_turns": (rendered_turns, f"{_W}, {_TR} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS turn_idx, CASE WHEN speaker = 'user' THEN 'PARTICIPANT' ELSE speaker END AS speaker, s AS t_start, e AS t_end, text FROM tr"),
    "loaded_turns": (loaded_turns, f"""{_W}, {_TR}, r AS (SELECT *, sum(CASE WHEN speaker IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS run FROM (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM w)),
        g AS (SELECT conv_id, run AS k, any_value(speaker) AS speaker, min(s) AS s, string_agg(word, ' ' ORDER BY i) AS text FROM r WHERE conv_id % 3 = 2 GROUP BY 1, 2), a AS (SELECT conv_id, k, speaker, s, text FROM tr WHERE conv_id % 3 < 2 UNION ALL SELECT * FROM g)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS turn_idx, speaker, s AS t_start, CAST(length(text) AS BIGINT) AS chars FROM a"""),
    "reread_results": (reread_results, f"WITH {_M} SELECT visit, system, unnest(['words', 'errors', 'others']) AS metric, CAST(unnest([words, errors, others]) AS DOUBLE) AS value FROM m"),
    "formatted_rows": (formatted_rows, f"WITH {_M} SELECT visit, system, CAST(words AS VARCHAR) AS words, format('{{:.2f}}', errors / words * 100) AS rate, format('{{:.2f}}', visit / 4) AS share, format('{{:.4f}}', errors / 7) AS ratio FROM m"),
    "indexed_objects": (indexed_objects, "SELECT printf('S%05d/day%04d_session001', c_custkey % 100, c_custkey % 30) AS session, ['audio', 'human', 'chirp'][c_custkey % 4 + 1] AS category, count(*) AS n FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1, 2"),
    "contained_names": (contained_names, "SELECT CAST(s_suppkey AS VARCHAR) AS stem, min(f) AS file FROM supplier LEFT JOIN (SELECT 'v' || c_custkey * 7 || '_x' AS f FROM customer) ON contains(f, CAST(s_suppkey AS VARCHAR)) GROUP BY 1"),
    "three_sides": (three_sides, "SELECT o_custkey, min(o_orderkey) FILTER (o_orderpriority[1] = '1') AS human, min(o_orderkey) FILTER (o_orderpriority[1] = '2') AS vendor, min(o_orderkey) FILTER (o_orderpriority[1] = '3') AS candidate FROM orders GROUP BY 1 HAVING human IS NOT NULL AND vendor IS NOT NULL AND candidate IS NOT NULL"),
    "folded_metrics": (folded_metrics, f"WITH {_M} SELECT system, count(*) AS visits, count_if(visit % 3 = 0) AS \"both\", CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(errors * 2) FILTER (visit % 3 = 0) AS BIGINT) AS partner FROM m GROUP BY 1"),
    "bridged_spans": (bridged_spans, f"""WITH {SEGMENTS_SQL}, x AS (SELECT *, CASE WHEN i % 9 < 6 THEN 'A' ELSE 'B' END AS sp FROM pt), r AS (SELECT *, sum(CASE WHEN sp IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY room ORDER BY i) AS run FROM (SELECT *, lag(sp) OVER (PARTITION BY room ORDER BY i) AS p FROM x)),
        g AS (SELECT room, run, any_value(sp) AS speaker, arg_min(s, i) AS s, arg_max(e, i) AS e FROM r GROUP BY 1, 2) SELECT room, false AS bridged, speaker, s AS t_start, e AS t_end FROM g UNION ALL SELECT room, true, speaker, s, greatest(e, coalesce(lead(s) OVER (PARTITION BY room ORDER BY run), e)) FROM g"""),
    "symmetric_errors": (symmetric_errors, f"""WITH RECURSIVE {WORDS_SQL}, a AS (SELECT conv_id, turn, {_ALNUM("string_agg(word, ' ' ORDER BY i)")} AS r FROM m GROUP BY 1, 2), b AS (SELECT conv_id, turn, {_ALNUM("string_agg(word, ' ' ORDER BY i)")} AS q FROM h GROUP BY 1, 2),
        pr AS (SELECT a.conv_id || '|' || a.turn AS p, a.conv_id, a.turn, r, coalesce(q, []) AS q FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn), {distance_sql('pr', 'di')} SELECT conv_id, turn, CAST(len(r) AS BIGINT) AS ref_words, CAST(errors AS BIGINT) AS errors FROM pr JOIN di USING (p)"""),
    "partner_errors": (partner_errors, f"""WITH RECURSIVE {WORDS_SQL}, a AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY i) AS a FROM m GROUP BY 1, 2), b AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY i) AS b FROM h GROUP BY 1, 2),
        ab AS (SELECT conv_id, turn, regexp_replace(regexp_replace(a, '\\[[^\\]]*\\](\\S*)', '\\1', 'g'), '\\{{[^\\}}]*\\}}(\\S*)', '\\1', 'g') AS a, regexp_replace(regexp_replace(coalesce(b, ''), '\\[[^\\]]*\\](\\S*)', '\\1', 'g'), '\\{{[^\\}}]*\\}}(\\S*)', '\\1', 'g') AS b FROM a LEFT JOIN b USING (conv_id, turn)),
        lv AS (SELECT conv_id || '|' || turn || '|' || l AS p, conv_id, turn, l, {_LOOSE.format('a')} AS r, {_LOOSE.format('b')} AS q FROM ab, (VALUES ('raw'), ('normalized'), ('filler_normalized')) v(l)),
        ra AS (SELECT p, unnest(range(len(r))) AS i, unnest(r) AS t FROM lv), qa AS (SELECT p, unnest(range(len(q))) AS j, unnest(q) AS t FROM lv), {blocks_sql('ra', 'qa', 'ba')},
        er AS (SELECT lv.*, CASE WHEN len(r) > 0 THEN 100.0::DOUBLE * coalesce(n, 0) / len(r) END AS rate FROM lv LEFT JOIN (SELECT p, sum(greatest(i2 - i1, j2 - j1)) AS n FROM ba WHERE tag <> 'equal' GROUP BY p) USING (p))
        SELECT conv_id, turn, any_value(rate) FILTER (l = 'raw') AS raw, any_value(rate) FILTER (l = 'normalized') AS normalized, any_value(rate) FILTER (l = 'filler_normalized') AS filler_normalized FROM er GROUP BY 1, 2"""),
}
