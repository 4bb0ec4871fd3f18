"""Queries on marked spans that another transcript may still show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import privacy
from parlance.plans import derived as D
from parlance.plans.derived import ALIGN_SQL, BY, WORDS_SQL


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words from each capitalised one on, some of them scrubbed."""
    w = D.words(spark, sf_dir)
    follows = F.lead("word").over(D.Window.partitionBy("conv_id").orderBy("word_idx"))
    return w.withColumn("next", follows).where("word rlike '^[A-Z]'").select("conv_id", F.col("word_idx").alias("first"), (F.col("word_idx") + 2).alias("last"), F.concat_ws(" ", "word", "next").alias("surface"), (F.col("word_idx") % 5 == 0).alias("scrubbed"))


def projected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.projected(_gold(spark, sf_dir), D.alignment(spark, sf_dir), BY).select("conv_id", "first", "last", "low", "high")


def projected_back_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.placed_words(spark, sf_dir).where("j % 13 < 2").select("conv_id", F.col("j").alias("first"), (F.col("j") + 3).alias("last"))
    return privacy.projected_back(p, D.alignment(spark, sf_dir), BY).select("conv_id", "first", "low", "high")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = D.placed_words(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("j", T.token(F.col("word")).alias("t")))).alias("x"))
    return each.select("conv_id", F.col("x.t").alias("tokens"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.leaks(privacy.projected(_gold(spark, sf_dir), D.alignment(spark, sf_dir), BY), _tokens(spark, sf_dir), BY)


def span_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each occurrence whether it can be read where it stands, or anywhere."""
    return _leaks(spark, sf_dir).select("conv_id", "first", "testable", "leaked", "elsewhere")


def leak_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.leak_rates(_leaks(spark, sf_dir), BY)


def open_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.open_marked(_leaks(spark, sf_dir).withColumn("redacted", F.col("first") % 3 == 0), BY)


def span_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = privacy.projected(_gold(spark, sf_dir), D.alignment(spark, sf_dir), BY).join(_tokens(spark, sf_dir), "conv_id")
    return s.select("conv_id", "first", privacy.context(F.col("tokens"), F.col("low"), F.col("high")).alias("around"))


def closest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens nearest to what each span says, within the region that it falls on."""
    s = privacy.projected(_gold(spark, sf_dir), D.alignment(spark, sf_dir), BY).join(_tokens(spark, sf_dir), "conv_id")
    needle = F.array_join(F.transform(T.words_of(F.col("surface")), T.token), " ")
    return privacy.closest(s.select("conv_id", "first", needle.alias("needle"), privacy.region(F.col("tokens"), F.col("low"), F.col("high")).alias("tokens")), ["conv_id", "first"])


def surface_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by the type that other systems' labels or the wording give them."""
    g = _gold(spark, sf_dir)
    label = F.element_at(F.array(*map(F.lit, ["NAME", "DATE", "PLACE"])), (F.col("first") % 3 + 1).cast("int"))
    labels = g.where("first % 4 < 2").select("surface", label.alias("label"), (F.col("conv_id") * 100000 + F.col("first")).alias("seen"))
    return privacy.surface_types(g, labels, {"NAME": "person", "DATE": "date"}).groupBy("category").agg(F.count("*").alias("n"))


def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer and priority the first and the last order: either rule of merging."""
    o = D.table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.col("o_orderstatus").alias("value"))
    return privacy.first_and_last(o, ["o_custkey", "o_orderpriority"], "o_orderkey")


_GOLD = f"""WITH RECURSIVE {WORDS_SQL}, {ALIGN_SQL}, g0 AS (SELECT *, lead(word) OVER (PARTITION BY conv_id ORDER BY i) AS nx FROM w), gold AS (SELECT conv_id, i AS f, i + 2 AS l, concat_ws(' ', word, nx) AS surface, i % 5 = 0 AS scrubbed FROM g0 WHERE regexp_matches(word, '^[A-Z]'))"""
_MET = "min(CASE WHEN {0}2 - {0}1 = {1}2 - {1}1 THEN {1}1 + greatest(f - {0}1, 0) ELSE {1}1 END) AS lo, max(CASE WHEN {0}2 - {0}1 = {1}2 - {1}1 THEN {1}1 + least(l - {0}1, {0}2 - {0}1) ELSE {1}2 END) AS hi"
_PROJ = f"""{_GOLD}, mm AS (SELECT gold.conv_id, f, l, {_MET.format('i', 'j')} FROM gold JOIN bl ON bl.conv_id = gold.conv_id AND i2 > f AND i1 < l GROUP BY 1, 2, 3),
  pj AS (SELECT gold.*, coalesce(greatest(lo - 2, 0), 0) AS low, coalesce(hi + 2, 0) AS high FROM gold LEFT JOIN mm USING (conv_id, f, l)),
  tk AS (SELECT conv_id, list(regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') ORDER BY j) AS tokens FROM hj GROUP BY 1),
  nd AS (SELECT pj.*, tokens, array_to_string(list_filter(list_transform(string_split_regex(surface, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9'']', '', 'g')), lambda x: x <> ''), ' ') AS needle FROM pj LEFT JOIN tk USING (conv_id)),
  lk AS (SELECT *, NOT scrubbed AS testable, NOT scrubbed AND needle <> '' AND contains(' ' || array_to_string(tokens[low + 1:high], ' ') || ' ', ' ' || needle || ' ') AS leaked, NOT scrubbed AND needle <> '' AND contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || needle || ' ') AS elsewhere FROM nd)"""

QUERIES = {
    "projected_spans": (projected_spans, f"{_PROJ} SELECT conv_id, f AS first, l AS last, low, high FROM pj"),
    "projected_back_spans": (projected_back_spans, f"""WITH RECURSIVE {WORDS_SQL}, {ALIGN_SQL}, sp AS (SELECT conv_id, j AS f, j + 3 AS l FROM hj WHERE j % 13 < 2), mm AS (SELECT sp.conv_id, f, {_MET.format('j', 'i')} FROM sp JOIN bl ON bl.conv_id = sp.conv_id AND j2 > f AND j1 < l GROUP BY 1, 2, l)
        SELECT conv_id, f AS first, greatest(lo - 2, 0) AS low, hi + 2 AS high FROM mm"""),
    "span_leaks": (span_leaks, f"{_PROJ} SELECT conv_id, f AS first, testable, leaked, elsewhere FROM lk"),
    "leak_rates": (leak_rates, f"""{_PROJ}, a AS (SELECT conv_id, needle, bool_or(leaked) AS leaked, bool_or(elsewhere) AS readable FROM lk WHERE testable GROUP BY 1, 2), b AS (SELECT conv_id, count(*) AS identifiers, count_if(leaked) AS identifiers_leaked, count_if(readable) AS identifiers_readable FROM a GROUP BY 1),
        c AS (SELECT conv_id, count(*) AS spans, count_if(testable) AS testable, count_if(leaked) AS leaked FROM lk GROUP BY 1)
        SELECT conv_id, spans, testable, leaked, coalesce(identifiers, 0) AS identifiers, coalesce(identifiers_leaked, 0) AS identifiers_leaked, coalesce(identifiers_readable, 0) AS identifiers_readable, CASE WHEN testable > 0 THEN leaked / testable END AS leak_rate, CASE WHEN identifiers > 0 THEN identifiers_readable / identifiers END AS identifier_rate FROM c LEFT JOIN b USING (conv_id)"""),
    "open_marked": (open_marked, f"{_PROJ} SELECT conv_id, CASE WHEN f % 3 = 0 AND leaked THEN 'blanked but readable' WHEN f % 3 = 0 THEN 'blanked' WHEN NOT testable THEN 'unverifiable' WHEN leaked THEN 'confirmed readable' ELSE 'wording absent' END AS outcome, count(*) AS n FROM lk GROUP BY 1, 2"),
    "span_contexts": (span_contexts, f"{_PROJ} SELECT conv_id, f AS first, array_to_string(tokens[greatest(low - 7, 0) + 1:high + 7], ' ') AS around FROM nd"),
    "surface_types": (surface_types, f"""{_GOLD}, lb AS (SELECT lower(surface) AS wording, ['NAME', 'DATE', 'PLACE'][f % 3 + 1] AS label, count(*) AS n, min(conv_id * 100000 + f) AS seen FROM gold WHERE f % 4 < 2 GROUP BY 1, 2),
        tp AS (SELECT wording, label FROM (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY n DESC, seen) AS r FROM lb) WHERE r = 1),
        ty AS (SELECT list_filter(list_transform(string_split_regex(surface, '\\s+'), lambda x: regexp_replace(lower(x), '[^a-z0-9'']', '', 'g')), lambda x: x <> '') AS t, label FROM gold LEFT JOIN tp ON tp.wording = lower(gold.surface))
        SELECT CASE label WHEN 'NAME' THEN 'person' WHEN 'DATE' THEN 'date' WHEN 'PLACE' THEN 'unclassified' ELSE CASE WHEN len(t) > 0 AND (len(list_filter(t, lambda x: list_contains(['{"', '".join(T.MONTHS)}'], x) OR regexp_matches(x, '^[0-9]{{1,2}}(st|nd|rd|th)$|^(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth)$'))) > 0
          OR len(list_filter(t, lambda x: NOT regexp_matches(x, '^[0-9]+$'))) = 0) THEN 'date' ELSE 'unclassified' END END AS category, count(*) AS n FROM ty GROUP BY 1"""),
    "merged_entries": (merged_entries, "SELECT o_custkey, o_orderpriority, arg_min(o_orderstatus, o_orderkey) AS first_wins, arg_max(o_orderstatus, o_orderkey) AS last_wins FROM orders GROUP BY 1, 2"),
    "closest_runs": (closest_runs, None),
}
