"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is the table: each row names a measure and the least and largest value that a document
may have.  ``compile_rules`` turns it into one boolean and one list of the rules that fail, over
the columns of ``measures``.  Everything is a projection of expressions: each row by itself, no
shuffle, no user function.

Words are runs of characters other than white space; a stop word is one as it is listed, in
lower case, so that shouted text has few.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.frames import documents

#: Least number of words, and largest share (in hundredths) of words in repeated windows of REPEAT_WORDS words.
LEAST_WORDS, MOST_REPEATED, REPEAT_WORDS = 50, 50, 3
_SPACES = " \t\n\x0b\x0c\r"
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOL = r"[#*$%&|<>]"

# Common short words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were which with you not "
    "der die das den dem des ein eine einer und in zu mit von für auf ist im nicht auch sich als an es "
    "le la les de du des un une et à en est que qui dans pour pas par sur plus au "
    "el los las un una y en que es por con para del se no al lo su"
)


class Rule(NamedTuple):
    """A document fails where the measure is below ``least`` or above ``most`` (None: no bound)."""

    name: str
    measure: str
    least: float | None
    most: float | None


RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_word_share", 0.02, None),
    Rule("repeated_lines", "dup_line_share", None, 0.5),
    Rule("bullets", "bullet_line_share", None, 0.9),
    Rule("ellipses", "ellipsis_line_share", None, 0.3),
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts n_words to n_repeat_words, and the ratios that rules may name, for every row of docs."""
    text = F.col("text")
    trimmed = documents(docs, unnamed=True).select("doc_id", F.coalesce(text, F.lit("")).alias("text")).select("doc_id", "text", F.trim(text, F.lit(_SPACES)).alias("trimmed"))
    none = F.array().cast("array<string>")
    worded = trimmed.select(
        "doc_id", "text", F.when(F.col("trimmed") == "", none).otherwise(F.split("trimmed", _SPACE, -1)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    words, lines, hashes, windows = F.col("words"), F.col("lines"), F.col("hashes"), F.col("windows")
    # Columns that a lambda looks into are columns of an earlier select: their expressions would be worked out for each element.
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - (REPEAT_WORDS - 1), F.lit(0)))
    others = lambda i: [F.get(words, i + k) for k in range(1, REPEAT_WORDS)]
    hashed = worded.select("*", F.transform(first, lambda x, i: F.xxhash64(x, *others(i))).alias("hashes"))
    # Windows whose hashes all differ are all different; only other texts have the windows themselves sorted, so that equal ones stand together.
    window = lambda x, i: F.struct(F.concat_ws(" ", x, *others(i)).alias("key"), i.alias("at"))
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    sorted_ = hashed.select("doc_id", "text", "words", "lines", F.when(some, F.sort_array(F.transform(first, window))).alias("windows"))
    twice = F.filter(windows, lambda x, i: x["key"].eqNullSafe(F.get(windows, i + 1)["key"]) | x["key"].eqNullSafe(F.get(windows, i - 1)["key"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["at"] + k for k in range(REPEAT_WORDS)]))))
    counted = sorted_.select(
        "doc_id", F.size(words).alias("n_words"), F.char_length(F.array_join(words, "")).alias("word_chars"), F.regexp_count(text, F.lit(_SYMBOL)).alias("n_symbols"),
        F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"), F.coalesce(F.array_size(covered), F.lit(0)).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: w.isin(*sorted(set(STOP_WORDS.split()))))).alias("stop_words"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).alias("bullets"), F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("ellipses"),
    )
    n, n_lines = F.col("n_words"), F.col("n_lines")
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return counted.select(
        "doc_id", *longs, _share(F.col("word_chars"), n).alias("mean_word_chars"), _share(F.col("n_symbols"), n).alias("symbols_per_word"), _share(F.col("stop_words"), n).alias("stop_word_share"),
        _share(F.col("n_dup_lines"), n_lines).alias("dup_line_share"), _share(F.col("bullets"), n_lines).alias("bullet_line_share"), _share(F.col("ellipses"), n_lines).alias("ellipsis_line_share"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of ``measures`` fails, in their order."""
    out = []
    for rule in rules:
        bounds = ([F.col(rule.measure) < rule.least] if rule.least is not None else []) + ([F.col(rule.measure) > rule.most] if rule.most is not None else [])
        failed = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
        out.append(F.when(failed, F.lit(rule.name)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed for every row of docs.

    ``base_failed``: fewer than LEAST_WORDS words, or more than MOST_REPEATED hundredths of them in
    repeated windows; ``kept``: neither that nor any rule of the table; ``failed`` names those rules.
    Null, empty and blank texts have no word and fail the base.  Repeated rows each give a row, rows
    without a doc_id too; an empty table gives an empty result; columns other than doc_id and text
    are not read.
    """
    found = measures(docs).withColumn("failed", compile_rules(rules))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size("failed") == 0)).alias("kept"), F.concat_ws(",", "failed").alias("failed"))


def quality_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB, over the view ``documents``."""
    space = r"[\x20\x09-\x0D]"
    tests = []
    for rule in rules:
        bounds = ([f"{rule.measure} < {rule.least}"] if rule.least is not None else []) + ([f"{rule.measure} > {rule.most}"] if rule.most is not None else [])
        tests.append(f"CASE WHEN {' OR '.join(bounds)} THEN '{rule.name}' END")
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
    share = lambda part, whole: f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} ELSE 0 END"
    windows = " || ' ' || ".join(f"ws[i + {k}]" for k in range(REPEAT_WORDS))
    return rf"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
    g AS (SELECT r, i, {windows} AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {REPEAT_WORDS - 2})) AS i FROM w)),
    f AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM g),
    c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM f, range({REPEAT_WORDS}) AS k(k) WHERE times > 1 GROUP BY r),
    m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '{_SYMBOL}', '', 'g')) AS n_symbols,
            len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
            len(list_filter(ws, lambda x: x IN ({stops}))) AS stop_words,
            len(list_filter(ls, lambda x: regexp_matches(x, '^{space}*[-*•]'))) AS bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){space}*$'))) AS ellipses
          FROM w LEFT JOIN c USING (r)),
    s AS (SELECT *, {share("word_chars", "n_words")} AS mean_word_chars, {share("n_symbols", "n_words")} AS symbols_per_word, {share("stop_words", "n_words")} AS stop_word_share,
            {share("n_dup_lines", "n_lines")} AS dup_line_share,
            {share("bullets", "n_lines")} AS bullet_line_share, {share("ellipses", "n_lines")} AS ellipsis_line_share FROM m),
    b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, concat_ws(',', {", ".join(tests)}) AS failed FROM s)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM b"""
