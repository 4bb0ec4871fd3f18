"""Whether what a reference marks as identifying can still be read in a system's transcript.

Spans (by, first, last: half-open token places of the reference) are carried over by matching
blocks (by, i1, i2, j1, j2); ``by`` names the columns of one visit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import align

#: Tokens by which a carried range is widened on either side.
PAD = 2
# Labels of what a model blanks, its placeholders as it writes them, and anything that looks like one.
LABELS = ["PERSON_NAME", "DATE", "LOCATION", "AGE", "GENDER", "US_STATE"]
PLACEHOLDER = r"^\[([A-Z_]+)\](?:['’]s)?[.,!?;:]*$"
BRACKETED = r"\[[A-Z_]+\]"
#: Share of a turn's words that a rewrite must account for, and most words of a block whose labels can't be told apart.
LEAST_VERBATIM, MOST_AMBIGUOUS = 0.85, 8
#: Tokens of a bucket; ranges and blocks meet in the buckets that they touch.
BUCKET = 512


def _buckets(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BUCKET), F.floor(F.greatest(first, last) / BUCKET)))


def projected(spans: DataFrame, blocks: DataFrame, by: list[str], pad: int = PAD) -> DataFrame:
    """spans with low and high: the range of the other side, from the least to the greatest place of any block that a span meets, widened; 0 and 0 where none does.

    Blocks of equal length map place by place, others as a whole.  High may lie beyond the end.
    """
    cut = blocks.select(*by, "i1", "i2", "j1", "j2").withColumn("bucket", _buckets(F.col("i1"), F.col("i2")))
    asked = spans.select(*by, "first", "last").distinct().withColumn("bucket", _buckets(F.col("first"), F.col("last")))
    met = asked.join(cut, [*by, "bucket"]).where("i2 > first and i1 < last")
    even = F.col("i2") - F.col("i1") == F.col("j2") - F.col("j1")
    low = F.when(even, F.col("j1") + F.greatest(F.col("first") - F.col("i1"), F.lit(0))).otherwise(F.col("j1"))
    high = F.when(even, F.col("j1") + F.least(F.col("last"), F.col("i2")) - F.col("i1")).otherwise(F.col("j2"))
    ends = met.groupBy(*by, "first", "last").agg(F.greatest(F.min(low) - pad, F.lit(0)).alias("low"), (F.max(high) + pad).alias("high"))
    return spans.join(ends, [*by, "first", "last"], "left").fillna(0, ["low", "high"])


def projected_back(spans: DataFrame, blocks: DataFrame, by: list[str], pad: int = PAD) -> DataFrame:
    """The mirror: spans of the other side, in places of the reference."""
    return projected(spans, blocks.select(*by, F.col("j1").alias("i1"), F.col("j2").alias("i2"), F.col("i1").alias("j1"), F.col("i2").alias("j2")), by, pad)


def stands_in(needle: Column, tokens: Column) -> Column:
    """Whether the needle's tokens stand side by side among the tokens; false for an empty needle."""
    return F.coalesce((needle != "") & F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" "))), F.lit(False))


def region(tokens: Column, low: Column, high: Column) -> Column:
    """Tokens from low to below high, as far as there are any."""
    return F.slice(tokens, (F.greatest(low, F.lit(0)) + 1).cast("int"), F.greatest(high - F.greatest(low, F.lit(0)), F.lit(0)).cast("int"))


def context(tokens: Column, first: Column, last: Column, width: int = 7) -> Column:
    """The words around a range, for a reader."""
    return F.array_join(region(tokens, first - width, last + width), " ")


def leaks(spans: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    """spans with leaked (the surface stands in the region that the span falls on) and elsewhere (anywhere in the transcript).

    spans: by, first, last, low, high, surface, scrubbed.  tokens: by, tokens (normalized, of the
    system).  Spans that the transcriber scrubbed have no surface left and never leak.
    """
    needle = F.array_join(F.filter(F.transform(T.words_of(F.coalesce("surface", F.lit(""))), T.token), lambda t: t != ""), " ")
    testable = ~F.col("scrubbed") & (F.trim(F.coalesce("surface", F.lit(""))) != "")
    joined = spans.join(tokens.select(*by, "tokens"), by, "left").withColumn("needle", needle).withColumn("testable", testable)
    return joined.withColumn("leaked", testable & stands_in(F.col("needle"), region(F.col("tokens"), F.col("low"), F.col("high")))).withColumn("elsewhere", testable & stands_in(F.col("needle"), F.col("tokens"))).drop("tokens")


def leak_rates(found: DataFrame, by: list[str]) -> DataFrame:
    """Occurrences that can be tested and leak, and distinct identifiers of a visit of which any occurrence can be read anywhere."""
    tested = found.where("testable")
    each = tested.groupBy(*by, "needle").agg(F.bool_or("leaked").alias("leaked"), F.bool_or("elsewhere").alias("readable"))
    names = each.groupBy(*by).agg(F.count("*").alias("identifiers"), F.count_if("leaked").alias("identifiers_leaked"), F.count_if("readable").alias("identifiers_readable"))
    spans = found.groupBy(*by).agg(F.count("*").alias("spans"), F.count_if("testable").alias("testable"), F.count_if("leaked").alias("leaked"))
    return spans.join(names, by, "left").fillna(0, ["identifiers", "identifiers_leaked", "identifiers_readable"]).withColumn("leak_rate", F.try_divide("leaked", "testable")).withColumn("identifier_rate", F.try_divide("identifiers_readable", "identifiers"))


def open_marked(found: DataFrame, by: list[str]) -> DataFrame:
    """Marked spans by what became of them: redacted holds if a placeholder covers the span."""
    kind = (
        F.when(F.col("redacted") & F.col("leaked"), "blanked but readable").when(F.col("redacted"), "blanked")
        .when(~F.col("testable"), "unverifiable").when(F.col("leaked"), "confirmed readable").otherwise("wording absent")
    )
    return found.groupBy(*by, kind.alias("outcome")).agg(F.count("*").alias("n"))


def closest(rows: DataFrame, keys: list[str], slack: int = 1) -> DataFrame:
    """keys, similarity, matched: the run of tokens closest to needle, of its number of words give or take ``slack``.

    rows: keys, needle, tokens.  Empty needles and token lists have similarity 0.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in align.parts(batches):
            best = [align.best_similarity(n or "", t or [], slack) for n, t in zip(batch.column("needle").to_pylist(), batch.column("tokens").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([b[0] for b in best], pa.float64()), pa.array([b[1] for b in best], pa.string())], names=[*keys, "similarity", "matched"])

    return rows.select(*keys, "needle", "tokens").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", similarity double, matched string")


def surface_types(surfaces: DataFrame, labels: DataFrame, categories: dict[str, str]) -> DataFrame:
    """surfaces with category: of the most frequent label that any system gave to the same wording (ties to the one seen first), else by the wording alone.

    labels: surface, label, seen (order).
    """
    counts = labels.groupBy(F.lower("surface").alias("wording"), "label").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    top = counts.groupBy("wording").agg(F.max_by("label", F.struct(F.col("n"), -F.col("seen"))).alias("label"))
    named = F.create_map(*[F.lit(x) for pair in categories.items() for x in pair])
    by_label = F.coalesce(F.try_element_at(named, F.col("label")), F.lit("unclassified"))
    joined = surfaces.withColumn("wording", F.lower("surface")).join(top, "wording", "left")
    return joined.withColumn("category", F.when(F.col("label").isNotNull(), by_label).otherwise(F.coalesce(T.lexical_type(F.col("surface")), F.lit("unclassified")))).drop("wording", "label")


def first_and_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys with the first and the last value of ``value`` in the given order: either rule of merging dictionaries."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("r", F.row_number().over(w)).groupBy(*keys).agg(F.min_by("value", "r").alias("first_wins"), F.max_by("value", "r").alias("last_wins"))


def _key(token: Column) -> Column:
    """A placeholder stands for its label alone, which no word can be."""
    label = F.regexp_extract(token, PLACEHOLDER, 1)
    return F.when(label != "", F.concat(F.lit("\0"), label)).otherwise(T.token(token))


def rewritten_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, accepted, unmatched, labels: what a model that was asked to copy a turn, but for placeholders, replaced in it.

    turns: keys, words (array), reply.  ``labels`` has place and label of each word that a block with
    known placeholders replaces: placeholder by placeholder where there is one for each word, else
    the first for all.  Blocks without a word or with more than MOST_AMBIGUOUS, and bracketed tokens
    that aren't known, count as ``unmatched``.  A rewrite that accounts for less than LEAST_VERBATIM
    of the words, or whose turn lacks a key, isn't accepted, and has no labels and nothing unmatched.
    All of it stays in the turn's row: nothing is joined or shuffled.
    """
    none = F.array().cast("array<string>")
    sides = turns.select(*keys, F.transform(F.coalesce("words", none), F.trim).alias("source"), T.words_of(F.col("reply")).alias("output"))
    keyed = sides.withColumn("ref", F.transform("source", _key)).withColumn("hyp", F.transform("output", _key))
    o = align.blocks(keyed, [*keys, "ref", "output"])
    # One step for each field that the next ones use more than once, since what a lambda repeats is computed again.
    add = lambda **fields: o.withColumn("ops", F.transform("ops", lambda x: reduce(lambda y, f: y.withField(*f), [(k, v(x)) for k, v in fields.items()], x)))
    edit = lambda x: x["tag"] != "equal"
    some = lambda x: F.size(x["known"]) > 0
    o = add(n=lambda x: x["i2"] - x["i1"], said=lambda x: F.when(edit(x), F.slice("output", x["j1"] + 1, x["j2"] - x["j1"])).otherwise(none))
    o = add(held=lambda x: F.filter(F.transform(x["said"], lambda t: F.regexp_extract(t, PLACEHOLDER, 1)), lambda h: h != ""))
    o = add(known=lambda x: F.filter(x["held"], lambda h: h.isin(LABELS)))
    o = add(fits=lambda x: edit(x) & some(x) & (x["n"] > 0) & (x["n"] <= MOST_AMBIGUOUS))
    o = add(stray=lambda x: edit(x) & F.when(some(x), ~x["fits"]).otherwise(F.exists(x["said"], lambda t: t.rlike(BRACKETED))))
    single = lambda x: (F.size(x["known"]) == F.size(x["held"])) & (F.size(x["known"]) == x["n"])
    label = lambda x, k: F.struct((x["i1"] + k).alias("place"), F.get(x["known"], F.when(single(x), k).otherwise(0)).alias("label"))
    given = F.flatten(F.transform(F.filter("ops", lambda x: x["fits"]), lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda k: label(x, k))))
    labels = F.filter(given, lambda g: F.get("ref", g["place"]) != "")
    accounted = F.aggregate("ops", F.lit(0), lambda a, x: a + F.when(~edit(x) | x["fits"], x["n"]).otherwise(0))
    whole = F.size("ref")
    o = o.withColumn("accepted", F.coalesce((whole > 0) & (F.size("output") > 0) & (accounted >= LEAST_VERBATIM * whole) & reduce(and_, [F.col(k).isNotNull() for k in keys]), F.lit(False)))
    unmatched = F.size(F.filter("ops", lambda x: x["stray"])).cast("long")
    return o.select(*keys, "accepted", F.when(F.col("accepted"), unmatched).otherwise(0).alias("unmatched"), F.when(F.col("accepted"), labels).otherwise(F.array().cast("array<struct<place:int,label:string>>")).alias("labels"))
