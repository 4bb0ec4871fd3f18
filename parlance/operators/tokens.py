"""Tokens of items (words, turns) with the items that they come from, and alignments of them as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import align

Normalizer = Callable[[Column], Column]


def tracked_tokens(items: DataFrame, by: list[str], order: str = "word_idx", text: str = "word", normalize: Normalizer = T.headline) -> DataFrame:
    """by, place, token, owner: the normalized tokens of all items in order, numbered from 0, and the item of each; an item may have none or several."""
    each = items.select(*by, F.col(order).alias("owner"), T.words_of(normalize(F.col(text))).alias("tokens")).select(*by, "owner", F.posexplode_outer("tokens").alias("pos", "token")).where("token is not null")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("owner", "pos")) - 1
    return each.withColumn("place", place.cast("long")).select(*by, "place", "token", "owner")


def intact_visits(items: DataFrame, by: list[str], order: str = "word_idx", text: str = "word", normalize: Normalizer = T.headline) -> DataFrame:
    """by, n_tokens, intact: whether the items' own tokens are those of their pooled text; a bracket that spans items breaks that, and owners can't be told."""
    held = items.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]).alias("texts"))
    own = F.flatten(F.transform("texts", lambda t: T.words_of(normalize(t))))
    both = held.select(*by, own.alias("own"), T.words_of(normalize(F.array_join("texts", " "))).alias("pooled"))
    return both.select(*by, F.size("own").cast("long").alias("n_tokens"), (F.col("own") == F.col("pooled")).alias("intact"))


def listed(tokens: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, name: the tokens of each visit in order of place, as an array."""
    return tokens.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias(name))


def hits(ref: DataFrame, hyp: DataFrame, by: list[str]) -> DataFrame:
    """by, i, j: places of the tokens (by, place, token) that a shortest edit path pairs as the same."""
    pairs = listed(ref, by, "ref").join(listed(hyp, by, "hyp"), by)
    return align.edit_steps(pairs, by).where("tag = 'hit'").select(*by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
