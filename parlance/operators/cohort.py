"""Cohorts of visits: what is complete and valid, what to sample, who leads, and totals over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds, words and seconds that a valid visit needs or may be off.
LEAST_SECONDS, LEAST_WORDS, SECONDS_OFF = 60.0, 50, 5.0
#: Decibels by which real channels differ on average, and within which of that a file is borderline.
SEPARATION, BORDER = 3.0, 1.0


def complete(objects: DataFrame, visit: list[str], category: str, categories: list[str]) -> DataFrame:
    """Visits that have an object of every category, with the first name of each."""
    wide = objects.groupBy(*visit).pivot(category, categories).agg(F.min("name"))
    for c in categories:
        wide = wide.where(F.col(c).isNotNull())
    return wide


def discovered(visits: DataFrame, visit: list[str], subset: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Visits that have a human transcript and sound, of a subset if one is given, the first ``limit`` in order if asked for."""
    found = visits.where("has_human and has_audio")
    found = found if subset is None else found.join(subset.select(*visit).distinct(), visit, "left_semi")
    return found if limit is None else found.orderBy(*visit).limit(limit)


def problems(facts: DataFrame) -> DataFrame:
    """facts with ``problems``: what is wrong with a visit.

    facts: seconds (of the sound), vendor_words, vendor_seconds, human_words, last_start, and
    whether the vendor's and the human's starts ascend; nulls mean that the file isn't there.
    """
    checks = {
        "missing audio": F.col("seconds").isNull(), "audio too short": F.col("seconds") < LEAST_SECONDS, "missing vendor transcript": F.col("vendor_words").isNull(),
        "vendor has no words": F.col("vendor_words") == 0, "vendor offsets not monotonic": ~F.col("vendor_ascends"), "vendor duration differs": F.abs(F.col("vendor_seconds") - F.col("seconds")) > SECONDS_OFF,
        "missing human transcript": F.col("human_words").isNull(), "human transcript too short": F.col("human_words") < LEAST_WORDS, "human times not monotonic": ~F.col("human_ascends"), "human turn past the end": F.col("last_start") > F.col("seconds") + SECONDS_OFF,
    }
    return facts.withColumn("problems", F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull()))


def ascends(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """by, ascends: whether the values never fall in the given order."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("falls", F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False))).groupBy(*by).agg((~F.bool_or("falls")).alias("ascends"))


def truncated(metrics: DataFrame, visit: list[str], system: str, ratio: float = 2.0, least: int = 2) -> DataFrame:
    """Visits of which every system, of ``least`` at least, has more than ``ratio`` times the reference's words: the reference must end early."""
    r = F.try_divide(F.col("hyp_words"), F.col("ref_words"))
    return metrics.groupBy(*visit).agg(F.min(r).alias("least_ratio"), F.count_distinct(system).alias("systems")).where((F.col("least_ratio") > ratio) & (F.col("systems") >= least))


def corpus_stats(files: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Files, hours of sound and of speech, and the least and most speakers of a file."""
    speech = segments.groupBy(*by).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("speech"), F.count_distinct("speaker").alias("speakers"))
    joined = files.join(speech, by, "left").fillna(0, ["speech", "speakers"])
    return joined.agg(F.count("*").alias("files"), (F.sum("seconds") / 3600).alias("hours"), (F.sum("speech") / 3600).alias("speech_hours"), F.min("speakers").alias("least_speakers"), F.max("speakers").alias("most_speakers"))


def channel_separation(windows: DataFrame, by: list[str], channels: str = "channels") -> DataFrame:
    """by, separation (mean absolute difference of levels, silent windows left out), method and whether the file is borderline."""
    loud = F.col("left_db").isNotNull() & F.col("right_db").isNotNull()
    out = windows.groupBy(*by).agg(F.max(channels).alias(channels), F.avg(F.when(loud, F.abs(F.col("left_db") - F.col("right_db")))).alias("mean"))
    value = F.when(F.col(channels) == 2, F.col("mean"))
    method = F.when(F.col(channels) != 2, "one speaker model").when(value >= SEPARATION, "channel dominance").otherwise("no real separation")
    return out.select(*by, value.alias("separation"), method.alias("method"), F.coalesce(F.abs(value - SEPARATION) < BORDER, F.lit(False)).alias("borderline"))


def changes(metrics: DataFrame, visit: list[str], system: str, value: str, base: str) -> DataFrame:
    """Of each other system the visits on which it is better (less), worse or as the base; visits without both count as unchanged."""
    own = metrics.where(F.col(system) == base).groupBy(*visit).agg(F.min(value).alias("base"))
    every = metrics.select(*visit).distinct().agg(F.count("*").alias("all"))
    both = metrics.where(F.col(system) != base).join(own, visit, "left").groupBy(system).agg(F.count_if(F.col(value) < F.col("base")).alias("better"), F.count_if(F.col(value) > F.col("base")).alias("worse"))
    return both.join(F.broadcast(every)).select(system, "better", "worse", (F.col("all") - F.col("better") - F.col("worse")).alias("unchanged"))


def leaders(values: DataFrame, name: str, value: str, low: str, high: str, lower_is_better: bool = True) -> DataFrame:
    """The best and the runner-up of a table of systems (ties by name), and whether their middle halves overlap, so that the order isn't established.

    values: one row for each system.
    """
    rank = F.col(value) if lower_is_better else -F.col(value)
    # Two rows of a table of systems: a top-k by min_by, without a sort of all.
    top = values.where(F.col(value).isNotNull()).agg(F.slice(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.col(name).alias("name"), F.col(value).alias("value"), F.col(low).alias("low"), F.col(high).alias("high")))), 1, 2).alias("t")).where("size(t) = 2")
    a, b = F.col("t")[0], F.col("t")[1]
    apart = (a["high"] < b["low"]) | (b["high"] < a["low"])
    return top.select(a["name"].alias("best"), a["value"].alias("best_value"), b["name"].alias("runner_up"), b["value"].alias("runner_up_value"), (~apart).alias("overlap"))


def subset_mean(metrics: DataFrame, subset: DataFrame, visit: list[str], by: list[str], value: str) -> DataFrame:
    """Mean of a value over the visits of a subset."""
    return metrics.join(subset.select(*visit).distinct(), visit, "left_semi").groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("visits"))


def most_common(rows: DataFrame, by: list[str], value: str, order: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by the first seen: a top-k."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "seen"))
    return counts.withColumn("place", rank).where(F.col("place") <= k).drop("seen")


def without_worst(metrics: DataFrame, visit: list[str], system: str, value: str, n: int = 10) -> DataFrame:
    """Mean of each system over all visits, and without the n visits that have the largest value of any system (ties by visit)."""
    gone = metrics.groupBy(*visit).agg(F.max(value).alias("worst")).orderBy(F.desc("worst"), *visit).limit(n).select(*visit, F.lit(True).alias("gone"))
    marked = metrics.join(F.broadcast(gone), visit, "left")
    return marked.groupBy(system).agg(F.avg(value).alias("mean"), F.avg(F.when(F.col("gone").isNull(), F.col(value))).alias("mean_without"))


def sampled(keys: DataFrame, key: Column, sizes: dict[str, int], seed: int) -> DataFrame:
    """Rows with ``part``: the first of each size in an order by a digest of key and seed, disjoint; a sampling operator, so all other rows go."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    total = sum(sizes.values())
    top = keys.withColumn("digest", digest).orderBy("digest").limit(total)
    place = F.row_number().over(Window.orderBy("digest"))
    out, edge = None, 0
    for name, n in sizes.items():
        edge += n
        out = F.when(place <= edge, name) if out is None else out.when(place <= edge, name)
    return top.withColumn("part", out).drop("digest")


def survey(spans: DataFrame, words: DataFrame, visit: list[str]) -> DataFrame:
    """visit, words, gold, testable of visits that have words and at least one span that can be tested."""
    s = spans.groupBy(*visit).agg(F.count("*").alias("gold"), F.count_if(~F.col("scrubbed") & (F.trim("surface") != "")).alias("testable")).where("testable > 0")
    return words.groupBy(*visit).agg(F.count("*").alias("words")).join(s, visit)


def totals(rows: DataFrame) -> DataFrame:
    """Sums of all whole-number columns."""
    return rows.agg(*[F.sum(c).alias(c) for c, kind in rows.dtypes if kind in ("int", "bigint", "smallint", "tinyint")])
