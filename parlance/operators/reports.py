"""Aggregations of per-visit metrics into reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(metrics: DataFrame, by: list[str], errors: str, words: str) -> DataFrame:
    """Mean and median of the visits' rates, and the pooled rate."""
    rate = F.try_divide(F.col(errors), F.col(words))
    return metrics.groupBy(*by).agg(F.count("*").alias("visits"), F.avg(rate).alias("mean_rate"), F.median(rate).alias("median_rate"), F.try_divide(F.sum(errors), F.sum(words)).alias("pooled_rate"))


def _at_places(values: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """by, n and the values at places (from 1, by n) of the sorted ones: from counts of the distinct values and their running sums, never a group in one row."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("to", F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    held = {name: F.max(F.when((place <= F.col("to")) & (place > F.col("to") - F.col("c")), F.col("value"))) for name, place in places.items()}
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[c.alias(name) for name, c in held.items()])


def quartiles_exclusive(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles at places k (n + 1) / 4 of the sorted values, interpolated; null below four values."""
    n = F.col("n")
    # Integer places: the whole part of k (n + 1) / 4, kept within the values, and the rest in quarters.
    whole = {k: F.least(F.greatest(F.floor(k * (n + 1) / 4), F.lit(1)), n - 1) for k in (1, 2, 3)}
    got = _at_places(values, by, value, {f"{side}{k}": whole[k] + step for k in (1, 2, 3) for side, step in (("low", 0), ("high", 1))})
    parts = {k: k * (n + 1) - whole[k] * 4 for k in (1, 2, 3)}
    return got.select(*by, n.cast("int").alias("n"), *[F.when(n >= 4, (F.col(f"low{k}") * (4 - parts[k]) + F.col(f"high{k}") * parts[k]) / 4).alias(f"q{k}") for k in (1, 2, 3)])


def upper_median(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The value at place n // 2 of the sorted ones (from 0), and at place int(0.9 (n - 1))."""
    n = F.col("n")
    return _at_places(values, by, value, {"median": F.floor(n / 2) + 1, "p90": F.floor(9 * (n - 1) / 10) + 1}).select(*by, "median", "p90")


def spread(values: DataFrame, by: list[str], value: str, above: float) -> DataFrame:
    """Quantiles, interpolated between the ends, and the number of values above a limit."""
    at = [0.05, 0.25, 0.5, 0.75, 0.95]
    got = values.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("q"), F.count_if(F.col(value) > above).alias("above"))
    return got.select(*by, *[F.col("q")[k].alias(f"p{round(100 * p):02d}") for k, p in enumerate(at)], "above")


def distribution(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of the group's values at or below each distinct one, from counts (no sort of rows)."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    running = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("share", F.sum("n").over(running) / F.sum("n").over(Window.partitionBy(*by)))


def head_to_head(metrics: DataFrame, visit: list[str], system: str, value: str, a: str, b: str) -> DataFrame:
    """Wins of either system over the visits that both have, the median difference and the means."""
    both = metrics.groupBy(*visit).agg(F.max(F.when(F.col(system) == a, F.col(value))).alias("a"), F.max(F.when(F.col(system) == b, F.col(value))).alias("b")).where("a is not null and b is not null")
    return both.agg(
        F.count("*").alias("visits"), F.count_if(F.col("a") < F.col("b")).alias("a_better"), F.count_if(F.col("b") < F.col("a")).alias("b_better"),
        F.median(F.col("a") - F.col("b")).alias("median_difference"), F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"),
    )


def common_visits(metrics: DataFrame, visit: list[str], system: str, systems: int) -> DataFrame:
    """Rows of the visits that every system has."""
    every = metrics.groupBy(*visit).agg(F.count_distinct(system).alias("n")).where(F.col("n") == systems).drop("n")
    return metrics.join(every, visit, "left_semi")


def worst(metrics: DataFrame, visit: list[str], value: str, n: int) -> DataFrame:
    """The n visits with the largest value of any system (a top-k, so it ends with a limit)."""
    return metrics.groupBy(*visit).agg(F.max(value).alias("worst")).orderBy(F.desc("worst"), *visit).limit(n)


def ranked_visits(metrics: DataFrame, visit: list[str], system: str, systems: list[str], terms: dict[str, str], words: str, rank_by: str = "worst") -> DataFrame:
    """rank, visit, and of each system its error rate, its dominant kind of error and the rate of that: visits that all the systems have, by the largest rate of any of them or by one system's (ties by visit).

    terms: name of a kind of error -> column that counts it.  The whole table is ranked, by ranges.
    """
    from parlance.operators.places import dense_places

    counts = {name: F.col(c) for name, c in terms.items()}
    shaped = metrics.withColumn("_shape", F.struct(F.try_divide(sum(counts.values()), F.col(words)).alias("wer"), dominant(counts).alias("shape"), F.try_divide(F.greatest(*counts.values()), F.col(words)).alias("shape_rate")))
    wide = shaped.groupBy(*visit).pivot(system, systems).agg(F.first("_shape"))
    for s in systems:
        wide = wide.where(F.col(f"`{s}`.wer").isNotNull())
    rates = [F.col(f"`{s}`.wer") for s in systems]
    key = F.greatest(*rates) if rank_by == "worst" and len(rates) > 1 else F.col(f"`{systems[0] if rank_by == 'worst' else rank_by}`.wer")
    placed = dense_places(wide.withColumn("_key", -key), ["_key", *visit], "rank")
    return placed.select((F.col("rank") + 1).alias("rank"), *visit, *[F.col(f"`{s}`.{f}").alias(f"{s}_{f}") for s in systems for f in ("wer", "shape", "shape_rate")])


def pooled_deltas(metrics: DataFrame, system: str, errors: str, words: str, base: str) -> DataFrame:
    """system, pooled (errors over words of all visits), delta (to the base system's; null if there is none)."""
    pooled = metrics.groupBy(system).agg(F.try_divide(F.sum(errors), F.sum(words)).alias("pooled"))
    # A row for each system.
    first = pooled.where(F.col(system) == base).agg(F.max("pooled").alias("_base"))
    return pooled.join(F.broadcast(first)).select(system, "pooled", (F.col("pooled") - F.col("_base")).alias("delta"))


def sides(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Keys that all tables have, with a struct of each table's other columns under its name."""
    out = None
    for name, table in tables.items():
        one = table.select(*key, F.struct(*[c for c in table.columns if c not in key]).alias(name))
        out = one if out is None else out.join(one, key)
    return out


def folded(metrics: DataFrame, others: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """metrics with each other scorer's measures under its name, null where it has no row; of repeated keys of a scorer one row counts."""
    for name, other in others.items():
        rest = [c for c in other.columns if c not in keys]
        metrics = metrics.join(other.groupBy(*keys).agg(F.min(F.struct(*rest)).alias(name)), keys, "left")
    return metrics


def dominant(counts: dict[str, Column]) -> Column:
    """Name of the largest of several numbers; ties in the given order."""
    top = F.greatest(*counts.values())
    out = None
    for name, value in counts.items():
        out = F.when(value == top, F.lit(name)) if out is None else out.when(value == top, F.lit(name))
    return out


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {
        "precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)),
        "under": F.try_divide(fn, tp + fn), "over": F.try_divide(fp, tp + fn), "net": F.try_divide(fp - fn, tp + fn),
    }


def outcome_sets(rows: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    """One pass over all groupings: GROUPING SETS, with the empty set for the whole."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(F.grouping_id().cast("long").alias("grouping"), *measures)
