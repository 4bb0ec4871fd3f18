"""Places of rows in an order of the whole table, without the table in one task; what shards and spread samples go by."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of monotonically_increasing_id below the partition's number.
_BITS = 33


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder that the session's spark.checkpoint.dir names; a local session without one gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not given:
            import tempfile

            given = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(given)
    return df.checkpoint()


def dense_places(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place, from 0, in the given order of all rows (ties in any).

    Ranges of the order are sorted by themselves; counts of the ranges, a row each, tell where each
    begins.  The sorted ranges are saved, so that both see the same.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    begins = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))
    return placed.join(F.broadcast(begins), part == F.col("_part")).withColumn(name, (F.col("_before") + within).cast("long")).select(*rows.columns, name)


def round_robin(rows: DataFrame, order: list[str], shards: int, name: str = "shard") -> DataFrame:
    """rows with their shard, from 1: every ``shards``-th row in the given order."""
    return dense_places(rows, order, "_place").withColumn(name, F.pmod("_place", F.lit(shards)) + 1).drop("_place")


def pending(shard: DataFrame, done: DataFrame, visit: list[str], only: Column | None = None) -> DataFrame:
    """Visits that aren't done yet, of those that ``only`` holds for if it is given."""
    left = shard if only is None else shard.where(only)
    return left.join(done.select(*visit).distinct(), visit, "left_anti")


class _Choice(NamedTuple):
    place: int
    subject: str


def spread_sample(visits: DataFrame, size: str, subject: str, visit: list[str], count: int, per_subject: int) -> DataFrame:
    """``count`` visits spread over their sizes, at most ``per_subject`` of a subject; fewer if no more fit.

    Visits stand in order of size (ties by visit).  A walk with the stride that would land ``count``
    of them takes at each step the first visit from there on, and after the last from the first,
    that isn't taken and whose subject isn't full.  One aggregate over all visits finds the first
    fitting visit for all steps at once; from the first step that an earlier one has spoilt, it is
    asked again.  The driver holds what is chosen, ``count`` places at most.
    """
    placed = saved(dense_places(visits, [size, *visit], "_place"))
    n = placed.count()
    stride = max(n / count, 1.0)
    chosen: list[_Choice] = []
    while n and len(chosen) < count:
        held: dict[str, int] = {}
        for c in chosen:
            held[c.subject] = held.get(c.subject, 0) + 1
        full = [s for s, k in held.items() if k >= per_subject]
        fits = ~F.col("_place").isin([c.place for c in chosen]) if chosen else F.lit(True)
        fits = fits & ~F.col(subject).cast("string").isin(full) if full else fits
        steps = range(len(chosen), count)
        ahead = lambda step: F.pmod(F.col("_place") - min(int(step * stride), n - 1), F.lit(n))
        found = placed.where(fits).agg(*[F.min(F.struct(ahead(k).alias("ahead"), F.col("_place").alias("place"), F.col(subject).cast("string").alias("subject"))).alias(f"s{k}") for k in steps]).first()
        if found[0] is None:
            break
        taken: set[int] = set()
        for f in found:
            if f["place"] in taken or held.get(f["subject"], 0) >= per_subject:
                break
            taken.add(f["place"])
            held[f["subject"]] = held.get(f["subject"], 0) + 1
            chosen.append(_Choice(f["place"], f["subject"]))
    return placed.where(F.col("_place").isin([c.place for c in chosen]) if chosen else F.lit(False)).select(*visits.columns)
