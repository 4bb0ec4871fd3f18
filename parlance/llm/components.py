"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.frames import shared

#: Links, of 16 bytes each, that one task takes in to shorten paths; a table of no more than these is finished by it.
TASK_LINKS = 2_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        x, y = parent[x], parent[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy()), b.append(batch.column(1).to_numpy())
    nodes, least = roots(np.concatenate(a), np.concatenate(b))
    keep = nodes != least
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(least[keep])], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node that it reaches) for every node that has a link to a smaller one.

    ``links`` has two columns of node numbers; direction, repeats and loops don't matter, rows
    with a null are left out.  Tables beyond TASK_LINKS are first contracted in parts and then
    brought to stars by alternating steps: every node hands its larger neighbours to the least
    one it knows, then its smaller ones.  A hub costs a row for each of its neighbours.
    """
    shared(links.sparkSession)
    a, b = links.columns
    links = links.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).where("node <> root").checkpoint()
    n = links.count()
    if n <= TASK_LINKS:
        return links.repartition(1).mapInArrow(_contract, "node long, root long")
    links = links.repartition(-(-n // TASK_LINKS)).mapInArrow(_contract, "node long, root long").checkpoint()
    before = None
    while True:
        both = links.union(links.select("root", "node").toDF("node", "root"))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).where("node <> root").distinct()
        lower = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(lower, "node").select(F.explode(F.array(F.struct("node", F.col("least").alias("root")), F.struct(F.col("root").alias("node"), F.col("least").alias("root")))).alias("x")).select("x.*")
        links = small.where("node <> root").distinct().checkpoint()
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
        if now == before:
            return links
        before = now
