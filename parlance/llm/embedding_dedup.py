"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on SIGHTS random lines.  On each line the vectors are sorted and each
is the centre of a window; two vectors collide where one lies in the other's window.  The
difference of a pair at distance r is normal with standard deviation r on every line, so the
number of collisions of the farthest pair asked for is binomial; the count that a pair must reach
is the largest that keeps RECALL of such pairs.  Pairs that reach it are verified by cosine.

Counting over all pairs of a table would be quadratic, so vectors are first dealt to cells, by
several coarse lines at once, in as many independent tables as the recall of the farthest pair
asks for; the number of lines grows with the logarithm of the number of vectors.  A pair that
shares cells in several tables is decided in the first of them only, so links are counted in the
cells and no list of pairs is ever made: a cell gives each vector its number of links and a
spanning forest of the links.  Equal vectors are one, with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.components import components, roots
from parlance.llm.frames import shared, shuffle_partitions

COSINE = 0.95
SIGHTS = 32
RECALL = 0.9995
#: Width of a cell along a coarse line; unit vectors spread over about one such line's unit.
CELL = 2.5
#: Vectors fall to a cell's share of one in SPLIT for each line: the inverse of the chance that two unrelated ones share a step of width CELL.
SPLIT = 1.8
#: Vectors that a cell should hold, and those beyond which it is dealt out in tiles.
CELL_VECTORS, TILE = 300, 4096
#: Share of the farthest pairs that may have no cell in common.
MISSED = 0.001
SEED = 7


def calibrated(far: float, window: float) -> int:
    """The largest count that at least RECALL of the pairs at distance ``far`` reach."""
    p = math.erf(window / far / math.sqrt(2))
    below, least = 0.0, 0
    for k in range(SIGHTS + 1):
        below += math.comb(SIGHTS, k) * p**k * (1 - p) ** (SIGHTS - k)
        if 1 - below < RECALL:
            break
        least = k + 1
    return least


def layout(n: int, far: float) -> tuple[int, int]:
    """Coarse lines to a cell, and tables."""
    lines = max(0, math.ceil(math.log(max(n, 1) / CELL_VECTORS) / math.log(SPLIT)))
    kept = (1 - far * math.sqrt(2 / math.pi) / CELL) ** lines
    return lines, 1 if not lines else math.ceil(math.log(MISSED) / math.log(1 - kept))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(column: pa.Array, kind) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).astype(np.float64).reshape(len(column), -1)


def _lines(width: int, count: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed + 1000 * width)).standard_normal((width, count))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    and vectors of different lengths don't link.  Repeated rows each count as a vector of their
    own in n_links.  Columns other than vec_id and embedding are not read; rows without a vec_id
    are left out.
    """
    spark = vectors.sparkSession
    shared(spark)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = np.float32 if single else np.float64
    element = "float" if single else "double"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding")).where("vec_id is not null")
    valid = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    marked = own.withColumn("valid", F.coalesce(valid, F.lit(False)))
    distinct = marked.where("valid").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).checkpoint()
    far = math.sqrt(2 - 2 * cosine) if cosine < 1 else 1e-6
    lines, tables = layout(distinct.count(), far)
    window, least = far, calibrated(far, far)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            lengths = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            begin = np.cumsum(lengths) - lengths
            for width in np.unique(lengths).tolist():
                some = np.flatnonzero(lengths == width)
                x = values[begin[some][:, None] + np.arange(width)]
                scaled = x.astype(np.float64)
                scaled /= np.abs(scaled).max(axis=1, keepdims=True)
                cells = np.zeros((len(some), tables), np.int64)
                if lines:
                    shift = np.random.Generator(np.random.PCG64(SEED + 2)).random(lines * tables) * CELL
                    step = np.floor((_unit(scaled) @ _lines(width, lines * tables, SEED + 1) + shift) / CELL).astype(np.int64).reshape(len(some), tables, lines)
                    for k in range(lines):
                        cells = cells * 1_000_003 + step[:, :, k]
                cells = cells * 31 + width
                raw = [v.tobytes() for v in x]
                names = pa.array([c.tobytes() for c in cells], pa.binary())
                ids, weight = batch.column(1).take(pa.array(some)), batch.column(2).take(pa.array(some))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), t, np.int32)), pa.array(cells[:, t]), ids, weight, names, pa.array(raw, pa.binary())], names=["table", "cell", "rep", "weight", "cells", "vector"]
                    )

    dealt = distinct.select("embedding", "rep", "weight").mapInArrow(deal, "table int, cell long, rep long, weight long, cells binary, vector binary")
    large = dealt.groupBy("table", "cell").agg(F.count("*").alias("size")).where(F.col("size") > TILE)
    chunks = F.ceil(F.col("size") / F.lit(TILE)).cast("int")
    chunk = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    tiled = (
        dealt.join(large, ["table", "cell"], "left").withColumn("chunk", F.coalesce(chunk, F.lit(0)))
        .withColumn("other", F.explode(F.when(F.col("size").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), chunks - 1))))
        .select(F.xxhash64("table", "cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("place"), (F.col("chunk") == F.col("other")).alias("whole"), "table", "chunk", "rep", "weight", "cells", "vector")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            yield _counted(t, kind, window, least, cosine)

    parts = shuffle_partitions(spark)
    found = tiled.repartition(parts, "place").sortWithinPartitions("place", "rep").mapInArrow(count, "rep long, links long, root long").checkpoint()
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.where("rep <> root").select("rep", "root")).select(F.col("node").alias("rep"), "root")
    keyed = marked.where("valid").select("vec_id", "embedding").join(distinct, "embedding").select("vec_id", "rep", "weight")
    joined = keyed.join(links, "rep", "left").join(comp, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    rest = marked.where(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each place, which stand together."""
    rest: list[pa.Table] = []
    name = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        places = t.column("place").to_numpy()
        edges = np.flatnonzero(np.r_[True, places[1:] != places[:-1], True]) if len(places) else []
        for a, b in zip(edges[:-1], edges[1:]):
            if rest and name != places[a]:
                yield pa.concat_tables(rest)
                rest = []
            name = places[a]
            rest.append(t.slice(a, b - a))
    if rest:
        yield pa.concat_tables(rest)


def _counted(t: pa.Table, kind, window: float, least: int, cosine: float) -> pa.RecordBatch:
    """Links of each vector decided in this place, and a spanning forest of them."""
    t = t.combine_chunks()
    rep, weight, chunk = (t.column(c).to_numpy() for c in ("rep", "weight", "chunk"))
    n, table = len(t), t.column("table")[0].as_py()
    links = np.zeros(n, np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if n > 1:
        x = _rows(t.column("vector").chunk(0), kind)
        x /= np.abs(x).max(axis=1, keepdims=True)
        unit = _unit(x)
        cells = np.frombuffer(b"".join(t.column("cells").to_pylist()), np.int64).reshape(n, -1)[:, :table]
        sights = unit @ _lines(unit.shape[1], SIGHTS, SEED)
        across = len(np.unique(chunk)) > 1
        orders = np.argsort(sights, axis=0, kind="stable")
        places = np.empty_like(orders)
        np.put_along_axis(places, orders, np.arange(n)[:, None], axis=0)
        step = max(1, min(1024, (16 << 20) // n))
        for a in range(0, n, step):
            mine = np.arange(a, min(n, a + step))
            seen = np.zeros((len(mine), n), np.int8)
            for k in range(SIGHTS):
                line = sights[orders[:, k], k]
                edge = np.zeros((len(mine), n + 1), np.int8)
                row = np.arange(len(mine))
                edge[row, np.searchsorted(line, sights[mine, k] - window, side="left")] += 1
                edge[row, np.searchsorted(line, sights[mine, k] + window, side="right")] -= 1
                seen += np.cumsum(edge, axis=1, dtype=np.int8)[:, places[:, k]]
            i, j = np.nonzero(seen >= least)
            i = mine[i]
            keep = i < j
            if across:
                keep &= chunk[i] != chunk[j]
            i, j = i[keep], j[keep]
            for b in range(0, len(i), 1 << 16):
                p, q = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                close = np.einsum("ij,ij->i", unit[p], unit[q]) >= cosine
                p, q = p[close], q[close]
                first = ~(cells[p] == cells[q]).any(axis=1)
                p, q = p[first], q[first]
                np.add.at(links, p, weight[q])
                np.add.at(links, q, weight[p])
                node, root = roots(np.concatenate([*left, p]), np.concatenate([*right, q]))
                left, right = [node[node != root]], [root[node != root]]
    root = np.arange(n)
    node, least_ = np.concatenate(left), np.concatenate(right)
    root[node] = least_
    order = np.flatnonzero((links > 0) | (root != np.arange(n)))
    return pa.RecordBatch.from_arrays([pa.array(rep[order]), pa.array(links[order]), pa.array(rep[root[order]])], names=["rep", "links", "root"])
