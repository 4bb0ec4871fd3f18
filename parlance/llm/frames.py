"""Helpers shared by the corpus operators: Arrow batches as flat byte buffers, and table access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at a time; bounds the size of its temporaries.
CHUNK_BYTES = 1 << 20
#: Sizes of blocks and buckets, in bytes of input; so many blocks before they begin to grow.
BLOCK_BYTES, BLOCK_MOST, BUCKET_BYTES, BLOCKS = 4 << 20, 32 << 20, 256 << 20, 16_384


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_large(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text or binary column as large_binary without nulls (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    return array.fill_null(b"") if array.null_count else array


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one buffer, and the row bounds (one more than there are rows)."""
    array = as_large(array)
    bounds = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``limit`` bytes; a longer row is a run of its own."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def documents(docs: DataFrame, *more, unnamed: bool = False) -> DataFrame:
    """doc_id and text alone, so that other columns, whatever their names, never meet the operator's own.

    Rows without a doc_id have no identity to be linked or learned under and are left out, but
    where each row is taken by itself (``unnamed``).
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return found if unnamed else found.where("doc_id is not null")


def bytes_of(docs: DataFrame) -> int:
    """Size that the plan states; where joins make that a guess beyond all measure, the texts are measured."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def blocks_and_buckets(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Into how many blocks texts are dealt, and into how many buckets what blocks ask.

    Blocks of ``block_bytes`` first, so that a small input is many tasks; as each block writes to each
    bucket they grow up to BLOCK_MOST, and beyond that there are more of them, without limit.
    """
    size, least = bytes_of(docs), shuffle_partitions(docs.sparkSession)
    return max(least, min(size // block_bytes, BLOCKS), size // BLOCK_MOST), max(least, size // BUCKET_BYTES)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared(spark: SparkSession) -> None:
    """checkpoint() needs a folder that all executors reach: the one that spark.checkpoint.dir names.

    Where it is unset, a local session, whose executors are this machine, gets one of its own;
    any other session is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    given = context.getConf().get("spark.checkpoint.dir")
    if not given and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not given:
        import tempfile

        given = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(given)
