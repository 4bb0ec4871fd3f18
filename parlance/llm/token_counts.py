"""Token counts under a SentencePiece model, by batch encoding that returns lengths only.

A text is cut at safe boundaries: a single space between a character that is no space and any
other character.  No piece of the model has a word mark after another character, so no merge
crosses such a cut, and the word mark that the encoder puts before each part stands for the
space that the cut took.  The parts are looked up in a bounded cache; those not in it go to the
encoder in batches of about the same number of bytes, whatever the lengths of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.frames import documents, slices

#: Text, in bytes, that is gathered before its unknown parts are encoded in one call.
BATCH_BYTES = 4 << 20
#: Bytes of remembered parts that a worker holds, at about ENTRY_BYTES for an entry beside its characters; the cache starts anew beyond it.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 160

_CUT = re.compile("(?<=[^ ▁]) (?=.)", re.DOTALL)


def _has_safe_cuts(model) -> bool:
    return not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))


class Counter:
    """Counts tokens of texts; one per worker process."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.safe = _has_safe_cuts(self.model)
        self.known: dict[str, int] = {}
        self.held = 0

    def parts(self, text: str) -> list[str]:
        return _CUT.split(text) if self.safe else [text]

    def count(self, texts: list[str]) -> list[int]:
        split = [self.parts(t) if t else [] for t in texts]
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        known = self.known
        new = list({p for parts in split for p in parts if p not in known})
        if new:
            known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
            self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
        return [sum(map(known.__getitem__, parts)) for parts in split]


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    Nulls and empty texts count 0 bytes and 0 tokens; repeated rows each give a row, rows without
    a doc_id too; an empty table gives an empty result; columns other than doc_id and text are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(model_file) or _COUNTERS.setdefault(model_file, Counter(model_file))
        for batch in batches:
            bounds = np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())])
            counts = [n for a, b in slices(bounds, BATCH_BYTES) for n in counter.count(batch.column(1).slice(a, b - a).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = documents(docs, F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), unnamed=True)
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
