"""Corrections of transcripts: labels in place of words, changed speakers, attached speakers, splits of a cohort."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.align import opcodes, parts
from parlance.operators.islands import merge_touching

UNKNOWN = "UNKNOWN"
#: What stays of a word behind its label: a possessive and closing punctuation.
TAIL = r"(?:['’]s)?[.,!?;:]*$"


def apply_labels(words: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Words with a label (by, word_idx, label) become ``[LABEL]``; the word and its label stay beside them."""
    joined = words.join(labels.select(*by, "word_idx", "label"), [*by, "word_idx"], "left")
    hit = F.col("label").isNotNull()
    shown = F.concat(F.lit("["), F.col("label"), F.lit("]"), F.regexp_extract("word", TAIL, 0))
    return joined.withColumn("redacted_from", F.when(hit, F.col("word"))).withColumn("word", F.when(hit, shown).otherwise(F.col("word"))).withColumnRenamed("label", "redaction_label")


def apply_changes(words: DataFrame, changes: DataFrame, by: list[str], reason: str) -> DataFrame:
    """New speakers (by, word_idx, new) with where they came from; changes to the same speaker leave no trace."""
    joined = words.join(changes.select(*by, "word_idx", "new"), [*by, "word_idx"], "left")
    moved = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("speaker"))
    return joined.withColumn("speaker_from", F.when(moved, F.col("speaker"))).withColumn("speaker_by", F.when(moved, F.lit(reason))).withColumn("speaker", F.when(moved, F.col("new")).otherwise(F.col("speaker"))).drop("new")


def differences(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Words that a relabelling may not touch and did: lost, added, reworded or retimed."""
    keep = ["word", "start", "end"]
    a = before.select(*by, "word_idx", F.struct(*keep).alias("a"))
    b = after.select(*by, "word_idx", F.struct(*keep).alias("b"))
    return a.join(b, [*by, "word_idx"], "full").where(~F.col("a").eqNullSafe(F.col("b")))


def attach_speakers(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, word_idx, speaker, origin of the hypothesis' tokens, and a row without word_idx for each pair that tells in ``dropped`` how many of the reference's tokens have no counterpart.

    Speakers come from matching blocks, by place within replaced ones (origin ``matched``); other
    tokens (``inserted``) take the speaker before, else the first one after, else the
    reference's first, else UNKNOWN.
    pairs: by, ref, hyp (token arrays) and speakers (of ref's tokens).
    """
    kinds = dict(pairs.dtypes)

    def attach(ref: list[str], who: list[str], hyp: list[str]) -> tuple[list[str], list[bool], int]:
        out: list[str | None] = [None] * len(hyp)
        met, dropped = [False] * len(hyp), 0
        for tag, i1, i2, j1, j2 in opcodes(ref, hyp):
            dropped += i2 - i1 if tag == "delete" else 0
            for j in range(j1, j2) if i2 > i1 else ():
                out[j], met[j] = who[min(i1 + j - j1, i2 - 1)], True
        known = [k for k, s in enumerate(out) if s is not None]
        default = who[0] if who else UNKNOWN
        for k, s in enumerate(out):
            if s is None:
                at = bisect.bisect_left(known, k)
                out[k] = (out[known[at - 1]] if at else out[known[0]]) if known else default
        return out, met, dropped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for k, (ref, who, hyp) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ref", "speakers", "hyp")))):
                found, met, dropped = attach(ref or [], who or [], hyp or [])
                n = len(found)
                at = pa.array([k] * (n + 1), pa.int64())
                columns = [pa.array([*range(n), None], pa.int64()), pa.array([*found, None], pa.string()), pa.array([*("matched" if m else "inserted" for m in met), None], pa.string()), pa.array([None] * n + [dropped], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in by), *columns], names=[*by, "word_idx", "speaker", "origin", "dropped"])

    return pairs.select(*by, "ref", "speakers", "hyp").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", word_idx long, speaker string, origin string, dropped long")


def split_by_key(key: Column, shares: dict[str, float], seed: int) -> Column:
    """A part for each key, from a digest of key and seed: all rows of a participant fall in one part, wherever they are."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    out, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        out = F.when(place < edge, name) if out is None else out.when(place < edge, name)
    return out.otherwise(list(shares)[-1])


def ranges_of_others(spans: DataFrame, by: list[str], system: str, systems: list[str]) -> DataFrame:
    """For each of the given systems the union of all others' ranges (leave one out)."""
    every = F.array(*map(F.lit, systems))
    each = spans.withColumn("left_out", F.explode(F.filter(every, lambda x: x != F.col(system))))
    return merge_touching(each.select(*by, "left_out", "start", "end"), [*by, "left_out"]).drop("piece")
