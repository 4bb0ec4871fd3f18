"""Language identification as inference on a mixture of languages.

A document is a mixture: its byte n-grams come from several languages in unknown proportions.
Each language gives a smoothed distribution over hashed n-grams; expectation-maximisation finds
the proportions that make a document likeliest.  More languages always fit better, so the set
is chosen by penalised likelihood: languages join in the order of their proportions, and a set
of k pays k times half the logarithm of the number of n-grams (times PENALTY).  Sets grow as
long as that pays, up to all languages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.frames import documents, flat, slices

#: About how many labelled documents of each language, chosen by a hash of doc_id, the distributions are learned from.
TRAIN_DOCS = 4_000
BUCKETS = 1 << 16
SMOOTHING = 0.05
ROUNDS = 12
PENALTY = 8.0

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits and ASCII punctuation say nothing about language and count as space.
_FOLD = np.where(_SPACE | ((np.arange(256) < 128) & ~np.array([chr(c).isalpha() for c in range(256)])), 32, _LOWER).astype(np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes that start at each place; a run of spaces counts once, so it has no gram within."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    x = _FOLD[data]
    x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _counted(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the distinct grams of each row."""
    keys = [grams(data[a:b]) + k * BUCKETS for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
    found, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return found // BUCKETS, found % BUCKETS, n


class Mixture:
    """Languages and their log probabilities over buckets."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.copy()  # bucket, language

    def proportions(self, row: np.ndarray, bucket: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the languages of the chosen set, zero for others, and whether there were grams at all."""
        langs = len(self.langs)
        total = np.bincount(row, weights=n, minlength=rows)
        some = total > 0
        share = np.full((rows, langs), 1.0 / max(1, langs))
        if not langs or not some.any():
            return share, some
        held = np.flatnonzero(some)
        share[held] = self._chosen(np.searchsorted(held, row), bucket, n, total[held])
        return share, some

    def _chosen(self, row: np.ndarray, bucket: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The same of rows that all have grams."""
        log = self.log[bucket]
        like = np.exp(log - log.max(axis=1, keepdims=True))
        alone = np.add.reduceat((log - log.max(axis=1, keepdims=True)) * n[:, None], np.searchsorted(row, np.arange(len(total))), axis=0)
        every = _fitted(like, row, n, total, np.full(alone.shape, 1.0 / len(self.langs)))
        order = np.argsort(-every, axis=1, kind="stable")
        pays = PENALTY * 0.5 * np.log(total + 1)
        chosen = np.zeros(alone.shape)
        chosen[np.arange(len(total)), alone.argmax(axis=1)] = 1.0
        best = alone.max(axis=1) - pays
        open_ = np.arange(len(total))
        for k in range(2, len(self.langs) + 1):
            mine = np.isin(row, open_)
            part, at = like[mine], np.searchsorted(open_, row[mine])
            keep = np.zeros((len(open_), len(self.langs)))
            np.put_along_axis(keep, order[open_, :k], 1.0 / k, axis=1)
            tried = _fitted(part, at, n[mine], total[open_], keep)
            mixed = np.log(np.maximum((part * tried[at]).sum(axis=1), 1e-300)) * n[mine]
            value = np.add.reduceat(mixed, np.searchsorted(at, np.arange(len(open_)))) - k * pays[open_]
            better = value > best[open_]
            open_, tried, value = open_[better], tried[better], value[better]
            chosen[open_], best[open_] = tried, value
            if not len(open_):
                break
        return chosen


def _fitted(like: np.ndarray, row: np.ndarray, n: np.ndarray, total: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Proportions of each row after ROUNDS of expectation and maximisation; every row has grams."""
    begin = np.searchsorted(row, np.arange(len(total)))
    for _ in range(ROUNDS):
        part = like * share[row]
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        share = np.maximum(np.add.reduceat(part, begin, axis=0) / total[:, None], 1e-12) * (share > 0)
        share /= share.sum(axis=1, keepdims=True)
    return share


def learn(docs: DataFrame, held_out, train_docs: int = TRAIN_DOCS) -> Mixture:
    """The mixture's languages, from the labelled rows of docs that ``held_out`` (a condition on doc_id) doesn't hold for."""
    labelled = documents(docs, F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & ~held_out)
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Mixture([], np.zeros((0, BUCKETS)))
    langs = sorted(sizes)
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000))
    most = F.lit(0)
    for lang in langs:
        most = F.when(F.col("lang") == lang, math.ceil(1_000_000 * min(1.0, train_docs / sizes[lang]))).otherwise(most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, bounds = flat(batch.column("text"))
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(grams(data[bounds[k] : bounds[k + 1]]), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = labelled.where(place < most).mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS))
    index = {lang: k for k, lang in enumerate(langs)}
    which = np.array([index[x] for x in rows.column("lang").to_pylist()], np.int64)
    counts[which, rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Mixture(langs, counts)


def identify(docs: DataFrame, mixture: Mixture, more: tuple = ()) -> DataFrame:
    """doc_id, lang_pred, score, languages (of the chosen set, by proportion) and shares of every row of docs.

    ``und`` with score 0 for null and empty texts and those without a letter (of any script; other
    numerals and signs are none), and if no language was learned.  Texts too short for an n-gram
    get the first language with an even share.  Ties go to the language first in alphabetical
    order; repeated rows each give a row, rows without a doc_id too.
    """
    import regex

    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column("text"))
            texts = batch.column("text")
            preds, scores, sets, shares = [], [], [], []
            for a, b in slices(bounds):
                share, some = mixture.proportions(*_counted(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]), b - a)
                order = np.argsort(-share, axis=1, kind="stable")
                for k in range(b - a):
                    if not mixture.langs or letter.search(texts[a + k].as_py() or "") is None:
                        preds.append("und"), scores.append(0.0), sets.append([]), shares.append([])
                        continue
                    held = [int(i) for i in order[k] if share[k, i] > 1e-6]
                    preds.append(mixture.langs[held[0]])
                    scores.append(float(min(1.0, share[k, held[0]])))
                    sets.append([mixture.langs[i] for i in held])
                    shares.append([float(share[k, i]) for i in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages", "shares"],
            )

    return documents(docs, unnamed=True).mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def held_out(modulus: int, remainder: int):
    """Whether the CRC-32 of doc_id, as text, leaves the remainder."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == F.lit(remainder)
