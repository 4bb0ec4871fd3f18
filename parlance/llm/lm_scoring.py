"""Language-model scores of whole texts: context-tree weighting beside a base of single words.

Texts are dealt to blocks by a hash of doc_id.  A block asks for what it needs, once for each
distinct gram and word however often it holds them, and tells how often they occur in its
training texts; the bucket that owns a gram or word adds up what all blocks tell, builds its part
of the tree and answers every block in the order it asked.  So neither the model nor the
vocabulary is ever in one place, what moves grows with the input, and a hot text, source or word
is a single request of each block.

A bucket owns whole subtrees below the two most recent bytes.  For the two levels above, which
have at most 65,280 nodes each whatever the input, every bucket tells the product of what its
nodes have; the sums of these weigh the levels up to the root, and go to all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import ctw
from parlance.llm.frames import blocks_and_buckets, documents, flat, shared, slices
from parlance.llm.words import mix, word_hashes

#: Text, in bytes, whose grams are sorted at a time when they are counted, and when they are looked up (at most 2^16 symbols then).
COUNT_BYTES, LOOK_BYTES = 2 << 20, 48 << 10
GRAMS, WORDS = 0, 1
_SHARED = 2  # bytes of context by which subtrees are dealt
_MESSAGE = "src long, dest long, kind int, tokens long, types long, ends long, payload binary"


def _train_rows(ids: np.ndarray, modulus: int, remainder: int) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(str(i).encode()) % modulus != remainder for i in ids.tolist()], bool)


def _block_grams(data: np.ndarray, bounds: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block, sorted, and how often they occur in its training texts."""
    keys, counts = [], []
    for a, b in _pieces(bounds, COUNT_BYTES):
        padded, at, row = ctw.pad(data[a.start : b], a.bounds)
        found = (ctw.grams(padded, at) << np.uint64(1)) | train[a.row + row].astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
        key, n = ctw.counted(found)
        keys.append(key), counts.append(n)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, n = ctw.counted(np.concatenate(keys), np.concatenate(counts))
    return ctw.counted(key >> np.uint64(1), n * (key & np.uint64(1)).astype(np.int64))


def _messages(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split(" ")[0] for c in _MESSAGE.split(", ")])


class _Run:
    def __init__(self, row: int, start: int, bounds: np.ndarray):
        self.row, self.start, self.bounds = row, start, bounds


def _pieces(bounds: np.ndarray, limit: int) -> Iterator[tuple[_Run, int]]:
    for a, b in slices(bounds, limit):
        yield _Run(a, int(bounds[a]), bounds[a : b + 1] - bounds[a]), int(bounds[b])


def _block_words(data: np.ndarray, bounds: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, counts = [], []
    for a, b in _pieces(bounds, COUNT_BYTES):
        found, row = word_hashes(data[a.start : b], a.bounds)
        key, n = ctw.counted(found, train[a.row + row].astype(np.int64))
        words.append(key), counts.append(n)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return ctw.counted(np.concatenate(words), np.concatenate(counts))


def _dealt(keys: np.ndarray, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket (sorted within), and the bounds of the buckets."""
    owner = mix((keys >> np.uint64(8 * (ctw.DEPTH + 1 - _SHARED))) + np.uint64(1)) if kind == GRAMS else keys
    dest = ((owner >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(dest, kind="stable")
    return order, np.searchsorted(dest[order], np.arange(buckets + 1))


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as steps, and counts; compressed, as it is sent and kept."""
    raw = np.diff(keys, prepend=np.uint64(0)).tobytes() + counts.astype(np.int64).tobytes()
    return len(keys).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(payload[:8], "little")
    raw = pa.Codec("zstd").decompress(payload[8:], 16 * n)
    return np.cumsum(np.frombuffer(raw, np.uint64, n), dtype=np.uint64), np.frombuffer(raw, np.int64, n, 8 * n)


def _gathered(asked: pa.Table, kind: int) -> tuple[pa.Table, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """The requests of a kind, each one's keys and counts, the distinct keys and their sums."""
    rows = asked.filter(pa.compute.equal(asked.column("kind"), kind)).sort_by("src")
    raw = [_unpacked(p) for p in rows.column("payload").to_pylist()]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return rows, raw, *ctw.counted(*(np.concatenate([x[k] for x in [none, *raw]]) for k in (0, 1)))


def _top(asked: DataFrame) -> ctw.Tree:
    """The levels above the buckets' trees, weighted by what all buckets have below them."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        _, _, distinct, total = _gathered(pa.Table.from_batches(held), GRAMS)
        tree = ctw.Tree(distinct, total, ctw.DEPTH, _SHARED)
        nodes, products = tree.levels[_SHARED].products()
        seen = total > 0
        short, n = ctw.counted(((distinct[seen] >> np.uint64(8 * ctw.DEPTH)) << np.uint64(8)) | (distinct[seen] & np.uint64(255)), total[seen])
        columns = [np.repeat([0, 1], [len(short), len(nodes)]), np.concatenate([short, nodes]).astype(np.int64), np.concatenate([n, np.zeros(len(nodes), np.int64)]), np.concatenate([np.zeros(len(short)), products])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "gram", "n", "product"])

    rows = asked.where(F.col("kind") == GRAMS).mapInArrow(tell, "kind long, gram long, n long, product double").groupBy("kind", "gram").agg(F.sum("n").alias("n"), F.sum("product").alias("product")).orderBy("kind", "gram").toArrow()
    kind, gram = rows.column("kind").to_numpy(), rows.column("gram").to_numpy().astype(np.uint64)
    n, product = rows.column("n").to_numpy(), rows.column("product").to_numpy()
    return ctw.Tree.above(gram[kind == 0], n[kind == 0], gram[kind == 1], product[kind == 1])


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    Learned from the rows whose crc32(doc_id) mod ``modulus`` is not ``remainder``.  Null and
    empty texts are their end alone; repeated rows each count and each give a row; rows without a
    doc_id are left out; with nothing to learn from, every bit has probability one half and every
    token counts as unknown.  The end is the byte 0, which a NUL in a text equals; probabilities
    of grams are sent with 24 bits.
    """
    shared(docs.sparkSession)
    docs = documents(docs)
    blocks, buckets = blocks_and_buckets(docs)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(blocks)))

    def read(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = block.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        data, bounds = flat(block.column("text").take(pa.array(order)))
        return ids[order], data, bounds, _train_rows(ids[order], modulus, remainder)

    def ask(block: pa.Table) -> pa.Table:
        src = block.column("block")[0].as_py()
        ids, data, bounds, train = read(block)
        out: list[tuple] = []
        for kind, (keys, counts) in ((GRAMS, _block_grams(data, bounds, train)), (WORDS, _block_words(data, bounds, train))):
            order, cut = _dealt(keys, kind, buckets)
            for dest in range(buckets):
                some = order[cut[dest] : cut[dest + 1]]
                ends = int(train.sum()) if kind == WORDS and dest == 0 else 0
                if len(some) or kind == WORDS:  # every bucket tells every block its totals of words
                    out.append((src, dest, kind, 0, 0, ends, _packed(keys[some], counts[some])))
        return _messages(out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        asked = pa.Table.from_batches(held) if held else None
        out: list[tuple] = []
        for kind in (GRAMS, WORDS) if held else ():
            rows, raw, distinct, total = _gathered(asked, kind)
            tokens = types = ends = 0
            if kind == GRAMS:
                value = ctw.Tree(distinct, total, ctw.DEPTH, _SHARED).log10(distinct, above.value).astype(np.float32)
            else:
                ends = sum(rows.column("ends").to_pylist())
                tokens, types, value = int(total.sum()) + ends, int((total > 0).sum()) + (ends > 0), total
            for src, (keys, _) in zip(rows.column("src").to_pylist(), raw):
                out.append((src, asked.column("dest")[0].as_py(), kind, tokens, types, ends, value[np.searchsorted(distinct, keys)].tobytes()))
        yield from _messages(out).to_batches()

    def settle(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, data, bounds, train = read(block)
        rows = len(ids)
        lookup = {}
        for kind, dtype in ((GRAMS, np.float32), (WORDS, np.int64)):
            keys, _ = (_block_grams if kind == GRAMS else _block_words)(data, bounds, train)
            order, cut = _dealt(keys, kind, buckets)
            value = np.zeros(len(keys), dtype)
            mine = answers.filter(pa.compute.equal(answers.column("kind"), kind))
            for dest, payload in zip(mine.column("dest").to_pylist(), mine.column("payload").to_pylist()):
                value[order[cut[dest] : cut[dest + 1]]] = np.frombuffer(payload, dtype)
            lookup[kind] = keys, value
        tokens, types, ends = (pa.compute.sum(answers.column(c)).as_py() or 0 for c in ("tokens", "types", "ends"))
        logs, known, words, likely = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
        keys, counts = lookup[WORDS]
        for a, b in _pieces(bounds, COUNT_BYTES):
            found, row = word_hashes(data[a.start : b], a.bounds)
            c = counts[np.searchsorted(keys, found)] if len(found) else np.zeros(0, np.int64)
            n, at = len(a.bounds) - 1, slice(a.row, a.row + len(a.bounds) - 1)
            words[at] = np.bincount(row, minlength=n)
            known[at] = np.bincount(row, weights=c > 0, minlength=n)
            logs[at] = np.bincount(row, weights=np.log10(c + 1.0), minlength=n)
        keys, values = lookup[GRAMS]
        for a, b in _pieces(bounds, LOOK_BYTES):
            padded, at, row = ctw.pad(data[a.start : b], a.bounds)
            found = ctw.grams(padded, at)
            for begin in range(0, len(found), 1 << 16):
                packed = np.sort((found[begin : begin + (1 << 16)] << np.uint64(16)) | np.arange(min(1 << 16, len(found) - begin), dtype=np.uint64))
                key = packed >> np.uint64(16)
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                value = np.repeat(values[np.searchsorted(keys, key[first])].astype(np.float64), np.diff(np.r_[first, len(key)]))
                np.add(likely[a.row : a.row + len(a.bounds) - 1], np.bincount(row[begin + (packed & np.uint64(0xFFFF)).astype(np.int64)], weights=value, minlength=len(a.bounds) - 1), out=likely[a.row : a.row + len(a.bounds) - 1])
        base = logs + np.log10(ends + 1.0) - (words + 1) * np.log10(tokens + types + 1.0)
        size = np.maximum(np.diff(bounds), 1)
        return pa.table(
            {
                "doc_id": ids, "held_out": ~train, "n_tokens": words + 1, "n_known": known + (1 if ends > 0 else 0), "train_tokens": np.full(rows, tokens, np.int64),
                "base_score": base, "score": likely, "bits_per_byte": -likely / np.log10(2.0) / size,
            }
        )

    # A bucket to a partition, kept: both the levels above and the answers are made of it.
    asked = dealt.groupBy("block").applyInArrow(ask, _MESSAGE).repartitionById(buckets, F.col("dest").cast("int")).checkpoint()
    above = docs.sparkSession.sparkContext.broadcast(_top(asked))
    answers = asked.mapInArrow(answer, _MESSAGE)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("block").cogroup(answers.groupBy("src")).applyInArrow(settle, schema)
