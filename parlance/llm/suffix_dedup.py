"""Suffix-array dedup: removes what repeats, in LENGTH bytes or more, from a document with a smaller id.

1.  Sample.  Of every run of SPAN consecutive GRAM-byte strings the one with the least hash is
    sampled, so each LENGTH-byte string holds a sample at a place that depends on its bytes alone:
    a difference cover chosen by content, with one sample in sixteen bytes.  Places are found
    once, as texts are dealt to blocks.  Each block names its samples once; buckets tell which
    names more than one document has.
2.  Suffixes.  Around a shared sample stand all LENGTH-byte strings that hold it: 2 LENGTH - GRAM
    bytes.  These go to the bucket of the sample, once for each block and with the smallest
    document.  A bucket builds suffix arrays over them by the difference-cover algorithm (sorting
    sampled triples, recursing on their names, merging the remaining suffixes) and compares
    adjacent prefixes: equal ones form a class, whose smallest document decides.
3.  Cover.  The answers come back to the block, as a bit for each string of each sample, and the
    bytes that the strings cover are removed.

A sample of more than HEAVY documents, counted over all blocks, would bring unbounded numbers of
surroundings to one bucket; its strings are dealt singly, sorted and compared there byte by byte.
Texts that equal one of a smaller document need no search: all their strings repeat.  Hashes only
deal and sort; what counts as equal is decided by bytes, but for whole texts, by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.frames import blocks_and_buckets, documents, flat, slices
from parlance.llm.suffix_array import ordered, suffix_array
from parlance.llm.words import _BASE, _TABLE, mix

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1
BEFORE, AROUND = LENGTH - GRAM, 2 * LENGTH - GRAM
#: Documents that hold a sample beyond which its strings are dealt singly.
HEAVY = 4096
#: Bytes of surroundings over which one suffix array is built; a sample's are never parted.
ARRAY_BYTES = 1 << 16
#: Bytes of text in which samples are sought at a time.
SLICE_BYTES = 1 << 18
#: Bytes of whole texts whose samples are written at a time.
BATCH_BYTES = 4 << 20
#: Bytes, as the plan states them, of a block of a small input.
BLOCK_BYTES = 2 << 20
#: Strings that are cut out at a time.
STRINGS = 1 << 15
_KEPT = 6  # bytes of a sample's hash that are sent, beside those that choose the bucket
_MESSAGE = "src long, dest long, kind int, payload binary"
_STATUS, _NEAR, _FAR, _COPY = 0, 1, 2, 3


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on, by doubling."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    now, have, out, done = _TABLE[data], 1, None, 0
    left = width
    while left:
        if left & 1:
            if out is None:
                out, done = now, have
            else:
                n = len(now) - done
                out = out[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + now[done : done + n]
                done += have
        left >>= 1
        if left:
            now = now[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + now[have:]
            have *= 2
    return mix(out)


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Extreme of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[:-rest], x[rest:]) if rest else x


def sample_places(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places of the samples of all rows; any row may be long, so the buffer is taken in slices with margins."""
    found = []
    for begin in range(0, len(data), SLICE_BYTES):
        end = min(len(data), begin + SLICE_BYTES)
        low, high = max(0, begin - SPAN), min(len(data), end + LENGTH)
        if high - low < LENGTH:
            continue
        first, last = int(np.searchsorted(bounds, low, side="right")) - 1, int(np.searchsorted(bounds, high, side="left"))
        edges = np.clip(bounds[first : last + 1], low, high)
        stop = np.repeat(bounds[first + 1 : last + 1], np.diff(edges))
        h = rolling(data[low:high], GRAM)
        place = np.arange(low, low + len(h))
        crosses = place + GRAM > stop[: len(h)]
        h = np.where(crosses, np.uint64(0xFFFFFFFFFFFFFFFF), h)
        least = _extreme(h, SPAN, np.minimum)
        whole = place[: len(least)] + LENGTH <= stop[: len(least)]
        edge = np.zeros(SPAN - 1, np.uint64)
        most = _extreme(np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), SPAN, np.maximum)
        at = place[(h == most) & ~crosses]
        found.append(at[(at >= begin) & (at < end)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the samples' places to each text: the first, then steps, which are less than SPAN + 1, as bytes."""
    for batch in batches:
        data, bounds = flat(batch.column("text"))
        for a, b in slices(bounds, BATCH_BYTES):
            edge = bounds[a : b + 1] - bounds[a]
            at = sample_places(data[bounds[a] : bounds[b]], edge)
            cut = np.searchsorted(at, edge)
            row = np.repeat(np.arange(b - a), np.diff(cut))
            first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
            step = np.where(first, at - edge[row], np.diff(at, prepend=0)).astype(np.uint8)
            places = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(step)])
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, places.cast(pa.binary())], names=[*batch.schema.names, "places"])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the lower bits: samples have the least of several hashes, so the upper ones are mostly small."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64) * buckets >> 32


def _cut(dest: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = ordered(dest, buckets)
    return order, np.searchsorted(dest[order], np.arange(buckets + 1))


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the row before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        differs = x[1:] != x[:-1]
        out[1:] |= differs if differs.ndim == 1 else differs.any(axis=1)
    return out


def _by_hash(hashes: np.ndarray) -> np.ndarray:
    """An order in which equal hashes stand together, but for what other hashes with the same upper bits part; places ascend within."""
    bits = np.uint64(max(1, len(hashes) - 1).bit_length())
    return (np.sort((hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def _wide(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(np.uint64)


def _row_hashes(words: np.ndarray) -> np.ndarray:
    hashes = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        hashes = mix(hashes * np.uint64(_BASE) + words[:, k])
    return hashes


class Block:
    """The documents of a block, in order of their ids, and what it asks and learns."""

    def __init__(self, own: pa.Table, answers: pa.Table, buckets: int):
        ids = own.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        own = own.take(pa.array(order))
        self.ids, self.buckets, self.rest = ids[order], buckets, own.column("rest") if "rest" in own.column_names else None
        self.data, self.bounds = flat(own.column("text"))
        copied = {p[:32]: int(p[32:]) for _, p in _answers(answers, _COPY)}
        long = np.diff(self.bounds) >= LENGTH
        self.copy = long & np.array([d in copied and copied[d] < i for d, i in zip(own.column("digest").to_pylist(), self.ids.tolist())], bool)
        step, edges = flat(own.column("places"))
        total = np.cumsum(step, dtype=np.int64)
        number = np.diff(edges)
        before = np.r_[0, total][edges[:-1]]
        row = np.repeat(np.arange(len(ids)), number)
        keep = ~self.copy[row]
        self.row = row[keep]
        self.place = (total - (before - self.bounds[:-1])[row])[keep]
        self.hash = np.zeros(len(self.place), np.uint64)
        for k in range(GRAM):
            self.hash = self.hash * np.uint64(_BASE) + _TABLE[self.data[self.place + k]]
        self.hash = mix(self.hash)
        self.order = _by_hash(self.hash)
        self.first = _fresh(self.hash[self.order])

    def asks_names(self) -> Iterator[tuple[int, int, bytes]]:
        """The distinct hashes, and in how many documents each stands."""
        h, doc = self.hash[self.order], self.ids[self.row[self.order]]
        first = np.flatnonzero(self.first)
        number = np.add.reduceat((self.first | _fresh(doc)).astype(np.int64), first) if len(first) else first
        h = h[first]
        order, cut = _cut(_bucket(h, self.buckets), self.buckets)
        kept = (h >> np.uint64(64 - 8 * _KEPT)).view(np.uint8).reshape(-1, 8)[order, :_KEPT]
        number = np.minimum(number[order], 0xFFFF).astype(np.uint16)
        for dest in range(self.buckets):
            a, b = cut[dest], cut[dest + 1]
            if a < b:
                yield dest, _STATUS, int(b - a).to_bytes(8, "little") + kept[a:b].tobytes() + number[a:b].tobytes()

    def learn(self, answers: pa.Table) -> None:
        """Of which samples the strings are sought, and which of them differ.

        ``at`` are the samples that another document has too, ``stands`` names for each its
        surroundings among the different ones of the block: ``text`` (with the room before and
        after), the smallest document ``doc`` and whether the sample is ``heavy``.
        """
        h = self.hash[self.order[self.first]]
        order, cut = _cut(_bucket(h, self.buckets), self.buckets)
        found = np.zeros(len(h), np.uint8)
        for dest, payload in _answers(answers, _STATUS):
            found[order[cut[dest] : cut[dest + 1]]] = np.frombuffer(payload, np.uint8)
        status = np.empty(len(self.hash), np.uint8)
        status[self.order] = np.repeat(found, np.diff(np.r_[np.flatnonzero(self.first), len(self.hash)]))
        self.at = at = np.flatnonzero(status)
        place, row = self.place[at], self.row[at]
        before = np.minimum(place - self.bounds[row], BEFORE)
        after = np.minimum(self.bounds[row + 1] - place, LENGTH)
        view = sliding_window_view(np.concatenate([np.zeros(BEFORE, np.uint8), self.data, np.zeros(LENGTH, np.uint8)]), AROUND)
        whole = np.zeros((len(at), AROUND + 8), np.uint8)
        around = np.arange(AROUND, dtype=np.int8) - BEFORE
        for a in range(0, len(at), STRINGS):
            b = a + STRINGS
            text, lo, hi = view[place[a:b]], before[a:b, None].astype(np.int8), after[a:b, None].astype(np.int8)
            whole[a:b, :AROUND] = np.where((around >= -lo) & (around < hi), text, 0)
        whole[:, AROUND], whole[:, AROUND + 1] = before, after
        words = whole.view(np.uint64)
        order = _by_hash(_row_hashes(words)) if len(at) else at
        first = _fresh(words[order])
        self.stands = np.empty(len(at), np.int64)
        self.stands[order] = np.cumsum(first) - 1
        chosen = order[first]
        self.text, self.doc = whole[chosen, : AROUND + 2], self.ids[row[chosen]]
        self.name, self.heavy = self.hash[at[chosen]], status[at[chosen]] == 2
        self.fits = _fitting(self.text)

    def _near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = np.flatnonzero(~self.heavy)
        order, cut = _cut(_bucket(self.name[mine], self.buckets), self.buckets)
        return mine, order, cut

    def _far(self) -> tuple[np.ndarray, ...]:
        """Strings around heavy samples: surroundings and bit of each, the different strings, which each is, their smallest documents, order and cuts."""
        mine = np.flatnonzero(self.heavy)
        which, back = (np.concatenate(x) if len(mine) else mine for x in zip(*(_set_bits(self.fits[mine[a : a + STRINGS]], mine[a : a + STRINGS]) for a in range(0, max(1, len(mine)), STRINGS))))
        view = sliding_window_view(self.text[:, :AROUND], LENGTH, axis=1)
        hashes = np.zeros(len(which), np.uint64)
        for a in range(0, len(which), STRINGS):
            hashes[a : a + STRINGS] = _row_hashes(_wide(view[which[a : a + STRINGS], BEFORE - back[a : a + STRINGS]]))
        order = _by_hash(hashes)
        fresh = np.ones(len(order), bool)
        for a in range(0, len(order) - 1, STRINGS):
            some = order[a : a + STRINGS + 1]
            text = view[which[some], BEFORE - back[some]]
            fresh[a + 1 : a + len(some)] = (text[1:] != text[:-1]).any(axis=1)
        first = order[fresh]
        inverse = np.empty(len(order), np.int32)
        inverse[order] = np.cumsum(fresh) - 1
        least = np.minimum.reduceat(self.doc[which[order]], np.flatnonzero(fresh)) if len(order) else np.zeros(0, np.int64)
        order, cut = _cut(_bucket(hashes[first], self.buckets), self.buckets)
        return which, back, view[which[first], BEFORE - back[first]], inverse, least, order, cut

    def asks_strings(self) -> Iterator[tuple[int, int, bytes]]:
        codec = pa.Codec("zstd")
        mine, order, cut = self._near()
        for dest in range(self.buckets):
            some = mine[order[cut[dest] : cut[dest + 1]]]
            if len(some):
                yield dest, _NEAR, len(some).to_bytes(8, "little") + self.doc[some].tobytes() + codec.compress(self.text[some].tobytes(), asbytes=True)
        _, _, different, _, least, order, cut = self._far()
        for dest in range(self.buckets):
            some = order[cut[dest] : cut[dest + 1]]
            if len(some):
                yield dest, _FAR, len(some).to_bytes(8, "little") + least[some].tobytes() + codec.compress(different[some].tobytes(), asbytes=True)

    def removed(self, answers: pa.Table) -> np.ndarray:
        """Whether each byte is covered."""
        bits = np.zeros(len(self.doc), np.uint32)
        mine, order, cut = self._near()
        for dest, payload in _answers(answers, _NEAR):
            bits[mine[order[cut[dest] : cut[dest + 1]]]] = np.frombuffer(payload, np.uint32)
        which, back, different, inverse, least, order, cut = self._far()
        earlier = np.zeros(len(different), bool)
        for dest, payload in _answers(answers, _FAR):
            earlier[order[cut[dest] : cut[dest + 1]]] = np.frombuffer(payload, np.uint8) > 0
        repeats = earlier[inverse] | (self.doc[which] > least[inverse])
        np.bitwise_or.at(bits, which[repeats], np.uint32(1) << back[repeats].astype(np.uint32))
        whole = np.where(self.ids[self.row[self.at]] > self.doc[self.stands], self.fits[self.stands], bits[self.stands])
        change = np.zeros(len(self.data) + 1, np.int16)  # no place has more than SPAN starts or ends in all
        some = np.flatnonzero(whole)
        whole, place = whole[some], self.place[self.at[some]]
        for shift in range(SPAN):
            start = place[(whole >> np.uint32(shift)) & np.uint32(1) > 0] - shift  # no place twice
            change[start] += 1
            change[start + LENGTH] -= 1
        gone = np.cumsum(change[:-1], dtype=np.int16) > 0
        for k in np.flatnonzero(self.copy).tolist():
            gone[self.bounds[k] : self.bounds[k + 1]] = True
        return gone


def _distinct(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of bytes, sorted, and which each row is."""
    if not len(strings):
        return strings, np.zeros(0, np.int64)
    keys = np.ascontiguousarray(strings).view(f"V{strings.shape[1]}").ravel()
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return strings[first], inverse


def _answers(answers: pa.Table, kind: int) -> Iterator[tuple[int, bytes]]:
    mine = answers.filter(pa.compute.equal(answers.column("kind"), kind))
    yield from zip(mine.column("dest").to_pylist(), mine.column("payload").to_pylist())


def _room() -> np.ndarray:
    before, after, back = np.arange(BEFORE + 1)[:, None, None], np.arange(LENGTH + 1)[:, None], np.arange(SPAN)
    return (((back <= before) & (LENGTH - back <= after)).astype(np.uint32) << back.astype(np.uint32)).sum(axis=2, dtype=np.uint32)


_ROOM = _room()


def _fitting(text: np.ndarray) -> np.ndarray:
    """Bit k of each: whether the string that starts k bytes before the sample lies in the document."""
    return _ROOM[text[:, AROUND], text[:, AROUND + 1]]


def _set_bits(bits: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, bit = np.nonzero((bits[:, None] >> np.arange(SPAN, dtype=np.uint32)) & np.uint32(1))
    return names[row].astype(np.int32), bit.astype(np.int8)


def _number(payload: bytes) -> int:
    return int.from_bytes(payload[:8], "little")


def _shared_names(raw: list[bytes]) -> list[bytes]:
    """For each name 0: of one document, 1: of several, 2: of more than HEAVY."""
    n = [_number(r) for r in raw]
    wide = np.zeros((sum(n), 8), np.uint8)
    wide[:, :_KEPT] = np.concatenate([np.frombuffer(r, np.uint8, k * _KEPT, 8).reshape(-1, _KEPT) for r, k in zip(raw, n)])
    names = wide.view(np.uint64).ravel()
    number = np.concatenate([np.frombuffer(r, np.uint16, k, 8 + k * _KEPT) for r, k in zip(raw, n)]).astype(np.int64)
    order = np.argsort(names)
    first = np.flatnonzero(_fresh(names[order]))
    total = np.add.reduceat(number[order], first)
    state = np.where(total > HEAVY, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
    status = np.empty(len(names), np.uint8)
    status[order] = np.repeat(state, np.diff(np.r_[first, len(names)]))
    return [x.tobytes() for x in np.split(status, np.cumsum(n)[:-1])]


def _unpacked(raw: list[bytes], width: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    codec, n = pa.Codec("zstd"), [_number(r) for r in raw]
    docs = np.concatenate([np.frombuffer(r, np.int64, k, 8) for r, k in zip(raw, n)])
    text = np.concatenate([np.frombuffer(codec.decompress(r[8 + 8 * k :], k * width), np.uint8).reshape(k, width) for r, k in zip(raw, n)])
    return n, docs, text


def _earlier_strings(raw: list[bytes]) -> list[bytes]:
    """Whether a smaller document has the string: strings sorted, neighbours compared."""
    n, docs, strings = _unpacked(raw, LENGTH)
    different, inverse = _distinct(strings)
    least = np.full(len(different), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, docs)
    return [x.tobytes() for x in np.split((least[inverse] < docs).astype(np.uint8), np.cumsum(n)[:-1])]


def _classes(text: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Bits of the strings of each surroundings that a smaller document among them has: suffix array, then adjacent prefixes."""
    order = suffix_array(text[:, :AROUND].ravel().astype(np.int64) + 1, LENGTH)
    back = BEFORE - order % AROUND
    order, back = order[back >= 0], back[back >= 0]
    row = order // AROUND
    valid = (_fitting(text)[row] >> back.astype(np.uint32)) & np.uint32(1) > 0
    start, row, back = order[valid], row[valid], back[valid]
    out = np.zeros(len(text), np.uint32)
    if not len(start):
        return out
    view = sliding_window_view(text[:, :AROUND].ravel(), LENGTH)
    fresh = np.ones(len(start), bool)
    for a in range(0, len(start) - 1, STRINGS):
        some = view[start[a : a + STRINGS + 1]]
        fresh[a + 1 : a + len(some)] = (some[1:] != some[:-1]).any(axis=1)
    first = np.flatnonzero(fresh)
    least = np.repeat(np.minimum.reduceat(doc[row], first), np.diff(np.r_[first, len(start)]))
    earlier = least < doc[row]
    np.bitwise_or.at(out, row[earlier], np.uint32(1) << back[earlier].astype(np.uint32))
    return out


def _earlier_surroundings(raw: list[bytes]) -> list[bytes]:
    """Bits of the strings of each surroundings that a smaller document has."""
    n, docs, text = _unpacked(raw, AROUND + 2)
    words = _wide(text)
    sample, whole = _row_hashes(_wide(text[:, BEFORE:LENGTH])) >> np.uint64(32), _row_hashes(words) >> np.uint64(32)
    order = np.argsort((sample << np.uint64(32)) | whole)
    group = _fresh(sample[order])
    first = group | _fresh(words[order])
    kind = np.empty(len(docs), np.int64)
    kind[order] = np.cumsum(first) - 1
    chosen = order[first]
    doc = np.minimum.reduceat(docs[order], np.flatnonzero(first))
    bits = np.zeros(len(chosen), np.uint32)
    begin = np.flatnonzero(group[first])
    sizes = np.diff(np.r_[begin, len(chosen)])
    begin, sizes = begin[sizes > 1], sizes[sizes > 1]
    at, ends = 0, np.cumsum(sizes)
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + ARRAY_BYTES // AROUND, side="right")))
        some = np.repeat(begin[at:to] - (np.cumsum(sizes[at:to]) - sizes[at:to]), sizes[at:to]) + np.arange(sizes[at:to].sum())
        bits[some] = _classes(text[chosen[some]], doc[some])
        at = to
    value = np.where(docs > doc[kind], _fitting(text), bits[kind])
    return [x.astype(np.uint32).tobytes() for x in np.split(value, np.cumsum(n)[:-1])]


_WORK = {_STATUS: _shared_names, _NEAR: _earlier_surroundings, _FAR: _earlier_strings}


def _answered(asked: pa.Table) -> pa.Table:
    out: list[tuple] = []
    for kind, work in _WORK.items():
        rows = asked.filter(pa.compute.equal(asked.column("kind"), kind))
        if len(rows):
            out += zip(rows.column("src").to_pylist(), rows.column("dest").to_pylist(), [kind] * len(rows), work(rows.column("payload").to_pylist()))
    return _messages(out)


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["src", "dest", "kind", "payload"])


def remove_repeats(docs: DataFrame, text: bool = False, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; with ``text``, also what is left (kept); with ``carry``, all columns of the row as a struct (rest) with fields c0, c1, ...

    Left-over bytes that are no UTF-8, as where a cut falls within a character, are left out of
    the text column only.  Null and empty texts have nothing to remove.  Repeated rows under one
    doc_id each give a row; a document doesn't make its own strings repeat.  Rows without a
    doc_id are left out; an empty table gives an empty result.
    """
    rest = [F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("rest")] if carry else []
    docs = documents(docs, *rest)
    blocks, buckets = blocks_and_buckets(docs, BLOCK_BYTES)
    block = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    kinds = dict(docs.dtypes)
    schema = "doc_id long, text string, digest binary" + (f", rest {kinds['rest']}" if carry else "")
    dealt = docs.select("doc_id", "text", digest, *(["rest"] if carry else [])).mapInArrow(_sampled, schema + ", places binary").withColumn("block", block)
    # A digest has a row for each block here, however many copies there are.
    copies = docs.where(F.octet_length("text") >= LENGTH).select("doc_id", block.alias("src"), digest).groupBy("digest", "src").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    several = copies.groupBy("digest").agg(F.min("least").alias("all_least"), F.max("most").alias("all_most")).where("all_least < all_most").select("digest", "all_least")
    known = copies.join(several, "digest").where("most > all_least")
    extra = known.select("src", F.lit(0).cast("long").alias("dest"), F.lit(_COPY).alias("kind"), F.concat("digest", F.col("all_least").cast("string").cast("binary")).alias("payload"))

    def ask_names(key: tuple, own: pa.Table, more: pa.Table) -> pa.Table:
        return _messages([(key[0].as_py(), *m) for m in Block(own, more, buckets).asks_names()] if len(own) else [])

    def ask_strings(key: tuple, own: pa.Table, more: pa.Table) -> pa.Table:
        if not len(own):
            return _messages([])
        b = Block(own, more, buckets)
        b.learn(more)
        return _messages([(key[0].as_py(), *m) for m in b.asks_strings()])

    def settle(key: tuple, own: pa.Table, more: pa.Table) -> pa.Table:
        b = Block(own, more, buckets)
        b.learn(more)
        gone = b.removed(more)
        rows: list[list] = [[], [], [], []]
        for begin, end in zip(b.bounds[:-1].tolist(), b.bounds[1:].tolist()):
            cut = gone[begin:end]
            kept = b.data[begin:end] if not cut.any() else b.data[begin:end][~cut]
            rows[0].append(int(cut.sum()))
            rows[1].append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
            rows[2].append(hashlib.sha256(kept).hexdigest())
            rows[3].append(kept.tobytes().decode("utf-8", "ignore") if text else None)
        out = {"doc_id": pa.array(b.ids), "n_bytes": pa.array(np.diff(b.bounds)), "n_removed": pa.array(rows[0], pa.int64()), "n_spans": pa.array(rows[1], pa.int64()), "kept_sha256": pa.array(rows[2], pa.string())}
        return pa.table(out | ({"kept": pa.array(rows[3], pa.string())} if text else {}) | ({"rest": b.rest} if carry else {}))

    def answered(fn, more: DataFrame) -> DataFrame:
        return dealt.groupBy("block").cogroup(more.groupBy("src")).applyInArrow(fn, _MESSAGE).groupBy("dest").applyInArrow(_answered, _MESSAGE)

    names = answered(ask_names, extra)
    strings = answered(ask_strings, extra.union(names))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if text else "") + (f", rest {kinds['rest']}" if carry else "")
    return dealt.groupBy("block").cogroup(extra.union(names).union(strings).groupBy("src")).applyInArrow(settle, schema)
