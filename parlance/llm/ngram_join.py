"""N-gram Jaccard join: count-vector R-trees over hashed groups of shingles.

Each document's distinct shingles are hashed into GROUPS groups (more for long texts); the numbers
in the groups are a point.  Two documents can share no more shingles than the sum of the lesser of
their numbers in each group, and two boxes of an R-tree no more than the sum of the lesser of their
upper corners.  Pairs whose bound falls short of what the threshold needs are cut off, box by box.

One tree over everything would hold all documents in one place, so there is a tree for each set
of documents that can hold a pair at all.  In a fixed order of shingles (frequent ones last), two
linked documents share one of their first n - ceil(t n) + 1.  Documents that have such a shingle
in common make a set; shingles that name the same set are one, and a large set is dealt out in
tiles that together hold each of its pairs.  Documents with equal shingles are one point.

Pairs are never rows.  Of the pairs that a tree leaves, each set tells a spanning forest, and so
linked documents come to stand in one candidate component.  A component is dealt into blocks, any
two of which make a tile; there all pairs are verified with the shingles, by counting what they
share for all members at once, and each member gets its number of links and the least member that
it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.components import components, roots
from parlance.llm.frames import blocks_and_buckets, documents, flat, ids_of, shared, slices
from parlance.llm.words import mix, word_hashes

WORDS = 5
#: The threshold in hundredths.
PERCENT = 80
#: Groups of a short text's vector; long texts have about one for GROUP_SHINGLES shingles.
GROUPS, GROUP_SHINGLES = 128, 8
LEAF = 32
#: Shingles that at least so many documents of one slice hold count as frequent; so many of the most frequent are ordered last.
SLICE_FREQUENT, FREQUENT = 2, 100_000
#: A set of more than twice as many documents is dealt out in tiles of two parts of about so many.
TILE = 512
#: Members and shingles in a block of a component; pairs are verified for two blocks at a time.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles that so many members hold, or more, are counted by a product of matrices, the others pair by pair.
DENSE = 12
#: Document numbers, of some 60 bytes each, that are sent to every executor to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted within each, and the bounds of the rows among them."""
    hashes, row = word_hashes(data, bounds)
    rows = len(bounds) - 1
    count = np.bincount(row, minlength=rows)
    begin = np.cumsum(count) - count
    number = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    to = np.cumsum(number)
    out = np.zeros(int(to[-1]) if rows else 0, np.uint64)
    at = np.repeat(begin - (to - number), number) + np.arange(len(out))
    width = np.repeat(np.minimum(count, WORDS), number)
    for k in range(WORDS):
        some = width > k
        out[some] = out[some] * _STEP + hashes[at[some] + k]
    out = mix(out + width.astype(np.uint64))
    edges = np.r_[0, to]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        out[a:b].sort()
    owner = np.repeat(np.arange(rows), number)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.r_[0, np.cumsum(np.bincount(owner[keep], minlength=rows))].astype(np.int64)


def count_vector(sets: np.ndarray) -> bytes:
    """Numbers in GROUPS groups or more, a power of two; neighbouring groups add up to coarser ones."""
    bits = min(16, max(GROUPS.bit_length() - 1, int(len(sets) // GROUP_SHINGLES).bit_length()))
    found = np.bincount((sets >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    kind = np.uint8 if found.max(initial=0) < 1 << 8 else np.uint32
    return bytes([kind().itemsize]) + found.astype(kind).tobytes()


def _counts(value: bytes, groups: int = 0) -> np.ndarray:
    counts = np.frombuffer(value, np.uint8 if value[0] == 1 else np.uint32, offset=1).astype(np.int32)
    return counts.reshape(groups, -1).sum(axis=1) if groups else counts


def _digests(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        sums = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(mix(sets ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[edges[1:]] - sums[edges[:-1]]).astype(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame) -> DataFrame:
    """A row for each document: a hash of its text, its number of shingles, two digests of the set and the count vector; and rows of locally frequent shingles (doc_id null, d1 the shingle, n its number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, times, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        more: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["doc_id", "n", "d1", "d2", "vector", "text_hash"]

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            every, which = np.unique(np.concatenate([shingle, *(m[0] for m in more)]), return_inverse=True)
            number = np.bincount(which, np.concatenate([times, *(m[1] for m in more)]), minlength=len(every)).astype(np.int64)
            most = np.argsort(-number, kind="stable")[:FREQUENT]
            return every[most], number[most]

        for batch in batches:
            data, bounds = flat(batch.column("text"))
            ids = ids_of(batch)
            for a, b in slices(bounds):
                sets, edges = shingle_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                d1, d2 = _digests(sets, edges)
                vectors = [count_vector(sets[x:y]) for x, y in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(np.diff(edges)), pa.array(d1), pa.array(d2), pa.array(vectors, pa.binary()), batch.column("text_hash").slice(a, b - a)], names=names)
                found, n = np.unique(sets, return_counts=True)
                more.append((found[n >= SLICE_FREQUENT], n[n >= SLICE_FREQUENT]))
                waiting += len(more[-1][0])
                if waiting > 4 * FREQUENT:
                    (shingle, times), more, waiting = gathered(), [], 0
        shingle, times = gathered()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(shingle), pa.int64()), pa.array(times), pa.array(shingle.astype(np.int64)), pa.nulls(len(shingle), pa.int64()), pa.nulls(len(shingle), pa.binary()), pa.nulls(len(shingle), pa.int64())], names=names)

    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(run, "doc_id long, n long, d1 long, d2 long, vector binary, text_hash long")


def text_hash() -> Column:
    """What tells apart the texts of one doc_id."""
    return F.xxhash64(F.col("text").cast("string"))


def _needed(n: np.ndarray) -> np.ndarray:
    """Shingles at the front of a set of n of which one at least is shared with each linked set."""
    return n - -(-PERCENT * n // 100) + 1


def postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """bucket, payload: first shingles of the documents' sets with the digest of each set; a payload for each bucket and run of text."""
    known, times = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, size = [], [], 0

        def out() -> pa.RecordBatch:
            token, node = np.concatenate(tokens), np.concatenate(nodes)
            order = np.lexsort((node, token))
            token, node = token[order], node[order]
            keep = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])] if len(token) else np.zeros(0, bool)
            token, node = token[keep], node[keep]
            dest = ((token >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(dest, kind="stable")
            cut = np.searchsorted(dest[order], np.arange(buckets + 1))
            full = [k for k in range(buckets) if cut[k] < cut[k + 1]]
            payload = [token[order[cut[k] : cut[k + 1]]].tobytes() + node[order[cut[k] : cut[k + 1]]].tobytes() for k in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(payload, pa.binary())], names=["bucket", "payload"])

        for batch in batches:
            data, bounds = flat(batch.column("text"))
            for a, b in slices(bounds):
                sets, edges = shingle_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                digest, _ = _digests(sets, edges)
                at = np.minimum(np.searchsorted(known, sets), max(0, len(known) - 1))
                rare = known[at] != sets if len(known) else np.ones(len(sets), bool)
                weight = np.where(rare, 0, times[at]) if len(known) else np.zeros(len(sets), np.int64)
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    s, w = sets[edges[k] : edges[k + 1]], weight[edges[k] : edges[k + 1]]
                    front = int(_needed(np.int64(len(s))))
                    if w.any():
                        order = np.lexsort((s, w))[:front]
                        s, w = s[order], w[order]
                    else:
                        s, w = s[:front], w[:front]
                    tokens.append(s), nodes.append(np.full(len(s), digest[k]))
                size += int(edges[-1])
                if size > 2_000_000:
                    yield out()
                    tokens, nodes, size = [], [], 0
        if tokens:
            yield out()

    return docs.mapInArrow(run, "bucket int, payload binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of documents that have a first shingle of this bucket in common, named by a hash of what they hold; large ones as tiles."""
    raw = [np.frombuffer(p, np.uint64) for batch in batches for p in batch.column(1).to_pylist()]
    token = np.concatenate([np.zeros(0, np.uint64), *(r[: len(r) // 2] for r in raw)])
    node = np.concatenate([np.zeros(0, np.uint64), *(r[len(r) // 2 :] for r in raw)])
    del raw
    order = np.argsort(token)
    token, node = token[order], node[order]
    same = token[1:] == token[:-1]
    alone = np.r_[True, ~same] & np.r_[~same, True] if len(token) else np.zeros(0, bool)
    token, node = token[~alone], node[~alone]
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    keep = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])] if len(token) else np.zeros(0, bool)
    token, node = token[keep], node[keep]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    number = np.diff(np.r_[first, len(token)])
    name = mix(np.add.reduceat(mix(node), first) + number.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    _, once = np.unique(name, return_index=True)
    once = once[number[once] > 1]
    for small in range(0, len(once), 4096):
        some = once[small : small + 4096]
        some = some[number[some] <= 2 * TILE]
        rows = np.repeat(first[some] - (np.cumsum(number[some]) - number[some]), number[some]) + np.arange(number[some].sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name[some], number[some]).astype(np.int64)), pa.array(node[rows].astype(np.int64))], names=["set", "d1"])
    for k in once[number[once] > 2 * TILE].tolist():
        side = int(-(-number[k] // TILE))
        members = node[first[k] : first[k] + number[k]]
        mine = (mix(members + np.uint64(1)) % np.uint64(side)).astype(np.int64)
        for other in range(side):
            tiles = mix(name[k] + mix((np.minimum(other, mine) * side + np.maximum(other, mine) + 1).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(tiles.astype(np.int64)), pa.array(members.astype(np.int64))], names=["set", "d1"])


class CountTree:
    """R-tree over count vectors: points in order of size, LEAF to a box, boxes LEAF to a box above."""

    def __init__(self, size: np.ndarray, counts: np.ndarray):
        order = np.lexsort((counts.argmax(axis=1), size))
        self.order, self.size, self.counts = order, size[order], counts[order]
        self.levels = [(self.counts, self.size, self.size)]
        while len(self.levels[-1][0]) > LEAF:
            upper, least, most = self.levels[-1]
            first = np.arange(0, len(upper), LEAF)
            self.levels.append((np.maximum.reduceat(upper, first, axis=0), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places (in the given order) of the pairs that the bound leaves, and their bounds."""
        n = len(self.levels[-1][0])
        todo = [(len(self.levels) - 1, np.arange(n), np.arange(n), True)]
        while todo:
            level, a, b, same = todo.pop()
            upper, least, most = self.levels[level]
            bound = np.minimum(upper[a][:, None, :], upper[b][None, :, :]).sum(axis=2)
            fits = (100 + PERCENT) * bound >= PERCENT * (least[a][:, None] + least[b][None, :])
            fits &= (100 * most[b][None, :] >= PERCENT * least[a][:, None]) & (100 * most[a][:, None] >= PERCENT * least[b][None, :])
            if same:
                fits &= a[:, None] <= b[None, :] if level else a[:, None] < b[None, :]
            x, y = np.nonzero(fits)
            if not level:
                yield self.order[a[x]], self.order[b[y]], bound[x, y] / np.maximum(self.size[a[x]] + self.size[b[y]], 1)
                continue
            n = len(self.levels[level - 1][0])
            for i, j in zip(a[x].tolist(), b[y].tolist()):
                todo.append((level - 1, np.arange(i * LEAF, min(n, (i + 1) * LEAF)), np.arange(j * LEAF, min(n, (j + 1) * LEAF)), i == j))


class Points:
    """Members of sets: their sizes and vectors; pairs are places."""

    def __init__(self, size: np.ndarray, vectors: list[bytes]):
        self.size, self.vectors = size, vectors
        self.counts = np.stack([_counts(v, GROUPS) for v in vectors]).astype(np.uint16)
        self.groups = np.array([(len(v) - 1) // v[0] for v in vectors])

    def enough(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs can be linked, by vectors as fine as both have."""
        keep = (100 * self.size[a] >= PERCENT * self.size[b]) & (100 * self.size[b] >= PERCENT * self.size[a])
        fine = np.minimum(self.groups[a], self.groups[b])
        for groups in np.unique(fine).tolist():
            some = np.flatnonzero(keep & (fine == groups))
            ends, at = np.unique(np.concatenate([a[some], b[some]]), return_inverse=True)
            counts = self.counts[ends] if groups == GROUPS else np.stack([_counts(self.vectors[k], groups) for k in ends.tolist()]) if len(ends) else self.counts[:0]
            step = max(1, (1 << 21) // groups)
            for k in range(0, len(some), step):
                part = some[k : k + step]
                bound = np.minimum(counts[at[k : k + len(part)]], counts[at[len(some) + k : len(some) + k + len(part)]]).sum(axis=1, dtype=np.int64)
                keep[part] = (100 + PERCENT) * bound >= PERCENT * (self.size[a[part]] + self.size[b[part]])
        return keep

    def forest(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Links that span what pairs of the set from ``low`` to ``high`` connect."""
        own = np.arange(low, high)
        label = own.copy()
        x, y, waiting = [], [], 0

        def settled() -> None:
            a, b = np.concatenate(x), np.concatenate(y)
            apart = label[a - low] != label[b - low]
            a, b = a[apart], b[apart]
            keep = np.minimum(self.groups[a], self.groups[b]) == GROUPS  # the tree's bound is all there is
            keep[~keep] = self.enough(a[~keep], b[~keep])
            held = np.flatnonzero(label != own)
            nodes, least = roots(np.concatenate([own[held], a[keep]]), np.concatenate([label[held], b[keep]]))
            label[nodes - low] = least

        for a, b, _ in CountTree(self.size[low:high], self.counts[low:high]).pairs():
            x.append(a + low), y.append(b + low)
            waiting += len(a)
            if waiting > 1 << 16:
                settled()
                x, y, waiting = [], [], 0
        if waiting:
            settled()
        held = np.flatnonzero(label != own)
        return own[held], label[held]


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs that the bound leaves in each set, whose rows stand together."""

    def done(t: pa.Table) -> pa.RecordBatch:
        name, node = t.column("set").to_numpy(), t.column("d1").to_numpy()
        points = Points(t.column("n").to_numpy(), t.column("vector").to_pylist())
        edges = np.flatnonzero(np.r_[True, name[1:] != name[:-1], True])
        first, number = edges[:-1], np.diff(edges)
        pairs = first[number == 2]
        pairs = pairs[points.enough(pairs, pairs + 1)]
        found = [(pairs, pairs + 1)] + [points.forest(a, a + n) for a, n in zip(first[number > 2].tolist(), number[number > 2].tolist())]
        a, b = (node[np.concatenate([f[k] for f in found])] for k in (0, 1))
        links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], names=["a", "b"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, t]) if rest is not None else t
        name = rest.column("set").to_numpy()
        last = int(np.flatnonzero(np.r_[True, name[1:] != name[:-1]])[-1]) if len(name) else 0
        if last:
            yield done(rest.slice(0, last))
            rest = rest.slice(last)
    if rest is not None and len(rest):
        yield done(rest)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles any two of the sets share, as a square."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    number = np.diff(np.r_[first, len(every)])
    out = np.zeros(m * m, np.int64)
    for n in range(2, DENSE):
        some = first[number == n]
        for k in range(0, len(some), 1 << 16):
            held = owner[some[k : k + (1 << 16), None] + np.arange(n)]
            x, y = np.triu_indices(n, 1)
            out += np.bincount((held[:, x] * m + held[:, y]).ravel(), minlength=m * m)
    out = out.reshape(m, m)
    some, n = first[number >= DENSE], number[number >= DENSE]
    for k in range(0, len(some), 4096):
        width = n[k : k + 4096]
        at = np.repeat(some[k : k + 4096] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        held = np.zeros((m, len(width)), np.float32)
        held[owner[at], np.repeat(np.arange(len(width)), width)] = 1
        out += np.triu(held @ held.T, 1).astype(np.int64)
    return out + out.T


def tile_links(sets: list[np.ndarray], half: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of a tile: of all members, or between its halves only."""
    size = np.array([len(s) for s in sets], np.int64)
    common = shared_counts(sets)
    linked = 100 * common >= PERCENT * (size[:, None] + size[None, :] - common)
    linked &= (np.arange(len(sets))[:, None] < np.arange(len(sets))[None, :]) if same else (half[:, None] < half[None, :])
    return np.nonzero(linked)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile, whose rows stand together: the members that have links, how many, and the least member that each reaches."""

    def done(t: pa.Table) -> pa.RecordBatch:
        tile = t.column("tile").to_numpy()
        d1, rep, weight, half = (t.column(c).to_numpy() for c in ("d1", "rep", "weight", "half"))
        same, values = t.column("same").to_numpy(), t.column("value").to_pylist()
        edges = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            _, once = np.unique(d1[a:b], return_index=True)  # repeated rows
            once += a
            if len(once) < 2:
                continue
            x, y = tile_links([np.frombuffer(values[k], np.uint64) for k in once.tolist()], half[once], bool(same[a]))
            links = np.bincount(x, weight[once[y]], len(once)) + np.bincount(y, weight[once[x]], len(once))
            nodes, least = roots(rep[once[x]], rep[once[y]])
            some = once[links > 0]
            out.append((d1[some], links[links > 0].astype(np.int64), rep[some], least[np.searchsorted(nodes, rep[some])]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(4)], names=["d1", "links", "rep", "root"])

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, t]) if rest is not None else t
        tile = rest.column("tile").to_numpy()
        last = int(np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])[-1]) if len(tile) else 0
        if last:
            yield done(rest.slice(0, last))
            rest = rest.slice(last)
    if rest is not None and len(rest):
        yield done(rest)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text, with its other columns; of texts under one doc_id the one that is meant."""
    for batch in batches:
        data, bounds = flat(batch.column("text"))
        rest = batch.drop_columns(["text"])
        for a, b in slices(bounds):
            sets, edges = shingle_sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            part = rest.slice(a, b - a)
            meant = pa.array(_digests(sets, edges)[0] == part.column("d1").to_numpy())
            value = pa.array([sets[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, value], names=[*part.schema.names, "value"]).filter(meant)


def _tiles(docs: DataFrame, reps: DataFrame, near: DataFrame, buckets: int) -> DataFrame:
    """d1, links, rep, root of the members of all candidate components, from every tile in which they have links."""
    comp = components(near).checkpoint()
    comp = comp.union(comp.select("root", "root").distinct()).toDF("d1", "component")
    placed = comp.join(reps.select("d1", "rep", "weight", "n"), "d1")
    sizes = placed.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = placed.join(sizes, "component").select("d1", "rep", "weight", "component", "blocks").checkpoint()
    asked = placed.withColumnRenamed("rep", "doc_id")
    picked = docs.join(F.broadcast(asked) if placed.count() <= BROADCAST_IDS else asked, "doc_id")
    values = picked.mapInArrow(_values, "doc_id long, d1 long, weight long, component long, blocks long, value binary")
    mine, other = F.pmod(F.xxhash64("d1"), F.col("blocks")), F.col("other")
    dealt = values.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.xxhash64("component", F.least("mine", other), F.greatest("mine", other)).alias("tile")
    dealt = dealt.select(tile, "d1", F.col("doc_id").alias("rep"), "weight", (F.col("mine") > other).cast("int").alias("half"), (F.col("mine") == other).alias("same"), "value")
    # Of a tile within one block every row says so; of a tile between two the lesser block is its first half.
    return dealt.repartition(buckets, "tile").sortWithinPartitions("tile").mapInArrow(_verified, "d1 long, links long, rep long, root long")


def _one_document(texts: DataFrame) -> DataFrame:
    """text_id, doc_id of every text of the documents that have several: what one of them reaches, all reach."""
    several = texts.groupBy("doc_id").agg(F.min("text_id").alias("least"), F.max("text_id").alias("most")).where("least <> most").select("doc_id")
    return texts.join(several, "doc_id").select("text_id", "doc_id").distinct()


def similar_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id, text_id, text_hash of every row of docs.

    A link needs 100 |A and B| >= 80 |A or B| of the sets of five-word shingles; a text of fewer
    words is one shingle, and null, empty and wordless texts have none and link with nothing.
    n_links is the number of other rows that a row is linked with, copies too; component_id is
    the smallest doc_id reachable, where different texts under one doc_id count as linked, being one
    document; text_id is the smallest doc_id reachable from the row's own text by links alone, and
    ``text_hash`` tells which text that is.  Repeated rows each give a row; rows without a doc_id are
    left out.  Shingles are compared by 64-bit fingerprints.
    """
    spark = docs.sparkSession
    shared(spark)
    docs = documents(docs)
    _, buckets = blocks_and_buckets(docs)
    found = signatures(docs).checkpoint()
    top = found.where("doc_id is null").groupBy(F.col("d1").alias("shingle")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    known, times = top.column("shingle").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(known)
    sig = found.where("doc_id is not null").select("doc_id", "n", "d1", "d2", "text_hash")
    some = found.where("doc_id is not null and n > 0")
    reps = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("vector").alias("vector")).checkpoint()
    sets = postings(docs, (known[order], times[order]), buckets).repartitionById(buckets, "bucket").mapInArrow(_sets, "set long, d1 long").distinct()
    rows = sets.join(reps.select("d1", "n", "vector"), "d1").select("set", "d1", "n", "vector")
    near = rows.repartition(buckets, "set").sortWithinPartitions("set", "d1").mapInArrow(_connected, "a long, b long")
    links = _tiles(docs, reps, near, buckets).checkpoint()
    comp = components(links.select("rep", "root")).withColumnRenamed("node", "rep")
    number = links.groupBy("d1").agg(F.sum("links").alias("links"))
    named = reps.select("d1", "d2", "rep", "weight").join(number, "d1", "left").join(comp, "rep", "left")
    any_ = F.col("n") > 0
    keyed = sig.join(named, ["d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(any_, F.coalesce("links", F.lit(0)) + F.col("weight") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(any_, F.coalesce("root", "rep")).otherwise(F.col("doc_id")).alias("text_id"), "text_hash",
    ).checkpoint()
    joined = components(_one_document(keyed.where("n_shingles > 0"))).toDF("text_id", "component_id")
    whole = keyed.join(joined, "text_id", "left")
    return whole.select("doc_id", "n_shingles", "n_links", F.coalesce("component_id", "text_id").alias("component_id"), "text_id", "text_hash")


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs, as in ``similar_links``."""
    return similar_links(docs).select("doc_id", "n_shingles", "component_id")
