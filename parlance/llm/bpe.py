"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each leaf of the tree holds the rank of the pair that starts at a symbol, each inner node the
least of its two children, left first; so the root names the leftmost pair of the lowest rank.
A merge changes at most three leaves, each in a number of steps logarithmic in the word's
length, and merging goes on until the root holds no rank.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.frames import documents, flat, slices

#: Bytes of remembered words that a worker holds, at about ENTRY_BYTES for an entry beside its strings; the cache starts anew beyond it.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 480
#: Words longer than this, in bytes, are encoded alone and each time, so that the cache's memory is bounded too.
LONG_WORD = 64
#: Bytes of text whose unknown words are merged together; longer texts are taken in pieces of about so many characters.
GROUP_BYTES = 1 << 19
#: Symbols that are merged at a time.
MERGE_SYMBOLS = 1 << 19

_NONE = 1 << 62
_NO_RANK = 1 << 40
_NO_LEAF = _NO_RANK * 256


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in Latin-1, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class PairTree:
    """Segment tree of pair ranks; the order is rank first, then position."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        size = self.size
        tree = [_NONE] * (2 * size)
        for k, rank in enumerate(ranks):
            if rank < _NONE:
                tree[size + k] = (rank << 32) | k
        for k in range(size - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left <= right else right
        self.tree = tree

    def least(self) -> int:
        """Position of the leftmost pair of the lowest rank, or -1."""
        top = self.tree[1]
        return -1 if top >= _NONE else top & 0xFFFFFFFF

    def put(self, k: int, rank: int) -> None:
        tree = self.tree
        at = self.size + k
        tree[at] = _NONE if rank >= _NONE else (rank << 32) | k
        at >>= 1
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            least = left if left <= right else right
            if tree[at] == least:
                return
            tree[at] = least
            at >>= 1


class Codec:
    """Encoder and decoder for a vocabulary file of byte-level BPE with word ends; one per worker process."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = _byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.tokens.update({i: t for t, i in self.special.items()})
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        # Up to here Python's tables of letters, digits and cases are the library's, and no characters combine.
        self.beyond = regex.compile("[^\u0000-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
        self.cut = regex.compile("(?<=[a-z0-9A-Z]) (?=[a-z0-9A-Z])")
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.names = {i: str(i) for i in self.tokens}
        self.known_ids: dict[str, str] = {}
        self.known_tokens: dict[str, str] = {}
        self.held = 0
        order = sorted(self.merges)
        self.pair_keys = np.array([(a << 20) | b for a, b in order], np.int64)
        self.pair_ranks = np.array([self.merges[p][0] for p in order], np.int64)
        self.pair_ids = np.array([self.merges[p][1] for p in order], np.int64)
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if not word:
            return []
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        n, merges = len(ids), self.merges
        if n == 1:
            return ids
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        none = (_NONE, -1)
        tree = PairTree([merges.get(p, none)[0] for p in zip(ids, ids[1:])])
        while (k := tree.least()) >= 0:
            gone = right[k]
            ids[k] = merges[ids[k], ids[gone]][1]
            ids[gone] = -1
            after = right[k] = right[gone]
            if gone < n - 1:
                tree.put(gone, _NONE)
            if after < n:
                left[after] = k
                tree.put(k, merges.get((ids[k], ids[after]), none)[0])
            else:
                tree.put(k, _NONE)
            before = left[k]
            if before >= 0:
                tree.put(before, merges.get((ids[before], ids[k]), none)[0])
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """The ids of many words of at most LONG_WORD bytes: the same trees, one in each row of an array, stepped together."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        size = 2
        while size <= LONG_WORD:
            rows = np.flatnonzero((lengths <= size) & (lengths > (size // 2 if size > 2 else 0)))
            step = MERGE_SYMBOLS // size
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                ids, alive = self._merge_rows([words[i] for i in some], lengths[some], size)
                flat, ends = ids[alive].tolist(), np.cumsum(alive.sum(axis=1)).tolist()
                begin = 0
                for i, end in zip(some.tolist(), ends):
                    out[i] = flat[begin:end]
                    begin = end
            size *= 2
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair among the sorted pairs, and its rank (_NO_RANK: none)."""
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return at, np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], _NO_RANK)

    def _merge_rows(self, words: list[bytes], lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(words)
        text = np.frombuffer(b"".join([w.ljust(size, b"\0") for w in words]), np.uint8).reshape(n, size)
        place = np.arange(size)
        ids = np.where(place < lengths[:, None] - 1, self.inner_ids[text], self.last_ids[text])
        ids[place >= lengths[:, None]] = -1
        right = np.where(place + 1 < lengths[:, None], place + 1, size)
        left = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), _NO_RANK, np.int64)
        tree[:, size : 2 * size - 1] = self._ranks(ids[:, :-1], ids[:, 1:])[1]
        tree[:, size:] = np.where(tree[:, size:] < _NO_RANK, tree[:, size:] * 256 + place, _NO_LEAF)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(r: np.ndarray, k: np.ndarray, rank: np.ndarray) -> None:
            at = k + size
            tree[r, at] = np.where(rank < _NO_RANK, rank * 256 + k, _NO_LEAF)
            while at.size and size > 1 and at[0] > 1:
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        while (r := np.flatnonzero(tree[:, 1] < _NO_LEAF)).size:
            k = tree[r, 1] & 255
            gone = right[r, k]
            ids[r, k] = self.pair_ids[self._ranks(ids[r, k], ids[r, gone])[0]]
            ids[r, gone] = -1
            after = right[r, gone]
            right[r, k] = after
            put(r, gone, np.full(len(r), _NO_RANK))
            more = after < size
            left[r[more], after[more]] = k[more]
            follows = np.where(more, ids[r, np.minimum(after, size - 1)], -1)
            put(r, k, self._ranks(ids[r, k], follows)[1])
            has = left[r, k] >= 0
            rb, before = r[has], left[r, k][has]
            put(rb, before, self._ranks(ids[rb, before], ids[rb, k[has]])[1])
        return ids, ids >= 0

    def learn(self, words: set[str]) -> None:
        """Put words into the cache: their ids, and their tokens, joined by spaces."""
        new = list(words.difference(self.known_ids))
        if self.held > CACHE_BYTES:
            self.known_ids, self.known_tokens, self.held = {}, {}, 0
            new = list(words)
        data = [w.encode("utf-8", "replace") for w in new]
        short = [i for i, d in enumerate(data) if len(d) <= LONG_WORD]
        names, tokens = self.names, self.tokens
        for i, ids in zip(short, self.merge_all([data[i] for i in short])):
            word, name, token = new[i], " ".join([names[t] for t in ids]), " ".join([tokens[t] for t in ids])
            self.known_ids[word], self.known_tokens[word] = name, token
            self.held += len(data[i]) + len(name) + len(token) + ENTRY_BYTES

    def words_of(self, text: str) -> list[str]:
        """Words of a text without special strings, composed and lower-cased.

        Versions of Unicode differ in marks, cases and letters, so beyond the range in which they
        agree the library's own normalizer and splitter are asked.
        """
        if self.beyond.search(text) is None:
            return self.words.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> Iterator[str]:
        """A long text in pieces, cut at spaces between ASCII letters and digits, where neither words nor special strings nor marks can cross."""
        at = 0
        while len(text) - at > GROUP_BYTES and (m := self.cut.search(text, at + GROUP_BYTES)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:] if at else text

    def split(self, text: str) -> list[tuple[bool, str]]:
        """Words and special strings of a text, in order; the flag marks special strings."""
        out: list[tuple[bool, str]] = []
        at = 0
        for m in self.specials.finditer(text) if self.special else ():
            out += [(False, w) for w in self.words_of(text[at : m.start()])] + [(True, m[0])]
            at = m.end()
        return out + [(False, w) for w in self.words_of(text[at:] if at else text)]

    def group(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids and its tokens, both joined by spaces."""
        rare = {k: self.split(t) for k, t in enumerate(texts) if self.special and self.specials.search(t)}
        words = [[w for special, w in rare[k] if not special] if k in rare else self.words_of(t) for k, t in enumerate(texts)]
        self.learn(set().union(*words))
        ids, tokens = self.known_ids, self.known_tokens
        for k, found in enumerate(words):
            if k not in rare and max(map(len, found), default=0) * 4 <= LONG_WORD:
                yield " ".join(map(ids.__getitem__, found)), " ".join(map(tokens.__getitem__, found))
                continue
            both = []
            for special, w in rare.get(k) or [(False, w) for w in found]:
                if special:
                    both.append((self.names[self.special[w]], w))
                elif w in ids:
                    both.append((ids[w], tokens[w]))
                else:
                    long = self.merge(w.encode("utf-8", "replace"))
                    both.append((" ".join([self.names[i] for i in long]), " ".join([self.tokens[i] for i in long])))
            yield " ".join([b[0] for b in both]), " ".join([b[1] for b in both])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.group([text]))[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens are joined by a space; ids that it doesn't hold are passed over."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    return _CODECS.get(path) or _CODECS.setdefault(path, Codec(path))


def _encoded(coder: Codec, ids: pa.Array, texts: list[str], out: tuple[str, ...]) -> pa.RecordBatch:
    """The rows of a slice; text by text, so that beside what is returned only one piece's ids and tokens are held."""
    short = coder.group([t for t in texts if len(t) <= GROUP_BYTES])
    number, digests, decoded_digests, numbers, decoded = [], [], [], [], []
    for t in texts:
        name, token, n, parts, before = hashlib.sha256(), hashlib.sha256(), 0, [], b""
        for some in [next(short)] if len(t) <= GROUP_BYTES else (next(coder.group([p])) for p in coder.pieces(t)):
            if not some[0]:
                continue
            name.update(before + some[0].encode())
            token.update(before + some[1].encode())
            n, before = n + some[0].count(" ") + 1, b" "
            if "ids" in out:
                numbers.append(np.fromstring(some[0], np.int32, sep=" "))
            if "decoded" in out:
                parts.append(some[1])
        number.append(n), digests.append(name.hexdigest()), decoded_digests.append(token.hexdigest()), decoded.append(" ".join(parts))
    columns = {"doc_id": ids, "n_tokens": pa.array(number, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded_digests, pa.string())}
    if "ids" in out:
        ends = np.cumsum([0, *number]).astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int32)))
    if "decoded" in out:
        columns["decoded"] = pa.array(decoded, pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def round_trip(docs: DataFrame, path: str, out: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs; also ids and decoded, as ``out`` names them.

    Null and empty texts have no tokens and the digests of empty strings; repeated rows each give
    a row, rows without a doc_id too; an empty table gives an empty result; other columns are not
    read.  Long texts are taken in pieces, cut between words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            _, bounds = flat(batch.column(1))
            for a, b in slices(bounds, GROUP_BYTES):
                yield _encoded(coder, batch.column(0).slice(a, b - a), [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if "ids" in out else "") + (", decoded string" if "decoded" in out else "")
    return documents(docs, unnamed=True).mapInArrow(run, schema)
