"""Each operator on odd texts, against brute force or the library it must equal."""

import hashlib
import re
import zlib

import pytest
from llm_cases import odd_rows, prose
from pyspark.sql import functions as F

from parlance.llm import bpe, decontaminate, language, licenses, lm_scoring, ngram_join, suffix_dedup, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = {r[0]: r[1] for r in odd_rows()}
low = lambda s: s.translate({c: c + 32 for c in range(65, 91)})


def tokenizer_file(name):
    return pytest.importorskip("public_tokenizers").path(name)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_suffix_array_is_sorted():
    import random

    import numpy as np

    from parlance.llm.suffix_array import suffix_array

    rng = random.Random(1)
    for _ in range(200):
        x = np.array([rng.randrange(1, rng.choice([2, 3, 9])) for _ in range(rng.randrange(60))], np.int64)
        assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def removed_by_hand(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        strings = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = bytearray(len(b))
        for k, s in enumerate(strings):
            if s in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(strings)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(odd, none, clashing, monkeypatch):
    want = removed_by_hand(TEXTS)
    got = {i: tuple(r)[1:5] for i, r in by_id(suffix_dedup.remove_repeats(odd)).items()}
    assert got == want
    again = suffix_dedup.remove_repeats(clashing, text=True).collect()
    assert len(again) == len(TEXTS) + 2 and {tuple(r)[:5] for r in again} == {(i, *v) for i, v in want.items()}
    assert suffix_dedup.remove_repeats(none).count() == 0


def removed_in_blocks(texts, blocks, buckets=3):
    """The rounds by hand, in this process, so that patched limits hold: removed bytes of each document."""
    import pyarrow as pa

    import parlance.llm.suffix_dedup as m

    least = {}
    for i, t in sorted(texts.items()):
        least.setdefault(hashlib.sha256((t or "").encode()).digest(), i)
    nothing, out = m._messages([]), {}
    own = []
    for k in range(blocks):
        ids = [i for i in texts if i % blocks == k]
        rows = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([texts[i] for i in ids], pa.string()), "digest": pa.array([hashlib.sha256((texts[i] or "").encode()).digest() for i in ids], pa.binary())})
        own.append(pa.Table.from_batches(list(m._sampled(iter([rows])))))
    copies = [(k, 0, m._COPY, d + str(i).encode()) for k in range(blocks) for d, i in least.items()]

    def asked(messages):
        return pa.concat_tables([nothing, *(m._answered(messages.filter(pa.compute.equal(messages.column("dest"), d))) for d in range(buckets))])

    def of(messages, k):
        return messages.filter(pa.compute.equal(messages.column("src"), k))

    more = m._messages(copies)
    more = pa.concat_tables([more, asked(m._messages([(k, *x) for k in range(blocks) for x in m.Block(own[k], of(more, k), buckets).asks_names()]))])
    told = []
    for k in range(blocks):
        b = m.Block(own[k], of(more, k), buckets)
        b.learn(of(more, k))
        told += [(k, *x) for x in b.asks_strings()]
    more = pa.concat_tables([more, asked(m._messages(told))])
    for k in range(blocks):
        b = m.Block(own[k], of(more, k), buckets)
        b.learn(of(more, k))
        gone = b.removed(of(more, k))
        out |= {i: int(gone[s:e].sum()) for i, s, e in zip(b.ids.tolist(), b.bounds[:-1], b.bounds[1:])}
    return out


def shared_lines():
    import random

    rng = random.Random(6)
    line, tail = prose(rng, 30), prose(rng, 25)
    return {k: prose(rng, rng.randrange(30)) + " " + line + prose(rng, rng.randrange(20)) + (tail if k % 3 else "") for k in range(40)}


@pytest.mark.parametrize("heavy", [1, 3, 4096])
def test_suffix_dedup_heavy_samples(monkeypatch, heavy):
    """Whether strings are dealt singly or searched by suffix arrays, and however texts are dealt to blocks, the same bytes go."""
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    for texts in (TEXTS, shared_lines()):
        want = {i: v[1] for i, v in removed_by_hand(texts).items()}
        for blocks in (1, 2, 5):
            assert removed_in_blocks(texts, blocks) == want


def test_samples_of_long_texts(monkeypatch):
    """Slices don't show: a long text has the same samples, one at least in each string of the length that counts."""
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    bounds = np.array([0, 0, 10, 60, 60, 4000, 4049, 4100, 5000])
    whole = suffix_dedup.sample_places(data, bounds)
    for size in (64, 100, 999):
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", size)
        assert suffix_dedup.sample_places(data, bounds).tolist() == whole.tolist()
    for a, b in zip(bounds, bounds[1:]):
        assert all(((whole >= k) & (whole <= k + 30)).any() for k in range(a, b - 49))
        assert b - a >= 50 or not ((whole >= a) & (whole < b)).any()


def test_suffix_dedup_carries_rows(spark, clashing):
    """Other columns, whatever their names, stay with their row, also where rows share a doc_id."""
    text = prose(__import__("random").Random(1), 60)
    docs = spark.createDataFrame([(1, text, "a"), (2, text + "TAIL", "b"), (2, "another", "c"), (None, "x", "d")], "doc_id long, text string, kept string")
    got = suffix_dedup.remove_repeats(docs, text=True, carry=True).collect()
    assert sorted((r["doc_id"], r["kept"], r["rest"]["c2"]) for r in got) == [(1, text, "a"), (2, "TAIL", "b"), (2, "another", "c")]
    assert suffix_dedup.remove_repeats(clashing, carry=True).where("rest.c1 is null").select("doc_id").collect()[0][0] == 0


def contained_by_hand(texts, items, share=0.8):
    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    out = {}
    for i, t in items.items():
        w = words(t)
        k = min(5, len(w))
        mine = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, x in texts.items():
            v = words(x)
            have = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            if mine and len(mine & have) >= share * len(mine) - 1e-9:
                out[d, i] = (len(mine), len(mine & have))
    return out


def test_decontamination(spark, odd, none, clashing):
    items = {0: TEXTS[9], 1: " ".join(TEXTS[10].split()[:40]), 2: "two words", 3: None, 4: "", 5: "nowhere to be found at all", 6: "one"}
    bench = spark.createDataFrame([(k, t, "x") for k, t in items.items()] * 2, "item_id long, text string, doc_id string")
    want = contained_by_hand(TEXTS, items)
    for docs in (odd, clashing):
        got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in decontaminate.contained_items(docs, bench).collect()}
        assert got == want and len(want) > 4
    assert decontaminate.contained_items(none, bench).count() == 0
    assert decontaminate.contained_items(odd, bench.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame([(0, TEXTS[9])], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contained_items(odd, bench).collect()} == {9}


def test_licenses(spark, none):
    rows = [(0, None), (1, ""), (2, "Released under the MIT Licence!"), (3, "words\nCopyright 2020 X\nLicensed under CC BY-NC 4.0\nmore"), (4, "© 2021 Me\nreleased UNDER the MIT license"), (5, "MIT")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows] + [(2, rows[2][1], "z")], "doc_id long, text string, form string")
    got = {r["doc_id"]: (r["license_id"], r["notices"], r["n_notices"]) for r in licenses.license_scan(docs, licenses.known_licenses(spark)).collect()}
    assert got == {0: (None, "", 0), 1: (None, "", 0), 2: ("MIT", "MIT", 1), 3: (None, "CC-BY-NC-4.0", 1), 4: ("MIT", "MIT", 1), 5: (None, "", 0)}
    whole = [(10, "Copyright (c) 2024 A. Person\n" + licenses.KNOWN["MIT"][2].replace(". ", ".\n\n")), (11, licenses.KNOWN["BSD-3-Clause"][1].upper()), (12, licenses.KNOWN["Zlib"][0].replace("acknowledgment", "acknowledgement")), (13, licenses.KNOWN["BSD-2-Clause"][0] + " And more.")]
    more = spark.createDataFrame([(i, t, "z") for i, t in whole], "doc_id long, text string, form string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.license_scan(more, licenses.known_licenses(spark)).collect()} == {10: "MIT", 11: "BSD-3-Clause", 12: "Zlib", 13: None}
    assert licenses.license_scan(none, licenses.known_licenses(spark)).count() == 0


def test_lm_scores(spark, odd, none, clashing):
    import collections
    import math

    got = by_id(lm_scoring.score(odd))
    assert len(got) == len(TEXTS)
    tokens = {i: [*WORD.findall(low(t or "")), None] for i, t in TEXTS.items()}
    train = [i for i in TEXTS if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, i not in train)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i])) < 1e-6
        assert r["score"] < 0
    assert lm_scoring.score(clashing).count() == len(TEXTS) + 2
    assert lm_scoring.score(none).count() == 0


def scores_by_hand(texts, train, depth=5):
    """Context-tree weighting with a dictionary of nodes: contexts of 0 to 5 bytes, and the path through the next byte."""
    import collections
    import math

    def steps(text):
        data = bytes(depth) + (text or "").encode() + b"\0"
        for k in range(depth, len(data)):
            path = 1
            for place in range(8):
                bit = data[k] >> (7 - place) & 1
                yield data[k - depth : k][::-1], path, bit
                path = path * 2 + bit

    counts = collections.defaultdict(lambda: [0, 0])
    for i in train:
        for context, path, bit in steps(texts[i]):
            for d in range(depth + 1):
                counts[context[:d], path][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    own = {node: kt(*n) for node, n in counts.items()}
    products, weighted = collections.defaultdict(float), {}
    for d in range(depth, -1, -1):
        for (context, path), pe in own.items():
            if len(context) == d:
                below = products[context, path]
                top = max(pe, below)
                weighted[context, path] = pe if d == depth else math.log(0.5) + top + math.log(math.exp(pe - top) + math.exp(below - top))
                if d:
                    products[context[:-1], path] += weighted[context, path]
    out = {}
    for i, text in texts.items():
        total = 0.0
        for context, path, bit in steps(text):
            p = 0.5
            for d in range(depth, -1, -1):
                node = context[:d], path
                if node in counts:
                    share = 1.0 if d == depth else 1 / (1 + math.exp(min(700, max(-700, products[node] - own[node]))))
                    p = share * (counts[node][bit] + 0.5) / (sum(counts[node]) + 1) + (1 - share) * p
            total += math.log10(p)
        out[i] = total
    return out


def test_lm_scores_equal_brute_force(spark):
    texts = {i: t and t[:3000] for i, t in TEXTS.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    want = scores_by_hand(texts, train)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(lm_scoring.score(docs))
    assert len(train) < len(texts) and all(abs(got[i]["score"] - want[i]) <= 1e-6 * abs(want[i]) + 1e-6 for i in texts)
    blank = by_id(lm_scoring.score(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")))
    assert all(abs(r["score"] - 8 * (len((texts[i] or "").encode()) + 1) * __import__("math").log10(0.5)) < 1e-3 for i, r in blank.items()) and blank


def groups_by_hand(texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in texts}


def test_ngram_join(spark, odd, none, clashing):
    want = groups_by_hand(TEXTS)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.similar_groups(odd)).items()} == want
    got = ngram_join.similar_groups(clashing).collect()
    assert len(got) == len(TEXTS) + 2 and {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, *v) for i, v in want.items()}
    assert ngram_join.similar_groups(none).count() == 0


def test_ngram_join_group_of_near_copies(spark):
    import random

    rng = random.Random(2)
    base = prose(rng, 100).split()
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.similar_groups(docs)).items()}
    assert got == groups_by_hand(texts)


def test_ngram_join_finds_all_links(spark, odd):
    """A group of near copies, with exact copies among them: every link, not only what holds the group together."""
    import random

    def by_hand(texts):
        sets = {}
        for i, t in texts.items():
            w = WORD.findall(low(t or ""))
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        return {(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}

    rng = random.Random(2)
    base = prose(rng, 100).split()
    texts = {}
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        texts[i] = " ".join(w)
    for docs, texts in ((spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts), (odd, TEXTS)):
        want, groups = by_hand(texts), groups_by_hand(texts)
        rows = ngram_join.similar_links(docs).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == groups
        assert {r["doc_id"]: r["n_links"] for r in rows} == {i: sum(i in p for p in want) for i in texts}


def test_ngram_join_of_texts_that_share_a_doc_id(spark):
    import random

    rng = random.Random(12)
    x, y, z = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(5, x), (5, y), (3, y), (9, x), (9, x), (12, z), (12, ""), (14, z), (15, None)]
    got = ngram_join.similar_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["text_id"], r["n_links"]) for r in got) == sorted([(5, 3, 5, 2), (5, 3, 3, 1), (3, 3, 3, 1), (9, 3, 5, 2), (9, 3, 5, 2), (12, 12, 12, 1), (12, 12, 12, 0), (14, 12, 12, 1), (15, 15, 15, 0)])


def near_sets(n=60):
    import random

    import numpy as np

    rng = random.Random(3)
    base = rng.sample(range(1, 1 << 40), 2000)
    sets = [np.unique(np.array([x if rng.random() > k % 9 / 30 else rng.randrange(1 << 40) for x in base[: 200 + 40 * (k % 3)]], np.uint64)) for k in range(n)]
    return [ngram_join.mix(s) for s in sets] + [ngram_join.mix(np.array(base, np.uint64))]


def test_tiles_hold_each_pair_once(monkeypatch):
    """Verified in one tile or in tiles of blocks, by pairs or by products: the same links, each once."""
    import numpy as np

    sets = [np.sort(s) for s in near_sets()]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert len(want) > 50
    for dense in (2, 12, 1000):
        monkeypatch.setattr(ngram_join, "DENSE", dense)
        x, y = ngram_join.tile_links(sets, np.zeros(len(sets), int), True)
        assert set(zip(x.tolist(), y.tolist())) == want and len(x) == len(want)
        got = []
        for i in range(3):
            for j in range(i, 3):
                some = [k for k in range(len(sets)) if k % 3 in (i, j)]
                x, y = ngram_join.tile_links([sets[k] for k in some], np.array([int(k % 3 == j) for k in some]), i == j)
                got += [tuple(sorted((some[a], some[b]))) for a, b in zip(x.tolist(), y.tolist())]
        assert len(got) == len(want) and set(got) == want


def test_bound_cuts_off_no_link(monkeypatch):
    """The forest of a set connects all that links connect, with boxes of several levels and vectors of several lengths."""
    import numpy as np

    from parlance.llm.components import roots

    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", 1)
    sets = [np.sort(s) for s in near_sets(150)]
    points = ngram_join.Points(np.array([len(s) for s in sets]), [ngram_join.count_vector(s) for s in sets])
    assert len(set(points.groups.tolist())) > 1
    x, y = ngram_join.tile_links(sets, np.zeros(len(sets), int), True)
    assert points.enough(x, y).all()
    nodes, least = roots(*points.forest(0, len(sets)))
    label = np.arange(len(sets))
    label[nodes] = least
    assert (label[x] == label[y]).all()


def test_large_set_is_dealt_out(monkeypatch):
    """Tiles of a large set hold each of its pairs."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "TILE", 7)
    nodes = np.arange(50, dtype=np.uint64) * np.uint64(977)
    payload = np.concatenate([np.full(50, 5, np.uint64), nodes]).tobytes()
    out = pa.Table.from_batches(list(ngram_join._sets(iter([pa.record_batch({"bucket": [0], "payload": [payload]})])))).to_pandas()
    held = {frozenset((a, b)) for _, g in out.groupby("set") for a in g["d1"] for b in g["d1"] if a < b}
    assert len(held) == 50 * 49 // 2 and out.groupby("set").size().max() < 50


def test_token_counts(odd, none, clashing):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {i: (len((t or "").encode()), len(model.encode(t or ""))) for i, t in TEXTS.items()}
    assert {i: (r["n_bytes"], r["n_tokens"]) for i, r in by_id(token_counts.token_counts(odd, path)).items()} == want
    assert token_counts.token_counts(clashing, path).count() == len(TEXTS) + 2
    assert token_counts.token_counts(none, path).count() == 0


def test_bpe(odd, none, clashing):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = by_id(bpe.round_trip(odd, path, out=("ids", "decoded")))
    for i, t in TEXTS.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["ids"], got[i]["n_tokens"], got[i]["decoded"]) == (ids, len(ids), lib.decode(ids, skip_special_tokens=False))
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.round_trip(clashing, path).count() == len(TEXTS) + 2
    assert bpe.round_trip(none, path).count() == 0


def test_bpe_range_of_its_own_tables():
    """Where the library isn't asked, Python's tables say the same; beyond, words are the library's."""
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib, coder = Tokenizer.from_file(path), bpe.Codec(path)
    split = lambda t: [t[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(t)]
    for c in [*range(0x250), *range(0x2010, 0x2060), 0x20AC]:
        for text in (f"x{chr(c)}y", f"1{chr(c)}\u2019{chr(c)}{chr(c)}"):
            assert coder.words_of(text) == split(lib.normalizer.normalize_str(text)), hex(c)
    odd = [0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC, 0x10D50, 0x10D65, 0x1ACD, 0x0F18, 0x03A3, 0x0378, 0x1E6C0, 0x0345, 0x1100, 0x1161, 0x2126, 0xFB01]
    for a in odd:
        for b in odd:
            text = f"a{chr(a)}{chr(b)} \u03a3{chr(b)}{chr(a)}o"
            assert coder.encode(text) == lib.encode(text, add_special_tokens=False).ids, (hex(a), hex(b))


def test_bpe_long_texts(spark, monkeypatch):
    """A text of several pieces, with a special string and a word without end, and a cache that overflows."""
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    lib, coder = Tokenizer.from_file(path), bpe.Codec(path)
    monkeypatch.setattr(bpe, "GROUP_BYTES", 300)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    texts = [" ".join(f"word{k} Caf\u00e9, {k}" for k in range(300)) + " <|endoftext|> tail", "x" * 2000 + " end", "", "short"]
    import pyarrow as pa

    got = bpe._encoded(coder, pa.array(range(4)), texts, ("ids", "decoded")).to_pylist()
    assert len(list(coder.pieces(texts[0]))) > 10
    for r, t in zip(got, texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_language(spark, odd, none, clashing):
    rows = [(k, ("the cat and the dog of the house " if k % 2 else "der hund und die katze das haus ") * (1 + k % 3), "en" if k % 2 else "de") for k in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixture = language.learn(train, language.held_out(4, 2))
    mixed = spark.createDataFrame([(0, "the cat and the dog"), (1, "der hund und das haus"), (2, None), (3, "123 !"), (4, "the cat and the dog of the house " * 20 + "der hund und die katze das haus " * 20)], "doc_id long, text string")
    got = by_id(language.identify(mixed, mixture))
    assert [got[k]["lang_pred"] for k in range(4)] == ["en", "de", "und", "und"] and sorted(got[4]["languages"]) == ["de", "en"]
    assert language.identify(clashing, mixture).count() == len(TEXTS) + 2
    assert language.identify(odd, language.learn(none, language.held_out(4, 2))).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, odd, none, clashing):
    import random

    rng = random.Random(4)
    rows = [(k, prose(rng, 50) + (" you vile fool " if k % 3 == 0 else " my dear friend ") + prose(rng, 20), int(k % 3 == 0)) for k in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None)], "doc_id long, toxic int")
    net = toxicity.learn(docs, labels, language.held_out(5, 0))
    found = toxicity.score(docs, net).join(labels.dropna(), "doc_id").where(language.held_out(5, 0)).collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) >= 0.9 * len(found)
    got = by_id(toxicity.score(odd, net))
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["n_windows"] == 0
    assert toxicity.score(clashing, net).count() == len(TEXTS) + 2
    assert toxicity.score(none, toxicity.learn(docs, labels.limit(0), language.held_out(5, 0))).count() == 0


def test_language_of_odd_texts(spark):
    """Numerals and signs are no letters; a document of five languages is told as five; rows without doc_id give a row."""
    import numpy as np

    rng = np.random.default_rng(1)
    words = {lang: ["".join(rng.choice(list(letters), 6)) for _ in range(80)] for lang, letters in {"a": "abcd", "b": "efgh", "c": "ijkl", "d": "mnop", "e": "qrst", "f": "uvwx"}.items()}
    rows = [(k, " ".join(rng.choice(words[lang], 60)), lang) for k, lang in enumerate("abcdef" * 20)]
    mixture = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), language.held_out(4, 2))
    texts = ["½", "²²²", "①②③④", "१२३ ", "!?", "漢字", "x", " ".join(" ".join(rng.choice(words[x], 200)) for x in "abcde"), " ".join(rng.choice(words["f"], 50))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "abcd")], "doc_id long, text string")
    got = by_id(language.identify(docs, mixture))
    assert [got[k]["lang_pred"] == "und" for k in range(9)] == [True] * 5 + [False] * 4
    assert sorted(got[7]["languages"]) == list("abcde") and got[8]["languages"] == ["f"] and None in got


def test_toxicity_reads_whole_words():
    """Words that differ behind their first letters differ in their characters, and long runs are cut between characters so that windows cover them."""
    import numpy as np

    def words(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return toxicity.Words(data, np.array([0, len(data)]))

    x, y = words("abcdefghijklmno"), words("abcdefghijklzzz")
    assert (x.chars != y.chars).any()
    for run in ("漢字" * 400, "a" * 1000, "привет" * 90, "é" * 23):
        data = run.encode()
        starts, ends = toxicity._cut_runs(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))
        assert starts[0] == 0 and ends[-1] == len(data) and (starts[1:] == ends[:-1]).all() and (ends - starts).max() <= toxicity.WORD_BYTES + 3
        for s, e in zip(starts, ends):
            data[s:e].decode()
    long = words("漢字" * 400)
    assert len(toxicity.windows(long.row, 1)[0]) > 3


@pytest.fixture(scope="module")
def given(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the given tables aren't here")
    return folder


def test_toxicity_of_held_out_documents(spark, given):
    from parlance.llm.queries import op8_toxicity

    found = op8_toxicity(spark, given).where("held_out").join(spark.read.parquet(f"{given}/labels.parquet").dropna(subset=["toxic"]), "doc_id").collect()
    right = [r["predicted"] == r["toxic"] for r in found]
    assert len(right) > 500 and sum(right) >= 0.95 * len(right)


def test_language_of_held_out_documents(spark, given):
    from parlance.llm.queries import op9_language

    found = op9_language(spark, given).where("held_out").join(spark.read.parquet(f"{given}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 1000 and sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)


def test_fingerprints_of_long_buffers(monkeypatch):
    """Taken in parts, words have the same fingerprints."""
    import numpy as np

    from parlance.llm import words

    data = np.frombuffer((prose(__import__("random").Random(2), 500) + " " + "x" * 900).encode(), np.uint8)
    bounds = np.array([0, 40, 40, 700, len(data)])
    want = words.word_hashes(data, bounds)
    for size in (16, 100, 1 << 20):
        monkeypatch.setattr(words, "HASH_BYTES", size)
        monkeypatch.setattr(words, "_powers", [])
        got = words.word_hashes(data, bounds)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_network_gradient():
    import numpy as np

    net = toxicity.Network(1)
    rng = np.random.default_rng(0)
    gates = rng.standard_normal((3, 5, 6 * toxicity.HIDDEN)).astype(np.float32)
    mask = np.ones((3, 5), bool)
    mask[0, 3:] = False
    keep = {}
    net.forward(gates, mask, keep)
    _, dgates = net.backward(np.ones(3, np.float32), keep)
    for at in ((0, 1, 4), (1, 2, 20), (2, 4, 40)):
        up, down = gates.copy(), gates.copy()
        up[at] += 1e-2
        down[at] -= 1e-2
        slope = (net.forward(up, mask).sum() - net.forward(down, mask).sum()) / 2e-2
        assert abs(slope - dgates[at]) < 2e-3
