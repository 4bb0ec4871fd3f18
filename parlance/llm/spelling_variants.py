"""Spelling variant grouping by anagram hashing.

A word's key is the sum of a power of each letter, so words of the same letters share it whatever
their order.  Words at one edit have keys that differ by one letter's value (added or removed) or
by the difference of two (exchanged).  Both are met by one equality join: each word is sent under
its own key and, for each of its letters, under its key less that letter's value.  A word with one
letter more then stands beside the word itself, and words with one letter exchanged stand together
under what they have in common.

Who stands together has the same letters, but maybe in another order; the order is verified by
what remains of each word without the letter, first by fingerprints, then letter by letter.
Links of words that share a remainder are counted together, so pairs are never rows.  A key with
very many words is dealt out once more by the fingerprints of the remainders.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.frames import documents, shared
from parlance.llm.sql import crc32_sql
from parlance.llm.words import _TABLE, mix, powers

#: Letters and occurrences that a word has at least; so many times as often is the form that a word is a variant of.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: One occurrence in so many loses a letter.
DAMAGED = 199
#: The power of a letter's code that is its value.
POWER = 5
#: Rows of one key that a task takes together; more are dealt out by their remainders.
HEAVY = 1 << 17
#: Rows that are verified at a time.
ROWS = 1 << 16

_RUN = r"[A-Za-zÀ-ÿ]"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUES = np.arange(256, dtype=np.int64) ** POWER
_KEYED = "key long, word string, n long, letter int"
_PART = "word string, n long, n_near long, best_n long, best string, mark long, at int"


def damaged_words(docs: DataFrame) -> DataFrame:
    """word: every run of at least LETTERS letters in every text, in lower case, of which one in DAMAGED loses a letter."""
    text = documents(docs, unnamed=True)
    # A shorter run yields no word.  explode() would have Spark filter empty arrays first, by a second search of the text.
    runs = text.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode_outer(F.regexp_extract_all("text", F.lit(f"{_RUN}{{{LETTERS},}}"), F.lit(0))).alias("run")).where("run is not null")
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _SMALL)).otherwise(F.col("run")).alias("run"))
    keyed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.char_length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return keyed.select(F.when(F.pmod("h", F.lit(DAMAGED)) == 0, cut).otherwise(F.col("run")).alias("word"))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, a byte each, and the words' bounds among them."""
    texts = words.to_pylist()
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word under its own key (letter -1), and for each of its letters under its key less that letter's value."""
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            part = batch.slice(k, ROWS)
            data, bounds = _letters(part.column(0))
            sums = np.r_[0, np.cumsum(_VALUES[data])]  # wraps around for very long words, as do differences
            own = sums[bounds[1:]] - sums[bounds[:-1]]
            owner = np.repeat(np.arange(len(part)), np.diff(bounds))
            held = np.unique(owner * 256 + data)
            row, letter = np.r_[np.arange(len(part)), held >> 8], np.r_[np.full(len(part), -1), held & 255]
            key = own[row] - np.where(letter < 0, 0, _VALUES[letter])
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(letter.astype(np.int32))], names=["key", "word", "n", "letter"])


def remainders(words: pa.Array, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and fingerprint of what remains of each word without its letter, at every place that has it; of the whole word where the letter is -1 (place -1)."""
    data, bounds = _letters(words)
    up, down = powers(len(data) + 2)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    owner = np.repeat(np.arange(len(words)), np.diff(bounds))
    at = np.flatnonzero(data == letter[owner])
    row = owner[at]
    left, right = sums[at] - sums[bounds[row]], sums[bounds[row + 1]] - sums[at + 1]
    marks = left * down[bounds[row]] + right * down[bounds[row] + 1]
    own = np.flatnonzero(letter < 0)
    whole = (sums[bounds[own + 1]] - sums[bounds[own]]) * down[bounds[own]]
    return np.r_[row, own], np.r_[at - bounds[row], np.full(len(own), -1)], mix(np.r_[marks, whole])


def _links(words: list[str], n: list[int], row: np.ndarray, at: np.ndarray, mark: np.ndarray) -> Iterator[tuple[str, int, int, int | None, str | None]]:
    """word, n, and of words that share a remainder, the number of links and the best word among them; the words themselves once with none."""
    order = np.lexsort((row, at, mark))
    row, at, mark = row[order], at[order], mark[order]
    edges = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1], True])
    for i in row[at == -1].tolist():
        yield words[i], n[i], 0, None, None
    best = lambda i: (-n[i], words[i])
    some = np.diff(edges) > 1
    for a, b in zip(edges[:-1][some].tolist(), edges[1:][some].tolist()):
        rows, places = row[a:b].tolist(), at[a:b].tolist()
        if rows[0] == rows[-1] and len(set(rows)) == 1:
            continue  # one word's like letters in a row
        # At one place, words whose remainders are the same differ in that letter alone.
        exchanged = defaultdict(list)
        longer: dict[str, dict[str, int]] = defaultdict(dict)
        whole = {words[i]: i for i, p in zip(rows, places) if p == -1}
        for k, (i, p) in enumerate(zip(rows, places)):
            if p == -1:
                continue
            beside = (k and places[k - 1] == p) or (k + 1 < len(places) and places[k + 1] == p)
            if beside or whole:
                rest = words[i][:p] + words[i][p + 1 :]
                if beside:
                    exchanged[p, rest].append(i)
                if rest in whole:
                    longer[rest][words[i]] = i
        for group in exchanged.values():
            if len(group) > 1:
                first, second = sorted(group, key=best)[:2]
                for i in group:
                    o = second if i == first else first
                    yield words[i], n[i], len(group) - 1, n[o], words[o]
        for rest, held in longer.items():
            i, o = whole[rest], min(held.values(), key=best)
            yield words[i], n[i], len(held), n[o], words[o]
            for o in held.values():
                yield words[o], n[o], 1, n[i], words[i]


def _found(rows) -> pa.RecordBatch:
    word, n, near, best_n, best = zip(*rows) if rows else [()] * 5
    none = pa.nulls(len(word), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string()), none, pa.nulls(len(word), pa.int32())], names=[p.split()[0] for p in _PART.split(", ")])


def _whole_groups(batches: Iterator[pa.RecordBatch], column: str, heavy: int | None) -> Iterator[tuple[bool, pa.Table]]:
    """Rows in pieces that hold whole groups of equal ``column``; or (True, ...) parts of a group of more than ``heavy`` rows."""
    rest, large = None, None
    for batch in batches:
        for k in range(0, len(batch), ROWS):
            t = pa.Table.from_batches([batch.slice(k, ROWS)])
            if large is not None:
                keys = t.column(column).to_numpy()
                same = int(np.searchsorted(keys, large, side="right"))
                if same:
                    yield True, t.slice(0, same)
                t, large = t.slice(same), None if same < len(t) else large
            rest = pa.concat_tables([rest, t]) if rest is not None else t
            keys = rest.column(column).to_numpy()
            last = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            if last:
                yield False, rest.slice(0, last)
                rest = rest.slice(last)
            if heavy is not None and len(rest) > heavy:
                large = keys[-1]
                yield True, rest
                rest = None
    if rest is not None and len(rest):
        yield False, rest


def near_words(vocabulary: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """word, n, n_near, best_n, best for each word: how many words are at one edit, and of those the most frequent (ties: least)."""
    shared(vocabulary.sparkSession)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large, t in _whole_groups(batches, "key", heavy):
            words, letter = t.column("word").combine_chunks(), t.column("letter").to_numpy()
            row, at, mark = remainders(words, letter)
            key = t.column("key").to_numpy()[row].astype(np.uint64)
            mark = mix(mark ^ mix(key))
            if large:
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([words.take(take), t.column("n").combine_chunks().take(take), *[pa.nulls(len(row), pa.int64())] * 2, pa.nulls(len(row), pa.string()), pa.array(mark.view(np.int64)), pa.array(at.astype(np.int32))], names=[p.split()[0] for p in _PART.split(", ")])
            else:
                yield _found(list(_links(words.to_pylist(), t.column("n").to_pylist(), row, at, mark)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _whole_groups(batches, "mark", None):
            mark, at = t.column("mark").to_numpy(), t.column("at").to_numpy()
            yield _found(list(_links(t.column("word").to_pylist(), t.column("n").to_pylist(), np.arange(len(t)), at, mark.view(np.uint64))))

    keyed = vocabulary.select("word", "n").mapInArrow(_keys, _KEYED)
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(verified, _PART).checkpoint()
    rest = found.where("mark is not null").repartition("mark").sortWithinPartitions("mark").mapInArrow(spread, _PART)
    every = found.where("mark is null").union(rest)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def _followed(forms: DataFrame) -> DataFrame:
    """word, root for every word that has a form: the last of its chain.  A form is TIMES as frequent as its word, so chains are short; each round doubles the steps."""
    ways = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = ways.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def group_variants(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of all texts.

    Words have at least LETTERS letters and OCCURRENCES occurrences.  ``form`` is the most frequent
    word at one edit (ties: least in code-point order), if it is TIMES as frequent, and ``root`` what
    forms lead to.  Null and empty texts have no words; repeated rows count each; a missing doc_id is
    written as nothing in the digest that damages words; an empty table gives an empty result; columns
    other than doc_id and text are not read.
    """
    shared(docs.sparkSession)
    vocabulary = damaged_words(docs).where(F.char_length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OCCURRENCES)
    is_form = F.col("best_n") >= TIMES * F.col("n")
    near = near_words(vocabulary, heavy).select("word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n")).checkpoint()
    roots = _followed(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql() -> str:
    """The same for DuckDB, over the view ``documents``."""
    return rf"""
    WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_SMALL}') AS run FROM documents),
    h AS (SELECT run, {crc32_sql("id || ':' || run")} AS h FROM r WHERE length(run) >= {LETTERS}),
    w AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h),
    v AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= {LETTERS} GROUP BY word HAVING count(*) >= {OCCURRENCES}),
    d AS (SELECT word, n, p, substr(word, 1, CAST(p AS INT) - 1) || substr(word, CAST(p AS INT) + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
    l AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
          UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
    b AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM l QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
    f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * v.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * v.n THEN other_n END AS form_n FROM v LEFT JOIN b USING (word)),
    c AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(root, step) AS root FROM c GROUP BY word) USING (word)"""
