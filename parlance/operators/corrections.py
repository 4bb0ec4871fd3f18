"""Corrections that a model proposes, applied to words: what it was shown, what of its answers holds, and why the rest was refused."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import islands
from parlance.operators.intervals import UNKNOWN
from parlance.sources.transcripts import parse_corrections

#: Words that one correction may move.
MOST_MOVED = 6
#: Characters of a turn beyond which it is cut between sentences.
TURN_CHARS = 1200
#: Tokens that a request may have, and turns that the next one shows again.
BUDGET, OVERLAP = 24_000, 4
COUNTERS = ["corrections_proposed", "corrections_applied", "applied_reassign", "applied_split", "words_moved", "unmatched", "malformed", "rejected_speaker", "rejected_long", "rejected_conflict", "duplicate", "chunk_failures"]


def shown_turns(words: DataFrame, by: list[str]) -> DataFrame:
    """by, run, first, last, speaker, line: each run of a speaker as a model is shown it: number, speaker, clock, pause before, words; body is the line without its number, measured that with no pause."""
    who = F.coalesce(F.nullif("speaker", F.lit("")), F.lit(UNKNOWN))
    runs = islands.islands(words.withColumn("speaker", who), by, ["word_idx"], ~F.col("speaker").eqNullSafe(F.lag("speaker").over(Window.partitionBy(*by).orderBy("word_idx"))), "run")
    each = runs.groupBy(*by, "run").agg(
        F.first("speaker").alias("speaker"), F.min("word_idx").alias("first"), (F.max("word_idx") + 1).alias("last"), F.min_by("start", "word_idx").alias("start"), F.max_by("end", "word_idx").alias("end"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", F.trim("word").alias("w")))), lambda x: x["w"]), " ").alias("text"),
    )
    w = Window.partitionBy(*by).orderBy("first")
    pause = F.greatest(F.col("start") - F.lag("end").over(w), F.lit(0.0))
    gap = F.when(F.lag("end").over(w).isNull(), "  ----").otherwise(F.format_string(" +%.1fs", F.bround(pause, 1)))
    number = (F.row_number().over(w) - 1).cast("long")
    body = lambda pause: F.concat(F.col("speaker"), F.lit("  ["), T.tenths_clock(F.col("start")), pause, F.lit("]  "), F.col("text"))
    shown = each.withColumn("run", number).withColumn("body", body(gap)).withColumn("measured", F.concat(F.lit("0  "), body(F.lit(" +0.0s"))))
    return shown.select(*by, "run", "first", "last", "speaker", F.concat(F.col("run").cast("string"), F.lit("  "), F.col("body")).alias("line"), "body", "measured")


def prompts(lines: DataFrame, by: list[str]) -> DataFrame:
    """by, prompt (all lines in order), labels (the speakers shown)."""
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "line"))), lambda x: x["line"]), "\n").alias("prompt"), F.array_sort(F.collect_set("speaker")).alias("labels"))


def requests(lines: DataFrame, by: list[str], measure: Callable[[Column], Column], budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """by, request, first_run, runs: the turns that each request shows, as many as fit the budget; the next begins with the last ``overlap`` of them.

    ``measure`` gives the tokens of a text: an expression, or an Arrow function around a tokenizer.
    A turn larger than the budget is still shown.  Where a request begins depends on those before, so
    a recording's turns, a number each, are folded in one task.
    """
    kinds = dict(lines.dtypes)
    sized = lines.select(*by, "run", measure(F.col("measured")).cast("long").alias("size"))

    def fold(t: pa.Table) -> pa.Table:
        sizes = t.sort_by("run").column("size").to_pylist()
        first, held, out = 0, 0, []
        for k, size in enumerate(sizes):
            if k > first and held + size > budget:
                out.append((first, k - first))
                first = max(first, k - overlap)
                held = sum(sizes[first:k])
            held += size
        out.append((first, len(sizes) - first))
        columns = {c: t.column(c).slice(0, 1).combine_chunks().take(pa.array([0] * len(out))) for c in by}
        return pa.table(columns | {"request": pa.array(range(len(out)), pa.int64()), "first_run": pa.array([a for a, _ in out], pa.int64()), "runs": pa.array([n for _, n in out], pa.int64())})

    return sized.groupBy(*by).applyInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in by) + ", request long, first_run long, runs long")


def request_prompts(lines: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """asked with prompt: its turns in order, numbered from 0 within the request."""
    each = asked.select(*by, "request", "first_run", "runs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("place"))
    shown = each.withColumn("run", F.col("first_run") + F.col("place")).join(lines.select(*by, "run", "body"), [*by, "run"])
    line = F.struct("place", F.concat(F.col("place").cast("string"), F.lit("  "), F.col("body")).alias("line"))
    return shown.groupBy(*by, "request", "first_run", "runs").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("prompt"))


def answers(prompts: DataFrame, keys: list[str], ask: Callable[[str], str]) -> DataFrame:
    """keys, reply: what ``ask`` says to each prompt, asked in the tasks; null where it raises."""
    kinds = dict(prompts.dtypes)

    def said(prompt: str) -> str | None:
        try:
            return ask(prompt)
        except Exception:  # a request that failed is counted as one
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array([said(p) for p in batch.column("prompt").to_pylist()], pa.string())], names=[*keys, "reply"])

    return prompts.select(*keys, "prompt").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", reply string")


def reviewed(words: DataFrame, by: list[str], ask: Callable[[str], str], measure: Callable[[Column], Column], budget: int = BUDGET, overlap: int = OVERLAP, most: int = MOST_MOVED) -> DataFrame:
    """by, word_idx, new, report as ``corrected`` gives them: the whole way from words by requests to a model's answers."""
    lines = shown_turns(words, by)
    asked = requests(lines, by, measure, budget, overlap)
    keys = [*by, "request", "first_run", "runs"]
    entries = parse_corrections(answers(request_prompts(lines, asked, by), keys, ask), keys)
    return corrected(words, entries, by, most)


def held_corrections(corrections: Column, transcript: Column, most: int = 2) -> Column:
    """Of an array of (original, ...) those of at most ``most`` words that the transcript holds."""
    return F.filter(corrections, lambda c: (F.coalesce(c["original"], F.lit("")) != "") & (F.size(T.words_of(c["original"])) <= most) & transcript.contains(c["original"]))


def _pairs(corrections: Column) -> Column:
    """original and suggested, trimmed, of each; of none where the array is null."""
    side = lambda c, name: F.trim(F.coalesce(c[name], F.lit(""))).alias(name)
    return F.coalesce(F.transform(corrections, lambda c: F.struct(side(c, "original"), side(c, "suggested"))), F.array().cast("array<struct<original:string,suggested:string>>"))


def replaced_in_text(text: Column, corrections: Column) -> Column:
    """A struct of text and hits: corrections (an array of original, suggested) made one after the other as whole words, and how often each was; null for those without either side."""
    quoted = lambda c: F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    plain = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")

    def step(done: Column, c: Column) -> Column:
        original, suggested = c["original"], c["suggested"]
        given = (original != "") & (suggested != "")
        new = F.when(given, F.regexp_replace(done["text"], quoted(original), plain(suggested))).otherwise(done["text"])
        hits = F.when(given, F.regexp_count(done["text"], quoted(original)))
        return F.struct(new.alias("text"), F.concat(done["hits"], F.array(hits)).alias("hits"))

    return F.aggregate(_pairs(corrections), F.struct(F.coalesce(text, F.lit("")).alias("text"), F.array().cast("array<int>").alias("hits")), step)


def replaced_word(word: Column, corrections: Column) -> Column:
    """A word after the corrections of one word that match it exactly, one after the other."""

    def step(done: Column, c: Column) -> Column:
        original, suggested = c["original"], c["suggested"]
        return F.when((suggested != "") & (F.size(T.words_of(original)) == 1) & (done == original), suggested).otherwise(done)

    return F.aggregate(_pairs(corrections), word, step)


def _met(word: Column, corrections: Column) -> Column:
    """A struct of word and places: the word after corrections (place, original, suggested) made one after the other, and the places of those that met it as it was at their turn."""

    def step(done: Column, c: Column) -> Column:
        hit = done["word"] == c["original"]
        return F.struct(F.when(hit, c["suggested"]).otherwise(done["word"]).alias("word"), F.when(hit, F.concat(done["places"], F.array(c["place"]))).otherwise(done["places"]).alias("places"))

    return F.aggregate(corrections, F.struct(word.alias("word"), F.array().cast("array<bigint>").alias("places")), step)


def with_corrections(texts: DataFrame, words: DataFrame, corrections: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts and words after a visit's corrections, and by, place, text_replacements, word_replacements, applied of each correction.

    texts: by, text.  words: by, word_idx, word.  corrections: by, place (order), original,
    suggested.  A correction of several words changes the text alone; one that matches nothing is
    told as not applied, one without either side not at all.
    """
    entry = F.struct("place", F.trim("original").alias("original"), F.trim("suggested").alias("suggested"))
    held = corrections.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_c"))
    told = F.col("_c").cast("array<struct<place:bigint,original:string,suggested:string>>")
    # Those that may meet a word, once for each visit.
    single = F.filter(told, lambda c: (F.size(T.words_of(c["original"])) == 1) & (c["suggested"] != ""))
    held = held.select(*by, told.alias("_c"), single.alias("_one")).withColumn("_known", F.col("_one.original"))
    told = F.col("_c")
    made = texts.join(held, by, "left").withColumn("_made", replaced_in_text(F.col("text"), told))
    spoken = words.join(held.select(*by, "_one", "_known"), by, "left").withColumn("_new", F.when(F.array_contains("_known", F.col("word")), _met(F.col("word"), F.col("_one"))))
    hits = spoken.select(*by, F.explode("_new.places").alias("place")).groupBy(*by, "place").agg(F.count("*").alias("word_replacements"))
    applied = made.where("_c is not null").select(*by, F.explode(F.arrays_zip(told.alias("c"), F.col("_made.hits").alias("n"))).alias("z")).select(*by, F.col("z.c.place").alias("place"), F.col("z.n").cast("long").alias("text_replacements")).where("text_replacements is not null")
    report = applied.join(hits, [*by, "place"], "left").withColumn("word_replacements", F.coalesce("word_replacements", F.lit(0))).withColumn("applied", F.col("text_replacements") > 0)
    return made.withColumn("text", F.col("_made.text")).select(*texts.columns), spoken.withColumn("word", F.coalesce("_new.word", "word")).select(*words.columns), report


def reasoned_flags(flags: Column) -> Column:
    """Of an array of (reasoning, ...) those whose reasoning quotes something."""
    return F.filter(flags, lambda f: F.coalesce(f["reasoning"].contains("'") | f["reasoning"].contains('"'), F.lit(False)))


def located(spans: DataFrame, by: list[str]) -> DataFrame:
    """spans with found: the place, from 0 within tokens, at which the quote's tokens first stand side by side; null if nowhere.

    spans: tokens (of a span, blank ones kept) and quote (tokens, blank ones dropped here).
    """
    target = F.filter(F.col("quote"), lambda t: t != "")
    n, m = F.size("target"), F.size("tokens")
    starts = F.when((n > 0) & (m >= n), F.sequence(F.lit(0), m - n))
    hit = F.filter(starts, lambda k: F.slice("tokens", k + 1, n) == F.col("target"))
    return spans.withColumn("target", target).withColumn("found", F.get(hit, F.lit(0))).drop("target")


def flagged_turns(turns: DataFrame, flags: DataFrame, by: list[str], roles: tuple[str, str]) -> DataFrame:
    """flags with turn_idx: the first turn whose text is exactly the flagged one; null where there is none.

    turns: by, turn_idx, text.  flags: by, flag, turn_text.
    """
    first = turns.groupBy(*by, F.trim("text").alias("turn_text")).agg(F.min("turn_idx").alias("turn_idx"))
    return flags.withColumn("turn_text", F.trim("turn_text")).where("turn_text <> ''").join(first, [*by, "turn_text"], "left")


def flipped_words(words: DataFrame, turns: DataFrame, flagged: DataFrame, by: list[str], roles: tuple[str, str]) -> DataFrame:
    """Words whose start lies in a flagged turn, give or take a millionth of a second, and whose speaker is the turn's: the other role."""
    hit = turns.join(flagged.where("turn_idx is not null").select(*by, "turn_idx").distinct(), [*by, "turn_idx"], "left_semi").select(*by, F.col("start").alias("t_start"), F.col("end").alias("t_end"), F.col("speaker").alias("role"))
    bucket = lambda c: F.floor(c / 60)
    dealt = hit.withColumn("bucket", F.explode(F.sequence(bucket(F.col("t_start") - 1e-6), bucket(F.greatest("t_start", "t_end") + 1e-6))))
    met = words.withColumn("bucket", bucket(F.col("start"))).join(dealt, [*by, "bucket"]).where("start >= t_start - 1e-6 and start <= t_end + 1e-6 and speaker = role").select(*by, "word_idx").distinct().withColumn("flip", F.lit(True))
    other = F.when(F.col("speaker") == roles[0], roles[1]).otherwise(roles[0])
    return words.join(met, [*by, "word_idx"], "left").withColumn("speaker", F.when(F.col("flip"), other).otherwise(F.col("speaker"))).withColumn("flipped", F.coalesce("flip", F.lit(False))).drop("flip")


def short_turns(words: DataFrame, by: list[str], most: int = TURN_CHARS) -> DataFrame:
    """by, first, last: runs of a speaker, those of more than ``most`` characters cut between sentences, as many to a piece as fit.

    Where a piece ends depends on where it began, so a recording's sentences are folded in one task.
    """
    kinds = dict(words.dtypes)
    w = Window.partitionBy(*by).orderBy("word_idx")
    runs = islands.islands(words, by, ["word_idx"], ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | (F.row_number().over(w) == 1), "run")
    length = F.sum(F.length(F.trim("word")) + 1)
    marked = islands.sentence_words(runs, [*by, "run"])
    chars = marked.groupBy(*by, "run", "part", "piece").agg(F.min("word_idx").alias("first"), (F.max("word_idx") + 1).alias("last"), length.alias("chars"))
    chars = chars.withColumn("run_chars", F.sum("chars").over(Window.partitionBy(*by, "run"))).drop("part", "piece")

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("first")
        out: list[list] = []
        size, run = 0, None
        for r, a, b, n, whole in zip(*(t.column(c).to_pylist() for c in ("run", "first", "last", "chars", "run_chars"))):
            if r == run and (whole <= most or not size or size + n <= most):
                out[-1][1], size = b, size + n
            else:
                out.append([a, b])
                size, run = n, r
        return pa.table({c: pa.array([t.column(c)[0].as_py()] * len(out), t.column(c).type) for c in by} | {"first": pa.array([x[0] for x in out], pa.int64()), "last": pa.array([x[1] for x in out], pa.int64())})

    return chars.groupBy(*by).applyInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in by) + ", first long, last long")


def corrected(words: DataFrame, entries: DataFrame, by: list[str], most: int = MOST_MOVED) -> DataFrame:
    """by, word_idx, new: the speakers that a model's answers give to words; and for each recording a row without word_idx that counts in ``report`` what was applied and why the rest was refused.

    words: by, word_idx, word, speaker.  entries: by, request (order), first_run, runs (which runs
    the request showed), place (order within the answer), turn, text, speaker, action, valid,
    unreadable; as ``parse_corrections`` gives them.  Each answer is held against the turn that it
    names: the quote must stand there, be short enough and go to another speaker who was shown.
    The first of two answers for a word stays, so a recording is settled in one task; without
    entries nothing changes.
    """
    kinds = dict(words.dtypes)
    token = F.trim(F.regexp_replace(T.headline(F.col("word")), r"\s+", " "))
    own = words.select(*by, "word_idx", token.alias("token"), "speaker")
    target = F.filter(F.transform(T.words_of(F.coalesce("text", F.lit(""))), T.headline), lambda t: t != "")
    asked = entries.select(*by, "request", "first_run", "runs", "place", "turn", target.alias("target"), F.col("speaker").alias("to"), "action", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("unreadable", F.lit(False)).alias("unreadable"))

    def settle(key: tuple, w: pa.Table, e: pa.Table) -> pa.Table:
        w, e = w.sort_by("word_idx"), e.sort_by([("request", "ascending"), ("place", "ascending")])
        ids, tokens, who = (w.column(c).to_pylist() for c in ("word_idx", "token", "speaker"))
        cuts = [k for k in range(len(ids)) if not k or who[k] != who[k - 1]] + [len(ids)]
        n = dict.fromkeys(COUNTERS, 0)
        new: dict[int, str] = {}
        for row in e.to_pylist():
            if row["unreadable"]:
                n["chunk_failures"] += 1
                continue
            n["corrections_proposed"] += 1
            verdict, places = _verdict(row, tokens, who, cuts, new, most)
            n[verdict] += 1
            if verdict == "corrections_applied":
                n[f"applied_{row['action']}"] += 1
                new.update(dict.fromkeys(places, row["to"]))
        moved = sorted(k for k, to in new.items() if to != who[k])
        n["words_moved"] = len(moved)
        columns = {c: pa.array([x.as_py()] * (len(moved) + 1), x.type) for c, x in zip(by, key)}
        report = pa.array([None] * len(moved) + [list(n.items())], pa.map_(pa.string(), pa.int64()))
        return pa.table(columns | {"word_idx": pa.array([*(ids[k] for k in moved), None], pa.int64()), "new": pa.array([*(new[k] for k in moved), None], pa.string()), "report": report})

    return own.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(settle, ", ".join(f"{c} {kinds[c]}" for c in by) + ", word_idx long, new string, report map<string,bigint>")


def _verdict(row: dict, tokens: list[str], who: list[str], cuts: list[int], new: dict[int, str], most: int) -> tuple[str, range]:
    """What becomes of one answer, and the places that it quotes."""
    nothing = range(0)
    if not row["valid"]:
        return "malformed", nothing
    run = row["first_run"] + row["turn"]
    if not 0 <= row["turn"] < row["runs"] or run >= len(cuts) - 1:
        return "unmatched", nothing
    low, high, target = cuts[run], cuts[run + 1], row["target"]
    found = next((k for k in range(low, high - len(target) + 1) if tokens[k : k + len(target)] == target), None) if target else None
    if found is None:
        return "unmatched", nothing
    places = range(found, found + len(target))
    if len(places) > most:
        return "rejected_long", nothing
    shown = {who[cuts[r]] or UNKNOWN for r in range(row["first_run"], min(row["first_run"] + row["runs"], len(cuts) - 1))}
    if row["to"] not in shown or row["to"] == who[low]:
        return "rejected_speaker", nothing
    taken = [new[k] for k in places if k in new]
    if taken:
        return ("duplicate" if len(taken) == len(places) and set(taken) == {row["to"]} else "rejected_conflict"), nothing
    return "corrections_applied", places
