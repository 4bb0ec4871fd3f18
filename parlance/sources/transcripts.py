"""Readers of transcripts: time-stamped text, word and turn JSON, vendor JSON, captions, WAV headers, model replies."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import parse_clock, unwrap_brackets

#: Speaker, clock and text of a line that opens a turn.
TURN_LINE = r"^(\S+)\s+((?:\d+:)?\d{1,2}:\d{2}(?:\.\d+)?)\s+(.+)$"
RENDERED_LINE = r"^\[([0-9:.]+) - ([0-9:.]+)\] ([^:]+): (.*)$"
WORD = "struct<word:string,start:double,end:double,speaker:string>"
#: Tasks that short rows are dealt to before they are made into many.
TASKS = 256
CORRECTION = "array<struct<turn:int,text:string,speaker:string,action:string>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: path and value (the whole text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def visit_of(path: Column) -> dict[str, Column]:
    """site, subject, session from a path that ends with them and a file name; timepoint from the session."""
    parts = F.split(path, "/")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return {"site": at(-4), "subject": at(-3), "session": at(-2), "timepoint": F.regexp_extract(path, r"(day\d+_session\d+)", 1)}


def parse_turns(texts: DataFrame, by: list[str], duration: Column) -> DataFrame:
    """by, turn_idx, speaker, start, end, text from ``value``: lines that open no turn go to the one before, those before any are dropped; a turn ends where the next starts, the last at the duration or its own start."""
    lines = texts.withColumn("duration", duration).select(*by, "duration", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    opens = F.regexp_extract("line", TURN_LINE, 2) != ""
    w = Window.partitionBy(*by).orderBy("n")
    turns = lines.withColumn("turn", F.sum(F.when(opens, 1).otherwise(0)).over(w)).where("turn > 0")
    said = F.when(opens, F.regexp_extract("line", TURN_LINE, 3)).otherwise(F.col("line"))
    each = turns.groupBy(*by, "turn").agg(
        F.max("duration").alias("duration"), F.max(F.when(opens, F.regexp_extract("line", TURN_LINE, 1))).alias("speaker"), F.max(F.when(opens, parse_clock(F.regexp_extract("line", TURN_LINE, 2)))).alias("start"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", said.alias("said")))), lambda x: x["said"]), " ").alias("text"),
    )
    after = F.lead("start").over(Window.partitionBy(*by).orderBy("turn"))
    return each.select(*by, (F.col("turn") - 1).cast("long").alias("turn_idx"), "speaker", "start", F.coalesce(after, F.greatest("duration", "start")).alias("end"), unwrap_brackets(F.col("text")).alias("text"))


def parse_rendered(texts: DataFrame, by: list[str]) -> DataFrame:
    """Turns of rendered transcripts, ``[a - b] speaker: text``."""
    lines = texts.select(*by, F.posexplode(F.split("value", r"\r?\n")).alias("turn_idx", "line")).where(F.col("line").rlike(RENDERED_LINE))
    part = lambda k: F.regexp_extract("line", RENDERED_LINE, k)
    return lines.select(*by, "turn_idx", part(3).alias("speaker"), parse_clock(part(1)).alias("start"), parse_clock(part(2)).alias("end"), part(4).alias("text"))


def _held_words() -> Column:
    bare, held = F.from_json("value", f"array<{WORD}>"), F.from_json("value", f"struct<words:array<{WORD}>>")["words"]
    return F.when(F.ltrim("value").startswith("["), bare).otherwise(held)


def parse_words(texts: DataFrame, by: list[str]) -> DataFrame:
    """Words of JSON payloads of either shape: an array of words, or an object that holds it."""
    shaped = texts.select(*by, _held_words().alias("words"))
    return shaped.select(*by, F.posexplode("words").alias("word_idx", "w")).select(*by, "word_idx", "w.word", "w.start", "w.end", "w.speaker")


def parse_vendor(texts: DataFrame, by: list[str]) -> DataFrame:
    """Words of a vendor's JSON: blank ones dropped, ends not before starts, in order of time, numbered speakers as SPEAKER_nn."""
    kind = "struct<words:array<struct<startOffset:double,endOffset:double,word:string,speakerLabel:string>>>"
    each = texts.select(*by, F.posexplode(F.from_json("value", kind)["words"]).alias("pos", "w")).where("trim(w.word) <> ''")
    label = F.col("w.speakerLabel")
    named = F.when(label.rlike("^[0-9]+$"), F.format_string("SPEAKER_%02d", label.try_cast("int"))).otherwise(label)
    start = F.col("w.startOffset")
    rows = each.select(*by, "pos", F.col("w.word").alias("word"), start.alias("start"), F.greatest(start, F.col("w.endOffset")).alias("end"), named.alias("speaker"))
    return rows.withColumn("word_idx", F.row_number().over(Window.partitionBy(*by).orderBy("start", "end", "pos")) - 1).drop("pos")


def newest_run(files: DataFrame, visit: list[str]) -> DataFrame:
    """The last path of each visit, by name."""
    return files.groupBy(*visit).agg(F.max_by(F.struct(*[c for c in files.columns if c not in visit]), "path").alias("f")).select(*visit, "f.*")


def first_tree(trees: list[DataFrame], visit: list[str]) -> DataFrame:
    """All rows of a visit from the first tree that holds it."""
    out = trees[0]
    for tree in trees[1:]:
        out = out.unionByName(tree.join(out.select(*visit).distinct(), visit, "left_anti"), allowMissingColumns=True)
    return out


def unique_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides with the same key, where it is unique on either."""
    once = lambda df: df.join(df.groupBy(key).agg(F.count("*").alias("n")).where("n = 1").drop("n"), key, "left_semi")
    return once(left).join(once(right), key)


def parse_corrections(replies: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a model's JSON replies: fences stripped, the outermost brackets taken; ``valid`` needs turn, text, speaker and a known action, ``unreadable`` marks replies without an array; an empty array has no rows."""
    fenced = F.regexp_extract("reply", r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(F.col("reply")), r"(?s)(\[.*\])", 1)
    parsed = replies.select(*by, F.from_json(F.when(body != "", body), CORRECTION).alias("parsed")).where("parsed is null or size(parsed) > 0")
    rows = parsed.select(*by, F.col("parsed").isNull().alias("unreadable"), F.posexplode_outer("parsed").alias("place", "c"))
    text, speaker, action = F.trim("c.text"), F.trim("c.speaker"), F.lower(F.trim("c.action"))
    known = action.isin("reassign", "split") & F.col("c.turn").isNotNull() & (text != "") & (speaker != "")
    fields = F.struct(F.col("c.turn").alias("turn"), text.alias("text"), speaker.alias("speaker"), action.alias("action")).alias("c")
    return rows.select(*by, "unreadable", F.coalesce("place", F.lit(0)).alias("place"), F.when(F.col("unreadable"), F.lit(None)).otherwise(F.coalesce(known, F.lit(False))).alias("valid"), fields).select(*by, "c.*", "unreadable", "valid", "place")


def _wav(content: bytes, length: int) -> tuple[int, int, int, float] | None:
    """Channels, rate, bits and seconds of a RIFF file's first bytes, chunk by chunk; what is behind the header counts as data where no data chunk states a size that fits."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, form, size = 12, None, None
    while at + 8 <= len(content):
        name, n = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        if name == b"fmt " and at + 24 <= len(content):
            form = (int.from_bytes(content[at + 10 : at + 12], "little"), int.from_bytes(content[at + 12 : at + 16], "little"), int.from_bytes(content[at + 22 : at + 24], "little"))
        if name == b"data":
            size = n if 0 < n <= length - at - 8 else length - at - 8
            break
        at += 8 + n + n % 2
    if form is None or not all(form):
        return None
    channels, rate, bits = form
    return channels, rate, bits, max(0, size if size is not None else length - 44) / (channels * rate * bits / 8)


def wav_headers(files: DataFrame) -> DataFrame:
    """path, channels, rate, bits, seconds of RIFF files (path, content: the first bytes, length); other files have no row."""

    def run(batches):
        for batch in batches:
            read = [_wav(c or b"", n) for c, n in zip(batch.column("content").to_pylist(), batch.column("length").to_pylist())]
            hit = [k for k, r in enumerate(read) if r]
            columns = [pa.array([read[k][c] for k in hit], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(hit, pa.int64())), *columns], names=["path", "channels", "rate", "bits", "seconds"])

    return files.select("path", "content", "length").mapInArrow(run, "path string, channels long, rate long, bits long, seconds double")


#: Speaker and clock that may open a line of a tagged transcript.
TAGGED = r"^(S\d+):\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+"


def parse_tagged(texts: DataFrame, by: list[str]) -> DataFrame:
    """by, line, speaker, text of tagged transcripts: lines without a tag keep the speaker before them; empty ones go."""
    lines = texts.select(*by, F.posexplode(F.split("value", r"\r?\n")).alias("line", "raw"))
    who = F.nullif(F.regexp_extract("raw", TAGGED, 1), F.lit(""))
    kept = F.last(who, ignorenulls=True).over(Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("speaker", kept).withColumn("text", F.trim(F.regexp_replace("raw", TAGGED, ""))).where("text <> ''").select(*by, "line", "speaker", "text")


def tagged_words(texts: DataFrame, by: list[str]) -> DataFrame:
    """by, word_idx, speaker, word of the same."""
    each = parse_tagged(texts, by).select(*by, "line", "speaker", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    return each.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("line", "pos")) - 1).cast("long").alias("word_idx"), "speaker", "word")


def _held_turns() -> Column:
    turn = "struct<speaker:string,start:double,end:double,text:string>"
    return F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{turn}>")).otherwise(F.from_json("value", f"struct<turns:array<{turn}>>")["turns"])


def parse_turn_json(texts: DataFrame, by: list[str]) -> DataFrame:
    """Turns of JSON payloads, an array of them or an object that holds it."""
    return texts.select(*by, F.posexplode(_held_turns()).alias("turn_idx", "t")).select(*by, F.col("turn_idx").cast("long").alias("turn_idx"), "t.speaker", "t.start", "t.end", "t.text")


def load_turns(texts: DataFrame, by: list[str], duration: Column) -> DataFrame:
    """Turns of transcripts of any kind: time-stamped text, turn JSON, or word JSON, whose runs of a speaker are turns.

    Each text is read once: its lines, turns or words are pieces, some of which open a turn that the
    others go on with, as ``parse_turns``, ``parse_turn_json`` and ``group_into_turns`` have it.
    """
    json = F.ltrim("value").rlike(r"^[\[{]")
    kind = F.when(json & F.col("value").rlike(r'"word"\s*:'), "words").when(json, "turns").when(~json, "plain")
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    piece = lambda speaker, start, end, text: F.struct(speaker.alias("speaker"), start.alias("start"), end.alias("end"), text.alias("text"))
    own = F.transform(_held_turns(), lambda t: piece(t["speaker"], t["start"], t["end"], t["text"]))
    said = F.transform(_held_words(), lambda w: piece(w["speaker"], w["start"], w["end"], w["word"]))
    lines = F.transform(F.filter(F.transform(F.split("value", r"\r?\n"), F.trim), lambda x: x != ""), lambda x: piece(blank, none, none, x))
    pieces = F.when(F.col("kind") == "plain", lines).when(F.col("kind") == "turns", own).when(F.col("kind") == "words", said)
    each = texts.withColumn("duration", duration).withColumn("kind", kind).select(*by, "kind", "duration", F.posexplode(pieces).alias("n", "p")).select(*by, "kind", "duration", "n", "p.*")
    plain, run = F.col("kind") == "plain", [*by, "kind"]
    part = lambda k: F.regexp_extract("text", TURN_LINE, k)
    w = Window.partitionBy(*run).orderBy("n")
    opens = F.when(plain, part(2) != "").when(F.col("kind") == "turns", True).otherwise(~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | (F.row_number().over(w) == 1))
    turns = each.withColumn("opens", opens).withColumn("turn", F.sum(F.when(F.col("opens"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("turn > 0")
    first = lambda read, given: F.max(F.when(F.col("opens"), F.when(plain, read).otherwise(F.col(given)))).alias(given)
    words = F.struct("n", F.when(plain & F.col("opens"), part(3)).otherwise(F.col("text")).alias("text"))
    whole = turns.groupBy(*run, "turn").agg(
        F.max("duration").alias("duration"), first(part(1), "speaker"), first(parse_clock(part(2)), "start"), F.max_by("end", "n").alias("end"), F.max("text").alias("own"), F.array_join(F.sort_array(F.collect_list(words))["text"], " ").alias("text"),
    )
    after = F.lead("start").over(Window.partitionBy(*run).orderBy("turn"))
    end = F.when(plain, F.coalesce(after, F.greatest("duration", "start"))).otherwise(F.col("end"))
    text = F.when(plain, unwrap_brackets(F.col("text"))).when(F.col("kind") == "turns", F.col("own")).otherwise(F.col("text"))
    return whole.select(*by, (F.col("turn") - 1).cast("long").alias("turn_idx"), "speaker", "start", end.alias("end"), text.alias("text"))


#: Readers of words by the kind of a system's files.
READERS = {"words": parse_words, "vendor": parse_vendor}


class System(NamedTuple):
    """Where a system's files are, below the folder of a visit, and how they are read.

    ``suffix`` ends the file's name, or is all of it if ``whole``; ``below`` is a folder between the
    visit's and the file.  With ``runs`` a visit's folder may hold a folder for each run; these are
    looked into where the visit's own folder has no such file.  Of several files the last by path
    counts, or the ``first``.
    """

    suffix: str
    reader: Callable[[DataFrame, list[str]], DataFrame] = parse_words
    whole: bool = False
    runs: bool = False
    below: str = ""
    first: bool = False


def _run(name: str) -> System:
    return System(name, whole=True, runs=True)


# Names of systems and the files that they leave.
SYSTEMS = {
    "chirp3": System(".json", parse_vendor, below="chirp", first=True),
    "ours": _run("transcript.json"),
    "ours_diar": _run("transcript.json"),
    "ours_spk": _run("transcript_speakers.json"),
    "ours_spk_rule": _run("transcript_speakers_rule.json"),
    "verbatimize": _run("transcript.json"),
    "baseline": System("_words.json"),
    "baseline_llm": System("_words_corrected.json"),
    "ours_llm": System("_words_corrected.json"),
    "baseline_mono": System("_words.json"),
}


def register_system(name: str, system: System) -> None:
    """Adds a system, or puts another in its place; readers get (by, value) and give by, word_idx, word, start, end, speaker."""
    SYSTEMS[name] = system


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root, without a slash before it), value of all files of a tree, by any path that Spark reads."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("full"), "value")
    below = F.regexp_replace("full", r"^.*?" + re.escape(root.rstrip("/").split(":")[-1].lstrip("/")) + "/", "")
    return files.select(F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))).alias("path"), "value")


def visit_files(files: DataFrame, visits: DataFrame, by: list[str], system: System) -> DataFrame:
    """by, path, value: of each visit (by, folder) the system's file."""
    name, parent = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    fits = name == system.suffix if system.whole else name.endswith(system.suffix)
    own = files.where(fits).select(parent.alias("at"), "path", "value", F.lit(1).alias("own"))
    found = own.union(own.select(F.regexp_extract("at", r"^(.*)/[^/]*$", 1), "path", "value", F.lit(0))) if system.runs else own
    below = F.concat("folder", F.lit(f"/{system.below}")) if system.below else F.col("folder")
    met = found.join(visits.select(*by, below.alias("at")), "at")
    order = Window.partitionBy(*by).orderBy(F.desc("own"), F.col("path") if system.first else F.desc("path"))
    return met.withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*by, "path", "value")


def read_visits(trees: dict[str, list[DataFrame]], visits: DataFrame, by: list[str]) -> DataFrame:
    """system, by, word_idx, word, start, end, speaker of registered systems; each has one or more trees of files (path, value), of which the first with words for a visit counts."""
    columns = ["word_idx", "word", "start", "end", "speaker"]
    out = None
    for name, roots in trees.items():
        system = SYSTEMS[name]
        read = [system.reader(visit_files(files, visits, by, system).select(*by, "value"), by).select(*by, *columns) for files in roots]
        one = first_tree(read, by).select(F.lit(name).alias("system"), *by, F.col("word_idx").cast("long").alias("word_idx"), *columns[1:])
        out = one if out is None else out.unionByName(one)
    return out


def read_systems(sources: dict[str, tuple[str, DataFrame]], by: list[str]) -> DataFrame:
    """system, by, word_idx, word, start, end, speaker of all systems; sources: name of the system -> (kind of reader, texts)."""
    out = None
    for system, (kind, texts) in sources.items():
        one = READERS[kind](texts, by).select(F.lit(system).alias("system"), *by, F.col("word_idx").cast("long").alias("word_idx"), "word", "start", "end", "speaker")
        out = one if out is None else out.unionByName(one)
    return out


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header, all columns as strings."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def index_objects(listing: DataFrame, categories: dict[str, str]) -> DataFrame:
    """session, category, name of a bucket's listing (value: a path a line): the session named in the path, and the first category whose pattern the path has."""
    kind = None
    for name, pattern in categories.items():
        kind = F.when(F.col("value").rlike(pattern), name) if kind is None else kind.when(F.col("value").rlike(pattern), name)
    named = listing.select(F.regexp_extract("value", r"([^/]+)/day\d+_session\d+", 0).alias("session"), kind.alias("category"), F.trim("value").alias("name"))
    return named.where("session <> '' and category is not null")


def parse_results(texts: DataFrame, visit: str) -> DataFrame:
    """visit, system, metric, value of JSON documents system -> metric -> value; nulls and what is no number go."""
    each = texts.select(visit, F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("system", "m"))
    return each.select(visit, "system", F.explode("m").alias("metric", "v")).withColumn("value", F.col("v").try_cast("double")).where("value is not null").drop("v")


def contained_names(targets: DataFrame, files: DataFrame) -> DataFrame:
    """stem, file: of each target's stem the first file (by name) whose stem holds it; null where none does.

    Pieces of the files' names as long as any stem are joined by equality.  Names are dealt to many
    tasks first: they take few bytes and so would be read by one, and their pieces sorted by it.
    """
    lengths = targets.select(F.length("stem").alias("n")).distinct()
    sized = files.select(F.col("stem").alias("file")).withColumn("n", F.explode(F.sequence(F.lit(1), F.length("file")))).where("file <> ''").join(lengths, "n", "left_semi").repartition(TASKS, "file", "n")
    pieces = sized.select("file", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("file") - F.col("n") + 1), lambda k: F.substr(F.col("file"), k, F.col("n"))))).alias("stem"))
    return targets.select("stem").join(pieces.groupBy("stem").agg(F.min("file").alias("file")), "stem", "left")
