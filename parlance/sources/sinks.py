"""Writers: annotation lines, captions, tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import format_clock


def rttm(segments: DataFrame, uri: str) -> DataFrame:
    """A line for each segment: recording, start, duration and speaker."""
    return segments.select(F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", uri, "start", F.col("end") - F.col("start"), "speaker").alias("value"))


def uem(spans: DataFrame, uri: str) -> DataFrame:
    return spans.select(F.format_string("%s NA %.3f %.3f", uri, "start", "end").alias("value"))


def vtt(cues: DataFrame, by: list[str]) -> DataFrame:
    """A WebVTT text for each recording."""
    block = F.concat(format_clock(F.col("start")), F.lit(" --> "), format_clock(F.col("end")), F.lit("\n"), F.col("speaker"), F.lit(": "), F.col("text"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cue", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return cues.groupBy(*by).agg(F.concat(F.lit("WEBVTT\n\n"), body, F.lit("\n")).alias("value"))


def srt(cues: DataFrame, by: list[str]) -> DataFrame:
    """A SubRip text for each recording; cues are numbered from 1."""
    block = F.concat((F.col("cue") + 1).cast("string"), F.lit("\n"), format_clock(F.col("start"), True), F.lit(" --> "), format_clock(F.col("end"), True), F.lit("\n"), F.col("speaker"), F.lit(": "), F.col("text"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cue", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return cues.groupBy(*by).agg(F.concat(body, F.lit("\n")).alias("value"))


def results(metrics: DataFrame, visit: str, system: str) -> DataFrame:
    """One JSON document for each visit: system -> metrics."""
    rest = [c for c in metrics.columns if c not in (visit, system)]
    entry = F.struct(F.col(system).alias("key"), F.struct(*rest).alias("value"))
    return metrics.groupBy(visit).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def lst(names: DataFrame, uri: str) -> DataFrame:
    """A line for each recording."""
    return names.select(F.col(uri).cast("string").alias("value")).distinct()


def database_yml(database: str, protocol: str, parts: list[str]) -> str:
    """The file that names a protocol's lists, annotations and scored regions."""
    lines = ["Databases:", f"  {database}: audio/{{uri}}.wav", "Protocols:", f"  {database}:", "    SpeakerDiarization:", f"      {protocol}:"]
    for part in parts:
        lines += [f"        {part}:", f"          uri: lists/{part}.lst", f"          annotation: rttm/{part}.rttm", f"          annotated: uem/{part}.uem"]
    return "\n".join(lines) + "\n"


def role_lines(turns: DataFrame, roles: DataFrame, by: list[str]) -> DataFrame:
    """by, value: turns as lines ``[start - end] role: text`` in order, ``?`` for times that aren't known; speakers without a role (by, speaker, role) keep their name."""
    time = lambda c: F.when(F.col(c).isNull(), "?").otherwise(F.format_string("%.2f", F.col(c)))
    named = turns.join(roles.select(*by, "speaker", "role"), [*by, "speaker"], "left")
    line = F.concat(F.lit("["), time("start"), F.lit(" - "), time("end"), F.lit("] "), F.coalesce("role", "speaker"), F.lit(": "), F.trim("text"))
    return named.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))


def report(rows: list, label: str, formats: dict[str, str]) -> str:
    """A block for each row of a report: its label, and a line for each measure that it has."""
    shown = {"pct": lambda v: f"{100 * v:.2f}%", "raw_pct": lambda v: f"{v:.2f}%", "ratio": lambda v: f"{v:.4f}", "int": lambda v: f"{int(v):,}"}
    blocks = []
    for row in rows:
        lines = [f"  {name}: {shown[kind](row[name]) if kind in shown else row[name]}" for name, kind in formats.items() if row[name] is not None]
        blocks.append("\n".join([str(row[label]), *lines]))
    return "\n\n".join(blocks)


def _free(spark, path: str) -> str:
    """The path, or the first of path-2, path-3, ... that isn't there yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    k = 1
    while True:
        name = path if k == 1 else f"{path}-{k}"
        if not hadoop(name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(name)):
            return name
        k += 1


def write_sessions(words: DataFrame, turns: DataFrame, metadata: DataFrame, path: str, run: str, inserted: bool = False) -> str:
    """A run's folder, which is returned: word JSON by visit and speaker, turns as JSON and as lines, metadata; with ``inserted``, also the words that have this origin.

    An existing run stays as it is: another gets the next number.
    """
    folder = _free(words.sparkSession, f"{path}/run={run}")
    words.write.partitionBy("visit", "speaker").json(f"{folder}/words")
    turns.write.partitionBy("visit").json(f"{folder}/turns")
    role_lines(turns, turns.select("visit", "speaker", F.col("speaker").alias("role")).distinct(), ["visit"]).write.partitionBy("visit").text(f"{folder}/transcripts")
    metadata.write.json(f"{folder}/metadata")
    if inserted:
        words.where("origin = 'inserted'").write.partitionBy("visit").json(f"{folder}/inserted")
    return folder


def shown_table(rows: DataFrame, formats: dict[str, str], order: list[str] | None = None) -> DataFrame:
    """Columns as text: int, pct (hundredths, two places), raw_pct (two places), ratio (four places) or plain; in order, if one is given."""
    shown = {"int": lambda c: F.format_string("%d", F.col(c).cast("long")), "pct": lambda c: F.format_string("%.2f", F.col(c) * 100), "raw_pct": lambda c: F.format_string("%.2f", F.col(c)), "ratio": lambda c: F.format_string("%.4f", F.col(c))}
    rows = rows.orderBy(*order) if order else rows
    return rows.select([F.when(F.col(c).isNotNull(), shown[formats[c]](c)).alias(c) if formats.get(c) in shown else F.col(c) for c in rows.columns])


def write_table(rows: DataFrame, path: str, formats: dict[str, str], order: list[str] | None = None) -> None:
    """CSV of such a table with a header; files in order hold ranges of an ordered table."""
    shown_table(rows, formats, order).write.mode("errorifexists").option("header", True).csv(path)


#: Orders of the per-span, per-turn, insertion, exposure and worst-visit tables.
ORDERS = {
    "leaks": ["subject", "session", "span", "system"], "turns": ["visit", "seg_idx", "system"], "insertions": ["site", "subject", "session", "system", "first"], "exposure": ["visit", "system"], "worst": ["rank"],
}
