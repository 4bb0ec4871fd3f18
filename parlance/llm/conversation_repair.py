"""Conversation structure repair: a DP over the subsequence of turns that are retained.

The roles of a repaired conversation read ``(s?(ua)+)?``.  A turn is kept, given another role or
deleted, and empty turns may be inserted.  Between two retained turns all others are deleted, at
the price that the prefix sums of deletions tell, and what must be inserted follows from the two
roles alone.  So for each role of the last retained turn one running minimum is enough: the price
of the best repair that ends there, less the deletions up to it.

Of repairs of the same price the one with the least audit wins.  An audit is never the start of
another of the same price that covers as many turns, so two of them are decided where they first
differ, and the order of the running minima, kept as ranks, decides for all that follows them.
Hence a turn takes constant time, and a conversation streams through: of each minimum there are
its price, its rank, its edits as a linked list, and the SHA-256 of its text so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.frames import BUCKET_BYTES, bytes_of, shuffle_partitions
from parlance.llm.sql import crc32_sql

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Roles to insert between the last retained turn (or none) and the next one, and after the last.
BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
AFTER = {"": "", "s": "ua", "u": "a", "a": ""}
BLANK, DUPLICATE, CUT = 1, 2, 3
LEGAL = ("su", "ua", "au")
_WORD, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Best(NamedTuple):
    """The best repair so far whose last retained turn has a certain role."""

    price: int  #: without the deletions up to now
    rank: int  #: among the audits of all minima
    edits: tuple | None  #: (place of the turn, letters, the edits before)
    text: object  #: SHA-256 of the repaired text


def _with(text, empty: bool, lines: list[tuple[str, str]]):
    text = text.copy()
    for role, words in lines:
        text.update(f"{'' if empty else chr(10)}{role}:{words}".encode())
        empty = False
    return text


class Conversation:
    """One conversation, whose turns are added in order."""

    def __init__(self):
        self.best = {"": Best(0, 0, None, hashlib.sha256())}
        self.n = self.illegal = self.turns = 0
        self.faults = [0, 0, 0, 0]
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.n += 1
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        if fault in (BLANK, DUPLICATE):
            return  # it must go, which the prefix sum of deletions holds for all minima alike
        price = (TRUNCATED if fault == CUT else 0) - DELETE
        # Of each role that the turn can end in: price, rank and letters of the best way there, in the order that decides.
        won = {end: (b.price, b.rank, "D", end) for end, b in self.best.items()}
        for end, letter, cost in [(initial, "K", KEEP)] * (initial in AFTER and initial != "") + [(e, "R", REROLE) for e in ROLES if e != initial]:
            for start, b in self.best.items():
                between = BETWEEN.get((start, end))
                if between is not None:
                    way = (b.price + INSERT * len(between) + cost + price, b.rank, "I" * len(between) + letter, start)
                    won[end] = min(won.get(end, way), way)
        ranks = {end: k for k, (_, end) in enumerate(sorted(((way[1], way[2]), end) for end, way in won.items()))}
        best = {}
        for end, (cost, _, letters, start) in won.items():
            b = self.best[start]
            if letters == "D":
                best[end] = b._replace(rank=ranks[end])
            else:
                lines = [(ROLES[g], "") for g in BETWEEN[start, end]] + [(role if letters[-1] == "K" else ROLES[end], text)]
                best[end] = Best(cost, ranks[end], (self.n, letters, b.edits), _with(b.text, b.edits is None, lines))
        self.best = best

    def report(self, conv_id: int | None) -> tuple:
        price, _, letters, end = min((b.price + INSERT * len(AFTER[end]), b.rank, "I" * len(AFTER[end]), end) for end, b in self.best.items())
        parts, edits, upto = [letters], self.best[end].edits, self.n
        while edits is not None:
            at, letters, edits_before = edits
            parts += ["D" * (upto - at), letters]
            upto, edits = at - 1, edits_before
        parts.append("D" * upto)
        digest = _with(self.best[end].text, self.best[end].edits is None, [(ROLES[g], "") for g in AFTER[end]]).hexdigest()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (conv_id, gaps, *self.faults[1:], self.illegal, price + DELETE * self.n, "".join(reversed(parts)), digest)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows damaged by crc32(conv_id:turn) modulo 20; a null counts as one space.

    0 drops the row (it stays as one that isn't present, without text), 1 empties the text, 2 removes its
    sentence marks, 3 repeats the row, 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    words = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("kind") != 0, F.col("text"))
    damaged = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), words.alias("text"), (F.col("kind") != 0).alias("present"), F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)).alias("copies"))
    return damaged.select("conv_id", "turn", "role", "text", "present", F.explode("copies").alias("copy")).drop("copy")


def _plain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of rows of any kind."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present = F.coalesce(F.col("present"), F.lit(False)) if "present" in turns.columns else F.lit(True)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), F.when(present, text("text")).alias("text"), present.alias("present"))


def _dealt(turns: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.repartition(max(shuffle_partitions(turns.sparkSession), bytes_of(turns) // BUCKET_BYTES), "conv_id")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """All rows, and whether the row is the first of its conversation."""
    before, began = None, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield not began or row[0] != before, row
            before, began = row[0], True


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [part.split() for part in REPORT.split(", ")]
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in fields])
    done, current, conv_id = [], None, None

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema=schema)
        done.clear()
        return out

    for first, (conv, turn, role, text, present, fault) in _runs(batches):
        if first:
            if current is not None:
                done.append(current.report(conv_id))
            current, conv_id = Conversation(), conv
            if len(done) >= 4096:
                yield batch()
        if present:
            current.add(turn, role, text, fault)
    if current is not None:
        done.append(current.report(conv_id))
    yield batch()


def repair(turns: DataFrame) -> DataFrame:
    """What is wrong with each conversation and the cheapest repair: the columns of REPORT.

    ``turns`` has conv_id, turn, role, text and, if it likes, present: rows that aren't present name
    their conversation only.  Turns are taken by number, nulls first; turns of one number by role and
    text.  Nulls in role and text count as one space; rows without a conv_id are one conversation; a
    role counts by its first character, and one without (or any but s, u, a) can't be kept.  A
    conversation without turns has zeros, an empty audit and the digest of nothing; an empty table
    gives an empty result; other columns are not read.  A conversation is hashed in order and so is one
    task's work, row by row, whatever its length; only its edits are held.
    """
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(~F.col("text").rlike(_WORD), BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.col("text").rlike(_ENDED), CUT).otherwise(0)
    # Dealt by conversation, the window and the runs need no other shuffle.
    rows = _dealt(turns, _plain(turns)).withColumn("seen", seen).withColumn("fault", fault).drop("seen")
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(_reports, REPORT)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of conversations, each of which begins with its audit."""
    out: list[tuple] = []
    place, end, audit, at, conv = 0, "", "", 0, None

    def next_role() -> str:
        return "a" if end == "u" else "u"

    def batch() -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * 5
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv_id", "place", "edit", "role", "text"])
        out.clear()
        return made

    for first, (conv_id, _, role, text) in _runs(batches):
        if first:
            while at < len(audit):
                end = next_role()
                out.append((conv, place, "I", ROLES[end], ""))
                place, at = place + 1, at + 1
            place, end, audit, at, conv = 0, "", text, 0, conv_id
        else:
            while audit[at] == "I":
                end = next_role()
                out.append((conv, place, "I", ROLES[end], ""))
                place, at = place + 1, at + 1
            if audit[at] != "D":
                end = role[:1] if audit[at] == "K" else next_role()
                out.append((conv, place, audit[at], role if audit[at] == "K" else ROLES[end], text))
                place += 1
            at += 1
        if len(out) >= 4096:
            yield batch()
    while at < len(audit):
        end = next_role()
        out.append((conv, place, "I", ROLES[end], ""))
        place, at = place + 1, at + 1
    yield batch()


def repaired_turns(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text of the turns that ``reports`` (of ``repair``) leaves or inserts, in order of place."""
    rows = _plain(turns).where("present").select("conv_id", F.lit(1).alias("kind"), "role", "text", "turn")
    both = rows.union(reports.select("conv_id", F.lit(0), F.lit(""), "audit", F.lit(None).cast("long")))
    sorted_ = _dealt(turns, both).sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text").drop("turn")
    return sorted_.mapInArrow(_edited, "conv_id long, place long, edit string, role string, text string")


def repair_sql() -> str:
    """``repair(damage(conversations))`` for DuckDB."""
    space = r"[\x20\x09-\x0D]"
    between = ", ".join(f"('{a}', '{b}', '{gap}')" for (a, b), gap in BETWEEN.items())
    after = ", ".join(f"('{a}', '{gap}')" for a, gap in AFTER.items())
    lines = "CASE gap WHEN '' THEN '' ELSE array_to_string(list_transform(string_split(gap, ''), lambda g: CASE g WHEN 'u' THEN 'user:' ELSE 'assistant:' END), chr(10)) END"
    joined = lambda a, b: f"{a} || CASE WHEN {a} <> '' AND {b} <> '' THEN chr(10) ELSE '' END || {b}"
    return rf"""
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    h AS (SELECT *, {crc32_sql("key")} % 20 AS kind FROM k),
    d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM h, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS c(c)),
    o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    s AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY conv ORDER BY i) AS before FROM o),
    t AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?]{space}*$') THEN 3 ELSE 0 END AS fault FROM s),
    between_(a, b, gap) AS (VALUES {between}), after_(a, gap) AS (VALUES {after}),
    e AS (SELECT conv, i, role, text, CASE fault WHEN 3 THEN {TRUNCATED} ELSE 0 END AS extra, 'K' AS letter, role[1] AS b, role AS named FROM t WHERE fault NOT IN (1, 2)
          UNION ALL SELECT conv, i, role, text, CASE fault WHEN 3 THEN {TRUNCATED} ELSE 0 END + {REROLE}, 'R', r.b, r.named FROM t, (VALUES ('u', 'user'), ('a', 'assistant')) AS r(b, named) WHERE fault NOT IN (1, 2)),
    ways AS (SELECT conv, i, a, b, gap, extra + {INSERT} * length(gap) AS price, repeat('I', length(gap)) || letter AS letters, {joined(lines, "(named || ':' || text)")} AS lines FROM e JOIN between_ USING (b)
             UNION ALL SELECT conv, i, a, a, '', {DELETE}, 'D', '' FROM t, after_),
    dp AS (SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, '' AS a, CAST(0 AS BIGINT) AS price, '' AS audit, '' AS said FROM t
           UNION ALL
           SELECT conv, i, b, price, audit, said FROM (
             SELECT ways.conv, ways.i, ways.b, dp.price + ways.price AS price, dp.audit || letters AS audit, {joined("dp.said", "ways.lines")} AS said,
                    row_number() OVER (PARTITION BY ways.conv, ways.b ORDER BY dp.price + ways.price, dp.audit || letters) AS place
             FROM dp JOIN ways ON ways.conv = dp.conv AND ways.i = dp.i + 1 AND ways.a = dp.a) WHERE place = 1),
    n AS (SELECT conv, conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv, conv_id),
    ends AS (SELECT dp.conv, price + {INSERT} * length(gap) AS cost, audit || repeat('I', length(gap)) AS audit, {joined("said", f"({lines})")} AS said FROM dp JOIN n ON n.conv = dp.conv AND n.n = dp.i JOIN after_ USING (a)),
    best AS (SELECT conv, cost, audit, sha256(said) AS repaired_sha256 FROM ends QUALIFY row_number() OVER (PARTITION BY conv ORDER BY cost, audit) = 1),
    found AS (SELECT * FROM n JOIN best USING (conv))
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM c.conv_id"""
