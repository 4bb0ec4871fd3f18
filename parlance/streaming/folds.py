"""Folds over the words of live visits in order of event time: turns across speakers, and windows of limited length.

Words wait in state until the watermark has passed them, as until then one before them may
still come; then they are folded in order of time.  What is open stays in state until no word
that is still to come can belong to it.  Needs a state store that keeps several states to a key
(``spark.sql.streaming.stateStore.providerClass``: RocksDB).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State store that holds more than one state for a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPEN = "number long, speaker string, begin double, last double, n long, upto double"
_WORD = "at double, until double, word_idx long, speaker string"


class Open(NamedTuple):
    """What is not closed yet: its number, speaker, first start, last end and words."""

    number: int
    speaker: str | None
    begin: float
    last: float
    n: int


class Turns(NamedTuple):
    """A turn ends with another speaker's word or a pause of more than ``gap`` seconds."""

    gap: float = 2.0

    def closes(self, held: Open, start: float, end: float, speaker: str | None) -> bool:
        return speaker != held.speaker or start - held.last > self.gap

    def over(self, held: Open, now: float) -> bool:
        """Whether no word that starts after ``now`` belongs to it."""
        return now - held.last > self.gap

    def deadline(self, held: Open) -> float:
        return held.last + self.gap


class Windows(NamedTuple):
    """A window ends with ``most`` words, before it gets longer than ``longest`` seconds, or at a pause of ``split`` once it has ``least``."""

    longest: float = 26.0
    most: int = 90
    split: float = 2.0
    least: float = 3.0

    def closes(self, held: Open, start: float, end: float, speaker: str | None) -> bool:
        return held.n >= self.most or end - held.begin > self.longest or (start - held.last >= self.split and held.last - held.begin >= self.least)

    def over(self, held: Open, now: float) -> bool:
        return held.n >= self.most or now - held.begin > self.longest or (now - held.last >= self.split and held.last - held.begin >= self.least)

    def deadline(self, held: Open) -> float:
        until = held.begin + self.longest
        return min(until, held.last + self.split) if held.last - held.begin >= self.least else until


class _Fold(StatefulProcessor):
    def __init__(self, rule: Turns | Windows):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WORD)
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["until"], r["word_idx"], r["speaker"]) for r in rows]
        return self._drained(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._drained(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _drained(self, key, new: list[tuple], watermark: int) -> Iterator[Row]:
        now = watermark / 1000
        *fields, upto = self.open.get() if self.open.exists() else (-1, None, 0.0, 0.0, 0, float("-inf"))
        held, early = Open(*fields), []
        # What was folded up to some time takes no words from before it any more.
        words = sorted([tuple(w) for w in self.waiting.get()] + [w for w in new if w[0] > upto], key=lambda w: (w[0], w[2]))
        for at, until, idx, speaker in words:
            if at > now:
                early.append((at, until, idx, speaker))
            elif held.n and not self.rule.closes(held, at, until, speaker):
                held = held._replace(last=max(held.last, until), n=held.n + 1)
            else:
                if held.n:
                    yield self._row(key, held)
                held = Open(held.number + 1, speaker, at, max(at, until), 1)
        if held.n and self.rule.over(held, now):
            yield self._row(key, held)
            held = held._replace(n=0)  # only the number goes on
        if early:
            self.waiting.put(early)
        else:
            self.waiting.clear()
        self.open.update((*held, max(now, upto)))
        times = [early[0][0]] if early else []
        if held.n:
            times.append(self.rule.deadline(held))
        if times:
            self.handle.registerTimer(int(max(min(times), now) * 1000) + 1)

    def _row(self, key, held: Open) -> Row:
        return Row(visit=key[0], number=held.number, speaker=held.speaker, start=held.begin, end=held.last, n_words=held.n)


def _folded(words: DataFrame, rule: Turns | Windows, late: str) -> DataFrame:
    seconds = lambda c: (F.unix_micros(c) / 1e6).alias
    rows = words.withWatermark("ts", late).select("visit", "ts", seconds(F.col("ts"))("at"), seconds(F.coalesce("ts_end", "ts"))("until"), "word_idx", "speaker")
    schema = "visit string, number long, speaker string, start double, end double, n_words long"
    return rows.groupBy("visit").transformWithState(_Fold(rule), schema, "Append", "EventTime")


def turns_across_speakers(words: DataFrame, gap: float = 2.0, late: str = "30 seconds") -> DataFrame:
    """visit, number, speaker, start, end (seconds), n_words of each turn once it is over; words: visit, word_idx, speaker, ts, ts_end.

    Words from before what is folded already are dropped; a word without an end ends where it starts.
    """
    return _folded(words, Turns(gap), late)


def limited_windows(words: DataFrame, longest: float = 26.0, most: int = 90, split: float = 2.0, least: float = 3.0, late: str = "30 seconds") -> DataFrame:
    """The same of windows as ``retime.windows`` cuts them, whoever speaks (speaker is the first word's)."""
    return _folded(words, Windows(longest, most, split, least), late)
