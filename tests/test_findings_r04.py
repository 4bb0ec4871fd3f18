"""Cases of the findings of round 4."""

from __future__ import annotations

from parlance.operators import intervals
from parlance.plans import derived, interval_queries, retime_queries, stream_queries


#: Y overlaps both speakers by as much: the one whose name comes first has it.
TIED = [(1, 0, "system", "a b c d"), (1, 1, "system", "e f"), (1, 2, "assistant", "g h i j k")]


def _conversations(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_f6_words_meet_turns_that_come_dealt_as_they_do(spark, tmp_path):
    rows = [(v, t, "user" if t % 2 else "assistant", " ".join("abcdefgh"[: 3 + t])) for v in range(6) for t in range(5)]
    _conversations(spark, tmp_path, rows)
    w, t = derived.words(spark, str(tmp_path)), derived.turns(spark, str(tmp_path))
    found = intervals.as_of(w.select("conv_id", w["word_idx"].alias("point"), w["start"].alias("t")), t, ["conv_id"]).where("speaker is not null")
    assert found.count() == w.count() == 6 * 25
    # Turn 3 isn't heard, nor is every 11th word: 16 words are scored.
    got = {r.conv_id: (r.correct, r.scored) for r in retime_queries.word_accuracy(spark, str(tmp_path)).collect()}
    assert got == {v: (13, 16) for v in range(6)}


def test_f2_ties_of_streams_go_as_in_the_sql(spark, tmp_path):
    assert [tuple(r) for r in stream_queries.matched_streams(spark, _conversations(spark, tmp_path, TIED)).collect()] == [(1, "assistant", "Y")]


def test_f2_the_first_of_equal_assignments():
    best = lambda rows: sorted(intervals._best(dict(rows)))
    # The last of the first side's names comes earliest, whichever side is smaller.
    assert best({("a", "y"): 5e9, ("b", "y"): 5e9}.items()) == [("a", "y")]
    assert best({("a", "x"): 3000.0, ("a", "w"): 1000.0, ("a", "v"): 1000.0, ("b", "x"): 2000.0}.items()) == [("a", "x")]
    # Then a name that is left out goes before the last of the second side, and that before the first.
    assert best({("a", "x"): 1.0, ("b", "x"): 1.0, ("c", "y"): 2.0}.items()) == [("b", "x"), ("c", "y")]
    assert best({("a", "x"): 2340.0, ("a", "y"): 2340.0}.items()) == [("a", "y")]
    assert best({(a, b): 1.0 for a in "abc" for b in "xy"}.items()) == [("a", "y"), ("b", "x")]
    assert best({(a, b): 1.0 for a in "ab" for b in "xyz"}.items()) == [("a", "z"), ("b", "y")]
    assert best({}.items()) == []


def test_f1_errors_of_tied_speakers_go_as_in_the_sql(spark, tmp_path):
    events = [(1938213, "2024-01-12 10:46:15", 29550), (1938447, "2024-01-12 12:22:40", 29558), (1938996, "2024-01-12 16:12:37", 29552), (1939740, "2024-01-12 21:21:14", 29551), (1939764, "2024-01-12 21:31:24", 29556), (1939911, "2024-01-12 22:28:06", 29556)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long").selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in interval_queries.diarization_errors(spark, str(tmp_path)).collect()] == [(2955011, 2040.0, 0.0, 2340.0, 12000.0)]


def test_f4_words_of_tied_streams_go_as_in_the_sql(spark, tmp_path):
    # Every 17th word is by the other speaker, the 23rd by none; the others of zoe's turns aren't heard.
    said = [(3, "zoe", 17), (5, "user", 1), (6, "user", 3), (8, "zoe", 2), (9, "user", 1), (10, "system", 1), (13, "zoe", 9), (14, "user", 1), (18, "zoe", 16), (19, "user", 1), (23, "zoe", 16), (24, "zoe", 1)]
    got = stream_queries.reassigned_words(spark, _conversations(spark, tmp_path, [(1, t, who, "a " * n) for t, who, n in said])).collect()
    assert {r.word_idx: (r.speaker, r.moved) for r in got} == {17: ("Y", False), 18: ("X", False), 19: ("X", False), 20: ("X", False), 23: ("X", True), 24: ("Y", False), 34: ("Y", False), 51: ("Y", False), 68: ("X", False)}


def test_f5_turns_of_tied_streams_go_as_in_the_sql(spark, tmp_path):
    got = stream_queries.turn_outcomes(spark, _conversations(spark, tmp_path, TIED)).collect()
    assert {r.seg_idx: (r.speaker, r.hyp_words, r.lost_to_speaker, r.wrong_speaker) for r in got} == {0: ("unnamed (SYSTEM)", 3, True, True), 1: ("unnamed (SYSTEM)", 2, True, True), 2: ("ASSISTANT", 5, False, False)}


def test_f3_counts_of_tied_streams_go_as_in_the_sql(spark, tmp_path):
    out = stream_queries.outcome_summary(spark, _conversations(spark, tmp_path, TIED)).where("speaker <> '-'")
    assert {r.speaker: (r.turns, r.misattributed, r.lost_to_speaker) for r in out.collect()} == {"ASSISTANT": (1, 0, 0), "unnamed (SYSTEM)": (2, 2, 2)}
