"""Cases of the findings of round 3."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from parlance.operators import align, corrections, folds, intervals, privacy, streams
from parlance.plans import derived, interval_queries, token_queries
from parlance.sources import transcripts


def _touched(spark, nearest):
    words = spark.createDataFrame([(1, 0, 5.0, 5.0, None), (1, 1, 10.0, 10.0, None), (1, 2, 5.0, 6.0, None)], "room long, word_idx long, start double, end double, speaker string")
    segments = spark.createDataFrame([(1, 0, 0.0, 5.0, "A"), (1, 1, 4.0, 9.0, "B"), (1, 2, 10.0, 12.0, "C"), (1, 3, 9.0, 11.0, "D")], "room long, seg_idx long, start double, end double, speaker string")
    return {r.word_idx: r.speaker for r in intervals.assign_speakers(words, segments, ["room"], nearest).collect()}


def test_f1_a_word_without_extent_goes_to_the_first_segment_that_touches_it(spark):
    assert _touched(spark, nearest=True) == {0: "A", 1: "C", 2: "B"}


def test_f2_the_same_without_nearest(spark):
    assert _touched(spark, nearest=False) == {0: "A", 1: "C", 2: "B"}


def test_f2_rooms_of_users_below_zero_and_days_before_1970(spark, tmp_path):
    rows = [(3, "1969-12-31 23:59:58", -7), (4, "1969-12-31 23:59:59.5", -7), (5, "1970-01-01 00:00:00.5", 7), (7, "1969-12-30 23:59:59.5", 17), (8, "1970-01-01 00:00:01", None)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.word_idx: (r.room, r.speaker) for r in interval_queries.assign_speakers(spark, str(tmp_path)).collect()}
    assert got == {4: (-19724, "S-3"), 5: (-19723, "UNKNOWN"), 7: (1000 - 19725, "UNKNOWN"), 8: (None, "UNKNOWN")}


def test_f11_short_names_are_dealt_to_many_tasks(spark):
    targets = spark.createDataFrame([("1",), ("12",), ("99",), ("v",)], "stem string")
    files = spark.createDataFrame([(f"v{k}_x",) for k in range(12, 40)], "stem string").coalesce(1)
    out = transcripts.contained_names(targets, files)
    assert {r.stem: r.file for r in out.collect()} == {"1": "v12_x", "12": "v12_x", "99": None, "v": "v12_x"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and f", {transcripts.TASKS}" in plan


def test_f10_f13_f14_f18_f21_f22_f24_few_rows_are_python_objects_at_a_time():
    batch = pa.RecordBatch.from_pydict({"x": [[str(k)] * 3 for k in range(1000)]})
    got = list(align.parts([batch, batch]))
    assert max(b.num_rows for b in got) <= 64
    assert [x for b in got for x in b.column("x").to_pylist()] == batch.column("x").to_pylist() * 2


def test_f10_claims_of_many_recordings(spark):
    n = 300
    words = spark.createDataFrame([(v, k, k * 1.0, k + 0.5) for v in range(n) for k in range(4)], "v long, word_idx long, start double, end double")
    segments = spark.createDataFrame([(v, s, 2.0 * s, 2.0 * s + 1.5) for v in range(n) for s in range(2)], "v long, seg_idx long, start double, end double")
    got = folds.claim_segments(words.coalesce(1), segments.coalesce(1), ["v"]).collect()
    assert sorted(map(tuple, got)) == [(v, s, 2 * s, 2 * s + 2, 1.0) for v in range(n) for s in range(2)]


def test_f21_edit_paths_take_few_bits():
    ref = [str(k * k % 101) for k in range(6000)]
    hyp = ["zz" if k % 7 == 0 else t for k, t in enumerate(ref) if k % 11]
    tracemalloc.start()
    path = align.edit_path(ref, hyp)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    i = sum(t != "insert" for t, _, _ in path)
    j = sum(t != "delete" for t, _, _ in path)
    assert (i, j) == (len(ref), len(hyp)) and all(ref[i] == hyp[j] for t, i, j in path if t == "hit")
    assert peak < 2_500_000


def test_f12_visits_are_dealt_to_many_tasks(spark):
    turns = spark.createDataFrame([(v, 0, "A", 0.0, 9.0, "a b c d e f") for v in range(30)], "v long, seg_idx long, speaker string, start double, end double, text string").coalesce(1)
    words = spark.createDataFrame([(v, k, w, k * 1.0, k + 0.5, "X") for v in range(30) for k, w in enumerate("abcdxf")], "v long, word_idx long, word string, start double, end double, speaker string").coalesce(1)
    out = streams.visit_scores(turns, words, ["v"])
    assert {r.v: r.wer for r in out.collect()} == {v: 1 / 6 for v in range(30)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count(f", {align.TASKS}") == 2


def test_f12_distances_without_paths():
    for k in range(200):
        ref, hyp = [str(j * (k + 3) % 7) for j in range(k % 13)], [str(j * (k + 5) % 5) for j in range(k % 11)]
        assert align.edit_distance(ref, hyp) == sum(t != "hit" for t, _, _ in align.edit_path(ref, hyp))


def test_f15_errors_are_swept_without_joins_of_boundaries(spark):
    ref = spark.createDataFrame([(1, "A", 0.0, 10.0), (1, "A", 8.0, 12.0), (1, "B", 9.0, 20.0), (1, None, 30.0, 31.0), (2, "A", 0.0, 1.0)], "room long, speaker string, start double, end double")
    hyp = spark.createDataFrame([(1, "A", 1.0, 9.5), (1, "X", 10.0, 22.0), (3, "A", 0.0, 2.0)], "room long, speaker string, start double, end double")
    same = spark.createDataFrame([(1, "A", "A")], "room long, a_speaker string, b_speaker string")
    out = streams.diarization_variants(ref, hyp, ["room"], same, {"all": (0.0, False), "collar": (2.0, False), "alone": (0.0, True)})
    got = {(r.variant, r.room): (r.missed, r.false_alarm, r.confusion, r.total) for r in out.collect()}
    assert got == {
        ("all", 1): (4.5, 2.0, 10.0, 23.0), ("all", 2): (1.0, 0.0, 0.0, 1.0), ("all", 3): (0.0, 2.0, 0.0, 0.0),
        ("collar", 1): (0.0, 1.0, 6.0, 12.0), ("collar", 3): (0.0, 2.0, 0.0, 0.0),
        ("alone", 1): (1.0, 2.0, 8.0, 17.0), ("alone", 2): (1.0, 0.0, 0.0, 1.0), ("alone", 3): (0.0, 2.0, 0.0, 0.0),
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "bucket" not in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f16_f19_turns_are_counted_and_dealt_not_words(spark, tmp_path):
    rows = [(1, 0, "user", "a b"), (1, 2, "user", "e g h"), (1, 2, "zoe", "f"), (1, 1, "assistant", "c  d"), (1, 3, "user", None), (2, None, "user", "x"), (2, 0, "user", "y z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    w = derived.words(spark, str(tmp_path))
    got = [(r.conv_id, r.turn, r.word, r.word_idx) for r in w.orderBy("conv_id", "word_idx").collect()]
    assert got == [(1, 0, "a", 0), (1, 0, "b", 1), (1, 1, "c", 2), (1, 1, "d", 3), (1, 2, "e", 4), (1, 2, "f", 5), (1, 2, "g", 6), (1, 2, "h", 7), (2, None, "x", 0), (2, 0, "y", 1), (2, 0, "z", 2)]
    t = derived.turns(spark, str(tmp_path))
    assert {(r.conv_id, r.seg_idx): (r.start, r.end, r.text) for r in t.collect()} == {(1, 0): (0.0, 0.75, "a b"), (1, 1): (1.0, 1.75, "c d"), (1, 2): (2.0, 3.75, "e f g h"), (2, None): (0.0, 0.25, "x"), (2, 0): (0.5, 1.25, "y z")}
    plan = _plan(w)
    assert "RepartitionByExpression" in plan and plan.index("Generate") < plan.index("Window")
    assert "Generate" not in _plan(t)
    # Both sides come dealt alike, and Spark takes their union for dealt so: it is dealt anew.
    near = intervals.nearest_word(t, w.select("conv_id", "start", "end"), ["conv_id"])
    assert {r.nearest for r in near.collect()} == {0.0} and f", {align.TASKS}" in _plan(near)


def test_f19_streams_are_swept_from_their_spans(spark):
    turns = spark.createDataFrame([(1, 0, "A", 0.0, 4.0, "a"), (1, 1, "B", 4.0, None, "b"), (1, 2, "A", None, 9.0, "c")], "v long, seg_idx long, speaker string, start double, end double, text string")
    words = spark.createDataFrame([(1, 1, "w", 3.0, 3.5, "X"), (1, 0, "w", 1.0, 2.0, "X"), (1, 2, "w", 3.5, 5.0, None)], "v long, word_idx long, word string, start double, end double, speaker string")
    out = streams.matched_streams(streams.reference_streams(turns, ["v"]), streams.word_streams(words, ["v"]), ["v"])
    assert sorted(map(tuple, out.collect())) == [(1, "A", "X")]
    assert "Generate" not in _plan(out) and "Union" not in _plan(out)


def test_f17_each_word_is_folded_once(spark):
    texts = spark.createDataFrame([(1, "a b a d")], "v long, text string")
    words = spark.createDataFrame([(1, k, w) for k, w in enumerate(["a", "b", "a", "d", None])] + [(2, 0, "a")], "v long, word_idx long, word string")
    given = spark.createDataFrame([(1, 0, "a", "b"), (1, 1, "b", "c"), (1, 2, "b d", "e"), (1, 3, "x", "y"), (1, 4, "c", " ")], "v long, place long, original string, suggested string")
    _, spoken, report = corrections.with_corrections(texts, words, given, ["v"])
    assert {(r.v, r.word_idx): r.word for r in spoken.collect()} == {(1, 0): "c", (1, 1): "c", (1, 2): "c", (1, 3): "d", (1, 4): None, (2, 0): "a"}
    assert {r.place: r.word_replacements for r in report.collect()} == {0: 2, 1: 3, 2: 0, 3: 0}
    assert "posexplode" not in _plan(report)


def test_f20_texts_of_all_forms_are_read_in_one_pass(spark):
    words = '[{"word": "a", "start": 0.5, "end": 1, "speaker": "A"}, {"word": "b", "start": 1, "end": 2, "speaker": "A"}, {"word": "c", "start": 2, "end": 3}]'
    texts = [(1, "lost\nA 0:01 x\n\n  y\r\nB 0:05.5 z"), (2, '{"turns": [{"speaker": "A", "start": 1, "end": 2, "text": "t"}, {"speaker": "A", "start": 3, "text": null}]}'), (3, words), (4, f'{{"words": {words}}}'), (5, None), (6, "")]
    out = transcripts.load_turns(spark.createDataFrame(texts, "v long, value string"), ["v"], F.lit(9.0))
    three = [(0, "A", 0.5, 2.0, "a b"), (1, None, 2.0, 3.0, "c")]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[:2]) == [
        (1, 0, "A", 1.0, 5.5, "x y"), (1, 1, "B", 5.5, 9.0, "z"), (2, 0, "A", 1.0, 2.0, "t"), (2, 1, "A", 3.0, None, None), *[(v, *r) for v in (3, 4) for r in three],
    ]
    assert "Union" not in _plan(out)


def test_f23_speakers_travel_beside_tokens(spark):
    side = lambda rows: spark.createDataFrame(rows, "v long, place long, token string, speaker string")
    ref = side([(1, k, t, s) for k, (t, s) in enumerate(zip("abcd", ["S1", "S1", "S2", "S2"]))] + [(2, 0, "a", "S1"), (3, 0, "a", "S1")])
    hyp = side([(1, k, t, s) for k, (t, s) in enumerate(zip("abxcd", ["2", "2", "1", "1", "2"]))] + [(3, 0, "b", "S1")])
    out = streams.relabelled_word_errors(ref, hyp, ["v"])
    assert {r.v: tuple(r)[1:] for r in out.collect()} == {1: (0.25, 1, 4, 1), 2: (1.0, 0, 0, None), 3: (0.0, 0, 0, 0)}
    assert _plan(out).count("Join") == 1


def test_f18_rewrites_stay_in_the_rows_of_their_turns(spark, tmp_path):
    replies = [(1, 0, "I saw Ann in May", "I saw [PERSON_NAME] in [DATE]"), (1, 1, "a b c d e f g h", "a [DATE] [AGE] d e f g h"), (1, None, "a b", "a b"), (2, 0, "a b c d e f g", "a b c [DATE] d e f [FOO]"), (3, 0, "a b", None)]
    out = privacy.rewritten_turns(spark.createDataFrame(replies, "v long, turn long, text string, reply string").withColumn("words", F.split("text", " ")), ["v", "turn"])
    got = {(r.v, r.turn): (r.accepted, r.unmatched, [tuple(x) for x in r.labels]) for r in out.collect()}
    assert got == {(1, 0): (True, 0, [(2, "PERSON_NAME"), (4, "DATE")]), (1, 1): (True, 0, [(1, "DATE"), (2, "AGE")]), (1, None): (False, 0, []), (2, 0): (True, 2, []), (3, 0): (False, 0, [])}
    rows = [(1, 0, "user", " ".join("abcdefg")), (1, 1, "user", "h i"), (1, 1, "zoe", "j"), (1, 2, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    query = token_queries.rewritten_turns(spark, str(tmp_path))
    assert {r.turn: (r.accepted, r.unmatched, r.labels) for r in query.collect()} == {0: (True, 0, "0:PERSON_NAME 1:PERSON_NAME 4:DATE 5:DATE"), 1: (False, 0, "")}
    for plan in map(_plan, (out, query)):
        assert "Join" not in plan and "Generate" not in plan
