"""Golden vectors of the transcript operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import align, folds, intervals, islands, reports
from parlance.sources import sinks, transcripts

BY = ["v"]


def _words(spark, runs):
    """Words of a second each, ``n`` for each (speaker, n)."""
    parts = spark.createDataFrame([(k, who, n) for k, (who, n) in enumerate(runs)], "part int, speaker string, n int")
    each = parts.select("part", "speaker", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).where("n > 0")
    at = F.row_number().over(Window.orderBy("part", "k")) - 1
    return each.select(F.lit(1).alias("v"), at.cast("long").alias("word_idx"), F.concat(F.lit("w"), at.cast("string")).alias("word"), at.cast("double").alias("start"), (at + 1).cast("double").alias("end"), "speaker")


def _segments(spark, rows):
    return spark.createDataFrame([(1, k, float(s), float(e), who) for k, (who, s, e) in enumerate(rows)], "v int, seg_idx long, start double, end double, speaker string")


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalizers(spark):
    t = F.lit("[UM] Don't, um, go-now {x}'s")
    assert _one(spark, T.headline(t)) == "don't go now x 's"
    assert _one(spark, T.alnum_only(t)) == "dont um gonow xs"
    assert _one(spark, F.array_join(T.loose_tokens(t, True), " ")) == "dont um gonow s"
    assert _one(spark, T.content_tokens(t)) == ["don't", "um", "go", "now", "x", "'s"]
    assert _one(spark, T.headline(F.lit(""))) == ""


def test_near_miss_and_kinds(spark):
    pairs = [("nine", "ninth", True), ("9th", "ninth", False), ("walk", "walking", True), ("cat", "cot", True), ("house", "mouse", True), ("red", "blue", False)]
    assert [_one(spark, T.near_miss(F.lit(a), F.lit(b))) for a, b, _ in pairs] == [x for _, _, x in pairs]
    assert [_one(spark, T.leak_kind(F.lit(x))) for x in ("maybe", "12 3", "jo", "jo ann smith lee")] == ["month or date", "number", "single word", "longer phrase"]


def test_cue_score(spark):
    assert abs(_one(spark, T.cue_score(F.lit("no i think so"), F.lit("no"))) - 2 / 3) < 1e-12
    assert _one(spark, T.cue_score(F.lit(""), F.lit(""))) == 1.0
    assert _one(spark, T.cue_score(F.lit(""), F.lit("no"))) == 0.0


def test_clock_and_buckets(spark):
    assert _one(spark, T.parse_clock(F.lit("1:00:01.5"))) == 3601.5
    assert _one(spark, T.parse_clock(F.lit("x"))) is None
    assert _one(spark, T.format_clock(F.lit(3601.5))) == "01:00:01.500"
    assert [_one(spark, T.length_bucket(F.lit(x), [1, 2, 5])) for x in (0.9, 1.0, 4.99, 5.0)] == ["<1s", "<2s", "<5s", "5s+"]


def test_assign_speakers(spark):
    segs = _segments(spark, [("A", 0, 5), ("B", 6, 10)])
    words = spark.createDataFrame([(1, k, s, e, None) for k, (s, e) in enumerate([(0.5, 1.0), (4.5, 5.5), (6.5, 7.0), (5.2, 5.8), (9.5, 11.0)])], "v int, word_idx long, start double, end double, speaker string")
    got = lambda **o: [r["speaker"] for r in intervals.assign_speakers(words, segs, BY, **o).orderBy("word_idx").collect()]
    assert got() == ["A", "A", "B", "UNKNOWN", "B"]
    assert got(nearest=True, bucket=2.0) == ["A", "A", "B", "B", "B"]
    points = spark.createDataFrame([(1, k, float(t), float(t), None) for k, t in enumerate([2, 7.5, 5, 6, 5.5, -1, 12])], words.schema)
    found = [r["speaker"] for r in intervals.assign_speakers(points, segs, BY).orderBy("word_idx").collect()]
    assert found == ["A", "B", "A", "B", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert intervals.assign_speakers(words, segs.limit(0), BY).where("speaker <> 'UNKNOWN'").count() == 0


def test_runs_and_short_run_rule(spark):
    runs = [(r["first"], r["last"]) for r in islands.speaker_runs(_words(spark, [("A", 2), ("B", 1), ("A", 3)]), BY).orderBy("first").collect()]
    assert runs == [(0, 2), (2, 3), (3, 6)]
    move = lambda *runs: {i: r["new"] for r in islands.short_run_rule(_words(spark, runs), BY).collect() for i in range(r["first"], r["last"])}
    assert move(("A", 10), ("B", 1), ("A", 10)) == {10: "A"}
    assert move(("A", 10), ("B", 4), ("A", 10)) == {}
    assert move(("A", 4), ("B", 2), ("C", 10)) == {4: "C", 5: "C"}
    assert move(("A", 8), ("B", 1), ("C", 8)) == {8: "A"}
    assert move(("B", 1), ("A", 10)) == {0: "A"}
    assert move(("A", 2)) == {}
    moved = move(("Z", 10), ("B", 1), ("A", 1), ("B", 1), ("Z", 10))
    assert moved[10] == "Z" and moved[12] == "Z"


def test_merges(spark):
    got = folds.merge_and_split(_segments(spark, [("A", 0, 20), ("A", 20.5, 24), ("A", 24.2, 60), ("B", 61, 62)]), BY).orderBy("piece").collect()
    assert [(round(r["start"], 6), round(r["end"], 6)) for r in got] == [(0, 24), (24.2, 42.1), (42.1, 60), (61, 62)]
    touching = islands.merge_touching(_segments(spark, [("A", 0, 2), ("A", 2, 4), ("A", 5, 6)]), BY).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in touching] == [(0, 4), (5, 6)]
    tiles = islands.tiled_spans(spark.createDataFrame([(1, 0, 0.0, 1.0, "A"), (1, 1, 1.5, 2.0, "A"), (1, 2, 3.0, 4.0, "B")], "v int, word_idx long, start double, end double, speaker string"), BY)
    assert [(r["speaker"], r["start"], r["end"]) for r in tiles.orderBy("start").collect()] == [("A", 0, 3), ("B", 3, 4)]
    over = intervals.overlap_lengths(_segments(spark, [("A", 0, 5)]), _segments(spark, [("X", 3, 7), ("X", 8, 9)]), BY).collect()
    assert [r["overlap"] for r in over] == [2.0]


def test_assignment_and_error_rate(spark):
    m = spark.createDataFrame([(1, "r0", "h0", 5.0), (1, "r0", "h1", 4.0), (1, "r1", "h0", 4.0), (1, "r1", "h1", 1.0)], "v int, a_speaker string, b_speaker string, overlap double")
    got = intervals.assign_labels(m, BY).collect()
    assert sum(r["overlap"] for r in got) == 8 and {(r["a_speaker"], r["b_speaker"]) for r in got} == {("r0", "h1"), ("r1", "h0")}
    ref, hyp = _segments(spark, [("A", 0, 10), ("B", 10, 20)]), _segments(spark, [("X", 0, 12), ("Y", 14, 22)])
    mapping = intervals.assign_labels(intervals.overlap_lengths(ref, hyp, BY), BY)
    e = intervals.error_rate(ref, hyp, BY, mapping).first()
    assert (e["missed"], e["false_alarm"], e["confusion"], e["total"]) == (2, 2, 2, 20)


def test_alignment(spark):
    pairs = spark.createDataFrame([(1, list("abcd"), list("axc")), (2, [], ["a"]), (3, list("ab"), list("ab"))], "k int, ref array<string>, hyp array<string>")
    e = {r["k"]: r for r in align.word_errors(pairs, ["k"]).collect()}
    assert (e[1]["hits"], e[1]["substitutions"], e[1]["deletions"], e[1]["insertions"], e[1]["wer"]) == (2, 1, 1, 0, 0.5)
    assert e[2]["wer"] == 1.0 and e[3]["wer"] == 0.0
    ref, hyp = "i met jo smith and redacted".split(), "i met personname and date".split()
    ops = [o[1:] for o in align.opcodes(ref, hyp)]
    assert ops == [(0, 2, 0, 2), (2, 4, 2, 3), (4, 5, 3, 4), (5, 6, 4, 5)]
    assert align.project(ops, 2, 4) == (0, 5) and align.project(ops, 5, 6) == (2, 7)
    assert align.best_similarity("jo smith", ["the", "jo", "smith"])[0] == 1.0


def test_edit_path_is_shortest():
    import random

    rng = random.Random(3)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        path = align.edit_path(a, b)
        assert sum(t != "hit" for t, _, _ in path) == row[-1]
        assert sum(t != "insert" for t, _, _ in path) == len(a) and sum(t != "delete" for t, _, _ in path) == len(b)


def test_placeholders_and_sources(spark):
    w = spark.createDataFrame([(1, k, t) for k, t in enumerate(["[DATE].", "[DATE].", "ok", "[UM", "[AGE]"])], "v int, word_idx long, word string")
    assert [(r["first"], r["last"], r["label"]) for r in islands.collapse_placeholders(w, BY).orderBy("first").collect()] == [(0, 2, "DATE"), (4, 5, "AGE")]
    text = "S1 00:00:01.500 hello there\ncontinued line\nS2: 0:04 [okay?] yes\nS1 1:00:00 bye"
    got = transcripts.parse_turns(spark.createDataFrame([(1, text)], "v int, value string"), BY, F.lit(0.0)).orderBy("turn_idx").collect()
    assert [(r["speaker"], r["start"], r["end"], r["text"]) for r in got] == [("S1", 1.5, 4.0, "hello there continued line"), ("S2:", 4.0, 3600.0, "okay yes"), ("S1", 3600.0, 3600.0, "bye")]
    json = spark.createDataFrame([(1, '{"words":[{"startOffset":1.0,"endOffset":0.5,"word":"a","speakerLabel":"0"},{"word":" "}]}')], "v int, value string")
    assert [(r["word"], r["end"], r["speaker"]) for r in transcripts.parse_vendor(json, BY).collect()] == [("a", 1.0, "SPEAKER_00")]
    little = lambda n, size: n.to_bytes(size, "little")
    form = b"fmt " + little(16, 4) + little(1, 2) + little(2, 2) + little(8000, 4) + little(32000, 4) + little(4, 2) + little(16, 2)
    whole = b"RIFF" + bytes(4) + b"WAVE" + b"LIST" + little(5, 4) + bytes(6) + form + b"data" + little(32000, 4)
    open_ended = b"RIFF" + bytes(4) + b"WAVE" + form + b"data" + little(0xFFFFFFFF, 4)
    files = [("whole", whole, 99999), ("open", open_ended, 44 + 64000), ("headless", b"RIFF" + bytes(4) + b"WAVE" + form, 44 + 96000), ("other", b"RIFX", 10), ("none", None, 0)]
    wav = {r["path"]: (r["channels"], r["rate"], r["bits"], r["seconds"]) for r in transcripts.wav_headers(spark.createDataFrame(files, "path string, content binary, length long")).collect()}
    assert wav == {"whole": (2, 8000, 16, 1.0), "open": (2, 8000, 16, 2.0), "headless": (2, 8000, 16, 3.0)}


def test_sessions_are_never_overwritten(spark, tmp_path):
    w = spark.createDataFrame([("v1", "A", 0, "hi", 0.0, 0.5, "matched"), ("v1", "A", 1, "um", 0.5, 0.6, "inserted")], "visit string, speaker string, word_idx long, word string, start double, end double, origin string")
    t = spark.createDataFrame([("v1", 0, "A", 0.0, None, "hi um")], "visit string, turn long, speaker string, start double, end double, text string")
    meta = spark.createDataFrame([("v1", 1.5)], "visit string, seconds double")
    first, second = (sinks.write_sessions(w, t, meta, str(tmp_path), "r", inserted=True) for _ in range(2))
    assert first.endswith("run=r") and second.endswith("run=r-2")
    assert [r["value"] for r in spark.read.text(f"{first}/transcripts").collect()] == ["[0.00 - ?] A: hi um"] and spark.read.json(f"{second}/inserted").count() == 1


def test_tables_and_reports(spark):
    rows = spark.createDataFrame([("b", 0.1234, 3), ("a", None, 1)], "name string, rate double, n int")
    assert [tuple(r) for r in sinks.shown_table(rows, {"rate": "pct", "n": "int"}, ["name"]).collect()] == [("a", None, "1"), ("b", "12.34", "3")]
    assert sinks.report(rows.orderBy("name").collect(), "name", {"rate": "pct", "n": "int"}) == "a\n  n: 1\n\nb\n  rate: 12.34%\n  n: 3"
    assert "rttm/train.rttm" in sinks.database_yml("D", "P", ["train"])


def test_windows_and_reports(spark):
    words = spark.createDataFrame([(1, k, s, e) for k, (s, e) in enumerate([(1.0, 3.0), (2.0, None), (4.5, 9.0), (5.0, 6.0), (None, 3.0)])], "v int, word_idx long, start double, end double")
    assert [(r["start"], r["end"]) for r in intervals.clip(words, F.lit(2.0), F.lit(5.0)).orderBy("start").collect()] == [(2, 5), (4.5, 5)]
    v = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 10)], "g int, x double")
    q = reports.quartiles_exclusive(v, ["g"], "x").first()
    assert (q["q1"], q["q2"], q["q3"]) == (1.5, 3, 7)
    assert reports.upper_median(v.where("x < 10"), ["g"], "x").first()["median"] == 3
    p = spark.range(1).select(*[c.alias(k) for k, c in reports.precision_recall(F.lit(2), F.lit(1), F.lit(2)).items()]).first()
    assert (round(p["precision"], 4), p["recall"], round(p["f1"], 4), p["under"], p["over"], p["net"]) == (0.6667, 0.5, 0.5714, 0.5, 0.25, -0.25)
    assert sinks.rttm(_segments(spark, [("A", 0, 1.5)]), "speaker").first()["value"].startswith("SPEAKER A 1 0.000 1.500")


def test_every_query_has_columns(spark):
    from parlance import queries

    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_repair(spark):
    from parlance.operators import repair

    w = _words(spark, [("A", 2)])
    changed = repair.apply_changes(w, spark.createDataFrame([(1, 0, "B"), (1, 1, "A")], "v int, word_idx long, new string"), BY, "rule")
    got = {r["word_idx"]: (r["speaker"], r["speaker_from"], r["speaker_by"]) for r in changed.collect()}
    assert got == {0: ("B", "A", "rule"), 1: ("A", None, None)}
    assert repair.differences(w, changed, BY).count() == 0 and repair.differences(w, w.where("word_idx = 0"), BY).count() == 1
    named = spark.createDataFrame([(1, 0, "Smith's,"), (1, 1, "said")], "v int, word_idx long, word string")
    shown = repair.apply_labels(named, spark.createDataFrame([(1, 0, "NAME")], "v int, word_idx long, label string"), BY)
    assert {r["word"] for r in shown.collect()} == {"[NAME]'s,", "said"}
    pairs = spark.createDataFrame([(1, list("abc"), ["X", "X", "Y"], list("zabqc"))], "v int, ref array<string>, speakers array<string>, hyp array<string>")
    got = repair.attach_speakers(pairs, BY)
    assert [(r["speaker"], r["origin"]) for r in got.where("word_idx is not null").orderBy("word_idx").collect()] == [("X", "inserted"), ("X", "matched"), ("X", "matched"), ("X", "inserted"), ("Y", "matched")]
    assert [r["dropped"] for r in got.where("word_idx is null").collect()] == [0]
    pairs = spark.createDataFrame([(1, [], [], ["a"]), (2, ["x", "y"], ["P", "Q"], ["a"]), (3, ["x", "y"], ["P", "Q"], [])], "v int, ref array<string>, speakers array<string>, hyp array<string>")
    got = {(r["v"], r["word_idx"]): (r["speaker"], r["origin"], r["dropped"]) for r in repair.attach_speakers(pairs, BY).collect()}
    assert got == {(1, 0): ("UNKNOWN", "inserted", None), (1, None): (None, None, 0), (2, 0): ("P", "matched", None), (2, None): (None, None, 0), (3, None): (None, None, 2)}


def test_nearest_over_whole_tables(spark, tmp_path):
    """The queries against brute force, with points and segments far beyond the first two days, ties and a room without segments."""
    import random
    from datetime import datetime, timedelta

    from parlance.plans import derived, interval_queries

    rng = random.Random(4)
    rows = [(k, 70 if k in (1, 2) else rng.randrange(2), datetime(2024, 1, 1) + timedelta(seconds=600 * rng.randrange(30 * 144))) for k in range(600)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    segs, points = derived.segments(spark, str(tmp_path)).collect(), derived.points(spark, str(tmp_path)).collect()
    turn, speaker = {}, {}
    for p in points:
        mine = [s for s in segs if s["room"] == p["room"]]
        if mine:
            turn[p["word_idx"]] = min(mine, key=lambda s: (not s["start"] <= p["start"] <= s["end"], 0 if s["start"] <= p["start"] <= s["end"] else abs(s["start"] - p["start"]), s["seg_idx"]))["seg_idx"]
        shared, at = {}, {}
        for s in mine:
            if min(p["end"], s["end"]) > max(p["start"], s["start"]):
                shared[s["speaker"]] = shared.get(s["speaker"], 0) + min(p["end"], s["end"]) - max(p["start"], s["start"])
                at[s["speaker"]] = min(at.get(s["speaker"], s["seg_idx"]), s["seg_idx"])
        holds = [s for s in mine if p["end"] <= p["start"] and s["start"] <= p["start"] <= s["end"]]
        near = min(mine, key=lambda s: (abs((p["start"] + p["end"]) / 2 - (s["start"] + s["end"]) / 2), s["seg_idx"]), default={"speaker": "UNKNOWN"})
        speaker[p["word_idx"]] = max(shared, key=lambda w: (shared[w], -at[w])) if shared else min(holds, key=lambda s: s["seg_idx"])["speaker"] if holds else near["speaker"]
    assert {r["point"]: r["seg_idx"] for r in interval_queries.QUERIES["nearest_turn"][0](spark, str(tmp_path)).collect()} == turn
    assert {r["word_idx"]: r["speaker"] for r in interval_queries.QUERIES["assign_nearest"][0](spark, str(tmp_path)).collect()} == speaker
    assert len(speaker) == 400 and {1, 2}.isdisjoint(turn)


def test_diarization_errors_of_all_days(spark, tmp_path):
    """A segment late in the month counts as much as one on the first day."""
    from datetime import datetime

    from parlance.plans import interval_queries

    rows = [(3, 0, datetime(2024, 1, 1)), (6, 0, datetime(2024, 1, 29)), (21, 0, datetime(2024, 1, 30))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {n: interval_queries.QUERIES[n][0](spark, str(tmp_path)).agg(*[F.sum(c).alias(c) for c in ("missed", "false_alarm", "confusion", "total")]).first() for n in ("diarization_errors", "diarization_errors_collar")}
    e = got["diarization_errors"]
    assert (e["missed"], e["false_alarm"], e["confusion"], e["total"]) == (60 + 60 + 600, 0, 0, 2400 + 4200 + 600)
    e = got["diarization_errors_collar"]
    assert (e["missed"], e["total"]) == (0, 2400 + 4200 + 600 - 3 * 120)


def test_claims_equal_brute_force():
    import random

    import numpy as np

    def brute(start, end, free, low, high):
        best = (0.0, -1, -1)
        for i in range(len(start)):
            if not free[i] or end[i] <= low:
                continue
            for j in range(i, len(start)):
                if not free[j] or start[j] >= high:
                    break
                shared, whole = min(end[j], high) - max(start[i], low), max(end[j], high) - min(start[i], low)
                if whole > 0 and shared / whole > best[0]:
                    best = (shared / whole, i, j)
        return best

    rng = random.Random(1)
    for k in range(3000):
        n = rng.randrange(1, 9)
        start = [rng.randrange(16) / 2 for _ in range(n)]
        end = [x + rng.choice([0, 0.25, 0.5, 1, 3]) for x in start]
        start, end = (sorted(start), sorted(end)) if k % 3 else (start, end)
        free, low = [rng.random() < 0.75 for _ in range(n)], rng.randrange(18) / 2 - 0.5
        high = low + rng.randrange(12) / 2
        assert folds.best_run(np.array(start), np.array(end), np.array(free), low, high) == brute(start, end, free, low, high)


def _talk(spark, folder, turns):
    rows = [(1, k, "user" if k % 2 else "assistant", " ".join(f"w{k}x{i}" for i in range(12))) for k in range(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")


def test_claimed_segments_of_all_turns(spark, tmp_path):
    from parlance.plans import word_queries

    _talk(spark, tmp_path, 9)
    got = {r["seg_idx"]: (r["first"], r["last"]) for r in word_queries.claimed_segments(spark, str(tmp_path)).collect()}
    assert got == {k + 1: (12 * k + (12 * k % 11 == 0), 12 * k + 12 - ((12 * k + 11) % 11 == 0)) for k in range(9)}


def test_blocks_of_long_sequences_equal_difflib():
    import difflib
    import random

    rng = random.Random(2)
    for k in range(2000):
        letters = "abcdefghijklmnop"[: rng.randrange(1, 16)]
        a = [rng.choice(letters) for _ in range(rng.randrange(30))]
        b = [x if rng.random() < 0.8 else rng.choice(letters) for x in a if rng.random() < 0.8] if k % 2 else [rng.choice(letters) for _ in range(rng.randrange(30))]
        assert align.opcodes(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_attached_speakers_of_all_turns(spark, tmp_path):
    from parlance.plans import repair_queries

    _talk(spark, tmp_path, 9)
    got = [r["speaker"] for r in repair_queries.attached_speakers(spark, str(tmp_path)).orderBy("word_idx").collect()]
    assert len(got) == sum(i % 11 > 0 for i in range(108))
    assert set(got[len(got) - 10 :]) == {"assistant"}


def test_covered_turns(spark):
    """The cap counts from the first start; the last kept turn ends where the one that went starts."""
    t = _segments(spark, [("A", 100, 105), ("B", 110, 115), ("A", 130, 140), ("B", 200, 210)])
    got = lambda cap: [(r["start"], r["end"]) for r in intervals.covered_turns(t, BY, cap).orderBy("seg_idx").collect()]
    assert got(None) == [(100, 105), (110, 115), (130, 200)]
    assert got(50) == [(100, 105), (110, 130)] and got(10) == [] and got(1000) == got(None)
    assert intervals.covered_turns(_segments(spark, [("A", 5, 6), ("B", 5, 9)]), BY).count() == 0


def test_nearest_word_at_any_distance(spark):
    turns = _segments(spark, [("A", 0, 10), ("A", 100, 110), ("A", 55, 60)])
    words = spark.createDataFrame([(1, 0, 20.0, 51.0), (1, 1, 30.0, 31.0), (1, 2, 109.0, 112.0), (1, 3, None, 5.0)], "v int, word_idx long, start double, end double")
    assert [r["nearest"] for r in intervals.nearest_word(turns, words, BY).orderBy("seg_idx").collect()] == [10, 0, 4]
    assert [r["nearest"] for r in intervals.band_counts(turns, words, BY).orderBy("seg_idx").collect()] == [10, 0, 4]
    assert [r["nearest"] for r in intervals.nearest_word(turns, words.limit(0), BY).collect()] == [None] * 3


def test_close_segments_within_a_long_one(spark):
    t = _segments(spark, [("A", 0, 100), ("A", 10, 20), ("A", 100.2, 110), ("A", 111, 112), ("B", 112, 113), ("A", 112.1, 114)])
    assert [(r["start"], r["end"]) for r in islands.merge_close(t, BY).orderBy("seg").collect()] == [(0, 110), (111, 112), (112, 113), (112.1, 114)]


def test_paused_turns_with_unknown_ends(spark):
    rows = [(0, 1, "A"), (1.5, None, "B"), (5, 6, "B"), (9, None, "B"), (30, None, "B"), (31, 32, "B"), (33, 34, "B")]
    w = spark.createDataFrame([(1, k, float(s), e and float(e), who) for k, (s, e, who) in enumerate(rows)], "v int, word_idx long, start double, end double, speaker string")
    got = [(r["start"], r["end"], r["n_words"]) for r in islands.paused_turns(w, BY).orderBy("turn").collect()]
    assert got == [(0, 1, 1), (1.5, 6, 2), (9, 34, 4)]


def test_overlap_of_a_side_with_itself(spark):
    both = lambda x, y: [r["overlap"] for r in intervals.overlap_lengths(_segments(spark, [("A", *s) for s in x]), _segments(spark, [("X", *s) for s in y]), BY).collect()]
    assert both([(0, 4), (2, 10)], [(1, 9)]) == [10]
    assert both([(0, 10), (1, 2)], [(0, 1.5), (3, 4)]) == [2.5]
    assert both([(0, 1)], [(1, 2)]) == []


def test_captions_with_unknown_ends(spark):
    rows = [("a", 0.0, 1.0, "A"), ("b", 1.0, None, "A"), ("c", 2.0, 3.0, "A"), ("d", 3.0, None, "A"), ("e", 5.0, None, "A"), ("f", None, None, "B"), (" ", 9.0, 9.5, "A")]
    w = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "v int, word_idx long, word string, start double, end double, speaker string")
    got = [(r["speaker"], r["start"], r["end"], r["text"]) for r in folds.caption_cues(w, BY).orderBy("cue").collect()]
    assert got == [("A", 0, 3, "a b c d"), ("A", 5, 5, "e"), ("B", 0, None, "f")]


def test_error_taxonomy_knows_repetitions(spark, tmp_path):
    from parlance.plans import word_queries

    pairs = spark.createDataFrame([(1, 0, ["a", "b", "yeah"], ["a", "a", "b", "like", "x"])], "conv_id long, turn int, ref array<string>, hyp array<string>")
    before = word_queries._pairs
    try:
        word_queries._pairs = lambda *a: pairs
        got = {r["kind"]: r["n"] for r in word_queries.error_taxonomy(spark, "").collect()}
    finally:
        word_queries._pairs = before
    assert got["repetition"] == 1 and got.get("discourse marker", 0) + got.get("other insertion", 0) == 1


def test_exposed_spans(spark):
    spans = spark.createDataFrame([(1, 0, 2), (1, 600, 1200), (1, 5, 5), (2, 0, 2)], "v int, first long, last long")
    covers = spark.createDataFrame([(1, 2, 4), (1, 1199, 1300), (2, 1, 2), (2, 7, 7)], "v int, first long, last long")
    assert sorted(tuple(r) for r in intervals.exposed(spans, covers, BY).collect()) == [(1, 0, 2), (1, 5, 5)]


def _turns(spark, rows):
    return spark.createDataFrame([(1, k, who, float(s), None if e is None else float(e), text) for k, (who, s, e, text) in enumerate(rows)], "v int, seg_idx long, speaker string, start double, end double, text string")


def _said(spark, rows):
    return spark.createDataFrame([(1, k, word, s, e, who) for k, (word, s, e, who) in enumerate(rows)], "v int, word_idx long, word string, start double, end double, speaker string")


def test_streams_and_strays(spark):
    from parlance.operators import streams

    t = _turns(spark, [("A:", 0, 4, "one two three four five"), ("S2:", 4, 5, "um yes"), ("A:", 5, None, "six")])
    ref = streams.reference_streams(t, BY)
    got = {r["speaker"]: (r["text"], [tuple(s) for s in r["spans"]]) for r in ref.collect()}
    assert got == {"A:": ("one two three four five six", [(0, 4), (5, 5)]), "S2:": ("um yes", [(4, 5)])}
    assert [(r["speaker"], r["strays"]) for r in streams.without_strays(ref, BY).collect()] == [("A:", 1)]
    assert sorted((r["speaker"], r["strays"]) for r in streams.without_strays(ref, BY, 50).collect()) == [("A:", 0), ("S2:", 0)]


def test_stream_scores(spark):
    """A bad match costs no more than a missing one; streams without words are no streams."""
    from parlance.operators import streams

    ref = spark.createDataFrame([(1, "A", "one", []), (1, "B", "two three", []), (1, "C", "um", []), (1, "D", "four", [])], "v int, speaker string, text string, spans array<struct<start:double,end:double>>")
    hyp = spark.createDataFrame([(1, "x", "a b c d", []), (1, "y", "two four", []), (1, "z", "um", [])], "v int, speaker string, text string, spans array<struct<start:double,end:double>>")
    mapping = spark.createDataFrame([(1, "A", "x"), (1, "B", "y"), (1, "D", "z")], "v int, a_speaker string, b_speaker string")
    scores = streams.stream_scores(ref, hyp, mapping, BY)
    assert {r["speaker"]: (r["raw"], r["capped"]) for r in scores.collect()} == {"A": (4, 1), "B": (0.5, 0.5), "D": (1, 1)}
    m = streams.stream_means(scores, BY).first()
    assert (m["streams"], round(m["swer"], 9), round(m["swer_uncapped"], 9)) == (3, round(2.5 / 3, 9), round(5.5 / 3, 9))


def test_words_of_unmatched_speakers(spark):
    from parlance.operators import streams

    t = _turns(spark, [("A", 0, 10, "a"), ("B", 10, 20, "b")])
    w = _said(spark, [("a", 1.0, 2.0, "x"), ("b", 11.0, 12.0, "y"), ("c", 9.0, 12.0, None), ("d", 30.0, 31.0, "third"), ("e", None, 5.0, "third")])
    mapping = spark.createDataFrame([(1, "A", "x"), (1, "B", "y")], "v int, a_speaker string, b_speaker string")
    got = [(r["speaker"], r["moved"]) for r in streams.reassigned(w, streams.reference_streams(t, BY), mapping, BY).orderBy("word_idx").collect()]
    assert got == [("x", False), ("y", False), ("y", True), ("y", True), ("third", False)]
    assert streams.reassigned(w, streams.reference_streams(t, BY), mapping.limit(0), BY).where("moved").count() == 0


def test_visit_scores(spark):
    from parlance.operators import streams

    t = _turns(spark, [("A", 0, 10, "one two three four five"), ("B", 10, 20, "six seven eight nine ten")])
    w = [(x, float(k), k + 0.5, "x") for k, x in enumerate("one two three four five".split())] + [(x, 10.0 + k, 10.5 + k, "y") for k, x in enumerate("six seven eight wrong ten".split())]
    r = streams.visit_scores(t, _said(spark, w), BY).first()
    assert (r["wer"], r["wer_sub"], r["wer_del"], r["wer_ins"], r["wer_no_ins"], r["swer"], r["qtp"], r["phantom_streams"], r["unmatched_hyp_words"]) == (0.1, 0.1, 0, 0, 0.1, 0.1, 1, 0, 0)
    assert r["der"] is not None and r["der_confusion"] == 0


def test_attribution(spark):
    """Of more predicted labels than true ones only the first by name can be read as any."""
    from parlance.operators import streams

    segs = _segments(spark, [("G", 0, 10)])
    w = _said(spark, [("a", 1.0, 2.0, "p1"), ("b", 2.0, 3.0, "p2"), ("c", 3.0, 4.0, "p2"), ("d", 50.0, 51.0, "p2")])
    assert tuple(streams.attribution(w, segs, BY).select("correct", "scored").first()) == (1, 3)


def test_variants_leave_out_overlap(spark):
    from parlance.operators import streams

    ref, hyp = _segments(spark, [("A", 0, 10), ("B", 8, 12)]), _segments(spark, [("A", 0, 12)])
    same = spark.createDataFrame([(1, "A", "A")], "v int, a_speaker string, b_speaker string")
    got = {r["variant"]: (r["missed"], r["confusion"], r["total"], r["der"]) for r in streams.diarization_variants(ref, hyp, BY, same, {"all": (0.0, False), "alone": (0.0, True)}).collect()}
    assert got == {"all": (2, 2, 14, 4 / 14), "alone": (0, 2, 10, 0.2)}


def test_turn_outcomes(spark):
    from parlance.operators import outcomes

    t = _turns(spark, [("A", 0, 1, "hello there"), ("B", 10, 11, "yes"), ("A", 30, 31, "[noise]"), ("B", 40, 50, "one one two")])
    w = _said(spark, [("hello", 0.1, 0.4, "x"), ("there", 1.2, 1.4, "x"), ("one", 41.0, 42.0, "y"), ("three", 42.0, 43.0, "y"), ("yes", 13.0, 13.5, "y")])
    got = {r["seg_idx"]: r for r in outcomes.turn_outcomes(t, w, BY).collect()}
    pick = lambda k: (got[k]["recovered"], got[k]["recovered_wide"], got[k]["lost_entirely"], got[k]["nearest_word"], got[k]["content_lost"], got[k]["previous_bucket"])
    assert pick(0) == (1.0, 1.0, False, None, False, "first turn") and pick(1) == (0.0, 1.0, True, 2.0, True, "<2s")
    assert pick(2) == (None, None, True, 10.0, False, "<2s") and pick(3)[:2] == (0.3333, 0.3333)
    whole = outcomes.summary(outcomes.turn_outcomes(t, w, BY)).where("length_bucket = '-' and previous_bucket = '-' and speaker = '-'").first()
    assert (whole["turns"], whole["content_scored"], whole["lost_entirely"], whole["lost_with_distance"], whole["over_five"]) == (4, 3, 2, 2, 0.5)


def test_corrections_of_a_model(spark):
    """What an answer changes and why others are refused."""
    from parlance.operators import corrections

    said = [("right.", "A"), ("so", "A"), ("how", "A"), ("are", "A"), ("you?", "A"), ("fine", "B"), ("thanks", "B"), ("ok", "A")]
    w = _said(spark, [(x, float(k), k + 0.5, who) for k, (x, who) in enumerate(said)])
    kind = "v int, request int, first_run int, runs int, place int, turn int, text string, speaker string, action string, valid boolean, unreadable boolean"
    rows = [
        (0, "how are you", "B", "split"), (0, "How, are you?", "B", "split"), (0, "are you", "A", "split"), (1, "fine thanks", "A", "reassign"), (1, "thanks", "B", "split"), (1, "not said", "A", "split"),
        (9, "ok", "B", "reassign"), (2, "ok", "nobody", "reassign"), (2, "  ", "B", "reassign"), (0, "so how", "B", "split"), (0, "right so how are you", "B", "split"),
    ]
    entries = [(1, 0, 0, 3, k, *r, True, False) for k, r in enumerate(rows)] + [(1, 0, 0, 3, 50, None, None, None, None, False, False), (1, 1, 0, 3, 0, None, None, None, None, None, True)]
    got = corrections.corrected(w, spark.createDataFrame(entries, kind), BY, most=4)
    assert {r["word_idx"]: r["new"] for r in got.where("word_idx is not null").collect()} == {2: "B", 3: "B", 4: "B", 5: "A", 6: "A"}
    n = got.where("word_idx is null").first()["report"]
    assert {k: v for k, v in n.items() if v} == {
        "corrections_proposed": 12, "corrections_applied": 2, "applied_split": 1, "applied_reassign": 1, "words_moved": 5, "duplicate": 1, "rejected_speaker": 3, "unmatched": 3, "malformed": 1, "rejected_conflict": 1, "rejected_long": 1, "chunk_failures": 1,
    }
    none = corrections.corrected(w, spark.createDataFrame([], kind), BY)
    assert none.where("word_idx is not null").count() == 0 and none.count() == 1


def test_validated_replies(spark):
    from parlance.operators import corrections

    fixes = F.from_json(F.lit('[{"original":"two words"},{"original":"three words here"},{"original":""},{"original":"absent"}]'), "array<struct<original:string>>")
    flags = F.from_json(F.lit('[{"reasoning":"says \\"no\\""},{"reasoning":"none"},{}]'), "array<struct<reasoning:string>>")
    r = spark.range(1).select(corrections.held_corrections(fixes, F.lit("in two words, three words here")).alias("a"), corrections.reasoned_flags(flags).alias("b")).first()
    assert [x["original"] for x in r["a"]] == ["two words"] and len(r["b"]) == 1


def test_projection_equals_the_plain_one(spark):
    import random

    from parlance.operators import privacy

    rng = random.Random(5)
    ref = [rng.choice("abcdef") for _ in range(40)]
    hyp = [x if rng.random() < 0.8 else "z" for x in ref if rng.random() < 0.9]
    ops = [o[1:] for o in align.opcodes(ref, hyp)]
    blocks = spark.createDataFrame([(1, *o) for o in ops], "v int, i1 int, i2 int, j1 int, j2 int")
    spans = spark.createDataFrame([(1, a, a + n) for a in range(38) for n in (1, 2)], "v int, first int, last int")
    assert {(r["first"], r["last"]): (r["low"], r["high"]) for r in privacy.projected(spans, blocks, BY).collect()} == {(a, a + n): align.project(ops, a, a + n) for a in range(38) for n in (1, 2)}
    back = [(j1, j2, i1, i2) for i1, i2, j1, j2 in ops]
    assert all((r["low"], r["high"]) == align.project(back, r["first"], r["last"]) for r in privacy.projected_back(spans.where("last < 30"), blocks, BY).collect())
