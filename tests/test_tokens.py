"""Alignments as tables, tokens and owners, rewritten turns, renamed speakers, forced times, requests and answers."""

import difflib
import json
import math
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import align, corrections, privacy, retime, streams, tokens
from parlance.sources import transcripts

BY = ["v"]


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def test_edit_path_within_memory():
    rng = random.Random(6)
    a = [str(int(rng.paretovariate(0.4))) for _ in range(6000)]
    b = [w if rng.random() < 0.85 else "zz" for w in a if rng.random() < 0.9]
    tracemalloc.start()
    path = align.edit_path(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # a whole table would take 4 * 6000 * 5400 bytes
    i = j = errors = 0
    for tag, x, y in path:
        assert (x, y) == (i, j) and (tag != "hit" or a[i] == b[j])
        i, j, errors = i + (tag != "insert"), j + (tag != "delete"), errors + (tag != "hit")
    row = list(range(len(b) + 1))
    for k, t in enumerate(a, 1):
        last, row = row, [k]
        for m, u in enumerate(b, 1):
            row.append(min(last[m] + 1, row[m - 1] + 1, last[m - 1] + (t != u)))
        if k == 300:
            break
    assert (i, j) == (len(a), len(b)) and errors < len(a) and sum(s[0] != "hit" for s in align.edit_path(a[:300], b)) == row[-1]


def test_edit_paths_with_few_rows_kept(monkeypatch):
    """The path doesn't depend on how many rows are kept."""
    rng = random.Random(3)
    pairs = [tuple([str(rng.randrange(k)) for _ in range(rng.randrange(30))] for _ in "ab") for k in (2, 4, 20) for _ in range(200)]
    whole = [align.edit_path(a, b) for a, b in pairs]
    monkeypatch.setattr(align, "SMALL", 0)
    assert [align.edit_path(a, b) for a, b in pairs] == whole


@pytest.mark.parametrize("most", [0, 15, 1 << 22])
def test_blocks_equal_difflib(monkeypatch, most):
    monkeypatch.setattr(align, "MOST_PLACES", most)
    rng = random.Random(most)
    for _ in range(300):
        k = rng.choice([1, 2, 5, 30])
        a, b = ([str(rng.randrange(k)) for _ in range(rng.randrange(25))] for _ in "ab")
        assert align.opcodes(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_alignment_of_tables(spark):
    side = lambda rows: frame(spark, "v int, place long, token string", rows)
    ref = side([(1, k, t) for k, t in enumerate("a b c d e".split())] + [(2, 0, "x")])
    hyp = side([(1, k, t) for k, t in enumerate("a q c d".split())] + [(3, 0, "y")]).repartition(3)
    got = sorted(tuple(r) for r in align.alignment(ref, hyp, BY).collect())
    assert got == [(1, "delete", 4, 5, 4, 4), (1, "equal", 0, 1, 0, 1), (1, "equal", 2, 4, 2, 4), (1, "replace", 1, 2, 1, 2), (2, "delete", 0, 1, 0, 0), (3, "insert", 0, 0, 0, 1)]


def test_from_tokens_to_spans_and_leaks(spark):
    """A name that one block carries over is read where it stands, one that was replaced isn't."""
    said = "my name is Ann Lee and I live in Rome".split()
    heard = "my name is Ann Lee and I live in home".split()
    side = lambda ws: frame(spark, "v int, place long, token string", [(1, k, w.lower()) for k, w in enumerate(ws)])
    blocks = align.alignment(side(said), side(heard), BY)
    spans = frame(spark, "v int, first long, last long, surface string, scrubbed boolean", [(1, 3, 5, "Ann Lee", False), (1, 9, 10, "Rome", False), (1, 9, 10, "", True)])
    placed = privacy.projected(spans, blocks, BY)
    assert {(r["first"], r["low"], r["high"]) for r in placed.collect()} == {(3, 1, 7), (9, 7, 12)}
    found = privacy.leaks(placed, frame(spark, "v int, tokens array<string>", [(1, [w.lower() for w in heard])]), BY)
    assert {(r["surface"], r["testable"], r["leaked"]) for r in found.collect()} == {("Ann Lee", True, True), ("Rome", True, False), ("", False, False)}


def test_anchors_are_equal_words(spark):
    side = lambda ws: frame(spark, "v int, place long, token string", [(1, k, w) for k, w in enumerate(ws)])
    blocks = align.alignment(side("a b c".split()), side("a x c".split()), BY)
    heard = frame(spark, "v int, j long, start double, end double", [(1, 0, 1.0, 1.5), (1, 1, 2.0, 2.5), (1, 2, 3.0, 3.5)])
    assert sorted((r["word_idx"], r["a_start"]) for r in retime.anchors(blocks, heard, BY).collect()) == [(0, 1.0), (2, 3.0)]


def test_tracked_tokens(spark):
    items = frame(spark, "v int, word_idx long, word string", [(1, 0, "Well-known,"), (1, 1, "[UM]"), (1, 2, "um"), (1, 3, "It's"), (2, 0, "[so"), (2, 1, "on]"), (3, 0, "um")])
    got = sorted(tuple(r) for r in tokens.tracked_tokens(items, BY).collect())
    assert got == [(1, 0, "well", 0), (1, 1, "known", 0), (1, 2, "it's", 3), (2, 0, "so", 0), (2, 1, "on", 1)]
    assert {tuple(r) for r in tokens.intact_visits(items, BY).collect()} == {(1, 3, True), (2, 2, False), (3, 0, True)}


REWRITES = [
    # words, reply, accepted, unmatched, labels
    ("I saw Ann today", "I saw [PERSON_NAME] today", True, 0, [(2, "PERSON_NAME")]),
    ("in Boston , Massachusetts now then and there", "in [LOCATION], [US_STATE] now then and there", True, 0, [(1, "LOCATION"), (3, "LOCATION")]),
    ("from Boston, Massachusetts now and then", "from [LOCATION], [US_STATE] now and then", True, 0, [(1, "LOCATION"), (2, "US_STATE")]),
    ("Ann's dog barks at me", "[PERSON_NAME]'s dog barks at me", True, 0, [(0, "PERSON_NAME")]),
    ("a b c d e f g h i j", "a [DATE] b c d e f g h i j", True, 1, []),
    ("a b c d e f g h i j", "a [HOSPITAL] c d e f g h i j", True, 1, []),
    ("a b c d e f g h i j", "a [dog] c d e f g h i j", True, 0, []),
    ("a [DATE] c", "a [DATE] c", True, 0, []),
    ("a b c d e f", "no no no no no no", False, 0, []),
    ("a b c d e f g h i j k", "a [DATE] k", False, 0, []),
    ("", "a", False, 0, []),
    ("a", "", False, 0, []),
]


def test_rewritten_turns(spark):
    rows = [(k, said.split(), reply) for k, (said, reply, *_) in enumerate(REWRITES)]
    got = privacy.rewritten_turns(frame(spark, "k int, words array<string>, reply string", rows), ["k"]).orderBy("k").collect()
    assert [(r["accepted"], r["unmatched"], [tuple(x) for x in r["labels"]]) for r in got] == [tuple(r[2:]) for r in REWRITES]


def test_relabelled_word_errors(spark):
    side = lambda rows: frame(spark, "v int, place long, token string, speaker string", [(v, k, t, s) for v, ts in rows.items() for k, (t, s) in enumerate(ts)])
    ref = side({1: [("a", "S1"), ("b", "S2"), ("c", "S3"), ("d", "S1")], 2: [("a", "S1"), ("b", "S1")], 3: [("a", "S1")], 4: [("a", "S9")], 5: [("a", "S1")]})
    hyp = side({1: [("a", "S2"), ("b", "S3"), ("x", "S1"), ("d", "2")], 2: [("a", "S1"), ("b", "S2")], 3: [("q", "S1")], 4: [("a", "S1")]})
    got = {r["v"]: tuple(r)[1:] for r in streams.relabelled_word_errors(ref, hyp, BY).collect()}
    # 1: the speakers S1, S2, S3 and 2 make four; shift 3 sends S2 to S1, S3 to S2.  2: either shift is wrong once, the lesser wins.  4: always wrong.
    assert got == {1: (0.0, 0, 3, 3), 2: (0.5, 1, 2, 0), 3: (0.0, 0, 0, 0), 4: (1.0, 0, 0, None), 5: (1.0, 0, 0, None)}


def test_refined_turns(spark):
    turns = frame(spark, "v int, seg_idx long, speaker string, start double, end double, text string", [(1, 0, "A", 0.0, 2.0, "one two"), (1, 1, "B", 2.0, 3.0, "  "), (1, 2, "A", 3.0, 9.0, "three"), (1, 3, "B", 9.0, 12.0, "four five")])
    words = frame(spark, "v int, word_idx long, start double, end double", [(1, 0, 0.2, 0.5), (1, 1, 0.6, 1.4), (1, 2, 7.0, 7.5), (1, 3, 9.5, 9.7), (1, 4, 9.8, 9.5)])
    got = [(r["start"], r["end"], r["outcome"]) for r in retime.refined_turns(turns, words, BY, 2.0).orderBy("seg_idx").collect()]
    assert got == [(0.2, 1.4, "refined"), (2.0, 3.0, "fallback_empty"), (3.0, 9.0, "fallback_drift"), (9.0, 12.0, "fallback_drift")]
    less = words.where("word_idx < 4")
    assert {r["outcome"] for r in retime.refined_turns(turns, less, BY, 2.0, strict=False).collect()} == {"word_count_mismatch"}
    with pytest.raises(Exception, match="transcript 5 vs aligned 4"):
        retime.refined_turns(turns, less, BY, 2.0).collect()


def said(spark, runs):
    rows, k = [], 0
    for who, text in runs:
        for w in text.split():
            rows.append((1, k, w, float(k), k + 0.5, who))
            k += 1
    return frame(spark, "v int, word_idx long, word string, start double, end double, speaker string", rows)


def windows_by_hand(sizes, budget, overlap):
    out, current = [], []
    for k, n in enumerate(sizes):
        if current and sum(sizes[i] for i in current) + n > budget:
            out.append(current)
            current = current[-overlap:] if overlap else []
        current = [*current, k]
    return [*out, current]


@pytest.mark.parametrize("overlap", [0, 1, 4])
def test_requests_overlap(spark, overlap):
    rng = random.Random(overlap)
    sizes = [rng.choice([1, 3, 9, 40]) for _ in range(60)]
    lines = frame(spark, "v int, run long, measured string", [(1, k, "x" * n) for k, n in enumerate(sizes)])
    for budget in (12, 30, 10_000):
        got = [list(range(r["first_run"], r["first_run"] + r["runs"])) for r in corrections.requests(lines, BY, F.length, budget, overlap).orderBy("request").collect()]
        assert got == windows_by_hand(sizes, budget, overlap)


def test_lines_as_a_model_sees_them(spark):
    w = frame(spark, "v int, word_idx long, word string, start double, end double, speaker string", [(1, 0, "So", 3661.25, 3661.5, "A"), (1, 1, "no", 3662.75, 3663.0, None)])
    lines = corrections.shown_turns(w, BY).orderBy("run").collect()
    assert [r["line"] for r in lines] == ["0  A  [01:01:01.2  ----]  So", "1  UNKNOWN  [01:01:02.8 +1.2s]  no"]


def review(spark, runs, answer, **more):
    """The counters that aren't zero, and the words that moved."""
    got = corrections.reviewed(said(spark, runs), BY, answer, F.length, **more).collect()
    report = next(r["report"] for r in got if r["word_idx"] is None)
    return {k: v for k, v in report.items() if v}, {r["word_idx"]: r["new"] for r in got if r["word_idx"] is not None}


TALK = [("A", "did you sleep no well"), ("B", "not really a b c d e f g"), ("A", "fine")]


@pytest.mark.parametrize(
    "entries, counters, moved",
    [
        ([(0, "no", "B", "split")], {"corrections_proposed": 1, "corrections_applied": 1, "applied_split": 1, "words_moved": 1}, {3: "B"}),
        ([(0, "No,", "B", " Reassign ")], {"corrections_proposed": 1, "corrections_applied": 1, "applied_reassign": 1, "words_moved": 1}, {3: "B"}),
        ([(0, "maybe", "B", "split"), (1, "no", "A", "split"), (7, "no", "B", "split"), (-1, "no", "B", "split")], {"corrections_proposed": 4, "unmatched": 4}, {}),
        ([(0, "no", "C", "split"), (0, "no", "A", "split")], {"corrections_proposed": 2, "rejected_speaker": 2}, {}),
        ([(1, "not really a b c d e", "A", "split")], {"corrections_proposed": 1, "rejected_long": 1}, {}),
        ([(1, "not really a b c d", "A", "split")], {"corrections_proposed": 1, "corrections_applied": 1, "applied_split": 1, "words_moved": 6}, {k: "A" for k in range(5, 11)}),
        ([(0, "no", "B", "split"), (0, "no well", "B", "split")], {"corrections_proposed": 2, "corrections_applied": 1, "applied_split": 1, "words_moved": 1, "rejected_conflict": 1}, {3: "B"}),
        ([(0, "no", "B", "split"), (0, "no", "B", "split")], {"corrections_proposed": 2, "corrections_applied": 1, "applied_split": 1, "words_moved": 1, "duplicate": 1}, {3: "B"}),
        ([(0, "no", "B", "shout"), (0, " ", "B", "split"), (0, "no", "", "split")], {"corrections_proposed": 3, "malformed": 3}, {}),
        ([], {}, {}),
    ],
)
def test_answers_of_a_model(spark, entries, counters, moved):
    reply = json.dumps([dict(zip(("turn", "text", "speaker", "action"), e)) for e in entries])
    assert review(spark, TALK, lambda prompt: f"Sure.\n```json\n{reply}\n```") == (counters, moved)


def test_failed_requests_are_counted(spark):
    def broken(prompt):
        raise RuntimeError("no model")

    assert review(spark, TALK, broken) == ({"chunk_failures": 1}, {})
    assert review(spark, TALK, lambda prompt: "nothing to say") == ({"chunk_failures": 1}, {})


def test_turns_that_are_shown_twice(spark):
    """Numbers are those of the request; the same answer from the next request is a duplicate, not a conflict."""
    runs = [("AB"[k % 2], f"turn number {k} no end") for k in range(8)]

    def ask(prompt):
        lines = [line.split("  ") for line in prompt.split("\n")]
        assert [int(line[0]) for line in lines] == list(range(len(lines)))
        return json.dumps([{"turn": int(line[0]), "text": "no", "speaker": "B" if line[1] == "A" else "A", "action": "split"} for line in lines])

    counters, moved = review(spark, runs, ask, budget=250, overlap=2)
    assert counters["duplicate"] > 0 and counters["corrections_applied"] == counters["words_moved"] == len(moved) == 8 and "rejected_conflict" not in counters
    assert counters["corrections_proposed"] == 8 + counters["duplicate"]


def test_replies_without_entries(spark):
    replies = frame(spark, "k int, reply string", [(1, "[]"), (2, "what?"), (3, None), (4, '[{"turn": 1, "text": " no ", "speaker": "A", "action": "SPLIT"}]')])
    got = {(r["k"], r["unreadable"], r["valid"], r["text"], r["action"]) for r in transcripts.parse_corrections(replies, ["k"]).collect()}
    assert got == {(2, True, None, None, None), (3, True, None, None, None), (4, False, True, "no", "split")}


def test_visit_scores_equal_the_operators(spark):
    """One pass over a visit gives what the operators give one by one."""
    rng = random.Random(5)
    turns, words = [], []
    for v in range(12):
        at = 0.0
        for k in range(rng.randrange(1, 9)):
            text = " ".join(rng.choice("no i think so um yes maybe we go home [laughs] today".split()) for _ in range(rng.randrange(0, 14)))
            end = rng.choice([None, at + rng.random() * 9])
            turns.append((v, k, rng.choice(["A", "B", "guest"]), at, end, text))
            for w in text.split():
                if rng.random() < 0.85:
                    s = round(at + rng.random() * 9, 3)
                    words.append((v, len(words), rng.choice([w, w, w, "zz"]), rng.choice([s, s, s, s, None]), s + rng.choice([0.2, 1.5]), rng.choice(["x", "y", "z", "", None])))
            at += rng.random() * 8
    t = frame(spark, "v int, seg_idx long, speaker string, start double, end double, text string", turns)
    w = frame(spark, "v int, word_idx long, word string, start double, end double, speaker string", words)
    ref, hyp = streams.reference_streams(t, BY), streams.word_streams(w, BY)
    scored = streams.without_strays(ref, BY)
    mapping = streams.matched_streams(scored, hyp, BY)
    repaired = streams.reassigned(w, ref, mapping, BY)
    means = lambda words: streams.stream_means(streams.stream_scores(scored, words, mapping, BY), BY)
    parts = means(streams.word_streams(repaired, BY)).join(means(hyp).select("v", F.col("swer").alias("swer_unmatched_dropped")), "v")
    parts = parts.join(repaired.groupBy("v").agg(F.count_if("moved").alias("unmatched_hyp_words")), "v").join(scored.groupBy("v").agg(F.max("strays").alias("phantom_streams")), "v").join(streams.diarization(t, w, BY), "v", "left")
    want = {r["v"]: r.asDict() for r in parts.collect()}
    got = {r["v"]: r.asDict() for r in streams.visit_scores(t, w, BY).collect()}
    assert len(got) > 8 and any(r["unmatched_hyp_words"] for r in got.values()) and any(r["phantom_streams"] for r in got.values())
    for v, r in got.items():
        for c, x in want[v].items():
            assert r[c] == x or (x is not None and math.isclose(r[c], x, abs_tol=1e-9)), (v, c, r[c], x)


def test_names_of_turns(spark):
    from parlance.operators import outcomes

    t = frame(spark, "v int, seg_idx long, speaker string, start double, end double, text string", [(1, 0, "Interviewer:", 0.0, 1.0, "a"), (1, 1, "S2:", 1.0, 2.0, "b"), (1, 2, "PARTICIPANT", 2.0, 3.0, "c")])
    w = frame(spark, "v int, word_idx long, word string, start double, end double, speaker string", [(1, 0, "a", 0.0, 1.0, "x")])
    assert [r["speaker"] for r in outcomes.turn_outcomes(t, w, BY).orderBy("seg_idx").collect()] == ["INTERVIEWER", "unnamed (S2)", "PARTICIPANT"]


def test_normalized_words_in_both_languages(spark):
    from parlance.operators.visit import cue_score, headline_tokens

    texts = ["[UM] Don't, um, go-now {x}'s", "İstanbul K", "", "no [i\nguess] I think\x1cso", "mm-hmm Last week"]
    for a in texts:
        assert headline_tokens(a) == spark.range(1).select(T.words_of(T.headline(F.lit(a))).alias("x")).first()["x"]
        for b in texts:
            x, y = headline_tokens(a), headline_tokens(b)
            assert math.isclose(cue_score(x, y), spark.range(1).select(T.cue_score(F.lit(" ".join(x)), F.lit(" ".join(y))).alias("x")).first()["x"])


def test_windows_of_speech(spark):
    from parlance.operators import folds

    spans = frame(spark, "v int, start double, end double", [(1, 0.0, 10.0), (1, 12.0, 20.0), (1, 21.0, 30.0), (1, 40.0, 100.0), (2, 5.0, 5.0)])
    got = [(r["start"], r["end"]) for r in folds.speech_windows(spans, BY).orderBy("window").collect()]
    assert got == [(0.0, 20.0), (21.0, 30.0), (40.0, 65.0), (65.0, 90.0), (90.0, 100.0)]


def test_chunks_overlap(spark):
    from parlance.operators import folds

    pieces = frame(spark, "v int, piece int, n_chars long", [(1, k, n) for k, n in enumerate([4, 4, 4, 11, 2, 2])])
    got = [tuple(r)[2:] for r in folds.overlapping_chunks(pieces, BY, size=10).orderBy("chunk").collect()]
    assert got == [(0, 1, 8), (1, 2, 8), (2, 3, 15), (3, 4, 13), (4, 5, 4)]
    assert [tuple(r)[2:] for r in folds.overlapping_chunks(pieces, BY, size=10, overlap=0).orderBy("chunk").collect()] == [(0, 1, 8), (2, 2, 4), (3, 3, 11), (4, 5, 4)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_dense_places(spark, partitions):
    from parlance.operators import places

    rng = random.Random(partitions)
    rows = [(rng.randrange(50), k) for k in range(400)]
    got = places.dense_places(frame(spark, "x int, k long", rows).repartition(partitions), ["x", "k"]).collect()
    assert {(r["x"], r["k"]): r["place"] for r in got} == {r: n for n, r in enumerate(sorted(rows))}
    shards = places.round_robin(frame(spark, "x int, k long", rows), ["k"], 3).collect()
    assert all(r["shard"] == r["k"] % 3 + 1 for r in shards)
    assert places.dense_places(frame(spark, "x int", []), ["x"]).count() == 0
    left = places.pending(frame(spark, "k long", [(1,), (2,), (3,)]), frame(spark, "k long", [(2,), (2,)]), ["k"], F.col("k") < 3)
    assert [r["k"] for r in left.collect()] == [1]


def spread_by_hand(rows, count, most):
    """A walk with a stride over rows (size, visit, subject) in order of size."""
    rows = sorted(rows)
    free, seen, out = list(range(len(rows))), {}, []
    for step in range(count):
        at = min(int(step * max(len(rows) / count, 1.0)), len(rows) - 1)
        fit = [k for k in [*(k for k in free if k >= at), *(k for k in free if k < at)] if seen.get(rows[k][2], 0) < most]
        if not fit:
            break
        free.remove(fit[0])
        seen[rows[fit[0]][2]] = seen.get(rows[fit[0]][2], 0) + 1
        out.append(rows[fit[0]][1])
    return sorted(out)


@pytest.mark.parametrize("n, count, most", [(100, 12, 2), (30, 30, 1), (7, 12, 3), (0, 4, 1)])
def test_spread_samples(spark, n, count, most):
    from parlance.operators import places

    rng = random.Random(n)
    rows = [(rng.randrange(9), v, rng.choice("aaaabcdefgh")) for v in range(n)]
    got = places.spread_sample(frame(spark, "words int, visit long, subject string", rows), "words", "subject", ["visit"], count, most)
    assert sorted(r["visit"] for r in got.collect()) == spread_by_hand(rows, count, most)


def test_trees_of_systems(spark, tmp_path):
    words = lambda *ws: json.dumps([{"word": w, "start": k, "end": k + 1, "speaker": "A"} for k, w in enumerate(ws)])
    files = {
        "s/p/v1/run_1/transcript.json": words("old"), "s/p/v1/run_2/transcript.json": json.dumps({"words": json.loads(words("new"))}), "s/p/v2/run_9/transcript.json": words("deep"), "s/p/v2/transcript.json": words("own"),
        "s/p/v1/x_words.json": words("x"), "s/p/v1/y_words.json": words("y"), "s/p/v2/run_1/z_words.json": words("too deep"), "s/p/v2/my transcript.json": words("not this"),
        "s/p/v1/chirp/b.json": '{"words": []}', "s/p/v1/chirp/a.json": json.dumps({"words": [{"word": "hi", "startOffset": 0, "endOffset": 1, "speakerLabel": "1"}]}), "s/p/v1/own.txt": "only this",
    }
    for path, text in files.items():
        (tmp_path / "one" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "one" / path).write_text(text)
    tree = transcripts.read_files(spark, f"{tmp_path}/one")
    assert {r["path"] for r in tree.collect()} == set(files)
    visits = frame(spark, "v int, folder string", [(1, "s/p/v1"), (2, "s/p/v2"), (3, "s/p/v3")])
    lines = lambda texts, by: texts.select(*by, F.lit(0).alias("word_idx"), F.col("value").alias("word"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("A").alias("speaker"))
    transcripts.register_system("lines", transcripts.System(".txt", lines))
    other = frame(spark, "path string, value string", [("s/p/v2/q_words.json", words("fallback")), ("s/p/v1/q_words.json", words("unused"))])
    got = transcripts.read_visits({"ours": [tree], "baseline": [tree, other], "chirp3": [tree], "lines": [tree]}, visits, BY)
    assert {(r["system"], r["v"], r["word"]) for r in got.collect()} == {("ours", 1, "new"), ("ours", 2, "own"), ("baseline", 1, "y"), ("baseline", 2, "fallback"), ("chirp3", 1, "hi"), ("lines", 1, "only this")}
    del transcripts.SYSTEMS["lines"]


def test_tables_are_written_in_order(spark, tmp_path):
    from parlance.sources import sinks

    rows = frame(spark, "subject string, session int, span int, system string, rate double", [("b", 1, 2, "x", 0.125), ("a", 2, 1, "y", None), ("a", 1, 1, "x", 1.0)])
    sinks.write_table(rows, f"{tmp_path}/leaks", {"rate": "pct"}, sinks.ORDERS["leaks"])
    back = spark.read.option("header", True).csv(f"{tmp_path}/leaks").collect()
    assert sorted((r["subject"], r["session"], r["rate"]) for r in back) == [("a", "1", "100.00"), ("a", "2", None), ("b", "1", "12.50")]
    text = [line for f in sorted((tmp_path / "leaks").glob("part-*")) for line in f.read_text().splitlines() if not line.startswith("subject")]
    assert [line[0] for line in text] == ["a", "a", "b"]


def test_corrections_of_words(spark):
    texts = frame(spark, "v int, text string", [(1, "The cat's cat sat. Cat $5 a.b axb über"), (2, "nothing")])
    words = frame(spark, "v int, word_idx long, word string", [(1, 0, "cat"), (1, 1, "sat."), (1, 2, "cat"), (2, 0, "nothing")])
    given = frame(spark, "v int, place long, original string, suggested string", [(1, 0, " cat ", "d$1\\"), (1, 1, "dog", "x"), (1, 2, "a.b", "c"), (1, 3, "d$1\\", "two words"), (1, 4, "", "y"), (1, 5, "sat", None), (1, 6, "cat sat", "z"), (1, 7, "ber", "no")])
    changed, spoken, report = corrections.with_corrections(texts, words, given, BY)
    assert {r["v"]: r["text"] for r in changed.collect()} == {1: "The two words's two words sat. Cat $5 c axb über", 2: "nothing"}
    assert [r["word"] for r in spoken.where("v = 1").orderBy("word_idx").collect()] == ["two words", "sat.", "two words"]
    assert {r["place"]: (r["text_replacements"], r["word_replacements"], r["applied"]) for r in report.collect()} == {0: (2, 2, True), 1: (0, 0, False), 2: (1, 0, True), 3: (2, 2, True), 6: (0, 0, False), 7: (0, 0, False)}


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(T.slug(F.lit("Lost Turns/By Role"))) == "lost-turns-by-role" and one(T.escape(F.lit("a<b & c>d"))) == "a&lt;b &amp; c&gt;d"
    iou = lambda *x: one(T.interval_iou(*[F.lit(float(v)) for v in x]))
    assert iou(0, 2, 1, 3) == 1 / 3 and iou(0, 1, 1, 2) == 0 and iou(0, 4, 1, 2) == 0.25


def test_rankings_and_deltas(spark):
    from parlance.operators import reports

    rows = frame(spark, "visit string, system string, s long, d long, words long", [("a", "x", 1, 2, 10), ("a", "y", 5, 0, 10), ("b", "x", 4, 4, 10), ("b", "y", 1, 1, 10), ("c", "x", 9, 0, 10), ("d", "x", 0, 0, 10), ("d", "y", 0, 2, 10)])
    ranked = lambda by: [r["visit"] for r in reports.ranked_visits(rows, ["visit"], "system", ["x", "y"], {"sub": "s", "del": "d"}, "words", by).orderBy("rank").collect()]
    assert ranked("worst") == ["b", "a", "d"] and ranked("x") == ["b", "a", "d"] and ranked("y") == ["a", "b", "d"]
    first = reports.ranked_visits(rows, ["visit"], "system", ["x", "y"], {"sub": "s", "del": "d"}, "words").where("rank = 1").first()
    assert (first["x_wer"], first["x_shape"], first["x_shape_rate"]) == (0.8, "sub", 0.4)
    deltas = {r["system"]: (r["pooled"], round(r["delta"], 9)) for r in reports.pooled_deltas(rows.withColumn("e", F.col("s") + F.col("d")), "system", "e", "words", "x").collect()}
    assert deltas == {"x": (0.5, 0.0), "y": (0.3, -0.2)}
    other = frame(spark, "visit string, m double", [("a", 1.0), ("a", 2.0)])
    assert {(r["visit"], r["other"] and r["other"]["m"]) for r in reports.folded(rows.where("system = 'x'"), {"other": other}, ["visit"]).collect()} == {("a", 1.0), ("b", None), ("c", None), ("d", None)}
