"""Spelling variants, conversation repair and quality rules: brute force on odd rows, and the SQL."""

import hashlib
import random
import re
import zlib

import pytest
from llm_cases import SCHEMA, odd_rows, prose

from parlance.llm import conversation_repair as cr
from parlance.llm import quality_rules as qr
from parlance.llm import spelling_variants as sv

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def duck(sql, **views):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, rows in views.items():
        con.register(name, rows)
    return con.execute(sql).fetchall()


# Spelling variants


def spelled(rng):
    """Texts whose words have near words of all kinds, like letters in a row, the same letters in another order, and a very long word."""
    base = ["lantern", "lantren", "anternl", "balloon", "aaaaaaa", "königlich", "straße", "ÉCLAIR"]
    rows = []
    for k in range(60):
        words = []
        for w in base:
            words += [w] * rng.choice([1, 3, 12])
            i, c = rng.randrange(len(w)), rng.choice("abc")
            words += rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:2] + w[2:][::-1]]).split() * rng.choice([1, 2])
        rng.shuffle(words)
        rows.append((k, rng.choice([" ", "-", "\n", "漢"]).join(words)))
    many = ["lanterns", "lanterz", "lanterx", "zlantern", "lanten", "lanternss", "ballloon", "baloon", "aaaaaa", "aaaaaaaa", "aaabaaa"]
    rows += [(70 + k, " ".join(many * (5 + k))) for k in range(3)] + [(80, " ".join(["lanterns"] * 200))]
    long = "ab" * 3000
    return rows + [(100 + k, t) for k, t in enumerate([None, "", "short", " ".join([long] * 3 + [long + "a"] * 7), " ".join([long] * 9)])] + [(None, "lantern balloon"), (7, rows[7][1])]


def variants_by_hand(rows):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]

    form, count = {}, {}
    for w in n:
        found = [o for o in n if near(w, o)]
        best = min(found, key=lambda o: (-n[o], o), default=None)
        count[w], form[w] = len(found), best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark):
    rows = spelled(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'x' AS word", "1 AS n", "'y' AS key").repartition(4)
    want = variants_by_hand(rows)
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want) and any(len(r[0]) > 1000 and r[4] for r in want)
    assert {tuple(r) for r in sv.group_variants(docs).collect()} == want
    assert {tuple(r) for r in sv.group_variants(docs, heavy=2).collect()} == want
    assert sv.group_variants(docs.where("false")).count() == 0


def test_spelling_variants_sql(spark):
    docs = spark.createDataFrame([r for r in spelled(random.Random(4)) if len(r[1] or "") < 5000], "doc_id long, text string")
    assert {tuple(r) for r in sv.group_variants(docs).collect()} == set(duck(sv.variants_sql(), documents=docs.toArrow()))


def test_remainders_meet_at_one_edit():
    import numpy as np
    import pyarrow as pa

    words = pa.array(["abcde", "abde", "abxde", "aabb"])
    row, at, mark = sv.remainders(words, np.array([ord("c"), -1, ord("x"), ord("a")]))
    of = {(int(r), int(p)): int(m) for r, p, m in zip(row, at, mark)}
    assert of[0, 2] == of[1, -1] == of[2, 2] and of[3, 0] == of[3, 1] and len(of) == 5


# Conversation repair


def cheapest(rows):
    """Least price, audit and lines by trying everything."""
    best = [3 * len(rows), "D" * len(rows), []]

    def go(k, cost, audit, out):
        roles = "".join(r[:1] for r, _ in out)
        if cost > best[0] or not re.fullmatch("(s?(ua)*u?)?", roles) or len(roles) < len(out):
            return
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", roles) and (cost, audit) < tuple(best[:2]):
                best[:] = cost, audit, out
        else:
            role, text, fault = rows[k]
            go(k + 1, cost + 3, audit + "D", out)
            if fault not in (1, 2):
                go(k + 1, cost + (fault == 3), audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    go(k + 1, cost + 2 + (fault == 3), audit + "R", [*out, (r, text)])
        for r in ("user", "assistant"):
            go(k, cost + 2, audit + "I", [*out, (r, "")])

    go(0, 0, "", [])
    return best


def test_cheapest_repairs():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), f"t{k}", rng.choice([0, 0, 0, 1, 2, 3, 3])) for k in range(rng.randrange(6))]
        c = cr.Conversation()
        for k, r in enumerate(rows):
            c.add(k, *r)
        cost, audit, out = cheapest(rows)
        assert c.report(1)[6:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def repaired_by_hand(rows):
    space = lambda x: " " if x is None else x
    held = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else space(role), "" if kind == 1 else re.sub("[.!?]", "", space(text)) if kind == 2 else space(text)
        held[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = set()
    for conv, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            last = WORD.findall(text)
            faults.append(1 if not last else 2 if (role, text) in seen else 0 if last[-1][-1] in ".!?" else 3)
            seen.add((role, text))
        numbers = {t for t, *_ in turns if t is not None}
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(turns, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.add((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest))
    return out


def chats():
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", None, "", "tool"], ["Fine.", "Go on", "  ", None, "So?  \n", "é!", "same.", "😀", "a. b"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choices(roles, [6, 6, 2, 1, 1, 1])[0], rng.choice(texts)) for c in range(60) for _ in range(rng.randrange(1, 6))]
    return rows + [(None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), (900, None, None, None), (901, 3, "user", "long. " * 20_000), (901, 4, "assistant", "x." * 9)] + [(902, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(4)]


def test_conversation_repair(spark):
    rows = chats()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = table.selectExpr("*", "'x' AS fault", "'x' AS seen", "1 AS kind", "2 AS copies").repartition(5)
    want = repaired_by_hand(rows)
    assert any(r[6] == 0 and r[7] for r in want) and any("I" in r[7] for r in want) and any("R" in r[7] for r in want)
    turns = cr.damage(clash)
    reports = cr.repair(turns).cache()
    assert {tuple(r) for r in reports.collect()} == want
    assert set(duck(cr.repair_sql(), conversations=table.toArrow())) == want
    texts = {r[0]: [] for r in want}
    for r in sorted(cr.repaired_turns(turns, reports).collect(), key=lambda r: r["place"]):
        texts[r["conv_id"]].append((r["role"], r["text"]))
    assert {(c, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()) for c, lines in texts.items()} == {(r[0], r[-1]) for r in want}
    assert cr.repair(cr.damage(table.where("false"))).count() == 0
    gone = spark.createDataFrame([(5, None, None, None, False)], "conv_id long, turn long, role string, text string, present boolean")
    assert tuple(cr.repair(gone).first()) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_conversation_takes_linear_time():
    c = cr.Conversation()
    for k in range(20_000):
        c.add(k, ("user", "assistant", "assistant")[k % 3], "x", 0)
    report = c.report(1)
    assert report[6] == 2 * (20_000 // 3) + 2 * (20_000 % 3 == 1) and len(report[7]) >= 20_000


# Quality rules


def measured_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def ruled():
    rng = random.Random(8)
    plain = " ".join(rng.choice("the of and a to stone river window light evening".split()) + ("." if k % 9 == 8 else "") for k in range(160))
    more = ["x y z x y z", "a a a a", "one\n\n one\none\n  \none\r", "#*$%&|<> " * 60, plain, plain.upper(), "\n".join(["the same line of text"] * 30), "\n".join("- " + plain[k * 9 : k * 9 + 40] for k in range(12)), "the of " + "pneumonoultramicroscopic " * 3 + prose(rng, 50), " \x0b\x0c a\x1fb\x85c  "]
    return [*odd_rows(), *[(50 + k, t, "en", "s", len(t)) for k, t in enumerate(more)], (None, plain, "en", "s", 1), (54, plain, "en", "s", 1)]


def test_quality_rules(spark):
    rows = [r for r in ruled() if len(r[1] or "") < 30_000]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clash = table.selectExpr("*", "'x' AS words", "1 AS n_words", "'x' AS failed", "1 AS windows")
    got = sorted(map(tuple, qr.quality(clash).collect()), key=str)
    assert sorted((r[:7] for r in got), key=str) == sorted(((r[0], *measured_by_hand(r[1])) for r in rows), key=str)
    assert got == sorted(duck(qr.quality_sql(), documents=table.toArrow()), key=str)
    kept = {r[0]: (r[7], r[8]) for r in got}
    assert kept[54] == (True, "") and kept[55] == (False, "stop_words") and kept[53][0] is False and "repeated_lines" in kept[56][1] and kept[57][1] == "bullets"
    assert qr.quality(table.where("false")).count() == 0


def test_rules_are_a_table(spark):
    table = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    one = (qr.Rule("few", "n_words", 5, None),)
    assert [r["failed"] for r in qr.quality(table, one).collect()] == ["few"] and [r["failed"] for r in qr.quality(table, ()).collect()] == [""]


def test_quality_is_a_projection(spark):
    table = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    plan = qr.quality(table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas|Aggregate|Join", plan)
