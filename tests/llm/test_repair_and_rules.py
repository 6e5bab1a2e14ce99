"""Conversation repair, spelling variants and repetition rules against plain versions, and the odd cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, conversation, repetition, spelling
from tidemark.llm.bytes import runs

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "turn", "role", "text")


def plain_damage(rows):
    for c, t, role, text in rows:
        c_, t_ = (" " if x is None else x for x in (c, t))
        way, role, text = zlib.crc32(f"{c_}:{t_}".encode()) % 20, " " if role is None else role, " " if text is None else text
        if way:
            text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
            yield from [(c, t, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)


def plain_repair(rows):
    """One conversation: the least (cost, audit) by whole strings, from the end; with the repaired text."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        rest = text.strip(" \t\n\r\x0b\x0c")
        faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "" if rest[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    given = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    never = (10**9, "", [])

    def inserted(best):
        best = dict(best)
        for _ in range(4):
            for s, (role, to) in given.items():
                c, a, r = best[to]
                best[s] = min(best[s], (c + 2, "I" + a, [f"{role}:", *r]))
        return best

    best = inserted({0: (0, "", []), 1: never, 2: never, 3: (0, "", [])})
    for (_, _, role, text), fault in zip(rows[::-1], faults[::-1]):
        now = {}
        for s in range(4):
            c, a, r = best[s]
            ways = [(c + 3, "D" + a, r)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (s, role[:1]) in step:
                    c, a, r = best[step[s, role[:1]]]
                    ways.append((c + extra, "K" + a, [f"{role}:{text}", *r]))
                c, a, r = best[given[s][1]]
                ways.append((c + extra + 2, "R" + a, [f"{given[s][0]}:{text}", *r]))
            now[s] = min(ways)
        best = inserted(now)
    turns = {r[1] for r in rows} - {None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, text = best[0]
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()


def plain_all(rows):
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r)
    return {c: plain_repair(r) for c, r in by.items()}


def talk(rng, conv, n):
    for turn in range(n):
        role = rng.choices(["user", "assistant", "system", "tool", None, ""], [9, 9, 2, 1, 1, 1])[0]
        text = rng.choices([f"Word {rng.randrange(9)}.", f"cut {rng.randrange(9)}", "", " \t", None, "Why?\n", "Über ."], [9, 4, 1, 1, 1, 2, 1])[0]
        yield conv, rng.choice([turn, turn, turn, turn * 3, None, 5]), role, text


def repaired(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit("clash")).withColumn("_way", F.lit(1))
    out = conversation.repair_all(df, conversation.damage(df, *COLUMNS), *COLUMNS)
    return {r[0]: tuple(r[1:]) for r in out.collect()}


def test_repair_of_many_conversations(spark):
    rng = random.Random(1)
    rows = [r for c in [None, *range(400)] for r in talk(rng, c, rng.randrange(1, 9))]
    assert repaired(spark, rows) == plain_all(rows)


def test_repair_of_a_conversation_that_spans_all_ranges(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Said {t}.", "Yes.", "cut", ""])) for t in range(900)]
    rows += [r for c in (1, 9) for r in talk(rng, c, 40)] + [(9, 5, "user", "Same.")] * 50
    monkeypatch.setattr(conversation, "PIECE", 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repaired(spark, rows) == plain_all(rows)
        # A part is a range: the large conversation's rows are not one task's.
        ranged = spark.createDataFrame(rows, SCHEMA).repartitionByRange("conv_id", "turn", "role", "text")
        assert ranged.where("conv_id = 7").select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_nothing_and_of_what_is_dropped_whole(spark):
    assert repaired(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_ties_take_the_least_label(spark):
    rows = [(1, 0, "assistant", "One."), (2, 0, "user", "A."), (2, 1, "user", "B."), (3, 0, "system", "S."), (4, 0, "system", "S."), (4, 1, "system", "T.")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["conv_id"]: (r["cost"], r["audit"]) for r in conversation.repair(df, *COLUMNS).collect()}
    assert found == {1: (2, "IK"), 2: (2, "KR"), 3: (3, "D"), 4: (4, "KIR")}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, times=10):
    n = {}
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            if len(w) >= 7:
                n[w] = n.get(w, 0) + 1
    n = {w: m for w, m in n.items() if m >= 2}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n}


def test_variants(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abÀé", k=rng.randrange(7, 10))) for _ in range(12)] + ["aaaaaaaa", "abababab", "aabbaabb"]
    docs = []
    for d in range(300):
        words = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.5)), len(base) - 1)]
            if rng.random() < 0.3:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÀ") + w[i:], w[:i] + rng.choice("abÉ") + w[i + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w + "1"]))
        docs.append((d % 250 if d % 40 else None, rng.choice([" ", "-", "ſ", "\n"]).join(words)))
    docs += [(1, None), (2, ""), (3, "short words only")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("word", F.lit("clash"))
    found = {tuple(r) for r in spelling.variants(df, "doc_id", "text").collect()}
    assert found == plain_variants(docs)
    assert any(f is not None and f != r for _, f, r, *_ in found) or any(f is not None for _, f, *_ in found)
    assert spelling.variants(df.limit(0), "doc_id", "text").collect() == []


def test_chains_of_forms_lead_to_the_last(spark):
    docs = [(i, " ".join(["abcdefgh"] * 2 + ["abcdefgx"] * 20 + ["abcdefyx"] * 200 + ["abcdezyx"] * 2000 + ["wwwwwwww"] * 3)) for i in (1,)]
    assert plain_variants(docs) == {tuple(r) for r in spelling.variants(spark.createDataFrame(docs, "d long, t string"), "d", "t", damage=2**40).collect()} or zlib.crc32(b"1:abcdefgh") % 31 == 0
    found = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(docs, "d long, t string"), "d", "t", damage=2**40).collect()}
    assert found == {**dict.fromkeys(["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"], "abcdezyx"), "wwwwwwww": "wwwwwwww"}


def test_very_long_words_emit_hashes_and_texts_are_taken_in_pieces(spark, monkeypatch):
    long = "ab" * 60_000
    docs = [(1, f"{long} {long[:-1]} word {long[:-1]}"), (2, f"{long}, {long[:500]}x{long[501:]} {long[:500]}x{long[501:]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(len(r["word"]), r["n"], r["n_near"]) for r in spelling.variants(df, "doc_id", "text", damage=2**40).collect()}
    assert found == {(120_000, 2, 2), (120_000, 2, 1), (119_999, 2, 1)}
    monkeypatch.setattr(spelling, "PIECE", 10)
    assert "".join(spelling._pieces("abc def ghijklmnopqrstu vw")) == "abc def ghijklmnopqrstu vw"
    assert all(not a[-1].isalpha() or not b[0].isalpha() for a, b in zip(list(spelling._pieces("abc def " * 9)), list(spelling._pieces("abc def " * 9))[1:]))


def plain_measure(text, least):
    body = (text or "").encode()
    words, n = body.split(), len(body)
    lines = [x for x in body.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    spans, longest = set(), 0
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and body[i + k] == body[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                spans |= {*range(i, i + k), *range(j, j + k)}
    chars = len(re.sub(r"[ \t\n\r\x0b\x0c]", "", text or ""))
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n, len(spans), longest


@pytest.mark.parametrize("seed", range(6))
def test_repetition_against_all_pairs_of_places(seed):
    rng = random.Random(seed)
    for _ in range(30):
        letters = rng.choice(["a", "ab", "abé \n", "abcdefgh \n#", "xyz\x00 "])
        text = "".join(rng.choices(letters, k=rng.randrange(0, 160)))
        if rng.random() < 0.6:
            piece = text[: rng.randrange(60)]
            text = rng.choice([text + piece, piece + text + piece, piece * 3 + text, text + "\n" + text])
        for least in (8, 20, 31):
            assert repetition.measure(text.encode(), least) == plain_measure(text, least)


def test_long_repeats_are_compared_in_stretches():
    rng = np.random.default_rng(5)
    half = rng.integers(97, 123, 300_000).astype(np.uint8).tobytes()
    got = dict(zip(repetition.NAMES, repetition.measure(half + b"#" + half)))
    assert (got["n_covered"], got["longest"]) == (600_000, 300_000)
    same = dict(zip(repetition.NAMES, repetition.measure(b"a" * 200_000)))
    assert (same["n_covered"], same["longest"]) == (200_000, 199_999)


def test_rules(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = fresh(40)
    docs = [
        (1, fresh(200)),
        (2, fresh(20)),
        (3, "one two three " * 40),
        (4, passage + "\n" + fresh(30) + "\n" + passage),  # under half of the words, but most bytes repeat
        (5, None),
        (6, ""),
        (None, fresh(60)),
        (1, fresh(200)),
        (8, fresh(300) + "\n" + passage + "\n" + fresh(300) + "\n" + passage),  # a passage of a tenth, twice
        (9, fresh(60) + " " + "x" * 5000),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit(0)).withColumn("t", F.lit("clash")).withColumn("n_words", F.lit("x"))
    found = [(r["doc_id"], r["base_failed"], r["kept"]) for r in repetition.judge(df, "doc_id", "text").collect()]
    want = [(1, False, True), (2, True, False), (3, True, False), (4, True, False), (5, True, False), (6, True, False), (None, False, True), (1, False, True), (8, False, True), (9, False, False)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert repetition.judge(df.limit(0), "doc_id", "text").collect() == []


def test_repetition_decides_where_the_plain_rules_do_not(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=8))
    passage = " ".join(word() for _ in range(30))
    text = " ".join([*(word() for _ in range(70)), passage, *(word() for _ in range(10)), passage])
    row = repetition.judge(spark.createDataFrame([(1, text)], "d long, t string"), "d", "t").first()
    assert not row["base_failed"] and not row["kept"] and row["longest"] >= len(passage)


def test_runs_cover_all_rows():
    assert runs(np.array([3, 3, 3]), 6) == [(0, 2), (2, 3)]


def test_words_and_their_keys_are_never_broadcast(spark):
    """However small their files are: a table of words is larger in memory, and has many times as many keys."""
    words = common.table(spark.createDataFrame([(i, w, 9) for i, w in enumerate(("abcdefgh", "abcdefg", "abcdefgx"))], "id long, word string, n long"), "words")
    near = spelling.near_pairs(words)
    assert {(r["a"], r["b"]) for r in near.collect()} == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)}
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
