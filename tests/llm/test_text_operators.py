"""Line, substring and near-duplicate dedup, decontamination and the pipeline, against plain versions."""

import hashlib
import random
import re
import time
from itertools import combinations
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, line_dedup, links, near_dedup, suffix_dedup

WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "é") for b in ("n", "s", "ma", "lo", "ve", "x1")]


def sentence(dice, n):
    return " ".join(dice.choices(WORDS, k=n))


def changed(dice, text, n):
    w = text.split(" ")
    for i in dice.sample(range(len(w)), n):
        w[i] = dice.choice(WORDS) + "q"
    return " ".join(w)


ODD = [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "One"), (905, "!"), (906, "long " * 30000), (907, "ein Zwei"), (908, "ein\tzWEI")]


@pytest.fixture(scope="module")
def docs():
    dice = random.Random(7)
    base = [sentence(dice, dice.randrange(3, 200)) for _ in range(40)]
    out = list(base)
    out += [base[0]] * 25  # exact copies
    big = sentence(dice, 150)
    out += [changed(dice, big, dice.randrange(0, 14)) for _ in range(60)]  # near copies, near and beyond the threshold
    out += [changed(dice, dice.choice(base), 1) for _ in range(20)]
    dice.shuffle(out)
    return [*enumerate(out), *ODD]


def frame(spark, docs):
    clash = {c: F.lit(c) for c in ("id", "digest", "bucket", "part", "k", "d")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicate_groups(spark, docs, n):
    found = near_dedup.groups(frame(spark, docs), "doc_id", "text", n=n, percent=80)
    assert {tuple(r) for r in found.select("doc_id", "n_shingles", "component", "kept").collect()} == brute.near_groups(docs, n, 80)


def test_near_duplicates_without_rows_ids_or_links(spark):
    df = frame(spark, [])
    assert near_dedup.groups(df, "doc_id", "text").count() == 0
    odd = frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, None)])
    got = sorted(map(str, near_dedup.groups(odd, "doc_id", "text").select("doc_id", "component", "kept").collect()))
    assert got == sorted(map(str, ["Row(doc_id=None, component=5, kept=False)"] * 2 + ["Row(doc_id=5, component=5, kept=True)"] * 2 + ["Row(doc_id=6, component=6, kept=True)"]))


def test_the_estimate_is_unbiased(spark):
    rng = np.random.default_rng(0)
    both = rng.integers(0, 1 << 62, 900)
    a, b = both[:800], both[100:]  # similarity 700 / 900
    text = lambda x: " ".join(map(str, x))
    rows = near_dedup.sketches(spark.createDataFrame([(1, text(a)), (2, text(b))], "i long, t string"), "i", "t", 1).select("k", "packed")
    x, y = rows.where("k = 1").select(F.col("packed").alias("x")), rows.where("k = 2").select(F.col("packed").alias("y"))
    got = x.join(y).select(near_dedup.estimate(F.col("x"), F.col("y"))).first()[0]
    assert abs(got - 700 / 900) < 0.15


def plain_line_dedup(docs):
    def norm(line):
        return re.sub(r"[^\w]+|_", " ", re.sub("[1-9]", "0", line.lower())).replace("  ", " ").strip(" ")

    def edits(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a):
            cur = [i + 1]
            for j, y in enumerate(b):
                cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
            prev = cur
        return prev[-1]

    at: dict = {}
    for k, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            if t is not None and norm(line):
                at.setdefault(norm(line), []).append((k, hashlib.md5(t.encode()).digest(), p))
    names, top = list(at), list(range(len(at)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in combinations(range(len(names)), 2):
        if abs(len(names[i]) - len(names[j])) <= 0.1 * max(len(names[i]), len(names[j])) and edits(names[i], names[j]) <= int(0.1 * max(len(names[i]), len(names[j]))):
            a, b = sorted((root(i), root(j)))
            top[b] = a
    groups: dict = {}
    for i, n in enumerate(names):
        groups.setdefault(root(i), []).extend(at[n])
    drop = {(k, p) for g in groups.values() for k, h, p in g if (k, h, p) != min(g)}
    return {k: None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if (k, p) not in drop) for k, t in docs}


def test_fuzzy_lines(spark):
    dice = random.Random(11)
    lines = [sentence(dice, dice.randrange(1, 60)) for _ in range(30)] + ["", "...", "Page 1 of 9!"]
    long = sentence(dice, 400)
    near = [changed(dice, long, 1) for _ in range(12)] + [long.upper(), "  " + long.replace(" ", ", ")]
    docs = [(i, "\n".join(dice.choices(lines + near, k=dice.randrange(1, 9)))) for i in range(40)] + [(100, None), (101, ""), (102, "\n"), (103, "Page 2 of 7"), (104, ("w " * 200 + "\n") * 3), (105, " ".join(map(str, range(20000))))]
    df = frame(spark, docs)
    found = line_dedup.dedup(df, "doc_id", "text").collect()
    assert {r["doc_id"]: r["text"] for r in found} == plain_line_dedup(docs)
    assert found[0].asDict().keys() == {*df.columns, "n_lines", "n_dropped"}
    clash = df.select("doc_id", "text", F.lit("x").alias("n_lines"), F.lit("y").alias("_h"), F.lit("z").alias("md5"), F.lit("w").alias("d"))
    again = line_dedup.dedup(clash, "doc_id", "text")
    assert again.columns == ["doc_id", "text", "_h", "md5", "d", "n_lines", "n_dropped"]
    assert {(r["text"], r["_h"], r["d"], r["n_lines"]) for r in again.collect()} == {(r["text"], "y", "w", r["n_lines"]) for r in found}
    assert line_dedup.dedup(df.limit(0), "doc_id", "text").count() == 0
    odd = line_dedup.dedup(frame(spark, [(None, "a b\na b"), (1, "a b"), (1, "a b")]), "doc_id", "text").select("doc_id", "text", "n_lines", "n_dropped")
    assert sorted(map(tuple, odd.collect()), key=str) == sorted([(None, "a b", 2, 1), (1, "", 1, 1), (1, "", 1, 1)], key=str)


def edited(dice, line, n):
    """line after n edits of a letter each: changed, left out or put in."""
    for _ in range(n):
        i = dice.choice([i for i, x in enumerate(line) if x != " "])
        line = line[:i] + dice.choice(["", "q", line[i] + "q"]) + line[i + 1 :]
    return line


@pytest.mark.parametrize("low, high, share, least", [(10, 45, 1, 1), (50, 99, 0.02, 0.95), (100, 299, 0.02, 0.98), (300, 900, 0.02, 0.98)])
def test_lines_within_the_edits_are_found(spark, low, high, share, least):
    """Recall against edit similarity alone; share is that of the edits allowed, 1 edit at least."""
    dice = random.Random(37)
    letters = "abcdefghijklmnoprstuvwxyz"
    docs, n = [], 160
    for k in range(n):
        line = ""
        while len(line) < dice.randrange(low, high):
            line = (line + " " + "".join(dice.choices(letters, k=dice.randrange(2, 9)))).strip()[:high]
        line = line.strip().ljust(low, "z")
        docs += [(2 * k, line), (2 * k + 1, edited(dice, line, max(1, int(share * (len(line) // 10)))))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", line_dedup.normal(F.col("text")))
    x, y = df.select("doc_id", F.col("line").alias("x")), df.select((F.col("doc_id") + 1).alias("doc_id"), F.col("line").alias("y"))
    # An edit that empties a word takes its space with it.
    within = x.where("doc_id % 2 = 1").join(y, "doc_id").where("levenshtein(x, y) <= floor(0.1 * greatest(length(x), length(y)))")
    want = {r["doc_id"] for r in within.collect()}
    found = line_dedup.dedup(df, "doc_id", "text")
    gone = {r["doc_id"] for r in found.where("n_dropped = 1").collect()}
    assert gone <= want and len(want) > 0.9 * n and len(gone) >= least * len(want)


def test_lines_that_only_share_a_passage_are_hardly_compared(spark, monkeypatch):
    dice = random.Random(43)
    word = lambda: "".join(dice.choices("abcdefghijklmnoprstuvwxyz", k=6))
    passage = "seventeen lighthouses overlooking harbour pavements"
    lines = [" ".join([*(word() for _ in range(5)), passage, *(word() for _ in range(6))]) for _ in range(80)]
    docs = [*enumerate(lines), *((100 + i, x[:-6] + "changed"[: i % 4 + 3]) for i, x in enumerate(lines[:20]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    compared, groups = [], line_dedup.linked_groups

    def counting(members, verify, *a, **b):
        return groups(members, lambda pairs: compared.append(pairs.count()) or verify(pairs), *a, **b)

    monkeypatch.setattr(line_dedup, "linked_groups", counting)
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, "doc_id", "text").collect()}
    assert found == plain_line_dedup(docs) and sum(x == "" for x in found.values()) == 20
    assert sum(compared) < 80 * 79 / 2 / 8


def test_lines_of_other_lengths_do_not_meet(spark, monkeypatch):
    """A passage in lines of which each is 1.4 times as long as the one before: no bucket brings two together."""
    dice = random.Random(59)
    word = lambda: "".join(dice.choices("abcdefghijklmnoprstuvwxyz", k=6))
    passage = "seventeen lighthouses overlooking harbour pavements"
    docs = [(i, " ".join([passage, *(word() for _ in range(int((60 * 1.4**i - len(passage)) / 7) + 1))])) for i in range(12)]
    docs += [(100 + i, x[:-1] + "~") for i, x in docs[8:]] + [(200 + i, x[:-1]) for i, x in docs[8:]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    met, groups = [], line_dedup.linked_groups

    def counting(members, *a, **b):
        met.extend(members.select("id").distinct().collect())
        return groups(members, *a, **b)

    monkeypatch.setattr(line_dedup, "linked_groups", counting)
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, "doc_id", "text").collect()}
    assert found == plain_line_dedup(docs) and sum(x == "" for x in found.values()) == 8
    assert len(met) == 8


def test_ids_in_bands_next_to_each_other_meet(spark):
    met = spark.range(12).selectExpr("7L as bucket", "id", "12L as n", "cast(id div 2 as int) as at")
    rows = links.in_bands(met, F.col("at")).select("bucket", "id").collect()
    of = {i: {r["bucket"] for r in rows if r["id"] == i} for i in range(12)}
    assert all(bool(of[i] & of[j]) == (abs(i // 2 - j // 2) <= 1) for i in of for j in of)


def test_letter_counts_lose_no_line_within_the_edits(spark):
    dice = random.Random(47)
    rows = []
    for n in (1, 9, 10, 30, 77, 200, 6000):
        for _ in range(12):
            a = "".join(dice.choices("aeinrst 0éxyzß", k=n))
            rows.append((a, edited(dice, "x" + a, n // 10 or 1)))
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"x": line_dedup.letter_counts(F.col("a")), "y": line_dedup.letter_counts(F.col("b"))})
    like = F.expr("levenshtein(a, b) <= floor(0.1 * greatest(length(a), length(b)))")
    near = F.abs(line_dedup.length_band(F.col("x")) - line_dedup.length_band(F.col("y"))) <= 1
    both = df.where(like).agg(F.count("*"), F.sum(F.when(line_dedup.may_be_like(F.col("x"), F.col("y")) & near, 1).otherwise(0))).first()
    assert both[0] == both[1] > 20


def test_one_rare_pair_of_words_is_enough(spark):
    """Four of 13 words have an edit, so 5 of 13 pairs of words are left; two that both lines sample are too much to ask."""
    dice = random.Random(53)
    docs, n = [], 160
    for k in range(n):
        line = ["".join(dice.choices("abcdefghijklmnoprstuvwxyz", k=9)) for _ in range(13)]
        docs += [(2 * k, " ".join(line)), (2 * k + 1, " ".join("q" + w if i % 3 == 2 else w for i, w in enumerate(line)))]
    found = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    gone = {r["doc_id"] for r in found.where("n_dropped = 1").collect()}
    assert gone <= {2 * k + 1 for k in range(n)} and len(gone) > 0.9 * n


def test_one_sampled_pair_of_words_is_enough_however_many_lines_have_it(spark):
    sketches = spark.createDataFrame([(i, 60, i << 40, [7, *range(100 * i + 100, 100 * i + 111)]) for i in range(40)], "id long, length int, simhash long, pairs array<int>")
    found, _ = line_dedup.candidates(sketches, sketches.select("id", "length", F.lit(None).cast("string").alias("short")))
    meet = found[0].groupBy("bucket").agg(F.collect_set("id").alias("ids")).collect()
    assert any(len(r["ids"]) == 40 for r in meet)


def test_what_is_shuffled_for_a_table_is_not_kept(spark):
    dirs = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    rows = spark.range(200000).groupBy("id").count()
    assert common.table(rows, "rows").count() == common.checkpoint(rows).count() == 200000
    time.sleep(1)
    # Of the counts above, a number a task.
    assert sum(f.stat().st_size for f in files() - before if f.exists()) < 100000


def test_finished_stars_take_no_round(spark, monkeypatch):
    written, table = [], common.table
    monkeypatch.setattr(common, "table", lambda df, name: written.append(name) or table(df, name))
    edges = lambda rows: spark.createDataFrame(rows, "a long, b long")
    found = common.connected_components(edges([(1, i) for i in range(2, 9)] + [(20, 30)]))
    assert sorted(map(tuple, found.collect())) == [(i, 1) for i in range(1, 9)] + [(20, 20), (30, 20)]
    assert len(written) == 1
    chain = common.connected_components(edges([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3)]))
    assert sorted(map(tuple, chain.collect())) == [(i, 0) for i in range(41)]


def test_repeated_substrings(spark):
    dice = random.Random(13)
    passage, short = sentence(dice, 70), sentence(dice, 30)
    docs = [(i, sentence(dice, 40) + " " + passage[dice.randrange(60) : dice.randrange(260, 300)] + " " + sentence(dice, 30) + short) for i in range(25)]
    docs += [(100, sentence(dice, 90))] * 1 + [(101, "ab" * 400), (102, "z" * 450), (103, None), (104, ""), (105, "ü" * 300), (106, docs[0][1]), (None, docs[0][1]), (107, "x" * 199), (108, "x" * 199)]
    df = frame(spark, docs)
    found = suffix_dedup.dedup(df, "doc_id", "text")
    got = found.select("doc_id", "n_bytes", suffix_dedup.removed(F.col("spans")), F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute.without_repeats(docs, 200)
    assert suffix_dedup.dedup(df.limit(0), "doc_id", "text").count() == 0


def test_contexts_of_one_anchor_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    dice = random.Random(17)
    passage = sentence(dice, 50)[:190]
    docs = [(i, sentence(dice, 30) + passage + dice.choice("abcdefghijklmno") * 12 + sentence(dice, 30)) for i in range(60)]
    found = suffix_dedup.dedup(frame(spark, docs), "doc_id", "text")
    got = found.select("doc_id", "n_bytes", suffix_dedup.removed(F.col("spans")), F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute.without_repeats(docs, 200)


def test_simhash_of_lines_of_any_number_of_words(spark):
    import xxhash

    dice = random.Random(31)
    rows = [(n, sentence(dice, n)) for n in (1, 2, 127, 255, 256, 257, 511, 512, 513, 5000)] + [(9000, "long " * 8999 + "long")]
    df = spark.createDataFrame(rows, "n long, t string").withColumn("w", F.split("t", " "))
    want = {}
    for n, t in rows:
        w = t.split(" ")
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in w]
        h = [xxhash.xxh64_intdigest(y.encode(), seed=x) for x, y in zip(h, w[1:])] + h[-1:]
        want[n] = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > n)
    got = line_dedup.with_sketches(df, ["n"], "w").collect()
    assert {r["n"]: r["simhash"] % (1 << 64) for r in got} == want
    assert all(len(r["pairs"]) == line_dedup.SAMPLES for r in got)


def test_suffix_order_is_the_sorted_order():
    dice = random.Random(19)
    texts = ["".join(dice.choices("ab", k=dice.randrange(0, 40))).encode() for _ in range(30)]
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    order, rank = suffix_dedup.suffix_order(data, at, np.arange(30) % 3, 64)
    of = np.repeat(np.arange(30), np.diff(at))
    key = lambda i: (of[i] % 3, texts[of[i]][i - at[of[i]] :])
    assert [key(i) for i in order] == sorted(key(i) for i in range(len(data)))
    assert all((rank[a] == rank[b]) == (key(a) == key(b)) for a, b in zip(order, order[1:]))


def test_decontamination(spark):
    dice = random.Random(23)
    items = [(i, sentence(dice, dice.randrange(1, 40))) for i in range(12)] + [(50, None), (51, "?!"), (52, "ba KON"), (None, sentence(dice, 12)), (3, sentence(dice, 15)), (60, "long " * 25)]
    docs = []
    for i in range(60):
        w = sentence(dice, dice.randrange(2, 60)).split()
        source = (dice.choice(items)[1] or "").split()
        s = dice.randrange(max(1, len(source) - 9))
        docs.append((i, " ".join(w[: len(w) // 2]) + " - " + ", ".join(source[s : s + dice.randrange(7, 14)]).upper() + "! " + " ".join(w[len(w) // 2 :])))
    docs += ODD
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(0))

    def run(df, bench):
        found = decontamination.find(df, "doc_id", "text", bench, "item_id", "text")
        ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
        return {tuple(r) for r in found.select("doc_id", "n_words", "n_hit", F.size("items"), ids, F.col("n_hit") > 0).collect()}

    assert run(df, bench) == brute.decontaminated(docs, items, 10)
    assert run(df, bench.limit(0)) == brute.decontaminated(docs, [], 10)
    assert run(df.limit(0), bench) == set()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    dice = random.Random(29)
    base = [sentence(dice, 60) for _ in range(12)]
    item = sentence(dice, 20)
    halves = lambda t: " ".join(t.split()[:30]) + "\n" + " ".join(t.split()[30:])
    texts = [*base, base[0], halves(changed(dice, base[1], 1)), base[2] + " " + item, "12 34", None, "", base[3] + "\n" + base[4]]
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, sentence(dice, 30), None, None, None)] * 2
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"] for r in df.select("doc_id").collect()})
        assert name == "best-fit packing" or df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    language, lines, near, clean, packed = seen
    assert language == {*range(15), 18, None}  # no letters: 15, 16, 17
    assert lines == language - {12, 18}  # every line is one of an earlier document
    assert near == lines - {13} and clean == near - {14} and packed == clean
    assert df.where("doc_id is null").select("sequence_id", "offset").count() == 1  # two equal rows are one document
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == df.count()
