"""URL filter, licences, sharding, packing, language ID, neighbours: contracts and the odd cases."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, language_id, license_scan, packing, sharding, url_filter
from tidemark.llm.common import connected_components, position_in_group
from tidemark.llm.queries import URL_RULES, tokenizer_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    found = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_positions_are_gapless_and_sums_run(spark):
    df = spark.range(200).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), "id", (F.col("id") % 5).alias("size"))
    found = position_in_group(df, ["g"], [], "id", "at", salts=8).collect()
    for g in ("hot", None):
        own = [r for r in found if r["g"] == g]
        assert sorted(r["at"] for r in own) == list(range(len(own)))
    sums = position_in_group(df, ["g"], [], "id", "before", of="size", salts=8).where("g is null").collect()
    assert sum(r["size"] for r in sums) == max(r["before"] + r["size"] for r in sums)


PAGES = [
    (1, "http://a.example.com/x?q", None),
    (2, "https://shop.example.com/en/1", '<link href="http://a.example.org/p" rel="canonical">'),
    (3, "http://a.example.org/p#top", None),
    (4, "http://b.example.org/", "<META HTTP-EQUIV='refresh' content='0; url=/en/'>"),
    (5, None, "<link rel=canonical href=http://b.example.org/>"),
    (6, "no scheme", ""),
    (7, "http://WWW.Example.com/en/2", None),
    (8, "http://c.net/es/1", '<link rel="canonical" href="//d.example.org/z">'),
    (9, "http://d.example.org/z", None),
    (9, "http://d.example.org/z", None),
    (None, "http://example.com", "x"),
    (11, "http://evil.com.org/en/", None),
]


def test_url_filter(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    found = {r["page_id"]: r for r in url_filter.judge(df, "page_id", "url", URL_RULES, html="html").collect()}
    says = {k: (r["rule"], r["verdict"]) for k, r in found.items()}
    assert says[1] == ("com/", "allow") and says[7] == ("www.example.com/en/", "allow")
    assert says[2] == ("example.com/en/", "block") and says[3] == (None, "block")  # an alias of a blocked page
    assert says[8] == ("net/es/", "block") and says[9] == (None, "block")
    assert says[4] == (None, "allow") and says[5] == (None, "allow") and says[6] == (None, "allow") and says[11] == (None, "allow")
    assert (found[6]["host"], found[6]["path"], found[None]["host"], found[None]["path"], says[None]) == ("", "", "example.com", "", (None, "allow"))
    assert url_filter.judge(df, "page_id", "url", URL_RULES, html="html").count() == len(PAGES)
    assert url_filter.judge(df.limit(0), "page_id", "url", URL_RULES, html="html").count() == 0


RELATIVE = [
    ("http://a.net/x/y?q=1", '<meta http-equiv="refresh" content="0; url=../es/1">', "http://a.net/es/1"),
    ("http://b.net/x/y", '<link rel=canonical href="index.html">', "http://b.net/x/index.html"),
    ("http://c.net/x/y?q=1#f", '<link rel=canonical href="?p=2">', "http://c.net/x/y?p=2"),
    ("http://d.net", '<link rel=canonical href="./p/./q/..">', "http://d.net/p/"),
    ("http://e.net/x", '<base href="/deep/er/"><link rel=canonical href="../z">', "http://e.net/deep/z"),
    ("http://f.net/x", '<base href="http://F2.net/a/b"><link rel=canonical href="c?u=http://q.net/../r">', "http://f2.net/a/c?u=http://q.net/../r"),
    ("http://g.net/x", '<link rel=canonical href="/../../z/../y">', "http://g.net/y"),
    ("http://h.net/x", '<link rel=canonical href="//i.net/z">', "http://i.net/z"),
    ("http://j.net/x", '<link rel=canonical href="#top">', None),
    ("http://k.net/x", '<link rel=canonical href="mailto:a@b.net">', None),
]


def test_relative_links_join_their_component(spark):
    df = spark.createDataFrame([(u, h) for u, h, _ in RELATIVE], "url string, html string")
    a = [u.split("#")[0] for u, _, _ in RELATIVE]
    assert rows(url_filter.linked_addresses(df, "url", "html")) == sorted(((u, to) for u, (_, _, to) in zip(a, RELATIVE) if to), key=str)
    pages = spark.createDataFrame([(1, "http://a.net/x/y", "<meta http-equiv=refresh content='0; url=../es/1'>"), (2, "http://a.net/es/1", None)], "page_id long, url string, html string")
    assert rows(url_filter.judge(pages, "page_id", "url", URL_RULES, html="html").select("page_id", "verdict")) == [(1, "block"), (2, "block")]


def test_spellings_of_an_address_are_aliases(spark):
    same = ["http://www.x.org/a/", "https://x.org/a?utm=1", "HTTP://M.X.org/a.html#top", "http://x.org/a//"]
    other = ["http://x.org/a/b", "http://m.org/a", "http://org/a", "http://www.m.x.org/A", "no host", None]
    rows_in = [(i, u) for i, u in enumerate([*same, *other, same[0]])]
    moved = spark.createDataFrame([("https://x.org/a?utm=1", "http://y.net/es/")], "a string, b string")
    df = spark.createDataFrame(rows_in, "page_id long, url string").withColumn("a", F.lit("clash")).withColumn("b", F.lit("clash"))
    found = {r["page_id"]: (r["verdict"], r["component"]) for r in url_filter.judge(df, "page_id", "url", URL_RULES, redirects=moved, addresses=True).collect()}
    # One of them leads to a blocked page, so all of its spellings are blocked.
    assert {found[i] for i in (0, 1, 2, 3, 10)} == {("block", "http://m.x.org/a.html")}
    assert all(found[i] == ("allow", None) for i in range(4, 10))
    assert url_filter.judge(df.limit(0), "page_id", "url", URL_RULES, addresses=True).count() == 0


def test_an_allowed_alias_keeps_its_component_open(spark):
    df = spark.createDataFrame([(1, "http://x.net/es/", None), (2, "http://y.org/", None), (3, "http://z.com/", None)], "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://x.net/es/", "http://y.org/"), ("http://y.org/", "http://z.com/"), (None, "http://y.org/")], "a string, b string")
    assert rows(url_filter.judge(df, "page_id", "url", URL_RULES, redirects=moved).select("page_id", "verdict")) == [(1, "block"), (2, "allow"), (3, "allow")]


def test_licences_in_other_spellings(spark):
    mit = license_scan.MIT.replace("Copyright (c) <year>", "COPYRIGHT 2020 A. Body and").replace("software", "SOFTWARE").replace("\n\n", "\r\n\r\n  ")
    docs = [(1, mit), (2, license_scan.APACHE_LINE.replace("License", "LICENCE")), (3, license_scan.MIT + " and more"), (4, ""), (5, None), (6, "!!!"), (None, mit), (1, mit)]
    found = rows(license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string").withColumn("license", F.lit(0)), "doc_id", "text").select("doc_id", "license"))
    assert found == sorted([(1, "MIT"), (1, "MIT"), (2, "Apache-2.0-line"), (3, None), (4, None), (5, None), (6, None), (None, "MIT")], key=str)


def test_lines_that_are_notices(spark):
    docs = [
        (1, "Intro.\nRELEASED under the MIT licence\r\nMore text.\n  Licensed under CC BY-NC 4.0.  \nLicensed under the M.I.T. terms."),
        (2, "It is released under the MIT License. Or is it?"),
        (3, license_scan.APACHE_LINE),
        (4, None),
        (5, "licence\n" * 20_000 + "Licensed under the MIT License!"),
        (1, "x\nLicensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."),
        (None, "Released under the MIT License."),
        (7, ""),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("notices", F.lit(1)).withColumn("_row", F.lit(2))
    found = rows(license_scan.scan(df, "doc_id", "text").select("doc_id", "license", "notices"))
    want = [(1, None, "CC-BY-NC-4.0-line,MIT-line"), (2, None, None), (3, "Apache-2.0-line", "Apache-2.0-line"), (4, None, None), (5, None, "MIT-line"), (1, None, "Apache-2.0-line"), (None, None, "MIT-line"), (7, None, None)]
    assert found == sorted(want, key=str)
    assert license_scan.scan(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("width", [50, 60, 66, 72, 79, 80, 100])
def test_licences_wrapped_by_hand(spark, width):
    import textwrap

    wrap = lambda t, w: "\n".join(textwrap.fill(p, w, break_on_hyphens=False) for p in t.split("\n"))
    docs = [(name, wrap(t, w)) for name, t in license_scan.KNOWN for w in (width, width + 1, width + 2)]
    isc = license_scan.ISC.replace("above copyright notice", "above\ncopyright notice").replace("Copyright <year> <owner>", "Copyright Jane Body\n(c) 2020 A. Body\n© B. Body")
    docs += [("ISC", isc), ("MIT", license_scan.MIT.replace("OR COPYRIGHT", "OR\nCOPYRIGHT"))]
    found = rows(license_scan.scan(spark.createDataFrame(docs, "name string, text string"), "name", "text").select("name", "license"))
    assert found == sorted(((n, n) for n, _ in docs), key=str)


def test_sharding_is_balanced_gapless_and_moves_little(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 90 + 8).alias("size"))
    found = sharding.shard(df, "doc_id", "size", 24).collect()
    loads, slots = np.zeros(24), {}
    for r in found:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert loads.max() / loads.mean() < 1.05 and loads.min() / loads.mean() > 0.9
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and len(found) == 6000
    cells = {c: 1000 for c in range(sharding.CELLS)}
    before, after = ({(c, low): s for c, low, _, s in sharding.walk(cells, n)} for n in (24, 25))
    moved = sum(before[k] != after.get(k) for k in before) / len(before)
    assert moved < 0.35
    odd = spark.createDataFrame([(None, 5), (1, None), (1, None), (1, 3)], "doc_id long, size long")
    assert sharding.shard(odd, "doc_id", "size", 3).count() == 4
    assert sharding.shard(odd.limit(0), "doc_id", "size", 3).count() == 0


def test_encoder_agrees_with_the_tokenizer_on_whole_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    dice = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "\t", "a", "it's", "Wörter", "12", "...", " ", "\x1f", "é", "<|endoftext|>", "\r\n", "日本", "'ll", " \n", " "]
    texts = ["".join(dice.choices(bits, k=dice.randrange(12))) for _ in range(600)] + ["", " ", "\n", " a", "a ", "\na\n"]
    encode = packing.Encoder(tokenizer_path())
    for low in range(0, len(texts), 100):
        for text, ids in zip(texts[low : low + 100], encode(pa.array(texts[low : low + 100], pa.large_string()))):
            assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("feed", [None, [], [12]])
def test_new_words_get_their_own_slots(feed):
    """Words that are lines of one text, and others, in any order; a tokenizer whose line feed is not one id, or never found."""
    encode = packing.Encoder(tokenizer_path())
    encode.feed = encode.feed if feed is None else feed
    dice = random.Random(4)
    words = list({"".join(dice.choices([" ", "a", "Wört", "\n", ".", "\t", "9"], k=dice.randrange(5))) for _ in range(300)})
    for some in (words[:100], [], words[100:]):
        slots = encode._learn(pa.array(some, pa.large_string()))
        assert sorted(slots.tolist()) == list(range(len(encode.words) - len(some), len(encode.words)))
        for word, k in zip(some, slots.tolist()):
            assert encode.words[k].as_py() == word
            assert encode.ids[encode.low[k] :][: encode.size[k]].tolist() == encode.tokenizer.encode(word, add_special_tokens=False).ids, repr(word)


def test_packing(spark):
    docs = [(1, "a b " * 90), (2, None), (3, ""), (4, "x " * 31), (4, "x " * 31), (None, "y y y"), *[(10 + i, "w " * i) for i in range(40)]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit("clash"))
    found = packing.pack(df, "doc_id", "text", tokenizer_path(), most=64).toPandas()
    encode = packing.Encoder(tokenizer_path())
    want = brute.token_pieces(docs, lambda t: encode(pa.array([t], pa.large_string()))[0].tolist(), 64)
    got = sorted(((None if d != d else int(d), p, s, n, zlib.crc32(bytes(i))) for d, p, s, n, i in found[["doc_id", "piece", "start", "length", "ids"]].itertuples(index=False)), key=str)
    assert got == want
    for _, bin_ in found.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum()[:-1]] and bin_.length.sum() <= 64
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 64) + 1
    assert packing.pack(df.limit(0), "doc_id", "text", tokenizer_path()).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # Greedy takes 5 + 4 of 10; 5 + 3 + 2 fits the widened gap.
    assert (1, {5: 1, 3: 1, 2: 1}) in packing.patterns({5: 1, 4: 1, 3: 1, 2: 1}, 10)
    dice = random.Random(5)
    for _ in range(30):
        counts = {n: dice.randrange(1, 9) for n in dice.sample(range(1, 65), 20)}
        found = packing.patterns(counts, 64)
        used: dict = {}
        for times, one in found:
            assert sum(n * k for n, k in one.items()) <= 64
            for n, k in one.items():
                used[n] = used.get(n, 0) + times * k
        assert used == counts


WORDS = {"en": "the and of house water running with people", "de": "der und haus wasser mit leuten laufen nicht", "fr": "le et de maison avec les gens courir pas"}


def test_language_of_held_out_texts(spark):
    dice = random.Random(1)
    docs = [(i, " ".join(dice.choices(WORDS[lang].split(), k=dice.randrange(4, 30))), lang if i % 2 else None, lang, f"www.site{i % 9}.{lang}") for i in range(300) for lang in [dice.choice(list(WORDS))]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, truth string, host string").withColumn("n", F.lit("clash"))
    model = language_id.fit(df.where("doc_id % 2 = 1"), "text", "lang")
    held = df.where("doc_id % 2 = 0")
    found = language_id.identify(held, "text", {"doc_id": F.col("doc_id"), "truth": F.col("truth")}, model=model).collect()
    assert sum(r["language"] == r["truth"] for r in found) >= 0.95 * len(found) and not any(r["rejected"] for r in found)
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "de", None), (3, "12 34", None, "x.fr"), (4, "und der und", None, None), (4, "und der und", None, None), (None, "the water", "xx", "a.en:80")], "doc_id long, text string, lang string, host string")
    both = df.select("doc_id", "text", "lang", "host").union(odd)
    got = language_id.identify(both, "text", {"doc_id": F.col("doc_id"), "text": F.col("text")}, declared=F.col("lang"), host=F.col("host"), model=model).where("doc_id < 5 or doc_id is null").collect()
    by = {(r["doc_id"], r["text"]): (r["language"], r["rejected"]) for r in got}
    assert by[1, None] == (None, True) and by[2, ""] == ("de", True) and by[3, "12 34"] == ("fr", True)
    assert by[4, "und der und"] == ("de", False) and by[None, "the water"] == ("en", False)
    none = language_id.identify(odd.limit(0), "text", {"doc_id": F.col("doc_id")}, declared=F.col("lang"), label="lang")
    assert none.count() == 0
    blank = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string")), "text", {"doc_id": F.col("doc_id")}, label="lang").collect()
    assert len(blank) == 6 and not any(r["rejected"] or r["language"] for r in blank)


def test_host_and_declaration_decide_for_short_texts(spark):
    dice = random.Random(2)
    docs = [(i, " ".join(dice.choices(WORDS["fr" if i % 3 else "en"].split(), k=12)), "fr" if i % 3 else "en", "a.fr" if i % 3 else "b.en") for i in range(200)]
    df = spark.createDataFrame([*docs, (1000, "q", None, "a.fr"), (1001, "q", None, "b.en")], "doc_id long, text string, lang string, host string")
    got = {r["doc_id"]: r["language"] for r in language_id.identify(df, "text", {"doc_id": F.col("doc_id")}, declared=F.col("lang"), host=F.col("host"), label="lang").where("doc_id >= 1000").collect()}
    assert got == {1000: "fr", 1001: "en"}


def test_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 16)).astype(np.float32)
    v[500:900] = v[3]  # a vector that many share
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0, None] + [1.0] * 14), (2400, [1.0]), (None, v[0].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    found = ann.search(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, k=10).toPandas()
    ids, all_v = np.array([*range(1500)]), v.astype(np.float64)
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((all_v - all_v[q]) ** 2).sum(1))
        want = [(round(d[i], 9), i) for i in np.lexsort((ids, d)) if i != q][:10]
        got = found[found.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 11)) and got.score.is_monotonic_increasing
        if q in (500, 600, 700, 800):
            assert [i for i in got.vec_id] == [i for _, i in want]
        hit += len({i for _, i in want} & set(got.vec_id))
    assert hit >= 0.9 * 150 and set(found.query_id) == set(range(0, 1500, 100))
    few = ann.search(spark.createDataFrame(data[:4] + [(100, [1.0] * 16)], df.drop("score").schema), "vec_id", "embedding", F.col("vec_id") == 100, k=10)
    assert few.count() == 4
    assert ann.search(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id = 7"), "vec_id", "embedding", F.col("vec_id") == 7).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5])
def test_crc_of_nothing(spark, n):
    from tidemark.llm.common import crc32_of_text

    text = None if not n else "é" * n
    assert spark.createDataFrame([(text,)], "t string").select(crc32_of_text(F.col("t"))).first()[0] == zlib.crc32((text or "").encode())
