"""Spelling variants: words one edit apart, found by a symmetric-delete join, and the frequent form each goes back to.

Every word emits a hash of itself and of each of its distinct single deletions, with the places at which the deletion
may have been made. Words that share a hash are candidates: one is the other's deletion, or both lose a letter at the
same place. The hash only gathers; the words themselves are compared before a pair counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytes import _ODD, _ODD_INVERSE, lean, mix, powers
from tidemark.llm.common import CRC32_LOOKUP, LOWER, UPPER, crc32_sql, forget, table

#: Letters of a word at least, occurrences at least, times that a form is more frequent.
LETTERS, OCCURRENCES, TIMES = 7, 2, 10
#: One run in so many loses a letter.
DAMAGE = 31
#: Different words, or letters in them, that a task counts before it hands them on; characters of a text at once.
HELD, PIECE = 200_000, 1 << 20
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BREAK = re.compile("[^a-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    """text in pieces that end between runs; a longer run stays whole."""
    low = 0
    while len(text) - low > PIECE and (end := _BREAK.search(text, low + PIECE)):
        yield text[low : end.start()]
        low = end.start()
    yield text[low:]


def occurrences(docs: DataFrame, key: str, text: str, letters: int = LETTERS, damage: int = DAMAGE) -> DataFrame:
    """(word, n): words of `letters` code points or more, with partial counts; a word has a row for each task or more."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % letters)

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1)):
                start = zlib.crc32(f"{name}:".encode())
                for piece in _pieces((body.as_py() or b"").translate(_LOWER).decode("utf-8", "replace")):
                    for word, n in Counter(run.findall(piece)).items():
                        if (h := zlib.crc32(word.encode(), start)) % damage == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                            if len(word) < letters:
                                continue
                        held[word] += n
                        size += len(word)
                    if len(held) > HELD or size > 10 * HELD:
                        yield handed()
                        size = 0
        yield handed()

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return docs.select(name.alias("k"), F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(task, "word string, n long")


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which word, hash, low, high): for each word itself (-1, -1) and its distinct deletions, which any place of low to high makes."""
    length = np.array([len(w) for w in words], np.int64)
    at = np.r_[0, np.cumsum(length)]
    letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(letter)
    of = np.repeat(np.arange(len(words)), length)
    place = np.arange(n) - at[:-1][of]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((letter + np.uint64(1)) * powers(_ODD, int(length.max(initial=0)))[place], out=sums[1:])
    whole = sums[at[1:]] - sums[at[:-1]]
    before, after = sums[:-1] - sums[at[:-1]][of], sums[at[1:]][of] - sums[1:]
    shorter = mix((before + after * _ODD_INVERSE) * _ODD + (length[of] - 1).astype(np.uint64))
    new = np.ones(n, bool)
    new[1:] = (letter[1:] != letter[:-1]) | (of[1:] != of[:-1])
    low = np.flatnonzero(new)
    high = np.r_[low[1:], n][: len(low)] - 1
    none = np.full(len(words), -1)
    own = mix(whole * _ODD + length.astype(np.uint64))
    return np.r_[np.arange(len(words)), of[low]], np.r_[own, shorter[low]].view(np.int64), np.r_[none, place[low]], np.r_[none, place[high]]


def _keyed(words: DataFrame) -> DataFrame:
    """words (id, word) -> (key, id, low, high)."""

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids, first = b.column(1).to_pylist(), b.column(0).to_numpy(), 0
            while first < len(texts):
                stop, size = first, 0
                while stop < len(texts) and (stop == first or size + len(texts[stop]) <= PIECE):
                    size += len(texts[stop])
                    stop += 1
                which, key, low, high = keys(texts[first:stop])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[first:stop][which]), pa.array(low), pa.array(high)], ["key", "id", "low", "high"])
                first = stop

    return words.select("id", "word").mapInArrow(task, "key long, id long, low long, high long")


def near_pairs(words: DataFrame) -> DataFrame:
    """words (id, word, n; different words) -> (a, b, word, n) with b's word and n, for every ordered pair one edit apart.

    A pair shares one key only: the shorter word, or what is left without the replaced letter. The words of a key are
    the key with one letter put in, so at most letters of the alphabet times places, however many rows there are.
    Joins are by sorting: Spark takes the keys for as few as the words, and tables for as small as their compressed files,
    and would broadcast what grows with the words.
    """
    one, other = _keyed(words).alias("one"), _keyed(words).alias("other")
    a, b = (lambda c: F.col(f"one.{c}")), (lambda c: F.col(f"other.{c}"))
    itself = (a("low") < 0) != (b("low") < 0)
    replaced = (a("low") >= 0) & (b("low") >= 0) & (a("low") <= b("high")) & (b("low") <= a("high"))
    place = F.greatest(a("low"), b("low")).cast("int").alias("place")
    met = one.join(other.hint("merge"), (a("key") == b("key")) & (a("id") != b("id")) & (itself | replaced)).select(a("id").alias("a"), b("id").alias("b"), place)
    mine = words.select(F.col("id").alias("a"), F.col("word").alias("_word"))
    theirs = words.select(F.col("id").alias("b"), "word", "n")
    cut = lambda w: F.concat(F.substr(w, F.lit(1), F.col("place")), F.substr(w, F.col("place") + 2))
    more = F.length("_word") - F.length("word")
    truly = F.when(more == 0, cut(F.col("_word")) == cut(F.col("word"))).when(more == 1, cut(F.col("_word")) == F.col("word")).when(more == -1, F.col("_word") == cut(F.col("word")))
    return met.join(mine.hint("merge"), "a").join(theirs.hint("merge"), "b").where(truly).select("a", "b", "word", "n")


def _ends(links: DataFrame) -> DataFrame:
    """links (id, to; without cycles) -> (id, to) with the last of each chain. Chains halve each round."""
    now = table(links, "links")
    while True:
        then = F.col("then.to")
        old = now
        both = now.alias("now").join(now.alias("then").hint("merge"), F.col("now.to") == F.col("then.id"), "left")
        now = table(both.select(F.col("now.id").alias("id"), F.coalesce(then, F.col("now.to")).alias("to"), then.isNotNull().alias("moved")), "links")
        forget(old)
        if not now.where("moved").head(1):
            return now.select("id", "to")
        # A form has ten times the occurrences, so a chain of longs has under 20 links: this ends in at most 6 rounds.


def variants(docs: DataFrame, key: str, text: str, letters: int = LETTERS, least: int = OCCURRENCES, times: int = TIMES, damage: int = DAMAGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `letters` code points and `least` occurrences or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a run that crc32 of `key:run` picks loses a
    letter. Null texts have no words, a null key counts as the empty string, repeated rows count each time. form is the
    most frequent word one edit away (ties: the smallest), null unless it has `times` the occurrences; root follows
    forms to the last, and is the word itself without one. An empty table gives an empty table; other columns of docs
    may have any names.
    """
    counted = occurrences(docs, key, text, letters, damage).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = table(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"), F.col("b").alias("to"))).alias("best")
    near = near_pairs(words).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best)
    near = near.select("id", "n_near", "best.form", "best.to", (-F.col("best.less")).alias("form_n"))
    has = F.col("form_n") >= F.lit(times) * F.col("n")
    formed = table(words.join(near.hint("merge"), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(has, F.col(c)).alias(c) for c in ("form", "to", "form_n")]), "formed")
    ends = _ends(formed.where("to is not null").select("id", "to"))
    roots = ends.join(words.select(F.col("id").alias("to"), F.col("word").alias("root")).hint("merge"), "to").select("id", "root")
    return formed.join(roots.hint("merge"), "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(letters: int = LETTERS, least: int = OCCURRENCES, times: int = TIMES, damage: int = DAMAGE) -> str:
    """DuckDB SQL of the same rows over `documents`; CRC-32 byte by byte, with its table made by the usual rule."""
    return f"""
with recursive {CRC32_LOOKUP},
runs as (
  select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as w from documents
), each as (select d, w, count(*) as n from runs where length(w) >= {letters} group by d, w),
hashed as (select w, n, {crc32_sql("d || ':' || w")} as h from each, lookup),
damaged as (
  select case when h % {damage} = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from hashed
), words as (select word, sum(n)::bigint as n from damaged where length(word) >= {letters} group by word having sum(n) >= {least}),
gone as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as s from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
shorter as (select distinct word, n, s from gone),
near as (
  select a.word, b.word as other, b.n as other_n from gone a join gone b on a.s = b.s and a.i = b.i and a.word <> b.word
  union all select s.word, w.word, w.n from shorter s join words w on w.word = s.s
  union all select w.word, s.word, s.n from shorter s join words w on w.word = s.s
), best as (select word, count(*) as n_near, (list(other order by other_n desc, other))[1] as form, max(other_n) as form_n from near group by word),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= {times} * n then form end as form, case when form_n >= {times} * n then form_n end as form_n
  from words w left join best b on w.word = b.word
), chain(word, last) as (
  select word, word from formed union all select c.word, f.form from chain c join formed f on f.word = c.last where f.form is not null
)
select f.word, f.form, c.last as root, f.n::bigint as n, f.n_near::bigint as n_near, f.form_n::bigint as form_n
from formed f join (select c.word, c.last from chain c join formed g on g.word = c.last where g.form is null) c on c.word = f.word
"""
