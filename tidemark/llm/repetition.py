"""Quality rules: plain counts of a text, and repetition within it by its suffix array.

A text's suffixes are ordered by Larsson-Sadakane refinement. Prefixes that neighbours in the order have in common are
its intervals: the deepest one that holds a suffix is the longest string that starts there and anywhere else. Those
stretches, the occurrences of maximal repeated substrings, are united; what they cover and the longest are limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytes import lean

#: Words at least; per cent of words in repeated 3-word windows at most.
WORDS, REPEATED_WORDS = 50, 50
#: Bytes of a repeated substring at least; per cent of the text's bytes that they cover, and that the longest has, at most.
REPEAT, COVERED, LONGEST = 64, 30, 15
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Bytes that a first key has; pairs' bytes compared one word after the other, then in stretches.
_KEY, _STEPS, _STRETCH = 7, 32, 1 << 14


def suffixes(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, pairs): suffixes of data that share their first bytes (the most of 7, 14, 28, ... up to `least`) with
    another, in order, and whether each shares them with the one before it.

    A suffix comes before those that it begins.
    """
    n, k = len(data), _KEY
    code = np.zeros(n + k, np.uint64)
    code[:n] = data
    code[:n] += np.uint64(1)
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key = (key << np.uint64(9)) | code[j : n + j]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    alone = new.copy()
    alone[:-1] &= new[1:]
    where = np.flatnonzero(~alone)  # places whose suffix is not yet told apart
    shared, same = where, ~new[where]
    while len(where):
        if k <= least:
            shared, same = where, ~new[where]
        elif not len(shared):
            break
        s = order[where]
        on = s + k
        second = np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)  # of one stretch, only one suffix can end here
        pair = (rank[s] << 32) | second if n < 1 << 31 else None
        if pair is None:
            again = np.lexsort((second, rank[s]))
            a, b = rank[s][again], second[again]
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        else:
            again = np.argsort(pair)
            pair = pair[again]
            fresh = np.ones(len(pair), bool)
            fresh[1:] = pair[1:] != pair[:-1]
        s = s[again]
        order[where] = s
        starts = np.flatnonzero(fresh)
        rank[s] = np.repeat(where[starts], np.diff(np.r_[starts, len(s)]))
        new[where] = fresh
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        where = where[~alone]
        k *= 2
    return order[shared], same


def common_prefixes(data: np.ndarray, order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of `order` has in common with the one before it, where `same`; else 0.

    As in Kasai's algorithm, a pair whose bytes before it are equal has one less than the pair before it. The others
    are compared, all at once; their sum is bound by n log n.
    """
    n, out = len(data), np.zeros(len(order), np.int64)
    if not len(order):
        return out
    i, j = order[1:][same[1:]], order[:-1][same[1:]]
    apart = (i == 0) | (j == 0) | (data[i - 1] != data[j - 1])
    p = np.full(n, -1, np.int64)  # by the place of the suffix
    a, b = i[apart], j[apart]
    most = n - np.maximum(a, b)
    got = np.zeros(len(a), np.int64)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live = np.arange(len(a))
    for _ in range(_STEPS):
        if not len(live):
            break
        differ = word[a[live] + got[live]] != word[b[live] + got[live]]
        step = np.where(differ.any(1), differ.argmax(1), 8)
        got[live] = np.minimum(got[live] + step, most[live])
        live = live[(step == 8) & (got[live] < most[live])]
    for x in live.tolist():
        u, v, l, end = int(a[x]), int(b[x]), int(got[x]), int(most[x])
        while l < end:
            width = min(_STRETCH, end - l)
            differ = data[u + l : u + l + width] != data[v + l : v + l + width]
            if differ.any():
                l += int(differ.argmax())
                break
            l += width
        got[x] = l
    p[a] = got
    rest = i[~apart]
    if len(rest):
        last = np.maximum.accumulate(np.where(p >= 0, np.arange(n), -1))[rest]
        p[rest] = p[last] - (rest - last)
    out[1:][same[1:]] = p[i]
    return out


def repeats(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the longest string of `least` bytes or more that starts at a place and at any other."""
    if len(data) <= least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, same = suffixes(data, least)
    up = common_prefixes(data, order, same)
    deepest = up.copy()
    deepest[:-1] = np.maximum(deepest[:-1], up[1:])
    take = deepest >= least
    return order[take], deepest[take]


def covered(place: np.ndarray, length: np.ndarray, n: int) -> int:
    """Bytes in the union of the stretches."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + length, -1)
    return int((np.cumsum(step)[:n] > 0).sum())


def in_repeated_windows(words: list[bytes], size: int = 3) -> int:
    """Words in windows of `size` words that are found twice or more."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    name = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key = name[: n - size + 1]
    for k in range(1, size):
        _, key = np.unique(key, return_inverse=True) if len(seen) ** (k + 1) >= 1 << 62 else (None, key)
        key = key * len(seen) + name[k : n - size + 1 + k]
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.zeros(n + 1, np.int64)
    twice = np.flatnonzero(times[back] > 1)
    np.add.at(hit, twice, 1)
    np.add.at(hit, twice + size, -1)
    return int((np.cumsum(hit)[:n] > 0).sum())


def measure(text: bytes, least: int = REPEAT) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bytes, n_covered, longest of a text."""
    data, words = np.frombuffer(text, np.uint8), text.split()
    chars = int((((data & 0xC0) != 0x80) & ~_SPACE[data]).sum())
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    place, length = repeats(data, least)
    return len(words), chars, int(_SYMBOL[data].sum()), dup, in_repeated_windows(words), len(data), covered(place, length, len(data)) if len(place) else 0, int(length.max(initial=0))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_covered", "longest"]


def judge(docs: DataFrame, key: str, text: str, words: int = WORDS, repeated: int = REPEATED_WORDS, least: int = REPEAT, most: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """One row for each row of docs: key, the counts of NAMES (long), base_failed, kept.

    base_failed: under `words` words, or over `repeated` per cent of them in 3-word windows found twice or more. Others
    are kept unless repeated substrings of `least` bytes or more, wherever they start, cover over `most` per cent of the
    text's UTF-8 bytes, or the longest has over `longest` per cent of them. Nothing is shuffled; a task works on a text
    at a time, in about 60 times its bytes. Null and empty texts have no words and so fail; repeated rows stay, null
    keys too; other columns of docs are dropped, whatever their names. An empty table gives an empty table.
    """

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[bytes, tuple[int, ...]] = {}  # copies in a batch are measured once
            found = []
            for t in b.column(1):
                body = t.as_py() or b""
                if body not in known:
                    known[body] = measure(body, least)
                found.append(known[body])
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64()) for _ in NAMES]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["k", *NAMES])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(task, f"k {kind}, " + ", ".join(f"{c} long" for c in NAMES))
    failed = (F.col("n_words") < words) | (100 * F.col("n_repeat_words") > repeated * F.col("n_words"))
    fine = (100 * F.col("n_covered") <= most * F.col("n_bytes")) & (100 * F.col("longest") <= longest * F.col("n_bytes"))
    return found.select(F.col("k").alias(key), *NAMES, failed.alias("base_failed"), (~failed & fine).alias("kept"))


def sql(words: int = WORDS, repeated: int = REPEATED_WORDS, least: int = REPEAT, most: int = COVERED, longest: int = LONGEST) -> str:
    """DuckDB SQL of the rows of op13 over `documents`, whose ids are distinct there. A byte is covered if a string of
    `least` bytes around it is found twice; the longest repeat is too long if a string of that many bytes is found twice."""
    space = r"[\x20\x09-\x0d]"
    return rf"""
with docs as (select doc_id, coalesce(text, '') as t, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
words as (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0d]+') as w from docs),
plain as (
  select d.doc_id, len(w) as n_words, length(regexp_replace(t, '{space}', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, n as n_bytes
  from docs d join words using (doc_id)
), lines as (select doc_id, line, count(*) as m from (select doc_id, unnest(string_split(t, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0d]') group by doc_id, line),
dup as (select doc_id, sum(m - 1) as n_dup_lines from lines group by doc_id),
windows as (select doc_id, i, [w[i], w[i + 1], w[i + 2]] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as m from windows) where m > 1),
rep as (select doc_id, count(distinct i + k) as n_repeat_words from twice, range(3) r(k) group by doc_id),
blocks as (select doc_id, n, 256 * b as low, substr(x, 512 * b + 1, {2 * (255 + least)}) as y from (select doc_id, n, x, unnest(range((n - {least}) // 256 + 1)) as b from docs where n >= {least})),
grams as (select doc_id, n, low + j as i, substr(y, 2 * j + 1, {2 * least}) as g from blocks, range(256) r(j) where low + j <= n - {least}),
again as (select doc_id, n, i from (select doc_id, n, i, count(*) over (partition by doc_id, g) as m from grams) where m > 1),
gaps as (select doc_id, n, i, lag(i) over (partition by doc_id order by i) as p from again),
cover as (select doc_id, sum(least({least}, coalesce(i - p, {least}))) as n_covered from gaps group by doc_id),
long as (select d.doc_id, d.x, unnest(range(d.n - greatest({least}, d.n * {longest} // 100 + 1) + 1)) as i, greatest({least}, d.n * {longest} // 100 + 1) as z from docs d join cover c using (doc_id) where 100 * n_covered > {longest} * n),
far as (select distinct doc_id from (select doc_id, count(*) as m from long group by doc_id, md5(substr(x, 2 * i + 1, 2 * z))) where m > 1),
judged as (
  select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_bytes, coalesce(n_covered, 0) as n_covered,
    n_words < {words} or 100 * coalesce(n_repeat_words, 0) > {repeated} * n_words as base_failed, far.doc_id is not null as far
  from plain left join dup using (doc_id) left join rep using (doc_id) left join cover using (doc_id) left join far using (doc_id)
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_covered::bigint as n_covered, base_failed, not base_failed and 100 * n_covered <= {most} * n_bytes and not far as kept from judged
"""
