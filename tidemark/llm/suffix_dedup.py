"""Removal of long byte strings that start in more than one place, by suffix arrays in shards.

Every string of `length` bytes has an anchor: the start of its `gram`-byte stretch with the least hash. Equal strings
have equal anchors at the same distance, so only places whose anchors' stretches occur again can repeat, and all that
could match meets under one anchor. An anchor's context is everything a string with that anchor can cover.
Equal contexts are one (that is how copies, however many, stay cheap). Different contexts of an anchor go to a shard,
where a suffix array is built by Larsson-Sadakane refinement and common prefixes by Kasai's algorithm. Contexts of an
anchor that has too many for a shard are dealt to several, whose sorted strings are then merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytes import _ODD, _ODD_INVERSE, flat, lean, mix, powers, runs
from tidemark.llm.common import checkpoint, sieve

LENGTH, GRAM = 200, 100
#: Bytes of contexts in a shard, about; an anchor with more than half of it is split.
SHARD = 1 << 20
#: Bytes of text whose anchors are looked for at once; one longer text is taken in stretches.
AT_ONCE = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
#: What a row of a shard's results is: a repeated stretch, a string of a split anchor, or a place that has it.
DONE, STRING, PLACE = 0, 1, 2


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash of the stretch, hash of the context) of the anchors of all strings of `length` bytes.

    At most 2^24 bytes. Of equal least hashes the first counts.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, n), out=sums[1:])
    back = powers(_ODD_INVERSE, n + 1)
    h = mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    # Least key of each `width` in a row: from running minima within blocks, forwards and backwards.
    width = length - gram + 1
    padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    forwards = np.minimum.accumulate(blocks, axis=1).ravel()
    backwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backwards[: n - length + 1], forwards[width - 1 : n - gram + 1])
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = of[: n - length + 1] == of[length - 1 :]
    place = np.unique(least[inside] & _PLACE).astype(np.int64)
    text = of[place]
    low = np.maximum(at[text], place - (length - gram))
    high = np.minimum(at[text + 1], place + length)
    context = mix((sums[high] - sums[low]) * back[low] ^ ((place - low).astype(np.uint64) << np.uint64(32)) ^ (high - low).astype(np.uint64))
    return text, place - at[text], h[place], context


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """texts (d, text) -> (d, pos, h, c); equal texts of a batch once."""

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column(0).to_numpy()
            _, first = np.unique(d, return_index=True)
            first.sort()
            d = d[first]
            all_data, all_at = flat(b.column(1).take(pa.array(first)))
            for lo, hi in runs(np.diff(all_at), AT_ONCE):
                whole, at = all_data[all_at[lo] : all_at[hi]], all_at[lo : hi + 1] - all_at[lo]
                # A longer text in stretches that overlap enough for every context.
                for core in range(0, max(len(whole), 1), AT_ONCE):
                    if hi - lo > 1 or len(whole) <= AT_ONCE:
                        start, stop, part_at = 0, len(whole), at
                    else:
                        start, stop = max(0, core - 2 * length), min(len(whole), core + AT_ONCE + 3 * length)
                        part_at = np.array([0, stop - start])
                    text, pos, h, c = anchors(whole[start:stop], part_at, length, gram)
                    pos = pos + start
                    if stop - start < len(whole):
                        own = (pos >= core) & (pos < core + AT_ONCE)
                        text, pos, h, c = text[own], pos[own], h[own], c[own]
                    yield pa.RecordBatch.from_arrays([pa.array(d[lo:hi][text]), pa.array(pos), pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))], ["d", "pos", "h", "c"])
                    if hi - lo > 1:
                        break

    return texts.mapInArrow(task, "d long, pos long, h long, c long")


def suffix_order(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of the texts data[at[i]:at[i + 1]], by group, then by their first `depth` bytes or more.

    Larsson-Sadakane: suffixes ordered by their first k bytes are refined to 2k by the ranks k bytes on, and only
    those that are not yet alone take part. Suffixes equal that far share a rank (the last place of their stretch).
    A suffix ends with its text, and comes before those that it begins.
    """
    n = len(data)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left = at[1:][of] - np.arange(n)
    k = 4
    padded = np.r_[data, np.zeros(k, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key = (key << np.uint64(9)) | np.where(left > j, padded[j : n + j] + np.uint64(1), 0).astype(np.uint64)
    _, dense = np.unique(group, return_inverse=True)
    key |= dense.astype(np.uint64)[of] << np.uint64(36)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]

    def ranks(new: np.ndarray) -> np.ndarray:
        ends = np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]
        return ends[np.cumsum(new) - 1]

    rank = np.zeros(n, np.int64)
    if n:
        rank[order] = ranks(new)
    where = np.flatnonzero(~(new & np.r_[new[1:], True])) if n else np.zeros(0, np.int64)  # places not yet alone
    while k < depth and len(where):
        s = order[where]
        nxt = np.where(left[s] > k, rank[np.minimum(s + k, n - 1)] + 1, 0)
        pair = (rank[s].astype(np.uint64) << np.uint64(32)) | nxt.astype(np.uint64)
        again = np.argsort(pair, kind="stable")
        s, pair = s[again], pair[again]
        order[where] = s
        # Places in `where` are in ascending order, and a stretch of equal rank fills its own places.
        new = np.r_[True, pair[1:] != pair[:-1]]
        ends = np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]
        rank[s] = where[ends[np.cumsum(new) - 1]]
        where = where[~(new & np.r_[new[1:], True])]
        k *= 2
    return order, rank


def common_prefixes(data: np.ndarray, at: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
    """For each place its common prefix with the place `before` it in suffix order (-1: none), up to `most`, inside texts.

    Kasai: if the place before it moves on with the place itself, the common prefix is just one shorter, so it is only
    ever extended; else it is counted anew. All texts are walked side by side.
    """
    n, size = len(data), np.diff(at)
    of = np.repeat(np.arange(len(size)), size)
    ends = at[1:][of]
    out = np.zeros(n, np.int64)
    walking = np.arange(len(size))
    length = np.zeros(len(size), np.int64)
    for step in range(int(size.max(initial=0))):
        walking = walking[size[walking] > step]
        i = at[walking] + step
        j = before[i]
        moved = (j > 0) & (before[np.maximum(i - 1, 0)] == j - 1) if step else np.zeros(len(i), bool)
        length[walking] = np.where(moved, np.maximum(length[walking] - 1, 0), 0)
        more = np.flatnonzero(j >= 0)
        while len(more):
            w = walking[more]
            a, b = i[more] + length[w], j[more] + length[w]
            good = (length[w] < most) & (a < ends[i[more]]) & (b < ends[j[more]])
            good &= data[np.minimum(a, n - 1)] == data[np.minimum(b, n - 1)]
            more = more[good]
            length[walking[more]] += 1
        out[i] = length[walking]
    return out


def _repeats_in_shard(length: int, gram: int):
    """A function of a shard's contexts: what of each context is repeated, and the strings of split anchors."""

    def task(t: pa.Table) -> pa.Table:
        h, c, d, pos, off, whole, split = (t.column(x).to_numpy() for x in ("h", "c", "d", "pos", "off", "whole", "split"))
        data, at = flat(t.column("ctx"))
        shard = t.column("shard")[0].as_py()
        order, rank = suffix_order(data, at, h, length)
        of = np.repeat(np.arange(len(h)), np.diff(at))
        t_in = np.arange(len(data)) - at[:-1][of]
        start = pos[of] - off[of] + t_in  # in the document
        able = (t_in <= off[of]) & (at[1:][of] - np.arange(len(data)) >= length)
        # Contexts overlap: a place of a document counts once for each anchor hash.
        cand = order[able[order]]
        seen = np.lexsort((start[cand], d[of[cand]], h[of[cand]]))
        s = cand[seen]
        twice = np.zeros(len(s), bool)
        twice[1:] = (h[of[s[1:]]] == h[of[s[:-1]]]) & (d[of[s[1:]]] == d[of[s[:-1]]]) & (start[s[1:]] == start[s[:-1]])
        single = np.ones(len(data), bool)
        single[s[twice]] = False
        cand = cand[single[cand]]
        before = np.full(len(data), -1, np.int64)
        before[cand[1:]] = np.where(h[of[cand[1:]]] == h[of[cand[:-1]]], cand[:-1], -1)
        common = common_prefixes(data, at, before, length)
        again = np.zeros(len(cand), bool)
        tie = common[cand] >= length
        again |= tie
        again[:-1] |= tie[1:]
        hit = cand[again & ~whole[of[cand]]]
        hit.sort()
        # Starts one after the other cover one stretch.
        first = np.ones(len(hit), bool)
        first[1:] = (of[hit[1:]] != of[hit[:-1]]) | (hit[1:] - hit[:-1] > length)
        firsts = np.flatnonzero(first)
        lasts = np.r_[firsts[1:] - 1, len(hit) - 1] if len(hit) else firsts
        n = len(firsts)
        columns = [d[of[hit[firsts]]], start[hit[firsts]], start[hit[lasts]] + length, *[np.zeros(n, np.int64)] * 2]
        # Of a split anchor, each distinct string once, and the places that no string of this shard repeats.
        parts = [[*columns, np.full(n, DONE)]]
        open_ = cand[split[of[cand]]]
        if len(open_):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(data)), out=sums[1:])
            # Equal strings follow each other in suffix order.
            first = open_[common[open_] < length]
            alone = cand[~again]
            alone = alone[split[of[alone]] & ~whole[of[alone]]]
            back = powers(_ODD_INVERSE, len(data) + 1)
            for places, kind in ((first, STRING), (alone, PLACE)):
                string = mix((sums[places + length] - sums[places]) * back[places]).astype(np.int64)
                parts.append([d[of[places]], start[places], start[places] + length, h[of[places]], string, np.full(len(places), kind)])
        columns = [np.concatenate(x) for x in zip(*parts)]
        return pa.table([*map(pa.array, columns), pa.array(np.full(len(columns[0]), shard, np.int64))], names=["d", "start", "end", "h", "string", "kind", "shard"])

    return task


def _merged(t: pa.Table) -> pa.Table:
    """The places of one bucket of split anchors whose string is in another shard's run too, by binary search in it."""
    key = mix(t.column("string").to_numpy().astype(np.uint64) ^ mix(t.column("h").to_numpy().astype(np.uint64)))
    kind, shard = t.column("kind").to_numpy(), t.column("shard").to_numpy()
    every = np.sort(key[kind == STRING])  # a string once a shard
    places = np.flatnonzero(kind == PLACE)
    own = key[places]
    times = np.searchsorted(every, own, "right") - np.searchsorted(every, own)
    return t.select(["d", "start", "end"]).take(pa.array(places[times > 1]))


def repeated_spans(docs: DataFrame, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(d, spans): for texts by their xxhash64, stretches [start, end) of bytes covered by strings that start elsewhere.

    Of equal texts only one is looked at, so copies are not seen as repeats of each other here.
    """
    texts = docs.where(F.octet_length(text) >= length).select(F.xxhash64(text).alias("d"), F.col(text).cast("string").alias("text"))
    rows = _anchor_rows(texts, length, gram).repartition("h").dropDuplicates(["h", "c", "d", "pos"])
    same, cls = Window.partitionBy("h"), Window.partitionBy("h", "c")
    apart = (F.min("d").over(cls) != F.max("d").over(cls)) | (F.min("pos").over(cls) != F.max("pos").over(cls))
    rows = rows.withColumn("n", F.row_number().over(cls.orderBy("d", "pos"))).withColumn("whole", apart)
    rows = rows.withColumn("kinds", F.sum((F.col("n") == 1).cast("long")).over(same)).where("whole or kinds > 1")
    rows = checkpoint(rows)
    spans = rows.where("whole").select("d", F.greatest(F.col("pos") - (length - gram), F.lit(0)).alias("start"), (F.col("pos") + length).alias("end"))
    # One context of each kind, where an anchor has several.
    kinds = rows.where("n = 1 and kinds > 1")
    total = kinds.count() * (2 * length - gram)
    shards = max(1, -(-total // SHARD))
    wanted = checkpoint(kinds.groupBy("d").agg(F.collect_list(F.struct("pos", "h", "c", "whole", "kinds")).alias("places")))
    once = texts.where(sieve(wanted, "d")(F.col("d"))).dropDuplicates(["d"])
    each = once.join(wanted, "d").select("d", F.col("text").cast("binary").alias("bytes"), F.explode("places").alias("p")).select("d", "bytes", "p.*")
    off = F.least(F.col("pos"), F.lit(length - gram))
    room = SHARD // 2 // (2 * length - gram)
    salt = F.pmod(F.xxhash64("c"), F.ceil(F.col("kinds") / room))
    split = F.col("kinds") > room
    shard = F.when(split, F.xxhash64("h", salt)).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards)))
    cut = each.select("h", "c", "d", "pos", off.alias("off"), F.substring("bytes", F.col("pos") - off + 1, off + F.lit(length)).alias("ctx"), "whole", split.alias("split"), shard.alias("shard"))
    found = cut.groupBy("shard").applyInArrow(_repeats_in_shard(length, gram), "d long, start long, end long, h long, string long, kind long, shard long")
    found = checkpoint(found)
    open_ = found.where(F.col("kind") != DONE).withColumn("bucket", F.pmod(F.xxhash64("h", "string"), F.lit(4 * shards + 64)))
    across = open_.groupBy("bucket").applyInArrow(_merged, "d long, start long, end long")
    spans = spans.unionByName(found.where(F.col("kind") == DONE).select("d", "start", "end")).unionByName(across)
    return spans.distinct().groupBy("d").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def dedup(docs: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: key, n_bytes, spans (removed, [start, end) bytes, merged) and kept (binary).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the text or another; whole
    texts are judged, matches never cross texts, and nothing is judged on what is left. Rows that repeat are copies of
    each other. Null texts are empty, other columns are dropped, and an empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).cast("string").alias("text"))
    spans = checkpoint(repeated_spans(rows, "text", length, gram))
    copied = rows.where(F.octet_length("text") >= length).select(F.xxhash64("text").alias("d"), F.unhex(F.md5("text")).alias("digest"))
    copied = copied.groupBy("d", "digest").count().where("count > 1").groupBy("d").agg(F.collect_list("digest").alias("copied"))
    touched = checkpoint(spans.join(copied, "d", "full").select("d", "spans", "copied"))
    may = sieve(touched, "d")
    d = F.xxhash64("text")
    n_bytes = F.octet_length("text").cast("long")
    no_spans = F.array().cast("array<struct<start: bigint, end: bigint>>")
    clear = rows.where(~may(d)).select("k", n_bytes.alias("n_bytes"), no_spans.alias("spans"), F.col("text").cast("binary").alias("kept"))
    near = rows.where(may(d)).withColumn("d", d).join(touched, "d", "left")
    whole = F.coalesce(F.array_contains("copied", F.unhex(F.md5("text"))), F.lit(False))
    all_of_it = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), n_bytes.alias("end")))
    near = near.select("k", "text", F.when(whole, all_of_it).otherwise(F.coalesce("spans", no_spans)).alias("spans"))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged, kept, sizes = [], [], []
            for value, stretches in zip(b.column(1), b.column(2).to_pylist()):
                raw = value.as_py().encode()
                out: list[dict] = []
                for s in stretches:
                    a, z = s["start"], min(s["end"], len(raw))
                    if out and a <= out[-1]["end"]:
                        out[-1]["end"] = max(z, out[-1]["end"])
                    else:
                        out.append({"start": a, "end": z})
                ends = [0, *(x["end"] for x in out)]
                kept.append(b"".join(raw[a:z] for a, z in zip(ends, [*(x["start"] for x in out), len(raw)])))
                merged.append(out)
                sizes.append(len(raw))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())], ["k", "n_bytes", "spans", "kept"])

    near = near.mapInArrow(cut, f"k {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return clear.unionByName(near).withColumnRenamed("k", key)


def removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
