"""Benchmark decontamination by a prefix-filtered set join.

Items and documents are seen as words. A window is `window` consecutive words of an item (a shorter item is one
window). Its shingles (of `shingle` words) are ordered by rarity in the corpus; as containment has to be whole, the
prefix that a match must share is the rarest shingle alone. Documents' shingles are joined with those prefixes by hash;
a candidate start must leave room for the window on both sides, and then every word of the window is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytes import flat, lean, lowered, runs, shingles, stretch_hashes, words
from tidemark.llm.common import checkpoint, table

WINDOW, SHINGLE = 10, 5
#: Bits of the filter of item shingles that goes to all tasks: 4 MB, whatever the items' number. It only spares rows.
FILTER_BITS = 1 << 25
_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def _split(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[str]:
    whole = data.tobytes()
    return [whole[a:b].decode("utf-8", "replace") for a, b in zip(low.tolist(), high.tolist())]


def item_windows(items: DataFrame, key: str, text: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, w, length, hashes): each window's words joined by spaces, and its shingles' hashes in order."""

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column(1))
            data = lowered(data)
            low, high, first = words(data, at, _IS_WORD)
            text_words, hashed = _split(data, low, high), stretch_hashes(data, low, high)
            row, w, length, hashes = [], [], [], []
            for i in range(len(b)):
                a, z = int(first[i]), int(first[i + 1])
                n = min(window, z - a)
                size = min(shingle, n)
                own, _ = shingles(hashed[a:z], np.array([0, z - a]), size) if n else (np.zeros(0, np.uint64), None)
                for s in range(z - a - n + 1 if n else 0):
                    row.append(i), w.append(" ".join(text_words[a + s : a + s + n])), length.append(n), hashes.append(own[s : s + n - size + 1].astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(w, pa.string()), pa.array(length, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], ["item", "w", "length", "hashes"])

    return items.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string")).mapInArrow(task, "item string, w string, length int, hashes array<long>")


def find(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: key, n_words, n_hit, spans (of words, [start, end), merged) and items (ids as text).

    A word is hit if it lies in any occurrence of any window. Null texts have no words, null and wordless items no
    windows; an item whose id is null counts as none. Of items with one id, all texts count. Repeated rows stay, other
    columns are dropped, and an empty table of documents gives an empty table; without items nothing is hit.
    """
    spark = docs.sparkSession
    of_items = checkpoint(item_windows(items, item_key, item_text, window, shingle))
    distinct = of_items.groupBy("w").agg(F.first("length").alias("length"), F.first("hashes").alias("hashes"))
    tokens = checkpoint(distinct.select("w", "length", F.size("hashes").alias("of"), F.posexplode("hashes").alias("place", "h")))
    sizes = sorted({min(r[0], shingle) for r in tokens.select("length").distinct().collect()})  # `window` at most
    bit = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    marked = tokens.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(pmod(h, 64) as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits")).collect()  # FILTER_BITS / 64 at most
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for at, value in marked:
        bits[at] = value
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_bits = shared.value
        for b in batches:
            all_data, all_at = flat(b.column(1))
            for lo, hi in runs(np.diff(all_at)):
                at = all_at[lo : hi + 1] - all_at[lo]
                data = lowered(all_data[all_at[lo] : all_at[hi]])
                low, high, first = words(data, at, _IS_WORD)
                hashed = stretch_hashes(data, low, high)
                hit, place = [], []
                for n in sizes:
                    h, p = shingles(hashed, first, n)
                    slot = h & np.uint64(FILTER_BITS - 1)
                    keep = (filter_bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                    hit.append(h[keep]), place.append(p[keep])
                h, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hit, place))
                of = np.searchsorted(first, p, "right") - 1
                order = np.argsort(of, kind="stable")
                h, p, of = h[order], p[order], of[order]
                n_hits = np.bincount(of, minlength=hi - lo)
                ends = pa.array(np.r_[0, np.cumsum(n_hits)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64), pa.int64())) for x in (p - first[of], h)]
                kept = b.column(1).slice(lo, hi - lo).take(pa.array(np.arange(hi - lo), mask=n_hits == 0))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), *lists, kept], ["k", "n_words", "places", "hashes", "text"])

    kind = docs.schema[key].dataType.simpleString()
    seen = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).mapInArrow(scan, f"k {kind}, n_words long, places array<long>, hashes array<long>, text string")
    seen = table(seen.withColumn("_row", F.monotonically_increasing_id()), "scanned")
    found = seen.where("text is not null").select("_row", "n_words", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("_row", "n_words", F.col("x.places").alias("at"), F.col("x.hashes").alias("h"))
    often = found.groupBy("h").agg(F.count("*").alias("often"))
    # The prefix: a window's rarest shingle. One that no document has rules the window out.
    ranked = tokens.join(often, "h")
    prefix = ranked.groupBy("w", "length", "of").agg(F.count("*").alias("there"), F.min(F.struct("often", "h", "place")).alias("rarest")).where("there = of")
    prefix = prefix.select("w", "length", F.col("rarest.h").alias("h"), F.col("rarest.place").alias("place"))
    start = F.col("at") - F.col("place")
    near = found.join(prefix, "h").where((start >= 0) & (start + F.col("length") <= F.col("n_words"))).select("_row", start.alias("start"), "w", "length")
    by_doc = near.groupBy("_row").agg(F.collect_set(F.struct("start", "length", "w")).alias("candidates"))  # of one text

    @lean
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column(1))
            data = lowered(data)
            low, high, first = words(data, at, _IS_WORD)
            spans, found_windows = [], []
            for i, candidates in enumerate(b.column(2).to_pylist()):
                a, z = int(first[i]), int(first[i + 1])
                own = _split(data, low[a:z], high[a:z])
                good = sorted((c["start"], c["start"] + c["length"], c["w"]) for c in candidates if " ".join(own[c["start"] : c["start"] + c["length"]]) == c["w"])
                merged: list[list[int]] = []
                for s, e, _ in good:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                spans.append([{"start": s, "end": e} for s, e in merged])
                found_windows.append(sorted({w for _, _, w in good}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(found_windows, pa.list_(pa.string()))], ["_row", "spans", "windows"])

    true = seen.select("_row", "text").join(by_doc, "_row").mapInArrow(verify, "_row long, spans array<struct<start: long, end: long>>, windows array<string>")
    true = checkpoint(true.where(F.size("spans") > 0))
    which = true.select("_row", F.explode("windows").alias("w")).join(of_items.where("item is not null").select("w", "item").distinct(), "w")
    which = which.groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = seen.select("_row", "k", "n_words").join(true.select("_row", "spans"), "_row", "left").join(which, "_row", "left")
    no_spans = F.array().cast("array<struct<start: long, end: long>>")
    return out.select(F.col("k").alias(key), "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
