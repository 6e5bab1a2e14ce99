"""Near-duplicate documents by b-bit MinHash.

A document's shingles give HASHES minima. Bands of ROWS minima each are its buckets; of every minimum the lowest
BITS bits are kept, packed in 64-bit words. Pairs that share a bucket are candidates. The share of equal BITS-bit
values, counted on the packed words and corrected for chance collisions (Li and Koenig, 2010), estimates the
similarity; pairs far below the threshold go, the rest is decided on the full sets. Documents that share a band with a
large group and are linked with none of those tried so far would have to be tried with all of it: for these the exact
prefix filter (a pair must share one of the rarest shingles of either) says which pairs are worth it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytes import SPACES, flat, lean, lowered, mix, runs, shingles, stretch_hashes, words
from tidemark.llm.common import forget, table
from tidemark.llm.links import linked_groups, shared_buckets

#: 32 bands of 4: at a similarity of 0.8 a pair shares no band once in 20 million times.
HASHES, ROWS, BITS = 128, 4, 4
#: Cells in which shingles are counted to order them by rarity. Any order finds the same links.
RARITY_CELLS = 1 << 18
#: Candidates go if the estimate is so many standard deviations below the threshold.
DEVIATIONS = 6.0
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False


def _sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's distinct shingles, sorted; those of text i are first[i]:first[i + 1]."""
    data = lowered(data)
    low, high, first = words(data, at, _IS_WORD)
    h, place = shingles(stretch_hashes(data, low, high), first, n)
    of = np.searchsorted(first, place, "right") - 1
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(at)))


def sketches(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, digest, n_shingles, set, bands, packed) for every row of docs.

    digest is the text's MD5, set a 128-bit digest of its shingles, bands and packed null for empty sets.
    """

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        for b in batches:
            all_data, all_at = flat(b.column(2))
            for lo, hi in runs(np.diff(all_at)):
                h, first = _sets(all_data[all_at[lo] : all_at[hi]], all_at[lo : hi + 1] - all_at[lo], n)
                count = np.diff(first)
                full = np.flatnonzero(count)
                starts = first[:-1][full]
                least = np.zeros((len(full), HASHES), np.uint64)
                both = np.zeros((hi - lo, 2), np.uint64)
                if len(full):
                    for k, s in enumerate(seeds):
                        least[:, k] = np.minimum.reduceat((h ^ s) * np.uint64(0x9FB21C651E98DF25) ^ (h >> np.uint64(31)) * (s | np.uint64(1)), starts)
                    least = mix(least)
                    both[full, 0] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    both[full, 1] = np.add.reduceat(mix(h ^ np.uint64(0x14057B7EF767814F)), starts)
                band = np.zeros((len(full), HASHES // ROWS), np.uint64)
                for r in range(ROWS):
                    band = mix(band + least[:, r::ROWS] + np.arange(HASHES // ROWS, dtype=np.uint64))
                each = 64 // BITS
                low_bits = (least & np.uint64((1 << BITS) - 1)).reshape(len(full), HASHES // each, each) << (np.arange(each, dtype=np.uint64) * np.uint64(BITS))
                packed = np.bitwise_or.reduce(low_bits, axis=2) if len(full) else np.zeros((0, HASHES // each), np.uint64)
                lists = []
                for x in (band, packed):
                    ends = np.zeros(hi - lo + 1, np.int32)
                    ends[1:] = np.cumsum(count > 0) * x.shape[1]
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int64).ravel())))
                whole = pa.array([x.tobytes() for x in both], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(count.astype(np.int64)), whole, *lists], ["k", "digest", "n_shingles", "set", "bands", "packed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"), F.col(text).cast("string").alias("text")).mapInArrow(task, f"k {kind}, digest binary, n_shingles long, set binary, bands array<long>, packed array<long>")


def _full_sets(texts: DataFrame, n: int) -> DataFrame:
    """(id, members): the sorted shingle hashes of texts (id, text), packed."""

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = flat(b.column(1))
            for lo, hi in runs(np.diff(at)):
                h, first = _sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([h[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["id", "members"])

    return texts.mapInArrow(task, "id long, members binary")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: equal values by bit counts, less those equal by chance."""
    words_ = HASHES * BITS // 64
    ones = F.lit(sum(1 << (BITS * i) for i in range(64 // BITS)))
    equal = F.lit(0)
    for k in range(words_):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for i in range(BITS.bit_length() - 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1 << i))
        equal = equal + F.lit(64 // BITS) - F.bit_count(x.bitwiseAND(ones))
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, left, right) of packed sets with 100 * intersection >= percent * union."""

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                few, many = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(many, few)
                both = int((many[np.minimum(at, len(many) - 1)] == few).sum()) if len(many) else 0
                good.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "left", "right").mapInArrow(task, "a long, b long")


def _prefix_pairs(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids (id, part) in different parts whose prefixes share a shingle: every link between parts.

    With shingles in one order, sets as similar as `percent` share one of the first |x| - ceil(percent * |x| / 100) + 1
    of either. The order is by rarity, so that common shingles come last.
    """
    own = table(sets.join(ids, "id").select("id", "part", "members"), "own")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_CELLS, np.int64)
        for b in batches:
            for m in b.column(0):
                np.add.at(total, (np.frombuffer(m.as_buffer(), np.uint64) % np.uint64(RARITY_CELLS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    often = np.zeros(RARITY_CELLS, np.int64)
    for cell, n in own.select("members").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # RARITY_CELLS at most
        often[cell] = n
    shared = ids.sparkSession.sparkContext.broadcast(often)

    @lean
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of = shared.value
        for b in batches:
            first, size = [], []
            for m in b.column(2):
                x = np.frombuffer(m.as_buffer(), np.uint64)
                x = x[np.lexsort((x, n_of[(x % np.uint64(RARITY_CELLS)).astype(np.int64)]))]
                first.append(x[: len(x) - -(-percent * len(x) // 100) + 1].astype(np.int64))
                size.append(len(x))
            n = np.array([len(x) for x in first], np.int64)
            row = pa.array(np.repeat(np.arange(len(b)), n))
            shingle = np.concatenate(first) if first else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(np.repeat(np.array(size, np.int64), n)), pa.array(np.concatenate([np.arange(k) for k in n]) if len(n) else n), pa.array(shingle)], ["id", "part", "size", "at", "shingle"])

    rows = table(own.mapInArrow(prefixes, "id long, part long, size long, at long, shingle long"), "prefixes")
    forget(own)
    # A shingle of one part only makes no pair.
    several = rows.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("shingle")
    rows = rows.join(several, "shingle")
    x, y = (rows.select("shingle", F.col("id").alias(f"id_{e}"), F.col("part").alias(f"part_{e}"), F.col("size").alias(f"size_{e}"), F.col("at").alias(f"at_{e}")) for e in "xy")
    # If it is the first that they share, what follows it has to make up the intersection.
    enough = (100 + percent) * F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y")) >= percent * (F.col("size_x") + F.col("size_y"))
    alike = (100 * F.col("size_x") >= percent * F.col("size_y")) & (100 * F.col("size_y") >= percent * F.col("size_x"))
    pairs = x.join(y, "shingle").where((F.col("part_x") < F.col("part_y")) & alike & enough)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def groups(docs: DataFrame, key: str, text: str, n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component (the smallest key reachable, its own included), kept.

    Shingles are n words (runs of anything but space and \\x09-\\x0D, A-Z lower-cased); a text of fewer words is one
    shingle; without words a document is linked with nothing. Documents are linked if
    100 * intersection >= percent * union. Equal sets form one class before any pair is made, so a group of copies of
    any size is one class. kept marks the rows whose key is the component's; with repeated keys there may be several.
    A null key never is the smallest of a component that has another; a component of null keys has a null component
    and keeps its rows. Other columns are dropped; an empty table gives an empty table.
    """
    rows = table(sketches(docs, key, text, n), "sketches")
    some = rows.where("n_shingles > 0")
    classes = some.groupBy("set").agg(F.min("k").alias("least"), F.min("digest").alias("digest"), F.first("bands").alias("bands"), F.first("packed").alias("packed"), F.first("n_shingles").alias("size"))
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = shared_buckets(classes.select("id", F.explode("bands").alias("bucket")))
    wanted = table(members.select("id").distinct().join(classes.select("id", "digest", "packed", "size"), "id"), "wanted")
    texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest"), F.col(text).cast("string").alias("text"))
    texts = texts.join(wanted.select("id", "digest"), "digest").dropDuplicates(["id"]).select("id", "text")
    sets = table(_full_sets(texts, n), "sets")
    t = percent / 100
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * t
    slack = DEVIATIONS * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)

    def verify(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(wanted.select(F.col("id").alias(end), F.col("packed").alias(f"packed_{end}"), F.col("size").alias(f"size_{end}")), end)
        near = pairs.where(estimate(F.col("packed_a"), F.col("packed_b")) >= t - slack)
        near = near.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")).select("a", "b")
        near = near.join(sets.select(F.col("id").alias("a"), F.col("members").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("right")), "b")
        return _confirmed(near, percent)

    parts = linked_groups(members, verify, across=lambda placed: _prefix_pairs(sets, placed.select("id", "part").distinct(), percent))
    by_class = classes.select("id", "set", "least").join(parts.withColumnRenamed("node", "id"), "id", "left").select("set", "least", F.coalesce("component", "id").alias("part"))
    by_class = table(by_class, "by_class")
    forget(members, wanted, sets, classes)
    lowest = by_class.groupBy("part").agg(F.min("least").alias("component"))
    by_set = by_class.join(lowest, "part").select("set", "component")
    out = rows.select("k", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set")).alias("set")).join(by_set, "set", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("k"))
    return out.select(F.col("k").alias(key), "n_shingles", component.alias("component"), F.col("k").eqNullSafe(component).alias("kept"))
