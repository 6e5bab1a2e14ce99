"""Nearest neighbours by a forest of hash-prefix trees (LSH forest), in shards.

A tree is the sorted array of its shard's hash strings: BITS signs of random projections of the centred vectors. A
query descends each tree to its longest matching prefix; then all trees ascend together, a bit at a time, until the
prefixes hold enough candidates, so the prefix is as long as the data allow. Candidates are compared on the original
vectors. Equal vectors are one entry with its smallest ids, so a vector that many rows share costs no more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

TREES, BITS = 24, 32
#: Distinct vectors of a shard, about, and queries of a block: what a task holds at once.
SHARD, BLOCK = 8192, 4096
#: Candidates, counted in every tree, at which the ascent ends: this share of the shard, and never fewer than LEAST.
SHARE, LEAST = 1.0, 256


def usable(vec: Column) -> Column:
    """Not null, with no null or non-finite component, and not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _search_block(k: int, share: float, least: int, trees: int, bits: int):
    def task(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if index.num_rows and queries.num_rows:
            unpack = lambda t, c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(t.num_rows, -1)
            hashes, vectors = unpack(index, "hashes", np.uint64), unpack(index, "v", np.float64)
            asked, wanted = unpack(queries, "hashes", np.uint64), unpack(queries, "v", np.float64)
            ids, lowest, q_ids = (t.column(c).to_numpy() for t, c in ((index, "cid"), (index, "lowest"), (queries, "cid")))
            order = np.argsort(hashes, axis=0, kind="stable")
            arrays = [np.ascontiguousarray(hashes[order[:, t], t]) for t in range(trees)]
            enough = max(least, int(share * len(ids)))
            low, high = (np.zeros((bits + 1, trees, len(q_ids)), np.int64) for _ in range(2))
            for x in range(bits + 1):  # the stretch that shares x bits
                rest = np.uint64(bits - x)
                for t in range(trees):
                    head = asked[:, t] >> rest
                    low[x, t] = np.searchsorted(arrays[t], head << rest)
                    high[x, t] = np.searchsorted(arrays[t], ((head + np.uint64(1)) << rest) - np.uint64(1), "right")
            counts = (high - low).sum(1)
            level = np.where(counts >= enough, np.arange(bits + 1)[:, None], 0).max(0)  # 0: all rows
            for q in range(len(q_ids)):
                x = level[q]
                mark = np.zeros(len(ids), bool)
                for t in range(trees):
                    mark[order[low[x, t, q] : high[x, t, q], t]] = True
                near = np.flatnonzero(mark & (ids != q_ids[q]))
                if not len(near):
                    continue
                d = np.sqrt(((vectors[near] - wanted[q]) ** 2).sum(1))
                if len(near) > 4 * k:
                    cut = np.partition(d, k)[k]
                    near, d = near[d <= cut], d[d <= cut]
                best = np.lexsort((lowest[near], d))[:k]
                out[0] += [q_ids[q]] * len(best)
                out[1] += ids[near[best]].tolist()
                out[2] += d[best].tolist()
                out[3] += lowest[near[best]].tolist()
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.table([pa.array(x, kind) for x, kind in zip(out, kinds)], names=["q", "c", "score", "lowest"])

    return task


def search(rows: DataFrame, key: str, vec: str, is_query: Column, k: int = 10, trees: int = TREES, bits: int = BITS, share: float = SHARE, least: int = LEAST, seed: int = 17) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest found: smallest Euclidean distance, ties to smaller ids.

    Candidates are all rows but the query's own. Vectors that are null or zero, hold null or non-finite components, or
    have another length than most, take no part. Rows with equal ids are rows of their own, and a row is its query's
    own once; null ids are never queries and are last among equals. An empty table, or no query, gives an empty table.
    """
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where(usable(F.col("v")))
    good = good.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = rows.sparkSession
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = length[0]
    good = good.where(F.size("v") == n)
    # Of equal vectors the k + 1 smallest ids, which is all that any answer can hold.
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("id")))
    few = good.select("v", "id").withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("nth", "id")))["id"].alias("ids"), F.count("*").alias("_n"))
    queries = good.where("asked").select("v", F.col("id").alias("query_id"))
    asked = queries.select("v").distinct().withColumn("asked", F.lit(True))
    classes = checkpoint(few.join(asked, "v", "left").select(F.monotonically_increasing_id().alias("cid"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))
    size = classes.count()
    centre = np.array(classes.agg(*[F.avg(F.get("v", F.lit(i))) for i in range(n)]).first(), np.float64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((n, trees * bits))
        weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(len(b), n)
            signs = ((v - centre) @ planes > 0).reshape(len(b), trees, bits)
            h = (signs * weights).sum(2, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([x.tobytes() for x in np.ascontiguousarray(v)], pa.binary()), pa.array([x.tobytes() for x in h], pa.binary())], ["cid", "lowest", "asked", "v", "hashes"])

    lowest = F.coalesce(F.get("ids", F.lit(0)), F.lit((1 << 63) - 1))
    index = checkpoint(classes.select("cid", "v", lowest.alias("lowest"), "asked").mapInArrow(hashed, "cid long, lowest long, asked boolean, v binary, hashes binary"))
    shards = max(1, -(-size // SHARD))
    blocks = max(1, -(-index.where("asked").count() // BLOCK))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = index.select("cid", "lowest", "v", "hashes", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    asks = index.where("asked").select("cid", "v", "hashes", every(shards).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "cid"), F.lit(blocks)).cast("int").alias("block"))
    near = data.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(_search_block(k, share, least, trees, bits), "q long, c long, score double, lowest long")
    order = F.row_number().over(Window.partitionBy("q").orderBy("score", "lowest"))
    near = near.withColumn("_n", order).where(F.col("_n") <= k).select("q", "c", "score")
    near = near.join(classes.select(F.col("cid").alias("c"), "ids"), "c").select("q", "score", F.explode_outer("ids").alias("vec_id"))
    found = near.groupBy("q").agg(F.collect_list(F.struct("score", "vec_id")).alias("near"))  # at most k * (k + 1)
    found = classes.where("asked").join(found, F.col("cid") == F.col("q"), "left").select("v", "ids", F.coalesce("near", F.array().cast("array<struct<score: double, vec_id: bigint>>")).alias("near"))
    each = queries.join(found, "v")
    own = F.array_position("ids", F.col("query_id")) - 1
    rest = F.transform(F.filter("ids", lambda x, i: i != own), lambda x: F.struct(F.lit(0.0).alias("score"), x.alias("vec_id")))
    last = F.lit((1 << 63) - 1)
    best = F.slice(F.array_sort(F.transform(F.concat(rest, "near"), lambda x: F.struct(x["score"].alias("score"), F.coalesce(x["vec_id"], last).alias("tie"), x["vec_id"].alias("vec_id")))), 1, k)
    return each.select("query_id", F.posexplode(best).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
