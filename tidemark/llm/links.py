"""From shared buckets to connected groups, without making all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, forget, stars, table

#: Rounds, at most, in which ids are tried with one other id of their bucket. They end early once they find little.
ROUNDS = 6
#: A round that links fewer than one in so many of the ids outside is the last one.
LITTLE = 8


def shared(members: DataFrame) -> DataFrame:
    """members (bucket, id, no pair twice) of the buckets with two ids or more, and n: how many these are. A table."""
    often = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return table(members.join(often.hint("shuffle_hash"), "bucket"), "met")


def in_bands(met: DataFrame, band: Column) -> DataFrame:
    """(bucket, id, n, band, no pair twice) of what shared() returned, its buckets cut by band, a whole number of its rows.

    Only ids whose bands differ by no more than one can be links. An id is in its own band and the next, so two such ids
    have one in common; in large buckets others hardly meet.
    """
    at = met.select("bucket", "id", "n", F.explode(F.array(band, band + 1)).alias("band"))
    return at.withColumn("bucket", F.xxhash64("bucket", "band"))


def shared_buckets(*members: DataFrame, sig: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """members (bucket, id, no pair twice) of the buckets with two ids or more, and hub: how often an id meets others.

    Several tables, of different buckets, are dealt one after the other, so that less is on disk at a time. sig, if given,
    takes a table of the ids that meet others and returns a row (id, sig) for each of them at least, which members get.
    """
    met = [shared(rows) for rows in members]
    every = met[0]
    for rows in met[1:]:
        every = every.unionByName(rows)
    hubs = every.groupBy("id").agg(F.sum("n").alias("hub"))
    if sig is not None:
        hubs = table(hubs, "hubs")
        met.append(hubs)
    out = table(every.join(hubs.join(sig(hubs), "id") if sig is not None else hubs, "id").drop("n"), "members")
    forget(*met)
    return out


def linked_groups(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[Column, Column], Column] | None = None,
    across: Callable[[DataFrame], DataFrame] | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(node, component) over all true links among ids that share a bucket. members comes from shared_buckets().

    verify takes distinct pairs (a < b) and returns those that are links. First each id is tried with one id of each of
    its buckets, the one that meets most others (the text that a group's others were made from, say), which joins most of
    a large group in one row an id and bucket. Then only buckets whose ids still are in several components matter. Ids
    outside a bucket's largest component are tried with one id inside it, by hash, as long as that finds links; in the
    end, those still outside are tried with every id of other components. A pair within a component would change
    nothing, so no link between components is lost.

    near, if given, is a necessary condition on the two ids' column sig (of any type) and is tested before a pair is made.
    across, if given, makes the last candidates instead: from the ids of mixed buckets (bucket, id, part, largest)
    pairs (a, b) that hold every link between parts.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    own = ["sig"] if near else []
    by_hash = lambda k: F.xxhash64("id", F.lit(k))
    rep_of = lambda order: [F.min_by(c, order).alias(f"rep_{c}") for c in ["id", *own]]
    fits = near(F.col("rep_sig"), F.col("sig")) if near else F.lit(True)

    def candidates(rows: DataFrame, x: str, y: str) -> DataFrame:
        return rows.select(*pair(x, y)).distinct()

    star = members.join(members.groupBy("bucket").agg(*rep_of(F.struct(-F.col("hub"), by_hash(0)))), "bucket").where((F.col("id") != F.col("rep_id")) & fits)
    links, parts, more = verify(candidates(star, "rep_id", "id")), None, None
    left = members.select("bucket", "id", *own)
    last, done, k = rounds < 2, False, 0
    while not done:
        k, done = k + 1, last
        parts, before = stars(links), [t for t in (parts, more) if t is not None]
        forget(*before)
        placed = left.join(parts.toDF("id", "component"), "id", "left").select("bucket", "id", *own, F.coalesce("component", "id").alias("part"))
        sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"), *rep_of(by_hash(k)))
        mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "part", *[f"rep_{c}" for c in ["id", *own]])).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        placed = placed.join(mixed, "bucket").select("bucket", "id", *own, "part", F.col("top.part").alias("largest"), *[F.col(f"top.rep_{c}").alias(f"rep_{c}") for c in ["id", *own]])
        before, placed = left, table(placed, "placed")
        if k > 1:
            forget(before)
        few = placed.where("part != largest")
        if not last:
            more = table(verify(candidates(few.where(fits), "rep_id", "id")), "links")
            last = k + 1 == rounds or more.count() * LITTLE <= few.select("id").distinct().count()
        elif across:
            more = verify(across(placed))
        else:
            x, y = (t.select("bucket", *[F.col(c).alias(f"{c}_{e}") for c in ["id", "part", "largest", *own]]) for t, e in ((few, "x"), (placed, "y")))
            on = near(F.col("sig_x"), F.col("sig_y")) if near else F.lit(True)
            # A pair of two ids outside is there twice; once is enough.
            one = (F.col("part_x") != F.col("part_y")) & ((F.col("part_y") == F.col("largest_y")) | (F.col("id_x") < F.col("id_y")))
            more = verify(candidates(x.join(y, "bucket").where(one & on), "id_x", "id_y"))
        # The components so far, as stars, and what is new.
        links = parts.toDF("a", "b").union(more.select("a", "b"))
        left = placed.select("bucket", "id", *own)
    out = connected_components(links)
    forget(left, parts)
    return out
