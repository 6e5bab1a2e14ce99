"""Split windows against plain loops over an entity's rows, a hot entity, and frozen profiles of many key sets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.frozen import Profile, frozen_profiles
from tidemark.operators.ranges import running_totals
from tidemark.operators.scans import Scan, large_entities, scanned
from tidemark.operators.sequence import invert_prefix, own_event

SCHEMA = "i int, e string, day int, v int, w double"


def rows_of(seed, n=400):
    dice = random.Random(seed)
    day = lambda: dice.choice([None, *range(40)])
    return [(i, dice.choice(["hot"] * 6 + ["a", "b", None]), day(), dice.choice([0, 1, 1, None]), dice.choice([0.5, 1.5, None])) for i in range(n)]


def mean(values):
    known = [v for v in values if v is not None]
    return (sum(known) / len(known) if known else None), len(known)


@pytest.mark.parametrize("few", [None, 80, 10_000])
def test_scan_matches_a_loop(spark, few):
    rows = rows_of(1)
    scan = Scan(totals={"before": F.col("v"), "n": F.lit(1)}, lags={"one": (F.col("v"), 1), "seven": (F.col("i"), 7)}, leads={"next": F.struct("i", "w")}, recent={"r1": (F.col("v"), 1), "r5": (F.col("w"), 5)})
    df = spark.createDataFrame(rows, SCHEMA)
    large = True if few is None else large_entities(df, "e", few)
    assert (large is False) == (few == 10_000)
    got = {r["i"]: r for r in scanned(df, ["e"], F.floor(F.col("day") / 3), ["day", "i"], scan, large).collect()}
    assert len(got) == len(rows)
    for e in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == e), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        for at, row in enumerate(own):
            r = got[row[0]]
            assert (r["before"], r["n"]) == (sum(x[3] or 0 for x in own[:at]), at)
            assert r["one"] == (own[at - 1][3] if at else None) and r["seven"] == (own[at - 7][0] if at >= 7 else None)
            assert r["next"] == ((own[at + 1][0], own[at + 1][4]) if at + 1 < len(own) else None)
            for name, k, c in (("r1", 1, 3), ("r5", 5, 4)):
                want = mean([x[c] for x in own[max(0, at - k) : at]])
                assert (r[name]["mean"], r[name]["n"]) == want
    assert scanned(spark.createDataFrame([], SCHEMA), ["e"], F.col("day"), ["day", "i"], scan).collect() == []


def test_a_hot_entity_is_many_tasks_work(spark):
    """The largest window of a scan is a bucket of the hot entity, not the entity: its rows are in many partitions."""
    df = spark.range(20_000).select(F.lit("hot").alias("e"), "id", (F.col("id") % 2).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scanned(df, ["e"], F.floor(F.col("id") / 500), ["id"], Scan(totals={"s": F.col("v")}, lags={"l": (F.col("id"), 3)}))
        each = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.count("*").alias("parts"), F.max("n").alias("most")).first()
        assert each["parts"] >= 6 and each["most"] <= 8000
        assert out.where("s <> floor(id / 2) or not l <=> if(id < 3, null, id - 3)").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_inversion_does_not_depend_on_the_stretches(spark):
    dice = random.Random(4)
    rows, i = [], 0
    for e in "abc":
        hits = 0
        for n in range(120):
            if dice.random() < 0.95:
                rows.append((i, e, n, hits / n + (0.3 / n if dice.random() < 0.1 else 0) if n else None))
                i += 1
            hits += dice.random() < 0.4
    df = spark.createDataFrame(rows, "i int, e string, n int, rate double")
    columns = ["i", "segment", "previous", "lag2", "lag5", "mean2", "mean10", "mean50"]
    one, many = (sorted(invert_prefix(df, "e", "n", "rate", ["i"], length=k).select(*columns).collect(), key=str) for k in (1 << 16, 7))
    assert one == many
    by = {r["i"]: r for r in many}
    for e in "abc":
        own = [by[r[0]] for r in rows if r[1] == e]
        for at, r in enumerate(own):
            segment = [x["previous"] for x in own[: at + 1] if x["segment"] == r["segment"]]
            assert r["lag2"] == (segment[-2] if len(segment) > 1 else None)
            want = mean(segment[-10:])[0]
            assert r["mean10"] == want or math.isclose(r["mean10"], want)
    first, second = (sorted(own_event(df, "e", "n", "rate", ["i"], "event", length=k).select("i", "event").collect(), key=str) for k in (1 << 16, 5))
    assert first == second and any(r["event"] is not None for r in first)


def test_running_totals_of_groups(spark):
    rows = rows_of(3, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["i"]: (r["s"], r["n"]) for r in running_totals(df.withColumn("one", F.lit(1)), ["i"], {"s": "v", "n": "one"}, by=["e"]).collect()}
    for i, e, *_ in rows:
        earlier = [r for r in rows if r[1] == e and r[0] < i]
        assert got[i] == (sum(r[3] or 0 for r in earlier), len(earlier))


def test_many_key_sets_of_two_entities(spark):
    dice = random.Random(9)
    names = ["p", "b", "g", "h", "k"]
    rows = [(i, dice.choice(["1", "2", None]), dice.choice([1, 2, 3]), dice.choice(["R", "F", None]), dice.choice(["|", "1:|", ""]), dice.choice([0, 1, 2]), dice.randrange(2019, 2023), dice.choice([0, 1, None]), dice.choice([0, 1]), dice.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, p string, b int, g string, h string, k int, season int, y int, z int, base double")
    sets = [("p",), ("p", "g"), ("p", "h", "k"), ("p", "k", "h", "g"), ("b", "h"), ("b", "g", "k")]
    profiles = [Profile(f"q{j}", s, "base", 20) for j, s in enumerate(sets)] + [Profile("z", ("p", "g"), "base", 5, "z", "y = 1"), Profile("alone", ("h", "g"), "base", 7)]
    got = {r["i"]: r for r in frozen_profiles(df, profiles).collect()}
    assert len(got) == len(rows)
    for row in rows:
        value = dict(zip(["i", *names, "season", "y", "z", "base"], row))
        for p in profiles:
            key = tuple(value[c] for c in p.keys)
            past = [dict(zip(["i", *names, "season", "y", "z", "base"], r)) for r in rows if r[6] < value["season"]]
            past = [r for r in past if tuple(r[c] for c in p.keys) == key and None not in key and (p.where is None or r["y"] == 1)]
            r = got[value["i"]][f"{p.name}_rate"]
            if not past:
                assert r is None
            else:
                assert math.isclose(r, (sum(x[p.target] or 0 for x in past) + p.k * value["base"]) / (len(past) + p.k))


def test_shuffles_do_not_grow_with_the_key_sets(spark):
    df = spark.range(1000).selectExpr("id % 7 as p", "id % 5 as b", "id % 3 as c", "id % 2 as d", "2019 + id % 4 as season", "id % 2 as y", "0.5D as base")
    sets = [("p", "c"), ("p", "d"), ("p", "c", "d"), ("b", "c"), ("b", "d"), ("b", "c", "d")]
    plan = frozen_profiles(df, [Profile(f"q{j}", s, "base", 20) for j, s in enumerate(sets)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 8 and plan.count("Range (") <= 3


def test_what_earlier_ranges_hold_does_not_shuffle_the_rows(spark):
    plan = running_totals(spark.range(1000), ["id"], {"s": "id"})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
