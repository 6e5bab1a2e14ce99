"""Blends are never worse than their parts, and weights are weights."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.metrics import probability_metrics
from tidemark.functions.rowlocal import cut_right, first_largest, mean_of_known, quantile_code, spread
from tidemark.operators.ensemble import blend, blend_weights, mixed, simplex_blend, simplex_weights
from tidemark.operators.sequence import invert_prefix, own_event


def test_blend_is_no_worse_in_any_domain(spark):
    dice = random.Random(1)
    rows = [(dice.randrange(2), dice.uniform(0.3, 0.7), dice.uniform(0.2, 0.8), "R" if i % 2 else "F") for i in range(1000)]
    df = spark.createDataFrame(rows, "y int, direct double, other double, gt string")
    w = blend_weights(df, "y", "direct", "other", "gt")
    assert all(0 <= r["weight"] <= 1 for r in w.collect())
    b = lambda c: F.avg((F.col("y") - F.col(c)) ** 2)
    for r in blend(df, w, "direct", "other", "gt").groupBy("gt").agg(b("direct").alias("d"), b("blend").alias("b")).collect():
        assert r["b"] <= r["d"] + 1e-14
    same = blend_weights(df.withColumn("other", F.col("direct")), "y", "direct", "other", "gt")
    assert {r["weight"] for r in same.collect()} == {0.0}


def test_simplex(spark):
    dice = random.Random(2)
    rows = [(dice.randrange(2), dice.random(), dice.random(), dice.random(), "R" if i % 3 else "F") for i in range(300)] + [(1, 0.1, 0.2, 0.3, "X")]
    out, weights = simplex_blend(spark.createDataFrame(rows, "y int, a double, b double, c double, gt string"), "y", ["a", "b", "c"], "gt")
    for w in weights.values():
        assert w.min() >= -1e-12 and abs(w.sum() - 1) < 1e-10
    assert out.where("blend is null").count() == 1


def test_simplex_beats_a_grid():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x, y = rng.random((50, 3)), rng.integers(0, 2, 50)
        g, c = x.T @ x, x.T @ y
        loss = lambda w: w @ g @ w - 2 * c @ w  # noqa: B023, E731
        best = min(loss(np.array([i, j, 20 - i - j]) / 20) for i in range(21) for j in range(21 - i))
        assert loss(simplex_weights(g, c)) <= best + 1e-9


def test_mixed_formula(spark):
    rows = [(0.4, 0.1, 0.2, 0.7, 0.6), (0.6, 0.2, 0.1, 0.8, 0.7)]
    df = spark.createDataFrame(rows, "d double, r double, m double, g double, c double")
    parts = mixed(*[F.col(x) for x in "drmgc"])
    got = df.select(parts["independent"].alias("i"), parts["logic"].alias("l")).collect()
    assert [round(r["i"], 9) for r in got] == [0.676, 0.676] and [round(r["l"], 9) for r in got] == [0.41424, 0.52528]


def test_metrics_of_one_class_and_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1), (1, 1.7)], "y int, p double")
    assert probability_metrics(df, "y", "p").first()["auc"] == (0.5 + 1 + 1 + 1) / 4
    one = probability_metrics(df.where("y = 1"), "y", "p").first()
    assert one["auc"] is None and one["skill"] is None


def test_row_functions_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5), (None, 2.0, 4.0), (None, None, None), (5.0, 5.0, 4.1)], "a double, b double, c double")
    got = df.select(spread(F.col("a"), F.col("b")), mean_of_known(F.col("a"), F.col("b")), cut_right(F.col("c"), [0.5, 1.0, 2.0, 4.0]), first_largest({"A": F.col("a"), "B": F.col("b")}), quantile_code(F.col("c"), F.array(*[F.lit(float(x)) for x in (0, 1, 4, 9)]))).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.5, 0, "B", 0), (None, 2.0, 3, "B", 2), (None, None, -1, "A", -1), (0.0, 5.0, 4, "A", 2)]


def test_inversion_finds_events_and_respects_gaps(spark):
    hits, rows = 0, []
    labels = [1, 0, 0, 1, 1, 0, 1]
    for n, y in enumerate(labels):
        rows.append((n, "e", n, hits / n if n else None, y))
        hits += y
    df = spark.createDataFrame([r for r in rows if r[0] != 4], "i int, e string, n int, rate double, y int")
    found = {r["i"]: r for r in invert_prefix(df, "e", "n", "rate", ["i"], windows=(2,)).collect()}
    assert {i: r["previous"] for i, r in found.items()} == {0: None, 1: 1.0, 2: 0.0, 3: 0.0, 5: None, 6: 0.0}
    assert found[5]["segment"] == found[3]["segment"] + 1 and found[3]["mean2"] == 0.0 and found[3]["lag2"] == 0.0
    own = {r["i"]: r["event"] for r in own_event(df, "e", "n", "rate", ["i"], "event").collect()}
    assert own == {0: 1.0, 1: 0.0, 2: 0.0, 3: None, 5: 0.0, 6: None}
    noisy = df.withColumn("rate", F.when(F.col("i") == 2, 0.31).otherwise(F.col("rate")))
    assert {r["i"]: r["previous"] for r in invert_prefix(noisy, "e", "n", "rate", ["i"], windows=()).collect()}[2] is None
