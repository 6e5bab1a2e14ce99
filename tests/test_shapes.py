"""Positions, quantiles, checks and ensembles on small tables, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks as C
from tidemark.operators import ensemble as E
from tidemark.operators.ranges import exact_quantiles, positions, running_totals
from tidemark.sources import io


def test_positions_and_totals_follow_the_order(spark):
    rows = [(i * 7919 % 1000, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = {r["k"]: (r["at"], r["before"]) for r in running_totals(positions(df, ["k"], "at"), [F.col("k")], {"before": "v"}).collect()}
    total = 0
    for at, (k, v) in enumerate(sorted(rows)):
        assert got[k] == (at, total)
        total += v
    assert positions(df.limit(0), ["k"], "at").count() == 0


def test_positions_in_a_descending_order_with_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, None)], "i int, x double")
    got = positions(df, [F.col("x").desc_nulls_last(), F.col("i")], "at")
    assert [r["i"] for r in got.orderBy("at").collect()] == [3, 1, 2, 4]


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [5.0] * 400 + [1.0, 9.0], [float(i * i % 101) for i in range(500)]])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    wanted = [0.0, 1 / 6, 0.5, 0.95, 1.0]
    assert np.allclose(exact_quantiles(df, "x", wanted).first()["quantiles"], np.quantile(values, wanted))


def test_quantiles_of_groups_and_of_nothing(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 7.0), ("c", None)], "g string, x double")
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "x", [0.5], by=["g"]).collect()}
    assert got == {"a": [4.5], "b": [7.0]}
    assert exact_quantiles(df.where("g = 'c'"), "x", [0.5]).first()["quantiles"] is None


def test_state_invariants_count_each_broken_rule(spark):
    good = dict(run_total=3, run_top=1, run_bot=2, score_diff=1, half="T", pitcher_diff=1, base_state="1_3", r1=1, r2=0, r3=1, runners=2, mix_n=4, p_n=4, home_we=0.4, away_we=0.6)
    rows = [good, good | {"run_total": 5}, good | {"half": "B"}, good | {"base_state": "?"}, good | {"r2": 1}, good | {"runners": None}, good | {"mix_n": 5}, good | {"away_we": 0.61}]
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in good.items())
    df = spark.createDataFrame([tuple(r[k] for k in good) for r in rows], schema)
    got = df.agg(*[c.alias(n) for n, c in C.state_invariants().items()]).first().asDict()
    assert abs(got.pop("we_gap") - 0.01) < 1e-9
    assert got == {"run_total": 1, "score_diff": 0, "score_parity": 0, "pitcher_diff": 1, "unknown_base_state": 1, "runner_1": 0, "runner_2": 1, "runner_3": 0, "runners": 1, "mix_n": 1}


def test_feature_lists_and_columns(spark):
    groups = {"a": ["x", "y"], "b": ["z"], "c": ["y"]}
    assert C.feature_list(groups, ["a", "b"], ["y"]) == ["x", "z"]
    for take, drop in ((["a", "c"], []), (["a"], ["z"])):
        with pytest.raises(ValueError):
            C.feature_list(groups, take, drop)
    df = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")
    assert C.arranged(df, ["w"], ["x"], {"z": "w"}).columns == ["w", "y"]


def test_infinities_and_gaps_become_finite(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (2.5,)], "x double")
    most = 1.7976931348623157e308
    assert [r[0] for r in df.select(C.finite(F.col("x"), 1.0)).collect()] == [most, -most, 1.0, 1.0, 2.5]


def test_repeated_predictions_raise_or_the_last_counts(spark):
    ids = spark.createDataFrame([(1,), (2,)], "i int")
    rows = spark.createDataFrame([(1, 0.9, 1), (1, 0.2, 2), (2, 0.5, 1)], "i int, p double, v int")
    assert {r["i"]: r["p"] for r in io.require_predictions(rows, ids, "i", "p", version="v").collect()} == {1: 0.2, 2: 0.5}
    with pytest.raises(ValueError):
        io.require_predictions(rows, ids, "i", "p")


def scores(spark, n=400, seed=3):
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    c = np.clip(y[:, None] * 0.4 + r.random((n, 5)) * 0.6, 0, 1)
    d = [("R", "F", "X")[i % 3] for i in range(n)]
    df = spark.createDataFrame([(i, int(y[i]), d[i], *map(float, c[i])) for i in range(n)], "i int, y int, gt string, a double, b double, c double, d double, e double")
    return df, y, np.array(d), c


def test_five_candidates_are_no_worse_than_any_weights_and_rest_takes_the_mean(spark):
    df, y, d, c = scores(spark)
    out, weights = E.simplex_blend(df, "y", list("abcde"), "gt", rest=True)
    got = np.array([r["blend"] for r in out.orderBy("i").collect()])
    random = np.random.default_rng(1).dirichlet(np.ones(5), 3000)
    for dom in "RF":
        m = d == dom
        best = ((c[m] @ random.T - y[m][:, None]) ** 2).mean(axis=0).min()
        assert ((got[m] - y[m]) ** 2).mean() <= best + 1e-12
        assert abs(weights[dom].sum() - 1) < 1e-12 and weights[dom].min() >= 0
    assert np.allclose(got[d == "X"], c[d == "X"] @ ((weights["R"] + weights["F"]) / 2))


def test_final_is_no_worse_than_its_parts(spark):
    df, y, d, c = scores(spark, seed=9)
    rows = E.core_and_final(df, "y", "a", "b", "c", "d", "gt")[0].orderBy("i").collect()
    for dom in "RF":
        m = [i for i in range(len(y)) if d[i] == dom]
        loss = lambda x: sum((x[i] - y[i]) ** 2 for i in m)
        safe, final = [r["safe"] for r in rows], [r["final"] for r in rows]
        assert loss(safe) <= min(loss(c[:, k]) for k in range(3)) + 1e-9
        assert loss(final) <= min(loss(safe), loss(c[:, 3])) + 1e-9
    assert all(rows[i]["final"] is None for i in range(len(y)) if d[i] == "X")


def test_audit_counts_what_does_not_match(spark):
    left = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.5), (3, 1, 0.9)], "k int, y int, p double")
    right = spark.createDataFrame([(1, 0, 0.2), (2, 0, 0.5), (4, 1, 0.9)], "k int, y int, p double")
    got = E.audit(left, right, ["k"], "y", ["p"]).first()
    assert (got["n"], got["unmatched"], got["different_labels"]) == (2, 2, 1)
    assert abs(got["mae"] - 0.05) < 1e-12 and abs(got["max_abs"] - 0.1) < 1e-12


def test_masks_of_all_folds_are_counted_at_once(spark):
    from tidemark.operators import checks as C

    df = spark.createDataFrame([(2019,), (2019,), (2020,), (2021,), (None,)], "season int")
    t = lambda e: F.expr(e)
    found = C.fold_overlaps(df, {"a": (t("season < 2020"), t("season = 2020")), "b": (t("season <= 2020"), t("season >= 2020")), "c": (t("season < 0"), t("season > 0"))})
    assert sorted(map(tuple, found.collect())) == [("a", 2, 1, 0, True), ("b", 3, 2, 1, False), ("c", 0, 4, 0, False)]


def test_scaler_fits_all_columns_at_once(spark):
    from tidemark.operators.scaling import RobustScaler

    dice = np.random.default_rng(3)
    a, b = dice.normal(size=200), dice.integers(0, 5, 200).astype(float)
    rows = [(float(x) if i % 4 else None, float(y), None, 7.0) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, none double, same double")
    found = RobustScaler.fit(df, ["a", "b", "none", "same"]).params
    known = np.array([r[0] for r in rows if r[0] is not None])
    filled = np.array([np.median(known) if r[0] is None else r[0] for r in rows])
    assert np.allclose(found["a"][:3], [np.median(known), *np.quantile(filled, [0.05, 0.95])]) and found["a"][3]
    assert np.allclose(found["b"][:3], [np.median(b), *np.quantile(b, [0.05, 0.95])]) and not found["b"][3]
    assert found["none"] == (0.0, 0.0, 0.0, True) and found["same"] == (7.0, 7.0, 7.0, False)
    assert RobustScaler.fit(df.limit(0), ["a"]).params == {"a": (0.0, 0.0, 0.0, False)}
