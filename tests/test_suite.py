import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as T
from tidemark.operators import suite as S


def test_a_stopped_suite_goes_on_with_the_rest(spark, tmp_path):
    runs, path, broken = [], str(tmp_path / "suite"), {"c"}

    def unit(name):
        def run():
            runs.append(name)
            value = F.raise_error(F.lit("lost")).cast("long") if name in broken else F.col("id")
            return spark.range(3).select(value.alias("id"), F.lit(name).alias("name"))

        return S.Unit(name, run)

    units = [unit(n) for n in "abcde"]
    with pytest.raises(RuntimeError, match="\\['c'\\]"):
        S.run_suite(spark, units, path, at_once=2)
    assert sorted(runs) == list("abcde") and S.finished(spark, path, units) == list("abde")
    broken.clear()
    more = [*units, unit("f")]
    assert [u.name for u in S.pending(spark, path, more)] == ["c", "f"]
    out = S.run_suite(spark, more, path)
    assert sorted(runs) == list("abccdef")
    assert sorted(map(tuple, out.select("unit", "id").collect())) == [(n, i) for n in "abcdef" for i in range(3)]
    assert S.run_suite(spark, more, path).count() == 18 and sorted(runs) == list("abccdef")
    with pytest.raises(ValueError):
        S.run_suite(spark, [unit("a"), unit("a")], path)
    S.discard(spark, path)
    assert S.finished(spark, path, more) == []


def test_ablation_finds_what_helps(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "id % 10 as signal", "hash(id) % 7 as noise", "cast(id % 10 > 4 as int) as y", "cast(id % 3 as int) as season")
    folds = [S.Fold("two", "season < 2", "season = 2", 1.0), S.Fold("one", "season < 1", "season = 1", 3.0)]
    o = T.Options(trees=2, depth=2, rate=0.5, l2=1.0)
    variants = {"noise": ["noise"], "both": ["noise", "signal"]}
    results = S.ablation(df, variants, folds, "y", str(tmp_path / "a"), o)
    rows = {r["variant"]: r for r in S.summary(results, "noise").collect()}
    assert rows["both"]["folds"] == 2 and rows["both"]["improved"] == 2 and rows["noise"]["improved"] == 0 and rows["noise"]["change"] == 0
    assert rows["both"]["brier"] < 0.15 < rows["noise"]["brier"] and abs(rows["noise"]["plain"] - 0.25) < 0.01
    each = {(r["variant"], r["fold"]): r["brier"] for r in results.collect()}
    assert abs(rows["both"]["brier"] - (each["both", "two"] + 3 * each["both", "one"]) / 4) < 1e-12
