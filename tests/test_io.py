import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import io

SCHEMA = "i int, season int, g string, r double, y int"


def table(spark):
    return spark.createDataFrame([(1, 2019, "R", 0.1 + 0.2, 1), (2, 2020, "F", None, 0), (3, 2020, None, 1 / 3, None)], SCHEMA)


@pytest.mark.parametrize("compress", [False, True])
def test_csv_round_trip(spark, tmp_path, compress):
    io.write_csv(table(spark), f"{tmp_path}/t", compress)
    assert sorted(io.read_csv(spark, f"{tmp_path}/t", SCHEMA).collect()) == sorted(table(spark).collect())


def test_nan_and_mark(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "t.csv").write_bytes("﻿i,season,g,r,y\n1,2019,R,NaN,1\n2,2020,F,-Inf,0\n".encode())
    got = io.read_first(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], "t.csv", SCHEMA).collect()
    assert [(r["i"], r["r"]) for r in got] == [(1, None), (2, None)]
    with pytest.raises(FileNotFoundError):
        io.read_first(spark, [f"{tmp_path}/a"], "t.csv", SCHEMA)


def test_guards(spark):
    df = table(spark)
    with pytest.raises(ValueError, match="zz"):
        io.require_columns(df, ["i", "zz"])
    with pytest.raises(ValueError, match="None"):
        io.require_domain(df, "g", ["R", "F"])
    assert io.require_domain(df, "season", [2019, 2020]) is df
    with pytest.raises(ValueError, match="'label': 1"):
        io.require_invariants(df, {"label": "y in (0, 1)", "id": "i > 0"})
    good = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 0.0)], "i int, p double")
    assert io.require_predictions(good, df, "i", "p").count() == 3
    with pytest.raises(ValueError):
        io.require_predictions(good.where("i < 3"), df, "i", "p")


def test_manifest_and_resume(spark):
    assert json.loads(io.manifest(table(spark), "season", "y")) == {"rows": 3, "columns": ["i", "season", "g", "r", "y"], "periods": {"2019": 1, "2020": 2}, "target_mean": 0.5}
    new = table(spark).select("i", F.lit(9.0).alias("r"), F.lit(5).alias("season"), "y").where("i > 1")
    got = io.append_latest(table(spark), new.withColumn("season", F.lit(2030)), ["i"], "season")
    assert {(r["i"], r["r"]) for r in got.collect()} == {(1, 0.1 + 0.2), (2, 9.0), (3, 9.0)}
