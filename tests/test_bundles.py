import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import bundles

SCHEMA = "row_id long, p double, n int, ok boolean, name string, w array<double>"


def table(spark, n=1000):
    rows = [(i, None if i % 7 == 0 else i / 3, None if i % 11 == 0 else -i, None if i % 5 == 0 else i % 2 == 0, None if i % 13 == 0 else "é" * (i % 4), None if i % 17 == 0 else [i * 1.0, float("nan") if i % 3 else 2.5]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def read(spark, path, **options):
    bundles.register(spark)
    return spark.read.format("bundle").options(**options).load(str(path))


@pytest.mark.parametrize("compression", ["none", "deflate"])
def test_round_trip_with_nulls_in_stretches(spark, tmp_path, compression):
    bundles.register(spark)
    table(spark).repartition(3).write.format("bundle").mode("overwrite").option("part", 150).option("compression", compression).save(str(tmp_path / "b"))
    index = json.loads((tmp_path / "b" / "bundle.json").read_text())
    assert max(p["rows"] for p in index["parts"]) == 150 and sum(p["rows"] for p in index["parts"]) == 1000
    back = read(spark, tmp_path / "b", stretch=64)
    assert [c for c in back.columns] == ["row_id", "p", "n", "ok", "name", "w"]
    # A part says what it holds: as text, rows are compared NaN and null alike.
    assert sorted(map(str, back.collect())) == sorted(map(str, table(spark).collect()))
    assert back.rdd.getNumPartitions() > len(index["parts"])
    assert not [x for x in (tmp_path / "b").iterdir() if x.name.startswith("_draft")]


def test_append_overwrite_and_columns(spark, tmp_path):
    bundles.register(spark)
    path = str(tmp_path / "b")
    write = lambda df, mode: df.write.format("bundle").mode(mode).save(path)
    write(table(spark, 50), "overwrite")
    write(table(spark, 20).select(F.col("row_id") + 100, *table(spark).columns[1:]).toDF(*table(spark).columns), "append")
    assert read(spark, path, columns="row_id").agg(F.count("*"), F.max("row_id")).first()[:] == (70, 119)
    write(table(spark, 3), "overwrite")
    assert read(spark, path).count() == 3 and len(list((tmp_path / "b").glob("*.npz"))) <= 3
    with pytest.raises(Exception, match="nowhere"):
        read(spark, path, columns="nowhere").count()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bundles.register(spark)
    path = tmp_path / "b"
    table(spark, 40).write.format("bundle").mode("overwrite").save(str(path))
    before = sorted(x.name for x in path.iterdir())
    bad = table(spark, 5000).withColumn("p", F.when(F.col("row_id") == 4999, F.raise_error(F.lit("lost"))).otherwise(F.col("p")))
    with pytest.raises(Exception, match="lost"):
        bad.repartition(4, "row_id").write.format("bundle").mode("overwrite").option("part", 100).save(str(path))
    assert sorted(x.name for x in path.iterdir()) == before and read(spark, path).count() == 40


def test_files_of_others(spark, tmp_path):
    n = 300
    np.savez_compressed(tmp_path / "p.npz", y=np.arange(n, dtype=np.int8), pred=np.linspace(0, 1, n), gt=np.array(["R", "F"] * (n // 2)), weights=np.array([0.25, 0.75]))
    got = read(spark, tmp_path / "p.npz", columns="y,pred,gt", stretch=70)
    assert got.agg(F.count("*"), F.round(F.sum("pred"), 6), F.count_if(F.col("gt") == "F")).first()[:] == (n, 150.0, 150)
    with pytest.raises(Exception, match="not aligned"):
        read(spark, tmp_path / "p.npz").count()
    np.savez(tmp_path / "o.npz", x=np.array([{}, None], dtype=object))
    with pytest.raises(Exception, match="Python objects"):
        read(spark, tmp_path / "o.npz").count()
    with pytest.raises(Exception, match="no bundle"):
        (tmp_path / "none").mkdir()
        read(spark, tmp_path / "none").count()
