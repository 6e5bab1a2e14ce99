import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranges
from tidemark.sources import store

SCHEMA = "i int, season int, g string, r double, m map<string,int>, a array<int>"


def table(spark):
    rows = [(i, 2019 + i % 3, None if i % 5 == 0 else "ab"[i % 2], i / 7 if i % 4 else None, {"k": i}, [i, None]) for i in range(200)]
    return spark.createDataFrame(rows, SCHEMA)


def test_digest_is_of_the_rows_and_of_nothing_else(spark):
    df = table(spark)
    one = store.content_digest(df)
    assert one == store.content_digest(df.repartition(7).orderBy(F.desc("i")).select(*reversed(df.columns)))
    changed = [
        df.withColumn("r", F.when(F.col("i") == 77, 0.5).otherwise(F.col("r"))),
        df.withColumn("g", F.when(F.col("i") != 77, F.col("g"))),
        df.where("i <> 3"),
        df.union(df.where("i = 3")),
        df.withColumnRenamed("g", "h"),
        df.withColumn("i", F.col("i").cast("long")),
    ]
    assert len({one, *map(store.content_digest, changed)}) == 7
    two = spark.createDataFrame([(None, 1)], "a int, b int"), spark.createDataFrame([(1, None)], "a int, b int")
    assert store.content_digest(two[0]) != store.content_digest(two[1])
    assert store.content_digest(df.limit(0)).startswith("0-")


def test_saved_tables_are_verified(spark, tmp_path):
    df, source = table(spark).withColumn("y", F.col("i") % 2), str(tmp_path / "in")
    df.drop("m", "a").write.csv(source, header=True)
    made = store.save_table(df, str(tmp_path / "t"), "season", "y", [2019, 2020, 2021], source)
    known = json.loads(made.json())
    assert known["rows"] == 200 and known["target_mean"] == 0.5 and known["seasons"] == {"2019": 67, "2020": 67, "2021": 66} and len(known["sources"]) >= 1
    assert store.load_table(spark, str(tmp_path / "t"), source).count() == 200
    with pytest.raises(ValueError, match="missing \\[2018\\], not expected \\[2021\\]"):
        store.save_table(df, str(tmp_path / "u"), "season", "y", [2018, 2019, 2020])
    assert not (tmp_path / "u").exists()
    store.load_table(spark, str(tmp_path / "t")).withColumn("i", F.col("i") + (F.col("i") == 9).cast("int")).write.parquet(str(tmp_path / "other"))
    os.rename(tmp_path / "t" / "rows", tmp_path / "t" / "rows-before")
    os.rename(tmp_path / "other", tmp_path / "t" / "rows")
    with pytest.raises(ValueError, match="digest"):
        store.load_table(spark, str(tmp_path / "t"))


def test_cached_tables_are_made_once_and_expire(spark, tmp_path):
    source, calls = str(tmp_path / "in"), []
    spark.range(10).write.parquet(source)

    def build():
        calls.append(1)
        return spark.read.parquet(source).withColumn("twice", F.col("id") * 2)

    get = lambda version="1", **k: store.cached(spark, "t", [source], ["id", "twice"], version, build, **k)
    first, second = get(), get()
    assert (first.reused, second.reused, len(calls)) == (False, True, 1)
    assert sorted(second.rows.collect()) == sorted(first.rows.collect())
    assert source not in second.rows._jdf.queryExecution().toString()  # the second run scans no source
    assert not get("2").reused and len(calls) == 2
    spark.range(5).write.mode("append").parquet(source)
    grown = get()
    assert not grown.reused and grown.rows.count() == 15
    assert not get(days=-1.0).reused

    def broken():
        return spark.range(3).select("id", F.raise_error(F.lit("lost")).alias("twice"))

    with pytest.raises(Exception, match="lost"):
        store.cached(spark, "t", [source], ["id", "twice"], "3", broken)
    assert not store.cached(spark, "t", [source], ["id", "twice"], "3", build).reused
    assert any(n.startswith("cache-t-") for n in store.expire(spark, -1.0)) and store.expire(spark, -1.0) == []


def test_bound_tables_are_released(spark):
    df = ranges.bound(spark.range(10))
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 10 and ranges.exists(spark, folder)
    assert ranges.release(spark) >= 1 and not ranges.exists(spark, folder) and ranges.release(spark) == 0
