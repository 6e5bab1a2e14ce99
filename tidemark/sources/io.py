"""Reading and writing tables, with checks that raise. Paths may be any that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or ValueError naming what is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """df, or ValueError naming some values outside allowed; null is outside."""
    bad = [r[0] for r in df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).select(column).distinct().limit(5).collect()]
    if bad:
        raise ValueError(f"{column} holds {bad}")
    return df


def require_invariants(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df, or ValueError with the counts of rows that break each SQL condition; all are counted in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in rules.items()]).first().asDict()
    if broken := {n: c for n, c in counts.items() if c}:
        raise ValueError(f"rows that break rules: {broken}")
    return df


def require_predictions(df: DataFrame, sample: DataFrame, key: str, value: str, version: str | None = None) -> DataFrame:
    """sample's keys with their value, or ValueError if one is missing, not finite or outside [0, 1].

    Of repeated keys the row with the largest version counts; without `version` a repeated key is an error too.
    """
    newest = F.max_by(value, version) if version else F.max(value)
    each = df.groupBy(key).agg(newest.alias(value), F.count("*").alias("_times"))
    out = sample.select(key).join(each, key, "left")
    good = F.coalesce(F.col(value).between(0, 1), F.lit(False))
    once = F.lit(True) if version else F.coalesce(F.col("_times") == 1, F.lit(True))
    return require_invariants(out.withColumns({"_good": good, "_once": once}), {"in [0, 1]": "_good", "one row a key": "_once"}).drop("_good", "_once", "_times")


def require_equal_rows(one: DataFrame, other: DataFrame) -> int:
    """The number of rows of both, or ValueError if they differ."""
    a, b = one.count(), other.count()
    if a != b:
        raise ValueError(f"tables of {a} and {b} rows")
    return a


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become null: inside the library only null is missing."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(~bad(F.col(c)), F.col(c)) for c in floats})


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file or folder with a header, plain or gzipped (by its ending); a byte-order mark is skipped by Spark's reader."""
    return nulls_for_nan(spark.read.schema(schema).csv(path, header=True, enforceSchema=True))


def read_first(spark: SparkSession, folders: list[str], name: str, schema: StructType | str) -> DataFrame:
    """The table `name` of the first folder that has it."""
    fs = spark._jvm.org.apache.hadoop.fs
    for folder in folders:
        at = fs.Path(f"{folder}/{name}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return read_csv(spark, f"{folder}/{name}", schema)
    raise FileNotFoundError(f"{name} in none of {folders}")


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    """A CSV folder with headers; doubles are written so that they read back the same."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def write_submission(df: DataFrame, sample: DataFrame, key: str, value: str, path: str, order: str) -> None:
    """(key, value) of the sample's rows as CSV, checked by require_predictions, in ascending `order`, a column of sample.

    Files follow each other in that order, by ranges: no task holds all rows. Repeated keys of the sample are an error.
    """
    require_invariants(sample.groupBy(key).agg(F.count("*").alias("n")), {"a sample's key once": "n = 1"})
    good = require_predictions(df, sample, key, value)
    places = sample.select(F.col(key).alias("_key"), F.col(order).alias("_order"))
    rows = good.join(places, F.col(key) == F.col("_key")).orderBy("_order").select(key, value)
    write_csv(rows, path)


def manifest(df: DataFrame, period: str, target: str) -> str:
    """JSON with rows, columns, rows of each period, and the target's mean: one aggregate, a row a period."""
    each = df.groupBy(period).agg(F.count("*").alias("n"), F.sum(target).alias("s"), F.count(target).alias("k")).orderBy(period).collect()
    k = sum(r["k"] for r in each)
    return json.dumps({"rows": sum(r["n"] for r in each), "columns": df.columns, "periods": {str(r[period]): r["n"] for r in each}, "target_mean": sum(r["s"] or 0 for r in each) / k if k else None})


def append_latest(old: DataFrame | None, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """old and new by name, of equal keys the row with the largest version: a resumed run's results."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_x"))
    return newest.select(*keys, *[F.col("_x")[c].alias(c) for c in rest])
