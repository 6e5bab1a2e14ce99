"""Places and sums along a total order, and exact quantiles, without a task that sees all rows."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Whether Spark removes what a query has shuffled as soon as the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir or, where that is unset, one in the warehouse."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_BOUND: dict[str, list[str]] = {}


def bound(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for rows that several aggregates read a few columns of.

    What made the rows (joins, windows) runs once, a lost executor costs none of it, and what was shuffled for it goes once
    it is written. The table goes by unbound(), by release() or when the driver's program ends.
    """
    spark = df.sparkSession
    path = temporary(spark, "rows")
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for what goes by release() or when the driver's program ends."""
    if not _BOUND:
        atexit.register(_at_exit)
    path = f"{shared_folder(spark)}/bound-{name}-{uuid.uuid4().hex}"
    _BOUND.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def unbound(df: DataFrame) -> None:
    """Removes the table that bound() has written, once nothing that is still to run reads it."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("bound-"):
            delete(df.sparkSession, folder)


def release(spark: SparkSession) -> int:
    """Removes all that bound() has written in this application; how many tables it was. Nothing may still read them."""
    paths = _BOUND.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder or file of any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def running_totals(df: DataFrame, order: list[str | Column], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Adds, for each {out: column}, the sum of the column over the rows before (with `by`, those of the same group).

    order must tell all rows apart. Rows are dealt to ranges of the order, summed within a range, and what earlier ranges
    hold is added: a window sees one range's rows, or one row a range (and group), however large a group is. The ranges
    are written first, as they are sampled and must not change, and so is what earlier ranges hold, so that Spark knows
    how little it is.
    """
    by = by or []
    ranged = bound(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = ranged.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()])
    along = Window.partitionBy(*by).orderBy("_range") if by else Window.orderBy("_range")
    starts = each.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[before(along, f"_sum_{o}").alias(f"_start_{o}") for o in sums])
    inside = ranged.select("*", *[before(Window.partitionBy("_range", *by).orderBy(*order), c).alias(f"_in_{o}") for o, c in sums.items()])
    on = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return inside.join(bound(starts), on).select(*df.columns, *[(F.col(f"_start_{o}") + F.col(f"_in_{o}")).alias(o) for o in sums])


def positions(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Adds out: the row's place from 0 in a total order."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, {out: "_one"}).drop("_one")


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, quantiles: an array in the order of probabilities) of the known values, interpolated as `percentile` does.

    Rows are counted for each distinct value, and the values at the wanted ranks are picked by running totals: no buffer
    holds the values of a group. Groups without known values have no row; without `by` there always is one, null then.
    """
    by = by or []
    values = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_m"))
    run = running_totals(values, [*by, "_v"], {"_before": "_m"})
    total = run.groupBy(*by).agg(F.min("_before").alias("_start"), F.sum("_m").alias("_n"))
    placed = run.join(total, by) if by else run.join(total)  # without by, one row
    rank = [F.lit(float(q)) * (F.col("_n") - 1) for q in probabilities]
    place = F.col("_before") - F.col("_start")
    at = lambda r: F.max(F.when((place <= r) & (r < place + F.col("_m")), F.col("_v")))
    ends = [at(f(r)).alias(f"_{name}{i}") for i, r in enumerate(rank) for name, f in (("low", F.floor), ("high", F.ceil))]
    found = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    value = [F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (r - F.floor(r)) for i, r in enumerate(rank)]
    return found.select(*by, F.when(F.col("_n").isNotNull(), F.array(*value)).alias("quantiles"))
