"""Suites of fits: units that run at once, are kept one by one, and are not run again when a suite is resumed."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.metrics import brier
from tidemark.operators import boosting as T
from tidemark.operators.ranges import delete, exists

#: Units that run at once. Each is a pool of its own: where spark.scheduler.mode is FAIR, a large one doesn't hold up the others.
AT_ONCE = 4


@dataclass(frozen=True)
class Unit:
    """name: letters, digits and `_.-`, one of its own. run gives the unit's results, a DataFrame of few rows."""

    name: str
    run: Callable[[], DataFrame]


def finished(spark: SparkSession, path: str, units: list[Unit]) -> list[str]:
    """Names of the units whose results are whole."""
    return [u.name for u in units if exists(spark, f"{path}/{u.name}/_SUCCESS")]


def pending(spark: SparkSession, path: str, units: list[Unit]) -> list[Unit]:
    """Units that a run of the suite still has to do, in order."""
    done = set(finished(spark, path, units))
    return [u for u in units if u.name not in done]


def run_suite(spark: SparkSession, units: list[Unit], path: str, at_once: int = AT_ONCE) -> DataFrame:
    """The results of all units, with their names as `unit`; those that path already has are not run again.

    A unit's results are there when its folder is whole, so a suite that was stopped anywhere goes on with the rest.
    After a failed unit the others are still run; then RuntimeError names the failed ones.
    """
    if len({u.name for u in units}) < len(units):
        raise ValueError("two units of one name")

    def one(unit: Unit) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", unit.name)
        spark.sparkContext.setJobDescription(unit.name)
        unit.run().withColumn("unit", F.lit(unit.name)).write.mode("overwrite").parquet(f"{path}/{unit.name}")

    failed: dict[str, Exception] = {}
    with ThreadPoolExecutor(at_once) as pool:
        waiting = [(u, pool.submit(inheritable_thread_target(spark)(one), u)) for u in pending(spark, path, units)]
        for unit, future in waiting:
            if (error := future.exception()) is not None:
                failed[unit.name] = error
    if failed:
        raise RuntimeError(f"units that failed: {sorted(failed)}") from next(iter(failed.values()))
    return spark.read.parquet(*[f"{path}/{u.name}" for u in units])


@dataclass(frozen=True)
class Fold:
    """SQL conditions of the rows to fit on and to judge by, and the fold's weight in summaries."""

    name: str
    train: str
    valid: str
    weight: float = 1.0


def fold_unit(rows: DataFrame, variant: str, features: list[str], fold: Fold, target: str, options: T.Options, weight: Column | None = None) -> Unit:
    """Fits the log loss on a fold's training rows and judges it, and the training rows' mean, on the others."""

    def run() -> DataFrame:
        train = rows.where(fold.train)
        model = T.fit(train, features, [F.col(target)], T.LOG_LOSS, weight=weight, options=options)
        out = T.scores(rows.where(fold.valid), model.table(rows.sparkSession), {"_p": None}, features)
        mean = float(train.agg(F.avg(target)).first()[0] or 0.0)
        p, y = F.col("_p")[0], F.col(target)
        return out.agg(F.count("*").alias("n"), brier(y, p).alias("brier"), brier(y, F.lit(mean)).alias("plain")).select(
            F.lit(variant).alias("variant"), F.lit(fold.name).alias("fold"), F.lit(float(fold.weight)).alias("weight"), F.lit(len(features)).alias("features"), F.lit(len(model.trees)).alias("trees"), "n", "brier", "plain"
        )

    return Unit(f"{variant}.{fold.name}", run)


def ablation(rows: DataFrame, variants: dict[str, list[str]], folds: list[Fold], target: str, path: str, options: T.Options, weight: Column | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """A row a (variant, fold): counts and errors. All units read one table of features; see run_suite."""
    units = [fold_unit(rows, v, names, f, target, options, weight) for v, names in variants.items() for f in folds]
    return run_suite(rows.sparkSession, units, path, at_once)


def summary(results: DataFrame, reference: str) -> DataFrame:
    """A row a variant: weighted error over the folds, its change against the reference variant, the worst fold and how
    many folds it improves."""
    base = results.where(F.col("variant") == reference).select("fold", F.col("brier").alias("_base"))
    both = results.join(base, "fold", "left").withColumn("_change", F.col("brier") - F.col("_base"))
    mean = lambda c: F.sum(F.col("weight") * F.col(c)) / F.sum("weight")
    return both.groupBy("variant").agg(
        F.count("*").alias("folds"), F.sum("n").alias("n"), F.max("features").alias("features"), mean("brier").alias("brier"), mean("_change").alias("change"), F.max("brier").alias("worst"), F.count_if(F.col("_change") < 0).alias("improved"), mean("plain").alias("plain")
    )


def discard(spark: SparkSession, path: str) -> None:
    """Removes a suite's results."""
    delete(spark, path)
