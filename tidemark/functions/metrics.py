"""Scores of probabilities as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import running_totals


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def brier(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def probability_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Brier, reference (always the rate), skill, scores, mean, deviation, and ROC AUC by average ranks, for each group.

    skill and scores are null if the reference is 0, AUC if there is one class only. Ranks come from counts of each
    distinct probability and running totals over ranges of them.
    """
    by = by or []
    c = clip(F.col(p))
    rows = df.select(*by, F.col(y).cast("double").alias("_y"), c.alias("_p"))
    one = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_y").alias("rate"), brier(F.col("_y"), F.col("_p")).alias("brier"), F.avg("_p").alias("mean"), F.stddev_pop("_p").alias("std"))
    reference = F.col("rate") * (1 - F.col("rate"))
    skill = F.when(reference > 0, 1 - F.try_divide("brier", reference))
    one = one.select(*by, "n", "brier", reference.alias("reference"), skill.alias("skill"), (1e5 * skill).alias("raw_score"), F.greatest(1e5 * skill, F.lit(0.0)).alias("score"), "mean", "std")
    values = rows.groupBy(*by, "_p").agg(F.count("*").alias("m"), F.sum("_y").alias("pos"))
    run = running_totals(values, [*by, "_p"], {"below": "m"})
    ranks = (F.col("below") + (F.col("m") + 1) / 2) * F.col("pos")
    auc = run.groupBy(*by).agg(F.sum(ranks).alias("r"), F.min("below").alias("start"), F.sum("pos").alias("np"), (F.sum("m") - F.sum("pos")).alias("nn"))
    # Totals run on from group to group: a group's ranks begin at its smallest one.
    area = F.try_divide(F.col("r") - F.col("start") * F.col("np") - F.col("np") * (F.col("np") + 1) / 2, F.col("np") * F.col("nn"))
    auc = auc.select(*by, area.alias("auc"))
    return one.join(auc, by) if by else one.join(auc)


def binary_metrics(y: Column, p: Column, small: float = 1e-7) -> dict[str, Column]:
    """Brier and log loss on probabilities clipped away from 0 and 1."""
    c = clip(p, small, 1 - small)
    return {"brier": F.avg((y - c) * (y - c)), "logloss": -F.avg(y * F.ln(c) + (1 - y) * F.ln(1 - c))}


def delta_metrics(a: Column, b: Column) -> dict[str, Column]:
    d = a - b
    return {"mae": F.avg(F.abs(d)), "rmse": F.sqrt(F.avg(d * d)), "max": F.max(F.abs(d))}
