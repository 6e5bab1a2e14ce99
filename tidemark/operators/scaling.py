"""Parameters that are fitted on one table and applied to another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import bound, exact_quantiles, unbound


@dataclass(frozen=True)
class RobustScaler:
    """Median imputation, centring by the median, scaling by the 5 to 95 per cent range, clipping at 10.

    Columns without a null when fitted get no missing indicator; a range of 0 divides by 1.
    """

    params: dict[str, tuple[float, float, float, bool]]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> RobustScaler:
        """All columns at once: their values as rows of one bound table, which is read for both sorts of quantiles."""
        pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
        values = bound(df.select(F.inline(pairs)))
        nulls = {r["_c"]: r["n"] for r in values.groupBy("_c").agg(F.count_if(F.col("_v").isNull()).alias("n")).collect()}
        median = {c: 0.0 for c in columns} | {r["_c"]: r["quantiles"][0] for r in exact_quantiles(values, "_v", [0.5], by=["_c"]).collect()}
        known = F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, float(median[c]))]), F.col("_c"))
        filled = values.withColumn("_v", F.coalesce("_v", known))
        ends = {r["_c"]: tuple(r["quantiles"]) for r in exact_quantiles(filled, "_v", [0.05, 0.95], by=["_c"]).collect()}
        unbound(values)
        return cls({c: (median[c], *ends.get(c, (0.0, 0.0)), nulls.get(c, 0) > 0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        new: dict[str, Column] = {}
        for c, (median, low, high, nulls) in self.params.items():
            scaled = (F.coalesce(F.col(c), F.lit(median)) - median) / ((high - low) or 1.0)
            new[f"{c}_scaled"] = F.greatest(F.least(scaled, F.lit(10.0)), F.lit(-10.0))
            if nulls:
                new[f"{c}_missing"] = F.col(c).isNull().cast("int")
        return df.withColumns(new)


def category_index(df: DataFrame, column: str) -> DataFrame:
    """(column, code): sorted distinct values from 1. The window runs over distinct values."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("code", F.dense_rank().over(Window.orderBy(column)).cast("int"))


def with_category(df: DataFrame, index: DataFrame, column: str, out: str) -> DataFrame:
    """df with out: the column's code, 0 for values that were not seen."""
    return df.join(index.withColumnRenamed("code", out), column, "left").withColumn(out, F.coalesce(out, F.lit(0)))
