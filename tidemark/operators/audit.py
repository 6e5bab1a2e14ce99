"""Whether a row's features depend on rows they should not see: the same rows are derived among all and in parts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dependent_rows(derive: Callable[[DataFrame], DataFrame], history: DataFrame, rows: DataFrame, key: list[str], columns: list[str], part: Column, parts: int) -> DataFrame:
    """(key, {column}_together, {column}_apart) of the rows that come out differently among all rows than with history
    and their own part only; none if each row depends on history and itself.

    part: from 0 to parts - 1, for each row. derive runs parts + 1 times, over all rows each, so no row is left out. key
    must tell rows apart. Null equals null.
    """
    mark = F.lit(None).cast("int")
    past, own = history.withColumn("_part", mark), rows.withColumn("_part", part.cast("int"))
    together = derive(past.unionByName(own)).where("_part is not null").select(*key, *[F.col(c).alias(f"{c}_together") for c in columns])
    each = [derive(past.unionByName(own.where(F.col("_part") == i))).where("_part is not null").select(*key, *[F.col(c).alias(f"{c}_apart") for c in columns]) for i in range(parts)]
    apart = functools.reduce(DataFrame.unionByName, each)
    same = functools.reduce(lambda a, b: a & b, [F.col(f"{c}_together").eqNullSafe(F.col(f"{c}_apart")) for c in columns])
    return together.join(apart, key, "full").where(~same)
