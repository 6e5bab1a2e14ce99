"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.facts import FACTS, RATED, ROW, facts, rated  # noqa: F401

ROW_SQL = ", ".join(f"r.{c}" for c in ROW)


def rounded(df: DataFrame, *columns: str, keys: list[str] | None = None, digits: int = 9) -> DataFrame:
    """keys (a row's identity by default) and columns, doubles rounded, and never -0.0, so that engines agree."""
    kinds = dict(df.dtypes)
    fix = lambda c: (F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c)
    return df.select(*[fix(c) for c in [*(ROW if keys is None else keys), *columns]])


def r9(e: str, name: str) -> str:
    return f"round({e}, 9) + 0.0 AS {name}"


def pick(**columns: Column) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]
