"""Events of an entity in order: recovering single events from running counts and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rowlocal import near_integer
from tidemark.operators.scans import Scan, large_entities, scanned

WINDOWS = (2, 3, 5, 10, 20, 30, 50)
#: Running counts in a stretch of an entity's rows that one task holds.
STRETCH = 1 << 20


def _hits(n: str, rate: str) -> Column:
    return F.col(n) * F.coalesce(F.col(rate), F.when(F.col(n) == 0, 0.0))


def stretch(n: str, length: int = STRETCH) -> Column:
    """A bucket of rows ordered by n: they are as many as `length`, unless values of n repeat."""
    return F.floor(F.col(n) / length)


def invert_prefix(df: DataFrame, entity: str, n: str, rate: str, order: list[str], tolerance: float = 0.05, windows: tuple[int, ...] = WINDOWS, length: int = STRETCH) -> DataFrame:
    """Adds segment, previous (the event before the row), lag2..lag5 and mean{w} of recovered events.

    A segment is a stretch in which n grows by 1 from row to row. Between neighbours of a segment, both with counts
    within tolerance of whole numbers, the count grows by the previous row's event, if that is 0 or 1. The rows of
    an entity with more than `length` are dealt to tasks by as many running counts; the totals of earlier parts and their
    last rows are carried on. df is read several times: bind it first where it is dear to make.
    """
    by, part, large = [n, *order], stretch(n, length), large_entities(df, entity, length)
    marked = df.withColumns({"_hits": F.rint(_hits(n, rate)), "_ok": near_integer(_hits(n, rate), tolerance)})
    was = scanned(marked, [entity], part, by, Scan(lags={"_was": (F.struct(F.col(n).alias("n"), "_hits", "_ok"), 1)}), large)
    step = F.coalesce(F.col(n) == F.col("_was.n") + 1, F.lit(False))
    change = F.col("_hits") - F.col("_was._hits")
    good = step & F.col("_ok") & F.col("_was._ok") & change.isin(0.0, 1.0)
    event = was.withColumns({"_break": (~step).cast("long"), "previous": F.when(good, change)}).drop("_was", "_hits", "_ok")
    # Segments end where the running number of breaks grows; a row's own break begins its segment.
    numbered = scanned(event, [entity], part, by, Scan(totals={"segment": F.col("_break")}), large).withColumn("segment", F.col("segment") + F.col("_break")).drop("_break")
    if not windows:
        return numbered
    recent = {f"_last{w}": (F.col("previous"), w - 1) for w in windows}
    run = scanned(numbered, [entity, "segment"], part, by, Scan(lags={f"lag{k}": (F.col("previous"), k - 1) for k in (2, 3, 4, 5)}, recent=recent), large)
    here = lambda c: F.coalesce(c, F.lit(0))
    known = F.col("previous").isNotNull().cast("long")
    means = {f"mean{w}": F.try_divide(F.col(f"_last{w}.total") + here(F.col("previous")), (F.col(f"_last{w}.n") + known).cast("double")) for w in windows}
    return run.withColumns(means).drop(*recent)


def own_event(df: DataFrame, entity: str, n: str, rate: str, order: list[str], out: str, length: int = STRETCH) -> DataFrame:
    """Adds out: the row's own event, from the growth of the count to the entity's next row; null if n does not follow."""
    rows = df.withColumn("_hits", F.rint(_hits(n, rate)))
    ahead = scanned(rows, [entity], stretch(n, length), [n, *order], Scan(leads={"_then": F.struct(F.col(n).alias("n"), "_hits")}), large_entities(df, entity, length))
    change = F.col("_then._hits") - F.col("_hits")
    return ahead.withColumn(out, F.when((F.col("_then.n") == F.col(n) + 1) & change.isin(0.0, 1.0), change)).drop("_hits", "_then")
