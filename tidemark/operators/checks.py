"""Checks that count what breaks them, in one pass, and lists of features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The eight base states as text, and whether the first, second and third base is taken.
BASE_STATES = {"___": (0, 0, 0), "1__": (1, 0, 0), "_2_": (0, 1, 0), "__3": (0, 0, 1), "12_": (1, 1, 0), "1_3": (1, 0, 1), "_23": (0, 1, 1), "123": (1, 1, 1)}


def state_invariants() -> dict[str, Column]:
    """Ten rules of the canonical columns as counts of the rows that break them, and the largest gap of two expectancies.

    A null on either side breaks a rule. Rows of an unknown base state count there and not as wrong runners.
    """
    c = F.col
    taken = {i: F.coalesce(*[F.when(c("base_state") == s, f[i]) for s, f in BASE_STATES.items()]) for i in range(3)}
    known = c("base_state").isin(*BASE_STATES)
    broken = lambda rule: F.count_if(~F.coalesce(rule, F.lit(False)))
    runner = lambda name, decoded: F.count_if(F.coalesce(known, F.lit(False)) & ~F.coalesce(c(name) == decoded, F.lit(False)))
    return {
        "run_total": broken(c("run_total") == c("run_top") + c("run_bot")),
        "score_diff": broken(c("score_diff") == c("run_bot") - c("run_top")),
        "score_parity": broken((c("run_total") + c("score_diff")) % 2 == 0),
        "pitcher_diff": broken(c("pitcher_diff") == F.when(c("half") == "T", c("score_diff")).otherwise(-c("score_diff"))),
        "unknown_base_state": broken(known),
        **{f"runner_{i + 1}": runner(f"r{i + 1}", taken[i]) for i in range(3)},
        "runners": runner("runners", taken[0] + taken[1] + taken[2]),
        "mix_n": broken(c("mix_n") == c("p_n")),
        "we_gap": F.max(F.abs(c("home_we") + c("away_we") - 1)),
    }


def fold_overlaps(df: DataFrame, folds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(fold, train, valid, overlap, good): rows of each fold's two masks and of both, all counted in one pass.

    A fold is good if both masks have rows and share none; null is in no mask.
    """
    counts = [F.struct(F.lit(n).alias("fold"), F.count_if(t).alias("train"), F.count_if(v).alias("valid"), F.count_if(t & v).alias("overlap")).alias(f"_{i}") for i, (n, (t, v)) in enumerate(folds.items())]
    each = df.agg(*counts).select(F.inline(F.array(*[f"_{i}" for i in range(len(folds))])))
    return each.withColumn("good", (F.col("overlap") == 0) & (F.col("train") > 0) & (F.col("valid") > 0))


def split_overlap(df: DataFrame, train: Column, valid: Column, by: list[str] | None = None) -> DataFrame:
    """(by, train, valid, overlap, good): counts of two masks; good if no row is in both and neither is empty."""
    t, v = (F.coalesce(m, F.lit(False)) for m in (train, valid))
    counts = df.groupBy(*(by or [])).agg(F.count_if(t).alias("train"), F.count_if(v).alias("valid"), F.count_if(t & v).alias("overlap"))
    return counts.withColumn("good", (F.col("overlap") == 0) & (F.col("train") > 0) & (F.col("valid") > 0))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in which none of the columns is null."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def feature_list(groups: dict[str, list[str]], take: list[str], drop: list[str] | None = None) -> list[str]:
    """The features of some groups in order, without some; ValueError for one that is there twice or dropped but not there."""
    out = [f for g in take for f in groups[g]]
    if twice := sorted({f for f in out if out.count(f) > 1}):
        raise ValueError(f"twice: {twice}")
    if absent := sorted(set(drop or []) - set(out)):
        raise ValueError(f"not there to drop: {absent}")
    return [f for f in out if f not in set(drop or [])]


def arranged(df: DataFrame, first: list[str], drop: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """df without some columns, others renamed, and those of `first` (new names) before the rest."""
    kept = {c: (rename or {}).get(c, c) for c in df.columns if c not in set(drop or [])}
    order = [*first, *[n for n in kept.values() if n not in set(first)]]
    old = {n: c for c, n in kept.items()}
    return df.select(*[F.col(old[n]).alias(n) for n in order])


def finite(c: Column, missing: float = 0.0) -> Column:
    """A double without null, NaN (both `missing`) and infinities (the largest and smallest double)."""
    most = 1.7976931348623157e308
    return F.when(c.isNull() | F.isnan(c), F.lit(missing)).otherwise(F.greatest(F.least(c, F.lit(most)), F.lit(-most)))
