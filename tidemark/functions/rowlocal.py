"""Row-local derivations as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<MISSING>"


def token(c: Column) -> Column:
    """A categorical's text: trimmed and lower-cased, missing as <MISSING>."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(MISSING))))


def cross(*columns: str) -> Column:
    """Parts joined with |, missing ones as <MISSING> (concat_ws alone would drop them)."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns])


def spread(*columns: Column) -> Column:
    """max - min; null if any is null (greatest and least alone skip nulls)."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(known, F.greatest(*columns) - F.least(*columns))


def mean_of_known(*columns: Column) -> Column:
    """The mean of those that are not null; null if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    return F.try_divide(total, reduce(lambda a, b: a + b, [c.isNotNull().cast("double") for c in columns]))


def recent_block(long: str, one: str, three: str, five: str) -> dict[str, Column]:
    """What a rate did of late: differences of four horizons, and mean, mean minus long and spread of the recent three.

    Nulls pass on: every part of a value must be known.
    """
    c = {"long": F.col(long), "prev1": F.col(one), "prev3": F.col(three), "prev5": F.col(five)}
    pairs = (("prev1", "long"), ("prev3", "long"), ("prev5", "long"), ("prev1", "prev3"), ("prev3", "prev5"), ("prev1", "prev5"))
    out = {f"{a}_minus_{b}": c[a] - c[b] for a, b in pairs}
    recent = [c["prev1"], c["prev3"], c["prev5"]]
    mean = (recent[0] + recent[1] + recent[2]) / 3
    return out | {"mean3": mean, "mean3_minus_long": mean - c["long"], "range3": spread(*recent)}


def experience(n: str, k: float = 2000.0) -> Column:
    """n / (n + k), n at least 0."""
    at_least = F.greatest(F.col(n), F.lit(0))
    return at_least / (at_least + k)


def shrunk(gap: Column, since: Column, long: Column, k: float = 100.0) -> Column:
    """(gap * since + k * long) / (gap + k); a missing gap counts as 0 and a missing since as long."""
    g = F.coalesce(gap, F.lit(0))
    return (g * F.coalesce(since, long) + k * long) / (g + k)


def entropy(*rates: Column) -> Column:
    """-sum p ln p with p clipped to [1e-6, 1]; nulls are left out."""
    one = lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-6))
    return -reduce(lambda a, b: a + b, [F.when(p.isNull(), 0.0).otherwise(one(p) * F.ln(one(p))) for p in rates])


def first_largest(values: dict[str, Column]) -> Column:
    """The name of the largest; nulls count as -1 and of equals the first wins."""
    v = {k: F.coalesce(c, F.lit(-1.0)) for k, c in values.items()}
    most = F.greatest(*v.values())
    return F.coalesce(*[F.when(c == most, k) for k, c in v.items()])


def cut_right(c: Column, edges: list[float]) -> Column:
    """The number of the right-closed interval that edges cut: 0 up to the first; -1 for null."""
    out = F.when(c.isNull(), -1)
    for i, e in enumerate(edges):
        out = out.when(c <= e, i)
    return out.otherwise(len(edges))


def quantile_code(c: Column, edges: Column) -> Column:
    """How many of the inner edges are at most c; -1 for null."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(c.isNull(), -1).otherwise(F.size(F.filter(inner, lambda e: e <= c)))


def near_integer(c: Column, tolerance: float = 0.05) -> Column:
    """Whether c is known, finite and within tolerance of a whole number."""
    return F.coalesce((F.abs(c - F.rint(c)) <= tolerance) & ~F.isnan(c), F.lit(False))


def outcome_class(y: Column, reverse: Column, middle: Column) -> Column:
    """0 success, 1 neither, 2 reverse only, 3 middle only, 4 anything else, nulls included."""
    return F.when(y == 1, 0).when((reverse == 0) & (middle == 0), 1).when((reverse == 1) & (middle == 0), 2).when((reverse == 0) & (middle == 1), 3).otherwise(4)


def bits(*flags: Column) -> Column:
    """flags packed in a number, the first as its lowest bit."""
    return reduce(lambda a, b: a + b, [F.shiftleft(f.cast("int"), i) for i, f in enumerate(flags)])


def prior(mode: str) -> Column:
    """What residual models start from, by mode; each part that is missing counts as the column `mean`.

    season expects the columns gap and since, of the frozen anchor.
    """
    m, known = F.col("mean"), lambda c: F.coalesce(c, F.col("mean"))
    long = known((F.col("p_n") * F.col("p_y_rate") + 200 * m) / (F.col("p_n") + 200))
    other, recent = known(F.col("b_y_rate")), known(mean_of_known(F.col("p_prev1_y"), F.col("p_prev3_y"), F.col("p_prev5_y")))
    is_f = F.col("gt") == "F"
    if mode == "flat":
        return m
    if mode == "pitch":
        return long
    if mode == "both":
        return 0.75 * long + 0.25 * other
    if mode == "domain":
        return F.when(is_f, 0.5 * long + 0.4 * recent + 0.1 * other).otherwise(0.5 * long + 0.3 * recent + 0.2 * other)
    base = 0.65 * long + 0.25 * recent + 0.10 * other
    if mode == "recent":
        return base
    if mode == "season":
        gap, k = F.coalesce("gap", F.lit(0)), F.when(is_f, 25.0).otherwise(100.0)
        return (gap * F.coalesce("since", base) + k * base) / (gap + k)
    raise ValueError(mode)
