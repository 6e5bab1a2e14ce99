"""Blends from sufficient statistics: rows are read once for moments, and the algebra is done on those few numbers."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import bound


def blend_weights(df: DataFrame, y: str, direct: str, other: str, domain: str) -> DataFrame:
    """(domain, weight): the share of `other` that minimises the squared error, in [0, 1]; 0 if both are equal."""
    d = F.col(other) - F.col(direct)
    m = df.groupBy(domain).agg(F.sum(d * (F.col(y) - F.col(direct))).alias("n"), F.sum(d * d).alias("d"))
    ratio = F.try_divide("n", "d")
    return m.select(domain, F.when(F.col("d") > 0, F.greatest(F.least(ratio, F.lit(1.0)), F.lit(0.0))).otherwise(0.0).alias("weight"))


def blend(df: DataFrame, weights: DataFrame, direct: str, other: str, domain: str) -> DataFrame:
    """df with blend = (1 - weight) * direct + weight * other; domains without a weight keep direct. weights: one row a domain.

    weights are written first: Spark knows then how few they are, and does not deal all rows by their few domains.
    """
    w = F.coalesce("weight", F.lit(0.0))
    return df.join(bound(weights), domain, "left").withColumn("blend", F.col(direct) + w * (F.col(other) - F.col(direct)))


def moments(df: DataFrame, y: str, candidates: list[str], domain: str) -> dict:
    """{domain: (Gram matrix, cross moments, sum of squares of y)} in one pass, a row a domain."""
    pairs = [(a, b) for i, a in enumerate(candidates) for b in candidates[i:]]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}") for i, (a, b) in enumerate(pairs)] + [F.sum(F.col(a) * F.col(y)).alias(f"c_{i}") for i, a in enumerate(candidates)]
    out = {}
    for row in df.groupBy(domain).agg(*sums, F.sum(F.col(y) * F.col(y)).alias("yy")).collect():
        g = np.zeros((len(candidates),) * 2)
        for i, (a, b) in enumerate(pairs):
            x, z = candidates.index(a), candidates.index(b)
            g[x, z] = g[z, x] = row[f"g_{i}"]
        out[row[domain]] = (g, np.array([row[f"c_{i}"] for i in range(len(candidates))]), row["yy"])
    return out


def simplex_weights(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """argmin w'Gw - 2c'w over w >= 0, sum w = 1: the best of all supports, each solved with one multiplier."""
    k, best, least = len(cross), None, np.inf
    for size in range(1, k + 1):
        for s in map(list, combinations(range(k), size)):
            system = np.block([[2 * gram[np.ix_(s, s)], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            part = np.linalg.lstsq(system, np.append(2 * cross[s], 1.0), rcond=None)[0][:size]
            if part.min() < -1e-12 or abs(part.sum() - 1) > 1e-8:
                continue
            w = np.zeros(k)
            w[s] = np.maximum(part, 0)
            w /= w.sum()
            loss = w @ gram @ w - 2 * cross @ w
            if loss < least - 1e-15:
                best, least = w, loss
    return best


def simplex_blend(df: DataFrame, y: str, candidates: list[str], domain: str, domains: tuple[str, ...] = ("R", "F"), out: str = "blend", rest: bool = False) -> tuple[DataFrame, dict]:
    """df with out, the candidates weighted per domain; outside domains null or, with rest, by the mean of their weights. Also the weights."""
    weights = {d: simplex_weights(g, c) for d, (g, c, _) in moments(df.where(F.col(domain).isin(*domains)), y, candidates, domain).items()}
    weighted = lambda w: sum((F.lit(float(x)) * F.col(c) for x, c in zip(w, candidates)), F.lit(0.0))
    value = weighted(np.mean(list(weights.values()), axis=0)) if rest and weights else F.lit(None).cast("double")
    for d, w in weights.items():
        value = F.when(F.col(domain) == d, weighted(w)).otherwise(value)
    return df.withColumn(out, value), weights


def mixed(direct: Column, reverse: Column, middle: Column, gate: Column, cond: Column, c: float = -1.2, share: float = 0.4) -> dict[str, Column]:
    """independent = clip(1 - r - m + c r m), gate = share * independent + (1 - share) * gate, logic = gate * cond."""
    independent = F.greatest(F.least(1 - reverse - middle + c * reverse * middle, F.lit(1.0)), F.lit(0.0))
    both = share * independent + (1 - share) * gate
    return {"independent": independent, "gate": both, "logic": both * cond}


def core_and_final(df: DataFrame, y: str, mixed_: str, offset: str, joint: str, structured: str, domain: str) -> tuple[DataFrame, dict]:
    """df with safe, a simplex blend of three models per domain, and final, one of safe and a fourth. Also both weights."""
    safe, first = simplex_blend(df, y, [mixed_, offset, joint], domain, out="safe")
    final, second = simplex_blend(safe, y, ["safe", structured], domain, out="final")
    return final, {"safe": first, "final": second}


def gate_grid(df: DataFrame, y: str, direct: str, reverse: list[str], middle: list[str], cond: list[str], cs: list[float], domain: str) -> DataFrame:
    """(reverse, middle, cond: places in their lists, c, n, brier) of every candidate, each blended in closed form per domain.

    logic = clip(1 - r - m + c r m) * cond. Where the clip bites at no c of the grid, a row's logic is a line in c, and
    six sums a candidate serve every c; only other rows meet all of them. What is shuffled are sums.
    """
    trees = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"), F.col(r).alias("r"), F.col(m).alias("m"), F.col(p).alias("p")) for i, r in enumerate(reverse) for j, m in enumerate(middle) for k, p in enumerate(cond)])
    rows = df.select(domain, (F.col(y) - F.col(direct)).alias("_e"), F.col(direct).alias("_q"), F.explode(trees).alias("t"))
    grid = F.array(*[F.lit(float(c)) for c in cs])
    at = lambda c: 1 - F.col("t.r") - F.col("t.m") + c * F.col("t.r") * F.col("t.m")
    ends = [at(F.lit(float(f(cs)))) for f in (min, max)]
    calm = F.coalesce((F.least(*ends) >= 0) & (F.greatest(*ends) <= 1) & F.col("t.p").isNotNull() & (ends[0] + ends[1]).isNotNull(), F.lit(False))
    rows = rows.select("*", F.explode(F.when(calm, F.array(F.lit(None).cast("double"))).otherwise(grid)).alias("c"))
    e, u, v = F.col("_e"), (1 - F.col("t.r") - F.col("t.m")) * F.col("t.p") - F.col("_q"), F.col("t.r") * F.col("t.m") * F.col("t.p")
    d = F.greatest(F.least(at(F.col("c")), F.lit(1.0)), F.lit(0.0)) * F.col("t.p") - F.col("_q")
    sums = rows.groupBy(domain, F.col("t.i").alias("reverse"), F.col("t.j").alias("middle"), F.col("t.k").alias("cond"), "c")
    parts = {"ed": e * d, "dd": d * d, "eu": e * u, "ev": e * v, "uu": u * u, "uv": u * v, "vv": v * v}
    sums = sums.agg(F.count("*").alias("n"), F.sum(e * e).alias("ee"), *[F.sum(x).alias(n) for n, x in parts.items()])
    s = F.col
    line = F.transform(grid, lambda c: F.struct(c.alias("c"), (s("eu") + c * s("ev")).alias("ed"), (s("uu") + 2 * c * s("uv") + c * c * s("vv")).alias("dd")))
    sums = sums.select(domain, "reverse", "middle", "cond", "n", "ee", F.inline(F.when(s("c").isNull(), line).otherwise(F.array(F.struct("c", "ed", "dd")))))
    sums = sums.groupBy(domain, "reverse", "middle", "cond", "c").agg(*[F.sum(x).alias(x) for x in ("n", "ee", "ed", "dd")])
    w = F.when(F.col("dd") > 0, F.greatest(F.least(F.try_divide("ed", "dd"), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    loss = F.col("ee") - 2 * w * F.col("ed") + w * w * F.col("dd")
    return sums.groupBy("reverse", "middle", "cond", "c").agg(F.sum("n").alias("n"), (F.sum(loss) / F.sum("n")).alias("brier"))


def audit(df: DataFrame, reference: DataFrame, key: list[str], y: str, names: list[str]) -> DataFrame:
    """(name, n, mae, rmse, max_abs): each of df's columns against the reference's, joined by key; both must hold the same rows.

    unmatched counts keys that one side lacks, different_labels those whose labels are not the same.
    """
    right = reference.select(*key, F.col(y).alias("_y"), *[F.col(c).alias(f"_r_{c}") for c in names])
    both = df.select(*key, F.col(y).alias("_x"), *names, F.lit(1).alias("_left")).join(right.withColumn("_right", F.lit(1)), key, "full")
    unmatched = F.count_if(F.col("_left").isNull() | F.col("_right").isNull())
    labels = F.count_if(F.col("_left").isNotNull() & F.col("_right").isNotNull() & ~F.col("_x").eqNullSafe(F.col("_y")))
    d = {c: F.abs(F.col(c) - F.col(f"_r_{c}")) for c in names}
    each = [F.struct(F.lit(c).alias("name"), F.count(x).alias("n"), F.avg(x).alias("mae"), F.sqrt(F.avg(x * x)).alias("rmse"), F.max(x).alias("max_abs")).alias(f"_a{i}") for i, (c, x) in enumerate(d.items())]
    one = both.agg(unmatched.alias("unmatched"), labels.alias("different_labels"), *each)
    return one.select(F.explode(F.array(*[f"_a{i}" for i in range(len(names))])).alias("x"), "unmatched", "different_labels").select("x.*", "unmatched", "different_labels")


def within(brier: Column, expected: float, tolerance: float = 5e-6) -> Column:
    """Whether a score is as near to the expected one as the tolerance says; null counts as far."""
    return F.coalesce(F.abs(brier - expected) <= tolerance, F.lit(False))
