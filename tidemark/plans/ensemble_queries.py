"""Grids, simplex ensembles, audits and tolerance (E4 to E6, E8, E9), class probabilities (M9) and folds (D2)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import rowlocal as R
from tidemark.operators import ensemble as E
from tidemark.operators.models import joint_to_success
from tidemark.operators.ranges import bound
from tidemark.plans.common import FACTS, ROW, ROW_SQL, facts, r9, rounded
from tidemark.plans.registry import register
from tidemark.plans.stats_queries import SCORED, scored, simplex_sql

_CS = [i / 5 - 2 for i in range(21)]
_PARTS = {"r0": "coalesce(p_reverse_rate, 0.1)", "r1_": "0.5 * coalesce(p_reverse_rate, 0.1) + 0.05", "m0": "coalesce(p_middle_rate, 0.1)", "m1": "0.5 * coalesce(b_middle_rate, 0.1) + 0.05", "q0": "other", "q1": "third"}
_TREES = "(VALUES " + ", ".join(f"({i}, {j}, {k})" for i, j, k in product((0, 1), (0, 1), (0, 1))) + ") t(i, j, k)"


@register(
    "e6_gate_grid",
    f"""WITH {SCORED}, s AS (SELECT y, gt, direct, {', '.join(f'{e} AS {n}' for n, e in _PARTS.items())} FROM scored),
x AS (SELECT gt, i, j, k, z, y - direct AS e, greatest(least(1 - rv - md + (z / 5 - 2) * rv * md, 1), 0) * cd - direct AS d FROM (SELECT *, CASE WHEN i = 0 THEN r0 ELSE r1_ END AS rv, CASE WHEN j = 0 THEN m0 ELSE m1 END AS md, CASE WHEN k = 0 THEN q0 ELSE q1 END AS cd FROM s, {_TREES}), range(21) g(z)),
m AS (SELECT gt, i, j, k, z, count(*) AS n, sum(e * e) AS ee, sum(e * d) AS ed, sum(d * d) AS dd FROM x GROUP BY ALL), w AS (SELECT *, CASE WHEN dd > 0 THEN greatest(least(ed / dd, 1), 0) ELSE 0 END AS w FROM m)
SELECT i AS reverse, j AS middle, k AS cond, round(z / 5 - 2, 6) + 0.0 AS c, sum(n)::bigint AS n, {r9('sum(ee - 2 * w * ed + w * w * dd) / sum(n)', 'brier')} FROM w GROUP BY i, j, k, z""",
)
def e6(spark, sf_dir):
    """The whole grid; its first least row is O6's."""
    df = scored(spark, sf_dir).selectExpr("y", "gt", "direct", *[f"{e} as {n}" for n, e in _PARTS.items()])
    out = E.gate_grid(df, "y", "direct", ["r0", "r1_"], ["m0", "m1"], ["q0", "q1"], _CS, "gt")
    return rounded(out.withColumn("c", F.round("c", 6)), *out.columns, keys=[])


def _candidates(spark, sf_dir, names: int):
    more = {"fourth": "0.5 * (direct + coalesce(p_prev5_y, direct))", "fifth": "least(greatest(other + 0.05 * (r1 - r2), 0), 1)"}
    df = scored(spark, sf_dir).selectExpr("*", *[f"{e} as {n}" for n, e in more.items()])
    return df, ["direct", "other", "third", "fourth", "fifth"][:names]


@register("e4_five_candidates")
def e4(spark, sf_dir):
    """Five candidates on the simplex per domain; a third domain takes the mean of both weights."""
    df, names = _candidates(spark, sf_dir, 5)
    # A third domain: the few rows of one order status.
    df = df.withColumn("gt", F.when(F.col("half") == "P", "X").otherwise(F.col("gt")))
    return rounded(E.simplex_blend(df, "y", names, "gt", rest=True)[0], "gt", "blend", digits=6)


@register("e5_core_and_final", f"WITH {SCORED}, c AS (SELECT *, 0.5 * (direct + coalesce(p_prev5_y, direct)) AS fourth FROM scored), {simplex_sql('w', 'c', 'direct', 'other', 'third')}, s AS (SELECT c.*, w.p * direct + w.q * other + (1 - w.p - w.q) * third AS safe FROM c JOIN w ON c.gt = w.gt), v AS (SELECT gt, greatest(least(sum((fourth - safe) * (y - safe)) / sum((fourth - safe) * (fourth - safe)), 1), 0) AS v FROM s GROUP BY gt) SELECT {ROW_SQL}, round(safe, 6) + 0.0 AS safe, round(safe + v * (fourth - safe), 6) + 0.0 AS final FROM s r JOIN v ON r.gt = v.gt")
def e5(spark, sf_dir):
    df, _ = _candidates(spark, sf_dir, 5)
    # Written once: two passes for moments and the result read a few columns, and shuffle nothing.
    df = bound(df.select(*ROW, "y", "gt", "direct", "other", "third", "fourth"))
    out, _ = E.core_and_final(df, "y", "direct", "other", "third", "fourth", "gt")
    return rounded(out, "safe", "final", digits=6)


@register("e8_prediction_audit", f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{a}' AS name, count(*) AS n, {r9(f'avg(abs({a} - {b}))', 'mae')}, {r9(f'sqrt(avg(({a} - {b}) * ({a} - {b})))', 'rmse')}, {r9(f'max(abs({a} - {b}))', 'max_abs')}, 0::bigint AS unmatched, 0::bigint AS different_labels FROM scored" for a, b in (("direct", "third"), ("other", "direct"))))
def e8(spark, sf_dir):
    df = scored(spark, sf_dir)
    key = [*ROW, "l_extendedprice", "l_shipdate"]
    reference = df.select(*key, "y", F.col("third").alias("direct"), F.col("direct").alias("other"))
    out = E.audit(df, reference, key, "y", ["direct", "other"])
    return rounded(out, *out.columns, keys=[])


@register("e9_tolerance", f"WITH {SCORED}, b AS (SELECT season, avg((y - direct) * (y - direct)) AS brier FROM scored GROUP BY season) SELECT season, {r9('brier', 'brier')}, abs(brier - 0.2) <= 0.01 AS near, abs(brier - 0.2) <= 5e-6 AS same FROM b")
def e9(spark, sf_dir):
    b = scored(spark, sf_dir).groupBy("season").agg(M.brier(F.col("y"), F.col("direct")).alias("brier"))
    return rounded(b.withColumns({"near": E.within(F.col("brier"), 0.2, 0.01), "same": E.within(F.col("brier"), 0.2)}), "season", "brier", "near", "same", keys=[])


_CLASS = "CASE WHEN y = 1 THEN 0 WHEN reverse = 0 AND middle = 0 THEN 1 WHEN reverse = 1 AND middle = 0 THEN 2 WHEN reverse = 0 AND middle = 1 THEN 3 ELSE 4 END"


@register("m9_joint_to_success", f"""WITH {FACTS}, c AS (SELECT *, {_CLASS} AS class FROM facts), q AS (SELECT gt, {', '.join(f'coalesce(avg(ball) FILTER (class = {k}), 0) AS q{k}' for k in range(5))} FROM c GROUP BY gt),
p AS (SELECT p, {', '.join(f'avg((class = {k})::int) AS p{k}' for k in range(5))} FROM c GROUP BY p)
SELECT {ROW_SQL}, {r9(' + '.join(f'p{k} * q{k}' for k in range(5)), 'success')} FROM facts r JOIN p ON r.p = p.p JOIN q ON r.gt = q.gt""")
def m9(spark, sf_dir):
    """Class probabilities (an entity's shares) weighted by each class's mean in the row's domain."""
    df = facts(spark, sf_dir)
    c = df.withColumn("class", R.outcome_class(F.col("y"), F.col("reverse"), F.col("middle")))
    means = c.groupBy("gt").agg(F.array(*[F.coalesce(F.avg(F.when(F.col("class") == k, F.col("ball"))), F.lit(0.0)) for k in range(5)]).alias("means"))
    shares = c.groupBy("p").agg(F.array(*[F.avg((F.col("class") == k).cast("int")) for k in range(5)]).alias("shares"))
    return rounded(joint_to_success(df.join(shares, "p"), "shares", means, "gt", "success"), "success")


_D2 = "f(fold, v, c, w) AS (VALUES ('forward_2000', 2000, 0, 0.2), ('forward_2001', 2001, 0, 0.3), ('within_2001', 2001, 6, 0.5))"
_TRAIN, _VALID = "(season < v OR (c > 0 AND season = v AND inning <= c))", "(season = v AND inning > c)"


@register("d2_fold_validation", f"""WITH {SCORED}, {_D2}, t AS (SELECT fold, gt, avg(y) AS rate, avg(CASE WHEN season >= v - 2 THEN y END) AS recent FROM scored, f WHERE {_TRAIN} GROUP BY fold, gt),
e AS (SELECT f.fold, f.w, a / 4 AS alpha, y, (a / 4) * t.recent + (1 - a / 4) * t.rate AS pred FROM scored s JOIN f ON s.season = f.v AND s.inning > f.c JOIN t ON t.fold = f.fold AND t.gt = s.gt, range(5) g(a)),
b AS (SELECT fold, w, alpha, count(*) AS n, avg((y - pred) * (y - pred)) AS brier FROM e GROUP BY ALL)
SELECT {r9('alpha', 'alpha')}, count(*) AS folds, sum(n)::bigint AS n, {r9('sum(w * brier) / sum(w)', 'brier')}, {r9('max(brier)', 'worst')} FROM b GROUP BY alpha""")
def d2(spark, sf_dir):
    """Three folds in one job: a long and a recent estimate from each fold's training rows, blended by a grid on its valid rows.

    Folds are masks on (period, month), so their training rates come from counts a (period, month, domain) and rows are
    read once for those.
    """
    folds = spark.createDataFrame([("forward_2000", 2000, 0, 0.2), ("forward_2001", 2001, 0, 0.3), ("within_2001", 2001, 6, 0.5)], "fold string, v int, c int, w double")
    cells = facts(spark, sf_dir).groupBy("season", "inning", "gt").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    cells = cells.join(folds)  # three folds, in the program, with a row a (period, month, domain)
    total = lambda c, m: F.sum(F.when(m, F.col(c)))
    recent = F.col("season") >= F.col("v") - 2
    rate = (F.sum("s") / F.sum("n")).alias("rate")
    train = cells.where(F.expr(_TRAIN)).groupBy("fold", "gt").agg(rate, F.try_divide(total("s", recent), total("n", recent)).alias("recent"))
    valid = cells.where(F.expr(_VALID)).groupBy("fold", "w", "gt").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(train, ["fold", "gt"])
    grid = valid.select("*", F.explode(F.array(*[F.lit(a / 4) for a in range(5)])).alias("alpha"))
    pred = F.col("alpha") * F.col("recent") + (1 - F.col("alpha")) * F.col("rate")
    # Labels are 0 or 1: their squared errors are those of s ones and n - s zeros.
    error = F.col("s") * (1 - pred) * (1 - pred) + (F.col("n") - F.col("s")) * pred * pred
    fold = grid.groupBy("fold", "w", "alpha").agg(F.sum("n").alias("n"), (F.sum(error) / F.sum("n")).alias("brier"))
    out = fold.groupBy("alpha").agg(F.count("*").alias("folds"), F.sum("n").alias("n"), (F.sum(F.col("w") * F.col("brier")) / F.sum("w")).alias("brier"), F.max("brier").alias("worst"))
    return rounded(out, *out.columns, keys=[])
