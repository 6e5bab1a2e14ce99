"""Aggregates (A), windows (W), scores, blends (E), sorts and set operations (O, U, J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import rowlocal as R
from tidemark.operators import ensemble as E
from tidemark.operators.ranges import bound, exact_quantiles
from tidemark.operators.scans import Scan, large_entities, scanned
from tidemark.operators.sequence import invert_prefix, own_event, stretch
from tidemark.plans.common import FACTS, RATED, ROW, ROW_SQL, facts, r9, rated, rounded
from tidemark.plans.registry import register
from tidemark.sources.facts import ORDER

_ORDER = ", ".join(ORDER)
#: Two predictors and their parts, made of rates so that every engine has the same.
_P = "coalesce(p_y_rate, 0.3333)"
_Q = "coalesce(b_y_rate, 0.3333)"


def scored(spark, sf_dir):
    return rated(spark, sf_dir).selectExpr("*", f"{_P} as direct", f"{_Q} as other", f"0.5 * ({_P} + 0.25) as third")


SCORED = f"{RATED}, scored AS (SELECT *, {_P} AS direct, {_Q} AS other, 0.5 * ({_P} + 0.25) AS third FROM rated)"


@register("a1_size_and_sum", f"WITH {FACTS} SELECT p, gt, count(*) AS n, coalesce(sum(CASE WHEN ball = 1 THEN y END), 0)::bigint AS s FROM facts GROUP BY p, gt")
def a1(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("p", "gt").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("ball") == 1, F.col("y"))), F.lit(0)).alias("s"))


@register("a5_count_pivot", f"WITH {FACTS} SELECT p, season, count(*) FILTER (gt = 'R') AS R, count(*) FILTER (gt = 'F') AS F, coalesce(sum(y) FILTER (gt = 'R'), 0)::bigint AS R_sum, coalesce(sum(y) FILTER (gt = 'F'), 0)::bigint AS F_sum FROM facts GROUP BY p, season")
def a5(spark, sf_dir):
    wide = facts(spark, sf_dir).groupBy("p", "season").pivot("gt", ["R", "F"]).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    return wide.select("p", "season", *[F.coalesce(f"{d}_n", F.lit(0)).alias(d) for d in "RF"], *[F.coalesce(f"{d}_s", F.lit(0)).alias(f"{d}_sum") for d in "RF"])


@register("a7_dominant_team", f"WITH {FACTS} SELECT b, season, pteam AS team, n FROM (SELECT b, season, pteam, count(*) AS n FROM facts GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY b, season ORDER BY n DESC, pteam) = 1")
def a7(spark, sf_dir):
    counts = facts(spark, sf_dir).groupBy("b", "season", "pteam").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "pteam"))
    return counts.groupBy("b", "season").agg(best.alias("x")).select("b", "season", F.col("x.pteam").alias("team"), (-F.col("x.m")).alias("n"))


@register("a8_named_aggregates", f"WITH {FACTS} SELECT season, gt, count(*) AS n, {r9('avg(y)', 'mean')}, max(score) AS high, min(score) AS low, count(*) FILTER (score < 0) AS wins FROM facts GROUP BY season, gt")
def a8(spark, sf_dir):
    out = facts(spark, sf_dir).groupBy("season", "gt").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.max("score").alias("high"), F.min("score").alias("low"), F.count_if(F.col("score") < 0).alias("wins"))
    return rounded(out, *out.columns, keys=[])


@register("a9_weighted_mean", f"WITH {SCORED}, f AS (SELECT season, gt, avg((y - direct) * (y - direct)) AS b, CASE WHEN gt = 'R' THEN 0.7 ELSE 0.3 END AS w FROM scored GROUP BY season, gt) SELECT season, {r9('sum(w * b) / sum(CASE WHEN b IS NOT NULL THEN w END)', 'weighted')}, {r9('sqrt(greatest(sum(w * b * b) / sum(w) - (sum(w * b) / sum(w)) * (sum(w * b) / sum(w)), 0))', 'weighted_std')} FROM f GROUP BY season")
def a9(spark, sf_dir):
    f = scored(spark, sf_dir).groupBy("season", "gt").agg(M.brier(F.col("y"), F.col("direct")).alias("b"))
    w = F.when(F.col("b").isNotNull(), F.when(F.col("gt") == "R", 0.7).otherwise(0.3))
    mean = F.sum(w * F.col("b")) / F.sum(w)
    out = f.groupBy("season").agg(mean.alias("weighted"), F.sqrt(F.greatest(F.sum(w * F.col("b") * F.col("b")) / F.sum(w) - mean * mean, F.lit(0.0))).alias("weighted_std"))
    return rounded(out, *out.columns, keys=[])


@register("a11_distinct_counts", f"WITH {FACTS} SELECT count(DISTINCT season) AS seasons, count(DISTINCT p) AS entities, count(DISTINCT b) AS others, count(DISTINCT CASE WHEN outs > 0 THEN outs END) + max((outs = 0)::int) AS outs_with_null FROM facts")
def a11(spark, sf_dir):
    known = F.when(F.col("outs") > 0, F.col("outs"))
    return facts(spark, sf_dir).agg(F.count_distinct("season").alias("seasons"), F.count_distinct("p").alias("entities"), F.count_distinct("b").alias("others"), (F.count_distinct(known) + F.max(known.isNull().cast("int"))).alias("outs_with_null"))


@register("a12_quantile_edges", f"WITH {RATED}, q AS (SELECT quantile_cont(p_y_rate, [0.0, 1/6, 2/6, 3/6, 4/6, 5/6, 1.0]) AS e, quantile_cont(p_n, 0.5) AS median_n, quantile_cont(p_n, 0.95) AS p95_n FROM rated) SELECT i::int AS edge, {r9('e[i + 1]', 'value')}, {r9('median_n', 'median_n')}, {r9('p95_n', 'p95_n')} FROM q, range(7) t(i)")
def a12(spark, sf_dir):
    df = rated(spark, sf_dir)
    n = exact_quantiles(df, "p_n", [0.5, 0.95]).select(F.get("quantiles", F.lit(0)).alias("median_n"), F.get("quantiles", F.lit(1)).alias("p95_n"))
    q = exact_quantiles(df, "p_y_rate", [i / 6 for i in range(7)]).withColumnRenamed("quantiles", "e").join(n)  # a row each
    return rounded(q.select(F.posexplode("e").alias("edge", "value"), "median_n", "p95_n"), "edge", "value", "median_n", "p95_n", keys=[])


@register("a14_group_mean_table", f"""WITH {FACTS}, c AS (SELECT *, CASE WHEN y = 1 THEN 0 WHEN reverse = 0 AND middle = 0 THEN 1 WHEN reverse = 1 AND middle = 0 THEN 2 WHEN reverse = 0 AND middle = 1 THEN 3 ELSE 4 END AS class FROM facts),
g AS (SELECT * FROM (VALUES ('R'), ('F')) d(gt), (VALUES (0), (1), (2), (3), (4), (5)) k(class)), m AS (SELECT gt, class, avg(ball) AS m FROM c GROUP BY 1, 2), dm AS (SELECT gt, avg(ball) AS m FROM c GROUP BY 1)
SELECT g.gt, g.class, {r9('coalesce(m.m, dm.m, (SELECT avg(ball) FROM c))', 'mean')} FROM g LEFT JOIN m ON g.gt = m.gt AND g.class = m.class LEFT JOIN dm ON g.gt = dm.gt""")
def a14(spark, sf_dir):
    c = facts(spark, sf_dir).withColumn("class", R.outcome_class(F.col("y"), F.col("reverse"), F.col("middle")))
    # A cell for each domain and class; two domains, six classes.
    grid = spark.createDataFrame([(d, k) for d in "RF" for k in range(6)], "gt string, class int")
    each = c.groupBy("gt", "class").agg(F.sum("ball").alias("s"), F.count("*").alias("n"))
    domain = each.groupBy("gt").agg((F.sum("s") / F.sum("n")).alias("dm"))
    whole = each.agg((F.sum("s") / F.sum("n")).alias("all"))
    out = grid.join(each, ["gt", "class"], "left").join(domain, "gt", "left").join(whole)
    return rounded(out.select("gt", "class", F.coalesce(F.try_divide("s", "n"), "dm", "all").alias("mean")), "gt", "class", "mean", keys=[])


@register("a15_group_bias", f"WITH {SCORED}, g AS (SELECT season, inning, count(*) AS n, avg(y - direct) AS r FROM scored GROUP BY 1, 2 HAVING count(*) >= 20), b AS (SELECT avg(y - direct) AS b FROM scored) SELECT count(*) AS used, {r9('sqrt(sum(n * (r - b) * (r - b)) / sum(n))', 'bias_rmse')} FROM g, b")
def a15(spark, sf_dir):
    e = scored(spark, sf_dir).groupBy("season", "inning").agg(F.count("*").alias("n"), F.sum(F.col("y") - F.col("direct")).alias("s"))
    bias = e.agg((F.sum("s") / F.sum("n")).alias("b"))  # one row
    d = F.col("s") / F.col("n") - F.col("b")
    out = e.where("n >= 20").join(bias).agg(F.count("*").alias("used"), F.sqrt(F.sum(F.col("n") * d * d) / F.sum("n")).alias("bias_rmse"))
    return rounded(out, *out.columns, keys=[])


_AUC = "(sum(rank * pos) FILTER (true) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(m) - sum(pos)))"


def _metrics_sql(by: str) -> str:
    g, comma = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    part = f"PARTITION BY {by} " if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""WITH {SCORED}, one AS (SELECT {comma}count(*) AS n, avg((y - direct) * (y - direct)) AS brier, avg(y) * (1 - avg(y)) AS reference, avg(direct) AS mean, stddev_pop(direct) AS std FROM scored {g}),
v AS (SELECT {comma}direct, count(*) AS m, sum(y) AS pos FROM scored GROUP BY {comma}direct), k AS (SELECT *, coalesce(sum(m) OVER ({part}ORDER BY direct ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (m + 1) / 2 AS rank FROM v),
a AS (SELECT {comma}{_AUC} AS auc FROM k {g})
SELECT {comma}n, {r9('brier', 'brier')}, {r9('reference', 'reference')}, {r9('1 - brier / reference', 'skill')}, round(1e5 * (1 - brier / reference), 4) + 0.0 AS raw_score, round(greatest(1e5 * (1 - brier / reference), 0), 4) + 0.0 AS score, {r9('mean', 'mean')}, {r9('std', 'std')}, {r9('auc', 'auc')} FROM one JOIN a {on}"""


def _rounded_metrics(df):
    return rounded(df.withColumns({c: F.round(c, 4) for c in ("raw_score", "score")}), *df.columns, keys=[])


@register("a16_scalar_metrics", f"WITH {SCORED} SELECT {r9('avg((y - direct) * (y - direct))', 'brier')}, {r9('avg(direct)', 'mean')}, {r9('stddev_pop(direct)', 'std')}, {r9('min(direct)', 'low')}, {r9('max(direct)', 'high')} FROM scored")
def a16(spark, sf_dir):
    out = scored(spark, sf_dir).agg(M.brier(F.col("y"), F.col("direct")).alias("brier"), F.avg("direct").alias("mean"), F.stddev_pop("direct").alias("std"), F.min("direct").alias("low"), F.max("direct").alias("high"))
    return rounded(out, *out.columns, keys=[])


@register("a17_probability_metrics", _metrics_sql(""))
def a17(spark, sf_dir):
    return _rounded_metrics(M.probability_metrics(scored(spark, sf_dir), "y", "direct"))


@register("w1_auc_by_domain", _metrics_sql("gt"))
def w1(spark, sf_dir):
    return _rounded_metrics(M.probability_metrics(scored(spark, sf_dir), "y", "direct", ["gt"]))


_C = "greatest(least(direct, 1 - 1e-7), 1e-7)"


@register("a18_binary_metrics", f"WITH {SCORED} SELECT gt, {r9(f'avg((y - {_C}) * (y - {_C}))', 'brier')}, {r9(f'-avg(y * ln({_C}) + (1 - y) * ln(1 - {_C}))', 'logloss')} FROM scored GROUP BY gt")
def a18(spark, sf_dir):
    out = scored(spark, sf_dir).groupBy("gt").agg(*[c.alias(n) for n, c in M.binary_metrics(F.col("y"), F.col("direct")).items()])
    return rounded(out, *out.columns, keys=[])


@register("a19_vector_delta", f"WITH {SCORED} SELECT {r9('avg(abs(direct - other))', 'mae')}, {r9('sqrt(avg((direct - other) * (direct - other)))', 'rmse')}, {r9('max(abs(direct - other))', 'max')} FROM scored")
def a19(spark, sf_dir):
    out = scored(spark, sf_dir).agg(*[c.alias(n) for n, c in M.delta_metrics(F.col("direct"), F.col("other")).items()])
    return rounded(out, *out.columns, keys=[])


@register("a20_grouped_evaluation", f"WITH {SCORED} SELECT coalesce(gt, 'ALL') AS grouping, count(*) AS n, {r9('avg((y - direct) * (y - direct))', 'brier')}, {r9('avg((y - direct) * (y - direct)) - avg((y - other) * (y - other))', 'delta')} FROM scored GROUP BY GROUPING SETS ((), (gt))")
def a20(spark, sf_dir):
    b = {c: M.brier(F.col("y"), F.col(c)) for c in ("direct", "other")}
    out = scored(spark, sf_dir).groupingSets([[], [F.col("gt")]], "gt").agg(F.count("*").alias("n"), b["direct"].alias("brier"), (b["direct"] - b["other"]).alias("delta"))
    return rounded(out.select(F.coalesce("gt", F.lit("ALL")).alias("grouping"), "n", "brier", "delta"), "grouping", "n", "brier", "delta", keys=[])


_INVERT = f"""{RATED}, t AS (SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN p_y_rate END AS p_y_rate) FROM rated),
s AS (SELECT *, coalesce(p_n = lag(p_n) OVER w + 1, false) AS step, p_n * coalesce(p_y_rate, CASE WHEN p_n = 0 THEN 0.0 END) AS hits FROM t WINDOW w AS (PARTITION BY p ORDER BY p_n, {_ORDER})),
g AS (SELECT *, round_even(hits, 0) AS whole, coalesce(abs(hits - round_even(hits, 0)) <= 0.05, false) AS ok, sum((NOT step)::int) OVER (PARTITION BY p ORDER BY p_n, {_ORDER} ROWS UNBOUNDED PRECEDING) AS segment FROM s),
e AS (SELECT *, CASE WHEN step AND ok AND lag(ok) OVER w AND whole - lag(whole) OVER w IN (0, 1) THEN whole - lag(whole) OVER w END AS previous, lag(y) OVER w AS truth FROM g WINDOW w AS (PARTITION BY p ORDER BY p_n, {_ORDER}))"""


def gapped(spark, sf_dir):
    """All rows, a part of them without a known rate: gaps in the sequences."""
    df = rated(spark, sf_dir).withColumn("p_y_rate", F.when(F.col("l_linenumber") != 3, F.col("p_y_rate")))
    return bound(df.select(*dict.fromkeys([*ROW, *ORDER, "p", "p_n", "p_y_rate", "y"])))


@register("w8_prefix_inversion", f"WITH {_INVERT} SELECT {ROW_SQL}, r.segment::bigint AS segment, r.previous, " + ", ".join(f"lag(r.previous, {k - 1}) OVER v AS lag{k}" for k in (2, 3, 4, 5)) + ", " + ", ".join(f"round(avg(r.previous) OVER (PARTITION BY p, segment ORDER BY p_n, {_ORDER} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 9) + 0.0 AS mean{k}" for k in (2, 3, 5, 10, 20, 30, 50)) + f" FROM e r WINDOW v AS (PARTITION BY p, segment ORDER BY p_n, {_ORDER})")
def w8(spark, sf_dir):
    out = invert_prefix(gapped(spark, sf_dir), "p", "p_n", "p_y_rate", ORDER)
    return rounded(out, "segment", "previous", *[f"lag{k}" for k in (2, 3, 4, 5)], *[f"mean{k}" for k in (2, 3, 5, 10, 20, 30, 50)])


@register("a21_reconstruction_audit", f"WITH {_INVERT} SELECT coalesce(season::varchar, 'ALL') AS season, count(*) FILTER (step) AS eligible, count(previous) AS used, {r9('count(previous) / nullif(count(*) FILTER (step), 0)', 'coverage')}, count(*) FILTER (previous = truth) AS exact, {r9('count(*) FILTER (previous = truth) / nullif(count(previous), 0)', 'accuracy')} FROM e GROUP BY ROLLUP (season)")
def a21(spark, sf_dir):
    df = gapped(spark, sf_dir)
    inverted = invert_prefix(df, "p", "p_n", "p_y_rate", ORDER, windows=())
    was = scanned(inverted, ["p"], stretch("p_n"), ["p_n", *ORDER], Scan(lags={"_was": (F.struct(F.col("y").alias("truth"), F.col("p_n").alias("n")), 1)}), large_entities(df, "p"), df)
    out = was.withColumns({"truth": F.col("_was.truth"), "step": F.coalesce(F.col("p_n") == F.col("_was.n") + 1, F.lit(False))})
    exact = F.count_if(F.col("previous") == F.col("truth"))
    out = out.rollup("season").agg(F.count_if("step").alias("eligible"), F.count("previous").alias("used"), F.try_divide(F.count("previous"), F.count_if("step")).alias("coverage"), exact.alias("exact"), F.try_divide(exact, F.count("previous")).alias("accuracy"))
    out = out.withColumn("season", F.coalesce(F.col("season").cast("string"), F.lit("ALL")))
    return rounded(out, *out.columns, keys=[])


@register("w9_forward_inversion", f"WITH {RATED}, h AS (SELECT *, round_even(p_n * coalesce(p_middle_rate, CASE WHEN p_n = 0 THEN 0.0 END), 0) AS h FROM rated) SELECT {ROW_SQL}, CASE WHEN lead(p_n) OVER w = p_n + 1 AND lead(h) OVER w - h IN (0, 1) THEN lead(h) OVER w - h END AS event, CASE WHEN count(y) OVER w3 = 3 THEN round(avg(y) OVER w3, 9) + 0.0 END AS prev3 FROM h r WINDOW w AS (PARTITION BY p ORDER BY p_n, {_ORDER}), w3 AS (PARTITION BY p ORDER BY p_n, {_ORDER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def w9(spark, sf_dir):
    df = bound(rated(spark, sf_dir).select(*dict.fromkeys([*ROW, *ORDER, "p", "p_n", "p_middle_rate", "y"])))
    out = own_event(df, "p", "p_n", "p_middle_rate", ORDER, "event")
    out = scanned(out, ["p"], stretch("p_n"), ["p_n", *ORDER], Scan(recent={"_last": (F.col("y"), 3)}), large_entities(df, "p"), df)
    return rounded(out.withColumn("prev3", F.when(F.col("_last.n") == 3, F.col("_last.mean"))), "event", "prev3")


@register("w10_latest_row", f"WITH {RATED} SELECT p, season, p_n, {r9('p_y_rate', 'p_y_rate')} FROM rated QUALIFY row_number() OVER (PARTITION BY p, season ORDER BY p_n DESC) = 1")
def w10(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("p", "season").orderBy(F.desc("p_n")))
    return rounded(rated(spark, sf_dir).withColumn("_n", nth).where("_n = 1"), "p", "season", "p_n", "p_y_rate", keys=[])


@register("w11_first_known", f"WITH {FACTS} SELECT p, season, first(CASE WHEN outs > 0 THEN outs END ORDER BY {_ORDER}) FILTER (outs > 0) AS outs, first(gt ORDER BY {_ORDER}) AS gt FROM facts GROUP BY p, season")
def w11(spark, sf_dir):
    by = F.struct(*ORDER)
    known = F.col("outs") > 0
    return facts(spark, sf_dir).groupBy("p", "season").agg(F.min_by("outs", F.when(known, by)).alias("outs"), F.min_by("gt", by).alias("gt"))


@register("w13_duplicate_flag", f"WITH {FACTS}, d AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM facts GROUP BY ALL) SELECT l_orderkey, l_linenumber, n > 1 AS duplicated, n FROM d")
def w13(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg((F.count("*") > 1).alias("duplicated"), F.count("*").alias("n"))


@register("a22_anchor_shares", f"WITH {RATED} SELECT season, count(*) AS n, {r9('avg((p_n > 0)::int)', 'seen_share')}, {r9('avg((p_y_rate IS NOT NULL)::int)', 'rate_share')}, {r9('quantile_cont(p_n, 0.5)', 'median_n')} FROM rated GROUP BY season")
def a22(spark, sf_dir):
    share = lambda c: F.avg(c.cast("int"))
    df = rated(spark, sf_dir)
    out = df.groupBy("season").agg(F.count("*").alias("n"), share(F.col("p_n") > 0).alias("seen_share"), share(F.col("p_y_rate").isNotNull()).alias("rate_share"))
    median = exact_quantiles(df, "p_n", [0.5], by=["season"]).select("season", F.get("quantiles", F.lit(0)).alias("median_n"))
    out = out.join(median, "season", "left")
    return rounded(out, *out.columns, keys=[])


@register("a25_manifest", f"WITH {FACTS} SELECT season, count(*) AS n, {r9('avg(y)', 'target_mean')}, {r9("avg((gt = 'F')::int)", 'f_share')}, {r9("avg(CASE WHEN gt = 'F' THEN y END) - avg(CASE WHEN gt = 'R' THEN y END)", 'gap')} FROM facts GROUP BY season")
def a25(spark, sf_dir):
    rate = lambda d: F.avg(F.when(F.col("gt") == d, F.col("y")))
    out = facts(spark, sf_dir).groupBy("season").agg(F.count("*").alias("n"), F.avg("y").alias("target_mean"), F.avg((F.col("gt") == "F").cast("int")).alias("f_share"), (rate("F") - rate("R")).alias("gap"))
    return rounded(out, *out.columns, keys=[])


@register("a26_robust_scale", f"WITH {RATED}, q AS (SELECT quantile_cont(p_y_rate, 0.5) AS m, quantile_cont(coalesce(p_y_rate, (SELECT quantile_cont(p_y_rate, 0.5) FROM rated)), 0.05) AS lo, quantile_cont(coalesce(p_y_rate, (SELECT quantile_cont(p_y_rate, 0.5) FROM rated)), 0.95) AS hi FROM rated) SELECT {ROW_SQL}, {r9('greatest(least((coalesce(p_y_rate, m) - m) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 10), -10)', 'scaled')}, (p_y_rate IS NULL)::int AS missing FROM rated r, q")
def a26(spark, sf_dir):
    from tidemark.operators.scaling import RobustScaler

    df = rated(spark, sf_dir)
    out = RobustScaler.fit(df, ["p_y_rate"]).transform(df)
    return rounded(out, "scaled", "missing") if "scaled" in out.columns else rounded(out.withColumnsRenamed({"p_y_rate_scaled": "scaled", "p_y_rate_missing": "missing"}), "scaled", "missing")


@register("a27_category_index", "WITH d AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) AS i FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey < 20)) SELECT c_custkey, coalesce(i, 0)::int AS code FROM customer LEFT JOIN d USING (c_mktsegment)")
def a27(spark, sf_dir):
    from tidemark.operators.scaling import category_index, with_category

    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return with_category(df, category_index(df.where("c_nationkey < 20"), "c_mktsegment"), "c_mktsegment", "code").select("c_custkey", "code")


@register("e1_domain_blend", f"WITH {SCORED}, w AS (SELECT gt, CASE WHEN sum((other - direct) * (other - direct)) > 0 THEN greatest(least(sum((other - direct) * (y - direct)) / sum((other - direct) * (other - direct)), 1), 0) ELSE 0 END AS w FROM scored GROUP BY gt) SELECT {ROW_SQL}, {r9('direct + w * (other - direct)', 'blend')} FROM scored r JOIN w ON r.gt = w.gt")
def e1(spark, sf_dir):
    df = scored(spark, sf_dir)
    return rounded(E.blend(df, E.blend_weights(df, "y", "direct", "other", "gt"), "direct", "other", "gt"), "blend")


@register("e2_gram_moments", f"WITH {SCORED} SELECT gt, " + ", ".join(r9(f"sum({a} * {b})", f"m_{a}_{b}") for i, a in enumerate(("direct", "other", "third")) for b in ("direct", "other", "third")[i:]) + ", " + ", ".join(r9(f"sum({a} * y)", f"m_{a}_y") for a in ("direct", "other", "third")) + " FROM scored GROUP BY gt")
def e2(spark, sf_dir):
    names = ("direct", "other", "third")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"m_{a}_{b}") for i, a in enumerate(names) for b in (*names[i:], "y")]
    out = scored(spark, sf_dir).groupBy("gt").agg(*sums)
    return rounded(out, *out.columns, keys=[])


def simplex_sql(name: str, source: str, a: str, b: str, c: str) -> str:
    """CTEs that end in name(gt, p, q): p of a, q of b and the rest of c have the least squared error; the best of the
    inner solution and the three edges (whose ends are the corners)."""
    u, v, t = f"({a} - {c})", f"({b} - {c})", f"(y - {c})"
    edge = lambda n, d: f"greatest(least(({n}) / nullif({d}, 0), 1), 0)"
    last = edge("vv - uv + tu - tv", "uu - 2 * uv + vv")
    return f"""{name}_m AS (SELECT gt, sum({u} * {u}) AS uu, sum({u} * {v}) AS uv, sum({v} * {v}) AS vv, sum({t} * {u}) AS tu, sum({t} * {v}) AS tv FROM {source} GROUP BY gt),
{name}_k AS (SELECT m.*, e, CASE e WHEN 0 THEN (tu * vv - tv * uv) / nullif(uu * vv - uv * uv, 0) WHEN 1 THEN {edge('tu', 'uu')} WHEN 2 THEN 0 ELSE {last} END AS p,
  CASE e WHEN 0 THEN (tv * uu - tu * uv) / nullif(uu * vv - uv * uv, 0) WHEN 1 THEN 0 WHEN 2 THEN {edge('tv', 'vv')} ELSE 1 - {last} END AS q FROM {name}_m m, range(4) r(e)),
{name}_l AS (SELECT *, p * p * uu + 2 * p * q * uv + q * q * vv - 2 * p * tu - 2 * q * tv AS loss FROM {name}_k WHERE p >= 0 AND q >= 0 AND p + q <= 1),
{name} AS (SELECT gt, arg_min(p, loss) AS p, arg_min(q, loss) AS q FROM {name}_l GROUP BY gt)"""


@register("e3_simplex_blend", f"WITH {SCORED}, {simplex_sql('w', 'scored', 'direct', 'other', 'third')} SELECT {ROW_SQL}, round(w.p * direct + w.q * other + (1 - w.p - w.q) * third, 6) + 0.0 AS blend FROM scored r JOIN w ON r.gt = w.gt")
def e3(spark, sf_dir):
    out, _ = E.simplex_blend(scored(spark, sf_dir), "y", ["direct", "other", "third"], "gt")
    return rounded(out, "blend", digits=6)


@register("e7_alpha_grid", f"WITH {SCORED}, a AS (SELECT i / 20 AS alpha FROM range(21) t(i)) SELECT {r9('alpha', 'alpha')}, {r9('avg((y - (alpha * direct + (1 - alpha) * other)) * (y - (alpha * direct + (1 - alpha) * other)))', 'brier')} FROM scored, a GROUP BY alpha")
def e7(spark, sf_dir):
    """The score is quadratic in alpha: three moments of the rows give the whole grid."""
    d, e = F.col("direct") - F.col("other"), F.col("y") - F.col("other")
    m = scored(spark, sf_dir).agg(F.avg(e * e).alias("a"), F.avg(d * e).alias("b"), F.avg(d * d).alias("c"))
    alpha = F.col("i") / 20
    grid = m.select(F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"), "a", "b", "c")
    return rounded(grid.select(alpha.alias("alpha"), (F.col("a") - 2 * alpha * F.col("b") + alpha * alpha * F.col("c")).alias("brier")), "alpha", "brier", keys=[])


@register("m10_mixed_predictor", f"WITH {SCORED}, r AS (SELECT *, coalesce(p_reverse_rate, 0.1) AS rv, coalesce(p_middle_rate, 0.1) AS md FROM scored), g AS (SELECT *, greatest(least(1 - rv - md - 1.2 * rv * md, 1), 0) AS ind FROM r) SELECT {ROW_SQL}, {r9('ind', 'independent')}, {r9('0.4 * ind + 0.6 * third', 'gate')}, {r9('(0.4 * ind + 0.6 * third) * other', 'logic')} FROM g r")
def m10(spark, sf_dir):
    df = scored(spark, sf_dir)
    known = lambda c: F.coalesce(c, F.lit(0.1))
    parts = E.mixed(F.col("direct"), known("p_reverse_rate"), known("p_middle_rate"), F.col("third"), F.col("other"))
    return rounded(df.select("*", *[c.alias(n) for n, c in parts.items()]), *parts)


@register("o5_top_rows", f"WITH {SCORED} SELECT season, inning, gt, {r9('avg((y - direct) * (y - direct))', 'brier')} FROM scored GROUP BY ALL ORDER BY round(avg((y - direct) * (y - direct)), 9), season, inning, gt LIMIT 15")
def o5(spark, sf_dir):
    b = scored(spark, sf_dir).groupBy("season", "inning", "gt").agg(F.round(M.brier(F.col("y"), F.col("direct")), 9).alias("brier"))
    return b.orderBy("brier", "season", "inning", "gt").limit(15)


@register("u1_union_by_name", f"WITH {FACTS} SELECT p, season, y, NULL::varchar AS half FROM facts WHERE season < 1998 UNION ALL SELECT p, season, NULL::int, half FROM facts WHERE season >= 1998")
def u1(spark, sf_dir):
    df = facts(spark, sf_dir)
    return df.where("season < 1998").select("p", "season", "y").unionByName(df.where("season >= 1998").select("season", "p", "half"), allowMissingColumns=True)


@register("u4_keep_last", f"WITH {FACTS} SELECT b, season, l_orderkey, l_linenumber, l_partkey FROM facts QUALIFY row_number() OVER (PARTITION BY b, season ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1")
def u4(spark, sf_dir):
    by = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return facts(spark, sf_dir).groupBy("b", "season").agg(F.max(by).alias("x")).select("b", "season", "x.l_orderkey", "x.l_linenumber", "x.l_partkey")


@register("j13_pending_work", f"WITH {FACTS} SELECT season, inning FROM (SELECT DISTINCT a.season, b.inning FROM facts a, (SELECT DISTINCT inning FROM facts) b) k WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.season = k.season AND f.inning = k.inning AND f.y = 1 AND f.score > 20 AND f.gt = 'F' AND f.outs = 1 AND f.strikes = 0)")
def j13(spark, sf_dir):
    df = facts(spark, sf_dir)
    # Periods times months: bounded by the calendar, not by rows.
    planned = df.select("season").distinct().select("season", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("inning"))
    planned = planned.join(df.select("inning").distinct(), "inning", "left_semi")
    done = df.where("y = 1 and score > 20 and gt = 'F' and outs = 1 and strikes = 0").select("season", "inning").distinct()
    return planned.join(done, ["season", "inning"], "left_anti").select("season", "inning")


@register("j5_reference_merge", f"WITH {SCORED}, b AS (SELECT season, gt, avg((y - direct) * (y - direct)) AS brier FROM scored GROUP BY 1, 2), ref AS (SELECT season, brier AS ref FROM b WHERE gt = 'R' AND season % 2 = 0) SELECT b.season, b.gt, {r9('b.brier', 'brier')}, {r9('b.brier - ref.ref', 'delta')} FROM b LEFT JOIN ref ON b.season = ref.season")
def j5(spark, sf_dir):
    b = scored(spark, sf_dir).groupBy("season", "gt").agg(M.brier(F.col("y"), F.col("direct")).alias("brier"))
    ref = b.where("gt = 'R' and season % 2 = 0").select("season", F.col("brier").alias("ref"))
    return rounded(b.join(ref, "season", "left").withColumn("delta", F.col("brier") - F.col("ref")), "season", "gt", "brier", "delta", keys=[])


@register("a18_quality_metrics", "SELECT toxic, count(*) AS n, round(avg(quality), 9) + 0.0 AS rate, round(avg((quality - 0.5) * (quality - 0.5)), 9) + 0.0 AS brier FROM labels GROUP BY toxic")
def x9(spark, sf_dir):
    out = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("toxic").agg(F.count("*").alias("n"), F.avg("quality").alias("rate"), M.brier(F.col("quality"), F.lit(0.5)).alias("brier"))
    return rounded(out, *out.columns, keys=[])
