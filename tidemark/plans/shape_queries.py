"""Order and position (O, P27, J10), unions and names (U), alignment (J7 to J10), checks (V) and preparation (P21 to P31, X)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import rowlocal as R
from tidemark.operators import checks as C
from tidemark.operators.ranges import bound, positions
from tidemark.operators.scans import Scan, large_entities, scanned
from tidemark.plans.common import FACTS, RATED, ROW, ROW_SQL, facts, r9, rated, rounded
from tidemark.plans.frozen_queries import anchor_sql, anchored
from tidemark.plans.registry import register
from tidemark.plans.stats_queries import SCORED, scored
from tidemark.sources.facts import ORDER, day
from tidemark.sources.io import require_predictions

_ORDER = ", ".join(ORDER)
_ROW = ", ".join(ROW)


@register("o1_stable_sort", f"WITH {FACTS} SELECT {ROW_SQL}, row_number() OVER (ORDER BY season, inning, {_ORDER}) - 1 AS position FROM facts r ORDER BY position")
def o1(spark, sf_dir):
    out = positions(facts(spark, sf_dir).select(*dict.fromkeys([*ROW, "inning", *ORDER])), ["season", "inning", *ORDER], "position")
    return out.orderBy("position").select(*ROW, "position")


@register("o2_default_sort", f"WITH {FACTS} SELECT {ROW_SQL}, inning FROM facts r ORDER BY season, inning, {_ORDER}")
def o2(spark, sf_dir):
    return facts(spark, sf_dir).orderBy("season", "inning", *ORDER).select(*ROW, "inning")


@register("o3_restore_order", f"WITH {RATED}, k AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS position FROM rated) SELECT {ROW_SQL}, position, lag(y) OVER (PARTITION BY b ORDER BY position DESC) AS following FROM k r ORDER BY position")
def o3(spark, sf_dir):
    """Rows are numbered, worked on in another order, and put back by number."""
    out = positions(facts(spark, sf_dir).select(*dict.fromkeys([*ROW, "b", "y", *ORDER])), ORDER, "position")
    out = out.withColumn("following", F.lag("y").over(Window.partitionBy("b").orderBy(F.desc("position"))))
    return out.orderBy("position").select(*ROW, "position", "following")


@register("o4_mixed_sort", f"WITH {FACTS}, g AS (SELECT season, inning, gt, count(*) AS n, CASE WHEN count(*) % 3 <> 0 THEN round(avg(y), 9) END AS rate FROM facts GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY rate DESC NULLS LAST, n, season DESC, inning, gt) - 1 AS position FROM g ORDER BY position")
def o4(spark, sf_dir):
    g = facts(spark, sf_dir).groupBy("season", "inning", "gt").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    g = g.withColumn("rate", F.when(F.col("n") % 3 != 0, F.round("rate", 9)))
    return positions(g, [F.col("rate").desc_nulls_last(), F.col("n"), F.col("season").desc(), F.col("inning"), F.col("gt")], "position").orderBy("position")


@register("o6_first_least", f"WITH {SCORED}, a AS (SELECT i, i / 20 AS alpha FROM range(21) t(i)), g AS (SELECT gt, i, round(avg((y - (alpha * direct + (1 - alpha) * other)) * (y - (alpha * direct + (1 - alpha) * other))), 6) AS brier FROM scored, a GROUP BY gt, i) SELECT gt, i::int AS i, brier FROM g QUALIFY row_number() OVER (PARTITION BY gt ORDER BY brier, i) = 1")
def o6(spark, sf_dir):
    d, e = F.col("direct") - F.col("other"), F.col("y") - F.col("other")
    m = scored(spark, sf_dir).groupBy("gt").agg(F.avg(e * e).alias("a"), F.avg(d * e).alias("b"), F.avg(d * d).alias("c"))
    alpha = F.col("i") / 20
    grid = m.select("gt", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"), "a", "b", "c")
    grid = grid.select("gt", "i", F.round(F.col("a") - 2 * alpha * F.col("b") + alpha * alpha * F.col("c"), 6).alias("brier"))
    # Of equal scores the first of the grid wins.
    return grid.groupBy("gt").agg(F.min(F.struct("brier", "i")).alias("x")).select("gt", "x.i", "x.brier")


@register("u2_union_same_schema", f"WITH {FACTS} SELECT {ROW_SQL}, 'train' AS part FROM facts r WHERE season < 1998 UNION ALL SELECT {ROW_SQL}, 'valid' FROM facts r WHERE season >= 1998")
def u2(spark, sf_dir):
    df = facts(spark, sf_dir).select(*ROW)
    return df.where("season < 1998").withColumn("part", F.lit("train")).union(df.where("season >= 1998").withColumn("part", F.lit("valid")))


@register("u3_column_bind", f"WITH {SCORED} SELECT {ROW_SQL}, {r9('direct', 'c0')}, {r9('other', 'c1')}, {r9('third', 'c2')}, {r9('0.5 * direct + 0.3 * other + 0.2 * third', 'weighted')} FROM scored r")
def u3(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("columns", F.array("direct", "other", "third"))
    product = F.zip_with("columns", F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), lambda c, w: c * w)
    df = df.withColumns({**{f"c{i}": F.get("columns", F.lit(i)) for i in range(3)}, "weighted": F.aggregate(product, F.lit(0.0), lambda a, x: a + x)})
    return rounded(df, "c0", "c1", "c2", "weighted")


@register("u5_distinct_values", f"WITH {FACTS} SELECT DISTINCT season, gt, half FROM facts")
def u5(spark, sf_dir):
    return facts(spark, sf_dir).select("season", "gt", "half").distinct()


@register("u6_name_sets", """WITH n AS (SELECT table_name AS t, regexp_replace(column_name, '^[a-z]+_', '') AS name FROM information_schema.columns WHERE table_name IN ('customer', 'supplier'))
SELECT name, bool_or(t = 'customer') AS in_customer, bool_or(t = 'supplier') AS in_supplier, CASE WHEN count(DISTINCT t) = 2 THEN 'both' WHEN bool_or(t = 'customer') THEN 'customer only' ELSE 'supplier only' END AS place FROM n GROUP BY name""")
def u6(spark, sf_dir):
    """Names that the rows of two tables have, as rows: one aggregate over both."""
    def names(t):
        keys = F.json_object_keys(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        return spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.explode(keys).alias("name"), F.lit(t).alias("t"))

    both = names("customer").unionByName(names("supplier")).select(F.regexp_replace("name", "^[a-z]+_", "").alias("name"), "t")
    has = {t: F.bool_or(F.col("t") == t) for t in ("customer", "supplier")}
    found = both.groupBy("name").agg(*[c.alias(f"in_{t}") for t, c in has.items()])
    place = F.when(F.col("in_customer") & F.col("in_supplier"), "both").when(F.col("in_customer"), "customer only").otherwise("supplier only")
    return found.withColumn("place", place)


_FOLDS = "f(fold, v, c) AS (VALUES ('forward_2000', 2000, 0), ('forward_2001', 2001, 0), ('within_2001', 2001, 6), ('overlap', 1998, 3), ('empty', 1900, 0))"
_TRAIN, _VALID = "(season < v OR (c > 0 AND season = v AND inning <= c))", "(season = v AND (inning > c OR fold = 'overlap'))"


@register("v2_split_overlap", f"WITH {FACTS}, {_FOLDS}, k AS (SELECT fold, count(*) FILTER ({_TRAIN}) AS train, count(*) FILTER ({_VALID}) AS valid, count(*) FILTER ({_TRAIN} AND {_VALID}) AS overlap FROM facts, f GROUP BY fold) SELECT *, (overlap = 0 AND train > 0 AND valid > 0) AS good FROM k")
def v2(spark, sf_dir):
    def masks(v, c, overlap=False):
        season, inning = F.col("season"), F.col("inning")
        return (season < v) | (F.lit(c > 0) & (season == v) & (inning <= c)), (season == v) & ((inning > c) | F.lit(overlap))

    folds = {"forward_2000": masks(2000, 0), "forward_2001": masks(2001, 0), "within_2001": masks(2001, 6), "overlap": masks(1998, 3, overlap=True), "empty": masks(1900, 0)}
    return C.fold_overlaps(facts(spark, sf_dir), folds)


_STATE = {
    "run_top": "outs + r1",
    "run_bot": "strikes + r2",
    "run_total": "outs + r1 + strikes + r2 + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END",
    "score_diff": "strikes + r2 - outs - r1 + CASE WHEN l_linenumber = 6 THEN 2 ELSE 0 END",
    "half_t": "CASE WHEN half = 'O' THEN 'T' ELSE 'B' END",
    "pitcher_diff": "CASE WHEN half = 'O' THEN strikes + r2 - outs - r1 ELSE outs + r1 - strikes - r2 END",
    "base_state": "CASE WHEN l_linenumber = 5 AND ball = 1 THEN 'x' ELSE concat(CASE WHEN r1 = 1 THEN '1' ELSE '_' END, CASE WHEN r2 = 1 THEN '2' ELSE '_' END, CASE WHEN r3 = 1 AND l_linenumber <> 4 THEN '3' ELSE '_' END) END",
    "runners": "r1 + r2 + r3",
    "mix_n": "CASE WHEN l_linenumber = 2 THEN p_n + 1 ELSE p_n END",
    "away_we": "1 - home_we + l_tax / 1000",
}
_DECODED = [f"CASE WHEN substr(base_state, {i}, 1) = '{i}' THEN 1 ELSE 0 END" for i in (1, 2, 3)]
_LEGAL = "base_state IN (" + ", ".join(f"'{s}'" for s in C.BASE_STATES) + ")"


@register("v5_canonical_invariants", f"""WITH {RATED}, s AS (SELECT * EXCLUDE (half), {', '.join(f'{e} AS {n}' for n, e in _STATE.items())} FROM rated)
SELECT count(*) FILTER (run_total <> run_top + run_bot) AS run_total, count(*) FILTER (score_diff <> run_bot - run_top) AS score_diff, count(*) FILTER ((run_total + score_diff) % 2 <> 0) AS score_parity,
  count(*) FILTER (pitcher_diff <> CASE WHEN half_t = 'T' THEN score_diff ELSE -score_diff END) AS pitcher_diff, count(*) FILTER (NOT {_LEGAL}) AS unknown_base_state,
  {', '.join(f'count(*) FILTER ({_LEGAL} AND r{i} <> {_DECODED[i - 1]}) AS runner_{i}' for i in (1, 2, 3))}, count(*) FILTER ({_LEGAL} AND runners <> {' + '.join(_DECODED)}) AS runners,
  count(*) FILTER (mix_n <> p_n) AS mix_n, {r9('max(abs(home_we + away_we - 1))', 'we_gap')} FROM s""")
def v5_canonical(spark, sf_dir):
    """All ten rules in one pass; the stand-in columns break some of them on purpose."""
    df = rated(spark, sf_dir).selectExpr("*", *[f"{e} as {n}" for n, e in _STATE.items()]).drop("half").withColumnRenamed("half_t", "half")
    out = df.agg(*[c.alias(n) for n, c in C.state_invariants().items()])
    return rounded(out, *out.columns, keys=[])


@register("v7_complete_rows", f"WITH {RATED} SELECT {ROW_SQL} FROM rated r WHERE p_prev1_middle IS NOT NULL AND b_middle_rate IS NOT NULL AND p_y_rate IS NOT NULL")
def v7(spark, sf_dir):
    return C.complete(rated(spark, sf_dir), ["p_prev1_middle", "b_middle_rate", "p_y_rate"]).select(*ROW)


@register("v8_label_guards", "SELECT count(*) FILTER (quality IS NULL) AS quality_null, count(*) FILTER (quality NOT IN (0, 1)) AS quality_other, count(*) FILTER (toxic IS NULL) AS toxic_null, count(*) FILTER (toxic NOT IN (0, 1)) AS toxic_other, count(*) AS n FROM labels")
def v8(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    guard = [g for c in ("quality", "toxic") for g in (F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(~F.col(c).isin(0, 1)).alias(f"{c}_other"))]
    return rows.agg(*guard, F.count("*").alias("n"))


@register("v9_prediction_guards", f"WITH {SCORED}, k AS (SELECT l_orderkey, {_ORDER.replace('l_orderkey, ', '')}, direct FROM scored) SELECT l_orderkey, {r9('last(direct ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate)', 'direct')} FROM k GROUP BY l_orderkey")
def v9(spark, sf_dir):
    """Every wanted id has a finite prediction in [0, 1], or it raises; of repeated ids the last counts (J9)."""
    df = scored(spark, sf_dir)
    last = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("place")
    out = require_predictions(df.select("l_orderkey", "direct", last), df.select("l_orderkey").distinct(), "l_orderkey", "direct", version="place")
    return rounded(out, "l_orderkey", "direct", keys=[])


_HALVES = "h AS (SELECT p, b, count(*) AS n, sum(y)::bigint AS s, max(outs) FILTER (outs > 0) AS outs FROM facts WHERE season < 1997 GROUP BY ALL), u AS (SELECT p, b, count(*) AS n, sum(y)::bigint AS s, max(outs) FILTER (outs > 1) AS outs FROM facts WHERE season >= 1997 GROUP BY ALL)"


def _halves(spark, sf_dir):
    """Earlier and later rows by pair: most pairs are in one of the two only."""
    df = facts(spark, sf_dir)
    state = lambda rows, least: rows.groupBy("p", "b").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.max(F.when(F.col("outs") > least, F.col("outs"))).alias("outs"))
    return state(df.where("season < 1997"), 0), state(df.where("season >= 1997"), 1)


@register("j7_outer_add", f"WITH {FACTS}, {_HALVES} SELECT p, b, coalesce(h.n, 0) + coalesce(u.n, 0) AS n, coalesce(h.s, 0) + coalesce(u.s, 0) AS s FROM h FULL JOIN u USING (p, b)")
def j7(spark, sf_dir):
    """Two tables of counts added by key; a key that one lacks counts as 0 there."""
    old, new = _halves(spark, sf_dir)
    return old.unionByName(new).groupBy("p", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


@register("j8_combine_first", f"WITH {FACTS}, {_HALVES} SELECT p, b, coalesce(u.outs, h.outs) AS outs, u.n AS newest_n FROM h FULL JOIN u USING (p, b)")
def j8(spark, sf_dir):
    """The newest known value, else the old one."""
    old, new = _halves(spark, sf_dir)
    both = old.select("p", "b", F.col("outs").alias("old")).join(new.select("p", "b", F.col("outs").alias("new"), F.col("n").alias("newest_n")), ["p", "b"], "full")
    return both.select("p", "b", F.coalesce("new", "old").alias("outs"), "newest_n")


@register("j10_positional_alignment", f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS position FROM scored) SELECT position, {_ROW}, y AS y_left, y AS y_right, {r9('other - direct', 'change')} FROM k")
def j10(spark, sf_dir):
    """Two tables in one order joined by place, with the labels of both, which must agree."""
    df = bound(scored(spark, sf_dir).select(*dict.fromkeys([*ROW, *ORDER, "y", "direct", "other"])))
    left = positions(df.drop("other"), ORDER, "position").withColumnRenamed("y", "y_left")
    right = positions(df.select(*ORDER, "y", "other"), ORDER, "position").select("position", F.col("y").alias("y_right"), "other")
    both = left.join(right, "position", "full").withColumn("change", F.col("other") - F.col("direct"))
    return rounded(both, "position", *ROW, "y_left", "y_right", "change", keys=[])


_FRAMES = {k: f"OVER (PARTITION BY p ORDER BY {_ORDER} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (1, 3, 5)}


@register("w7_full_windows", f"WITH {FACTS} SELECT {ROW_SQL}, " + ", ".join(f"CASE WHEN count(y) {w} = {k} THEN round(avg(y) {w}, 9) + 0.0 END AS prev{k}" for k, w in _FRAMES.items()) + " FROM facts r")
def w7(spark, sf_dir):
    """Means of the last 1, 3 and 5 labels, null until there are so many."""
    scan = Scan(recent={f"_last{k}": (F.col("y"), k) for k in (1, 3, 5)})
    df = facts(spark, sf_dir)
    out = scanned(df, ["p"], day(), ORDER, scan, large_entities(df, "p"))
    full = {f"prev{k}": F.when(F.col(f"_last{k}.n") == k, F.col(f"_last{k}.mean")) for k in (1, 3, 5)}
    return rounded(out.withColumns(full), *full)


@register("a10_candidate_summary", f"""WITH {SCORED}, a AS (SELECT i, i / 10 AS alpha FROM range(11) t(i)), f AS (SELECT i, season, avg((y - (alpha * direct + (1 - alpha) * other)) * (y - (alpha * direct + (1 - alpha) * other))) AS brier, avg((y - other) * (y - other)) - avg((y - (alpha * direct + (1 - alpha) * other)) * (y - (alpha * direct + (1 - alpha) * other))) AS delta, (season - 1991)::double AS w FROM scored, a GROUP BY i, alpha, season),
m AS (SELECT i, sum(w * brier) / sum(w) AS brier, sum(w * delta) / sum(w) AS delta, max(brier) AS worst, min(delta) AS worst_delta, count(*) FILTER (round(delta, 9) > 0) AS improved, count(*) AS folds FROM f GROUP BY i)
SELECT m.i::int AS i, {r9('m.brier', 'brier')}, {r9('m.delta', 'delta')}, round((SELECT sqrt(greatest(sum(w * (f.brier - m.brier) * (f.brier - m.brier)) / sum(w), 0)) FROM f WHERE f.i = m.i), 7) + 0.0 AS std, {r9('worst', 'worst')}, {r9('worst_delta', 'worst_delta')}, improved, folds FROM m""")
def a10(spark, sf_dir):
    """Each candidate over its folds: weighted means and deviation, the worst fold, and how many folds it improves."""
    d, e, alpha = F.col("direct") - F.col("other"), F.col("y") - F.col("other"), F.col("i") / 10
    fold = scored(spark, sf_dir).groupBy("season").agg(F.avg(e * e).alias("a"), F.avg(d * e).alias("b"), F.avg(d * d).alias("c"))
    fold = fold.select("season", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("i"), "a", "b", "c")
    brier = F.col("a") - 2 * alpha * F.col("b") + alpha * alpha * F.col("c")
    fold = fold.select("i", (F.col("season") - 1991).cast("double").alias("w"), brier.alias("b"), (F.col("a") - brier).alias("d"))
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    means = fold.groupBy("i").agg(mean("b").alias("brier"), mean("d").alias("delta"), F.max("b").alias("worst"), F.min("d").alias("worst_delta"), F.count_if(F.round("d", 9) > 0).alias("improved"), F.count("*").alias("folds"))
    off = F.col("b") - F.col("brier")
    spread = fold.join(means.select("i", "brier"), "i").groupBy("i").agg(F.round(F.sqrt(F.greatest(F.sum(F.col("w") * off * off) / F.sum("w"), F.lit(0.0))), 7).alias("std"))
    out = means.join(spread, "i")
    return rounded(out, "i", "brier", "delta", "std", "worst", "worst_delta", "improved", "folds", keys=[])


def _season_sql() -> str:
    long = "coalesce((p_n * p_y_rate + 200 * mean) / (p_n + 200), mean)"
    known = " + ".join(f"coalesce(p_prev{k}_y, 0)" for k in (1, 3, 5))
    recent = f"coalesce(({known}) / nullif({' + '.join(f'(p_prev{k}_y IS NOT NULL)::int' for k in (1, 3, 5))}, 0), mean)"
    base = f"(0.65 * {long} + 0.25 * {recent} + 0.10 * coalesce(b_y_rate, mean))"
    inner = anchor_sql("p", ["y"], 0.05).replace(f"SELECT {ROW_SQL},", "SELECT r.*,", 1)
    k = "CASE WHEN gt = 'F' THEN 25.0 ELSE 100.0 END"
    return f"SELECT {ROW_SQL}, round((coalesce(panchor_gap_n, 0) * coalesce(panchor_y_since, {base}) + {k} * {base}) / (coalesce(panchor_gap_n, 0) + {k}), 8) + 0.0 AS prior_season FROM (SELECT t.*, (SELECT avg((l_returnflag = 'N')::int) FROM lineitem) AS mean FROM ({inner}) t) r"


@register("p21_season_prior", _season_sql())
def p21_season(spark, sf_dir):
    mean = facts(spark, sf_dir).agg(F.avg("y").alias("mean"))  # one row
    df = anchored(rated(spark, sf_dir), "p", ["y"], 0.05).withColumns({"gap": F.col("panchor_gap_n"), "since": F.round("panchor_y_since", 9)})
    return rounded(df.join(mean).withColumn("prior_season", R.prior("season")), "prior_season", digits=8)


@register("p25_replicated_labels", f"WITH {FACTS} SELECT {ROW_SQL}, concat_ws(',', {', '.join(['y'] * 8)}, reverse, middle, ball, strike) AS labels FROM facts r")
def p25(spark, sf_dir):
    labels = F.concat(F.array_repeat("y", 8), F.array("reverse", "middle", "ball", "strike"))
    return facts(spark, sf_dir).select(*ROW, F.array_join(labels.cast("array<string>"), ",").alias("labels"))


@register("p26_arranged_columns", "SELECT c_nationkey AS nation, c_custkey, c_name, c_mktsegment AS segment FROM customer")
def p26(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment")
    return C.arranged(df, first=["nation"], drop=["c_acctbal"], rename={"c_nationkey": "nation", "c_mktsegment": "segment"})


@register("p27_positional_id", f"WITH {FACTS} SELECT {ROW_SQL}, row_number() OVER (ORDER BY {_ORDER}) - 1 AS position FROM facts r")
def p27(spark, sf_dir):
    return positions(facts(spark, sf_dir).select(*dict.fromkeys([*ROW, *ORDER])), ORDER, "position").select(*ROW, "position")


_GROUPS = {"context": ["balls", "strikes", "outs"], "long": ["p_y_rate", "p_middle_rate", "b_y_rate"], "recent": ["p_prev1_y", "p_prev3_y", "p_prev5_y"]}
_SETS = {"canonical": (["context", "long"], []), "with_recent": (["context", "long", "recent"], []), "without_batter": (["context", "long", "recent"], ["b_y_rate"])}
_EXPECTED = {"canonical": (6, "p_y_rate IS NOT NULL AND p_middle_rate IS NOT NULL AND b_y_rate IS NOT NULL"), "with_recent": (9, "p_y_rate IS NOT NULL AND p_middle_rate IS NOT NULL AND b_y_rate IS NOT NULL AND p_prev1_y IS NOT NULL"), "without_batter": (8, "p_y_rate IS NOT NULL AND p_middle_rate IS NOT NULL AND p_prev1_y IS NOT NULL")}


@register("p30_feature_sets", f"WITH {RATED} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {k} AS features, count(*) FILTER ({c}) AS complete_rows FROM rated" for n, (k, c) in _EXPECTED.items()))
def p30(spark, sf_dir):
    df = rated(spark, sf_dir)
    lists = {n: C.feature_list(_GROUPS, take, drop) for n, (take, drop) in _SETS.items()}
    whole = lambda fs: F.count_if(F.forall(F.array(*[F.col(f).isNotNull() for f in fs]), lambda x: x))
    one = df.agg(*[F.struct(F.lit(n).alias("name"), F.lit(len(fs)).alias("features"), whole(fs).alias("complete_rows")).alias(n) for n, fs in lists.items()])
    return one.select(F.explode(F.array(*lists)).alias("x")).select("x.*")


@register("p31_inference_base", f"WITH {RATED}, k AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS position FROM rated) SELECT {_ROW}, position, NULL::int AS y, upper(trim(gt)) AS gt, {r9('p_prev1_y - p_y_rate', 'prev1_minus_long')}, {r9('p_n / (p_n + 2000.0)', 'w')} FROM k")
def p31(spark, sf_dir):
    """Rows to be scored: place, integer period, normal domain, the features of training, and no label."""
    df = positions(rated(spark, sf_dir).select(*dict.fromkeys([*ROW, *ORDER, "gt", "p_n", "p_y_rate", "p_prev1_y", "p_prev3_y", "p_prev5_y"])), ORDER, "position")
    new = {"season": F.col("season").cast("int"), "gt": F.upper(F.trim("gt")), "y": F.lit(None).cast("int"), "w": R.experience("p_n")}
    block = R.recent_block("p_y_rate", "p_prev1_y", "p_prev3_y", "p_prev5_y")
    return rounded(df.withColumn("prev1_minus_long", block["prev1_minus_long"]).withColumns(new), "position", "y", "gt", "prev1_minus_long", "w")


@register("x1_to_numeric", "SELECT c_custkey, try_cast(c_name AS DOUBLE) AS name, try_cast(substr(c_name, 10, 12) AS DOUBLE) AS code, CAST(c_nationkey::varchar AS DOUBLE) AS nation FROM customer")
def x1(spark, sf_dir):
    """Text as numbers: null where it is none (name, code), or an error (nation)."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return df.select("c_custkey", F.col("c_name").try_cast("double").alias("name"), F.substring("c_name", 10, 12).try_cast("double").alias("code"), F.col("c_nationkey").cast("string").cast("double").alias("nation"))


@register("x2_finite_values", f"WITH {RATED} SELECT {ROW_SQL}, {r9('coalesce(p_y_rate, 0.5)', 'filled')}, {r9('coalesce(p_y_rate, b_y_rate, 0)', 'by_row')}, CASE WHEN outs = 0 AND score > 0 THEN 'largest' WHEN outs = 0 AND score < 0 THEN 'smallest' WHEN outs = 0 THEN 'missing' ELSE 'plain' END AS kind FROM rated r")
def x2(spark, sf_dir):
    """Nulls and NaN filled by a number or by another column; infinities become the largest or smallest double."""
    inf = lambda x: F.lit(float(x))
    ratio = F.when(F.col("outs") != 0, F.col("score") / F.col("outs")).when(F.col("score") > 0, inf("inf")).when(F.col("score") < 0, inf("-inf")).otherwise(inf("nan"))
    value = C.finite(ratio, missing=-0.125)
    kind = F.when(value == 1.7976931348623157e308, "largest").when(value == -1.7976931348623157e308, "smallest").when(value == -0.125, "missing").otherwise("plain")
    df = rated(spark, sf_dir).withColumns({"filled": C.finite(F.col("p_y_rate").cast("double"), 0.5), "by_row": F.coalesce("p_y_rate", "b_y_rate", F.lit(0.0)), "kind": kind})
    return rounded(df, "filled", "by_row", "kind")


@register("a20_reconstruction_groups", f"WITH {SCORED}, k AS (SELECT *, CASE WHEN p_prev5_middle IS NULL THEN 'RECON_MISSING' ELSE 'RECON_AVAILABLE' END AS recon FROM scored), g AS (SELECT season, coalesce(gt, recon, 'ALL') AS grouping, count(*) AS n, avg((y - direct) * (y - direct)) AS brier, avg((y - other) * (y - other)) AS control FROM k GROUP BY GROUPING SETS ((season), (season, gt), (season, recon))) SELECT season, grouping, n, {r9('brier', 'brier')}, {r9('brier - control', 'delta')} FROM g")
def a20_groups(spark, sf_dir):
    """Scores of each fold over all rows, each domain, and rows with and without reconstructed state, against the control."""
    df = scored(spark, sf_dir).withColumn("recon", F.when(F.col("p_prev5_middle").isNull(), "RECON_MISSING").otherwise("RECON_AVAILABLE"))
    s, g, r = F.col("season"), F.col("gt"), F.col("recon")
    b = {c: M.brier(F.col("y"), F.col(c)) for c in ("direct", "other")}
    out = df.groupingSets([[s], [s, g], [s, r]], "season", "gt", "recon").agg(F.count("*").alias("n"), b["direct"].alias("brier"), (b["direct"] - b["other"]).alias("delta"))
    return rounded(out.select("season", F.coalesce("gt", "recon", F.lit("ALL")).alias("grouping"), "n", "brier", "delta"), "season", "grouping", "n", "brier", "delta", keys=[])
