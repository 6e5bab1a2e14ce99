"""Row-local derivations (P1 to P29), and checks of rows and frames (V1 to V14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rowlocal as R
from tidemark.operators.ranges import exact_quantiles
from tidemark.plans.common import FACTS, RATED, ROW_SQL, facts, r9, rated, rounded
from tidemark.plans.frozen_queries import anchor_sql, anchored, anchored_facts
from tidemark.plans.registry import register
from tidemark.sources.io import require_domain


def _with(df: DataFrame, columns: dict) -> DataFrame:
    return rounded(df.select("*", *[c.alias(n) for n, c in columns.items()]), *columns)


@register("p1_win_expectancy", f"WITH {FACTS} SELECT {ROW_SQL}, {r9("CASE WHEN half = 'O' THEN home_we ELSE 1 - home_we END", 'pitching_we')} FROM facts r")
def p1(spark, sf_dir):
    return _with(facts(spark, sf_dir), {"pitching_we": F.when(F.col("half") == "O", F.col("home_we")).otherwise(1 - F.col("home_we"))})


def _block_sql(t: str) -> dict[str, str]:
    c = {"long": f"p_{t}_rate", **{f"prev{k}": f"p_prev{k}_{t}" for k in (1, 3, 5)}}
    out = {f"{a}_minus_{b}": f"{c[a]} - {c[b]}" for a, b in (("prev1", "long"), ("prev3", "long"), ("prev5", "long"), ("prev1", "prev3"), ("prev3", "prev5"), ("prev1", "prev5"))}
    r = [c[f"prev{k}"] for k in (1, 3, 5)]
    mean = f"({' + '.join(r)}) / 3"
    some = " OR ".join(f"{x} IS NULL" for x in r)
    return out | {"mean3": mean, "mean3_minus_long": f"{mean} - {c['long']}", "range3": f"CASE WHEN {some} THEN NULL ELSE greatest({', '.join(r)}) - least({', '.join(r)}) END"}


def _block(t: str):
    return R.recent_block(f"p_{t}_rate", f"p_prev1_{t}", f"p_prev3_{t}", f"p_prev5_{t}")


for _name, _t in (("p2_recent_success", "y"), ("p3_recent_middle", "middle")):
    register(_name, f"WITH {RATED} SELECT {ROW_SQL}, {', '.join(r9(e, n) for n, e in _block_sql(_t).items())} FROM rated r")(lambda spark, sf_dir, t=_t: _with(rated(spark, sf_dir), _block(t)))

_GAPS = {f"{h}_{t}": (f"p_{t}_rate" if h == "long" else f"p_{h}_{t}", f"b_{t}_rate") for t in ("y", "middle") for h in ("long", "prev1", "prev3", "prev5")}


@register("p4_entity_gaps", f"WITH {RATED} SELECT {ROW_SQL}, {', '.join(r9(f'{a} - {b}', 'gap_' + n) for n, (a, b) in _GAPS.items())}, {r9('(p_prev1_y + p_prev3_y + p_prev5_y) / 3 - b_y_rate', 'gap_mean_y')} FROM rated r")
def p4(spark, sf_dir):
    columns = {f"gap_{n}": F.col(a) - F.col(b) for n, (a, b) in _GAPS.items()}
    return _with(rated(spark, sf_dir), columns | {"gap_mean_y": _block("y")["mean3"] - F.col("b_y_rate")})


_GATED = ["prev1_minus_long", "prev3_minus_long", "prev5_minus_long", "mean3_minus_long", "prev1_minus_prev5"]


@register("p5_experience_gate", f"WITH {RATED} SELECT {ROW_SQL}, {r9('p_n / (p_n + 2000.0)', 'w')}, {', '.join(r9(f'({_block_sql(t)[n]}) * (p_n / (p_n + 2000.0))', f'{t}_{n}_w') for t in ('y', 'middle') for n in _GATED)} FROM rated r")
def p5(spark, sf_dir):
    w = R.experience("p_n")
    return _with(rated(spark, sf_dir), {"w": w} | {f"{t}_{n}_w": _block(t)[n] * w for t in ("y", "middle") for n in _GATED})


_CROSSES = {"x1": ("balls", "strikes"), "x2": ("balls", "strikes", "bhand"), "x3": ("phand", "bhand"), "x4": ("inning", "half"), "x5": ("gt", "phand", "bhand"), "x6": ("r1", "r2", "r3", "outs_if")}


@register("p6_context_crosses", f"WITH {FACTS}, r AS (SELECT *, CASE WHEN outs > 0 THEN outs END AS outs_if FROM facts) SELECT {ROW_SQL}, " + ", ".join(" || '|' || ".join(f"coalesce({c}::varchar, '<MISSING>')" for c in cs) + f" AS {n}" for n, cs in _CROSSES.items()) + " FROM r")
def p6(spark, sf_dir):
    return _with(facts(spark, sf_dir).withColumn("outs_if", F.when(F.col("outs") > 0, F.col("outs"))), {n: R.cross(*cs) for n, cs in _CROSSES.items()})


@register("p7_canonical_context", f"WITH {FACTS} SELECT {ROW_SQL}, balls * 3 + strikes AS count_state, r1 + 2 * r2 + 4 * r3 AS base_code, inning::varchar || '|' || lower(trim(half)) AS game_phase, coalesce(nullif(score, 0), balls + strikes) AS run_total FROM facts r")
def p7(spark, sf_dir):
    flag = lambda c: F.greatest(F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(1)), F.lit(0))
    return _with(facts(spark, sf_dir), {"count_state": F.col("balls") * 3 + F.col("strikes"), "base_code": flag("r1") + 2 * flag("r2") + 4 * flag("r3"), "game_phase": F.concat(F.col("inning").cast("string"), F.lit("|"), R.token(F.col("half"))), "run_total": F.coalesce(F.nullif("score", F.lit(0)), F.col("balls") + F.col("strikes"))})


@register("p8_tokens", "SELECT c_custkey, coalesce(lower(trim(c_mktsegment)), '<missing>') AS segment, coalesce(lower(trim(CASE WHEN c_nationkey > 5 THEN c_name END)), '<missing>') AS name FROM customer")
def p8(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", R.token(F.col("c_mktsegment")).alias("segment"), R.token(F.when(F.col("c_nationkey") > 5, F.col("c_name"))).alias("name"))


@register("p9_domain_token", "SELECT o_orderkey, upper(trim(o_orderpriority)) AS domain FROM orders")
def p9(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.upper(F.trim("o_orderpriority")).alias("domain"))


_SIDE = "CASE WHEN half = 'F' THEN score WHEN half = 'O' THEN -score ELSE score + 1 END"


@register("p10_side_inference", f"""WITH {FACTS}, t AS (SELECT half, avg((abs(score - other) <= 1e-8 + 1e-5 * abs(other))::int) AS same, avg((abs(score + other) <= 1e-8 + 1e-5 * abs(other))::int) AS opposite, count(*) AS n
  FROM (SELECT half, score, {_SIDE} AS other FROM facts) WHERE score IS NOT NULL AND other IS NOT NULL AND score <> 0 GROUP BY half)
SELECT half, n, {r9('same', 'same_share')}, {r9('opposite', 'opposite_share')}, CASE WHEN n < 20 OR greatest(same, opposite) < 0.8 THEN NULL WHEN same >= opposite THEN 'home' ELSE 'away' END AS side FROM t""")
def p10(spark, sf_dir):
    other = F.when(F.col("half") == "F", F.col("score")).when(F.col("half") == "O", -F.col("score")).otherwise(F.col("score") + 1)
    near = lambda x: F.avg((F.abs(x) <= 1e-8 + 1e-5 * F.abs("other")).cast("int"))
    rows = facts(spark, sf_dir).select("half", "score", other.alias("other")).where("score is not null and other is not null and score != 0")
    by = rows.groupBy("half").agg(F.count("*").alias("n"), near(F.col("score") - F.col("other")).alias("same_share"), near(F.col("score") + F.col("other")).alias("opposite_share"))
    side = F.when((F.col("n") < 20) | (F.greatest("same_share", "opposite_share") < 0.8), None).when(F.col("same_share") >= F.col("opposite_share"), "home").otherwise("away")
    return rounded(by.withColumn("side", side), "half", "n", "same_share", "opposite_share", "side", keys=[])


_RECENT = 1998
_MASKS = {f"{era}_{hand}": (era, hand) for era in ("recent", "old") for hand in ("L", "R")}


@register("p11_regime_masks", f"WITH {RATED} SELECT {ROW_SQL}, " + ", ".join(r9(f"CASE WHEN gt = 'R' AND season {'>=' if e == 'recent' else '<'} {_RECENT} AND bhand = '{h}' THEN p_fast_rate END", "fast_" + n) for n, (e, h) in _MASKS.items()) + f", {r9(f"CASE WHEN gt = 'R' AND season >= {_RECENT} THEN {_block_sql('y')['range3']} END", 'range_recent')}, {r9(f"CASE WHEN gt = 'R' AND season < {_RECENT} THEN {_block_sql('y')['range3']} END", 'range_old')} FROM rated r")
def p11(spark, sf_dir):
    """Hands are L and R, or it raises (V3): a third one would have no column."""
    df = facts(spark, sf_dir)
    require_domain(df, "bhand", ["L", "R"])
    return _regimes(rated(spark, sf_dir), ["L", "R"])


@register("p12_frozen_hands", f"WITH {RATED} SELECT {ROW_SQL}, " + ", ".join(r9(f"CASE WHEN gt = 'R' AND season {'>=' if e == 'recent' else '<'} {_RECENT} AND bhand = '{h}' THEN p_fast_rate END", f"fast_{e}_{h}") for e in ("recent", "old") for h in ("R", "S")) + f", {r9(f"CASE WHEN gt = 'R' AND season >= {_RECENT} THEN {_block_sql('y')['range3']} END", 'range_recent')}, {r9(f"CASE WHEN gt = 'R' AND season < {_RECENT} THEN {_block_sql('y')['range3']} END", 'range_old')} FROM rated r")
def p12(spark, sf_dir):
    """The levels of hands are given; a level that the table lacks has a column of nulls."""
    return _regimes(rated(spark, sf_dir), ["R", "S"])


def _regimes(df, hands):
    era = {"recent": F.col("season") >= _RECENT, "old": F.col("season") < _RECENT}
    fast = {f"fast_{e}_{h}": F.when((F.col("gt") == "R") & era[e] & (F.col("bhand") == h), F.col("p_fast_rate")) for e in era for h in hands}
    return _with(df, fast | {f"range_{e}": F.when((F.col("gt") == "R") & era[e], _block("y")["range3"]) for e in era})


_EDGES = "list_distinct(list_sort(quantile_cont(p_fast_rate, [0.0, 1/6, 2/6, 3/6, 4/6, 5/6, 1.0])))"


@register("p13_regime_cross", f"""WITH {RATED}, e AS (SELECT quantile_cont(p_fast_rate, [0.0, 1/6, 2/6, 3/6, 4/6, 5/6, 1.0]) AS q FROM rated)
SELECT {ROW_SQL}, CASE WHEN gt <> 'R' THEN 'NON_R' ELSE (CASE WHEN season >= {_RECENT} THEN 'RECENT' ELSE 'OLD' END) || '_R|H=' || bhand || '|FAST=' || CASE WHEN p_fast_rate IS NULL THEN 'MISS' ELSE 'Q' || len(list_filter(q[2:6], lambda x: round(x, 12) <= round(p_fast_rate, 12))) END END AS regime_cross FROM rated r, e""")
def p13(spark, sf_dir):
    df = rated(spark, sf_dir)
    edges = exact_quantiles(df, "p_fast_rate", [i / 6 for i in range(7)]).withColumnRenamed("quantiles", "q")
    # One row of seven numbers.
    df = df.join(edges)
    code = R.quantile_code(F.round("p_fast_rate", 12), F.transform("q", lambda x: F.round(x, 12)))
    era = F.when(F.col("season") >= _RECENT, "RECENT").otherwise("OLD")
    fast = F.when(code < 0, "MISS").otherwise(F.concat(F.lit("Q"), code.cast("string")))
    return _with(df, {"regime_cross": F.when(F.col("gt") != "R", "NON_R").otherwise(F.concat(era, F.lit("_R|H="), "bhand", F.lit("|FAST="), fast))})


@register("p14_temporal_pair", f"WITH {FACTS} SELECT {ROW_SQL}, (season >= {_RECENT} AND gt = 'F')::int AS recent_f, gt || CASE WHEN season >= {_RECENT} THEN '_RECENT' ELSE '_OLD' END AS gt_regime FROM facts r")
def p14(spark, sf_dir):
    recent = F.col("season") >= _RECENT
    return _with(facts(spark, sf_dir), {"recent_f": (recent & (F.col("gt") == "F")).cast("int"), "gt_regime": F.concat("gt", F.when(recent, "_RECENT").otherwise("_OLD"))})


def _anchored(spark, sf_dir):
    return anchored_facts(spark, sf_dir, {"p": (_LABELS, 0.05), "b": (["y", "middle"], None)})


_LABELS = ["y", "reverse", "middle", "ball", "strike"]


def _p15_sql() -> str:
    s = lambda e, t: f"((coalesce({e}anchor_gap_n, 0) * coalesce({e}anchor_{t}_since, {e}_{t}_rate) + 100 * {e}_{t}_rate) / (coalesce({e}anchor_gap_n, 0) + 100))"
    one = lambda e, labels, tol: anchor_sql(e, labels, tol).replace("SELECT " + ROW_SQL, "SELECT r.*", 1)
    keys = "l_orderkey l_linenumber l_partkey l_quantity l_extendedprice l_shipdate".split()
    columns = {"x_y_diff": f"{s('p', 'y')} - {s('b', 'y')}", "x_middle_diff": f"{s('p', 'middle')} - {s('b', 'middle')}", "x_gap_ratio": "ln(1 + coalesce(panchor_gap_n, 0)) - ln(1 + coalesce(banchor_gap_n, 0))", **{f"x_{t}": s("p", t) for t in _LABELS[1:]}, "x_valid_proxy": f"(1 - {s('p', 'reverse')}) * (1 - {s('p', 'middle')})"}
    b = ", ".join(f"b.{c}" for c in ("banchor_gap_n", "banchor_y_since", "banchor_middle_since"))
    return f"WITH a AS ({one('p', _LABELS, 0.05)}), b AS ({one('b', ['y', 'middle'], None)}), r AS (SELECT a.*, {b} FROM a JOIN b ON {' AND '.join(f'a.{k} = b.{k}' for k in keys)} AND a.b = b.b AND a.p_n = b.p_n) SELECT {ROW_SQL}, {', '.join(r9(e, n) for n, e in columns.items())} FROM r"


@register("p15_anchor_cross", _p15_sql())
def p15(spark, sf_dir):
    df = _anchored(spark, sf_dir)
    s = {f"{e}_{t}": R.shrunk(F.col(f"{e}anchor_gap_n"), F.round(f"{e}anchor_{t}_since", 9), F.col(f"{e}_{t}_rate")) for e, ts in (("p", _LABELS), ("b", ["y", "middle"])) for t in ts}
    gap = lambda e: F.log1p(F.coalesce(f"{e}anchor_gap_n", F.lit(0)))
    columns = {"x_y_diff": s["p_y"] - s["b_y"], "x_middle_diff": s["p_middle"] - s["b_middle"], "x_gap_ratio": gap("p") - gap("b")}
    return _with(df, columns | {f"x_{t}": s[f"p_{t}"] for t in _LABELS[1:]} | {"x_valid_proxy": (1 - s["p_reverse"]) * (1 - s["p_middle"])})


@register("p16_season_basis", f"WITH a AS ({anchor_sql('p', ['y', 'reverse', 'middle', 'ball', 'strike'], 0.05).replace('SELECT ' + ROW_SQL, 'SELECT r.*', 1)}) SELECT {ROW_SQL}, " + ", ".join(r9(f"(coalesce(panchor_gap_n, 0) * coalesce(panchor_y_since, p_y_rate) + {k} * p_y_rate) / (coalesce(panchor_gap_n, 0) + {k})", f"eb_{k}") for k in (10, 30, 100, 300)) + f", {r9('ln(1 + coalesce(panchor_gap_n, 0))', 'log_support')}, " + r9("-(" + " + ".join(f"CASE WHEN p_{t}_rate IS NULL THEN 0 ELSE greatest(least(p_{t}_rate, 1.0), 1e-6) * ln(greatest(least(p_{t}_rate, 1.0), 1e-6)) END" for t in ("reverse", "middle", "ball", "strike")) + ")", "aux_entropy") + " FROM a r")
def p16(spark, sf_dir):
    df = anchored(rated(spark, sf_dir), "p", ["y", "reverse", "middle", "ball", "strike"], 0.05)
    gap, since, long = F.col("panchor_gap_n"), F.round("panchor_y_since", 9), F.col("p_y_rate")
    columns = {f"eb_{k}": R.shrunk(gap, since, long, k) for k in (10, 30, 100, 300)}
    return _with(df, columns | {"log_support": F.log1p(F.coalesce(gap, F.lit(0))), "aux_entropy": R.entropy(*[F.col(f"p_{t}_rate") for t in ("reverse", "middle", "ball", "strike")])})


@register("p17_anchor_form", f"WITH a AS ({anchor_sql('p', ['y', 'middle'], 0.05).replace('SELECT ' + ROW_SQL, 'SELECT r.*', 1)}) SELECT {ROW_SQL}, " + ", ".join(r9(f"panchor_{t}_since - p_prev{k}_{t}", f"form_{t}_{k}") for t in ("y", "middle") for k in (1, 3, 5)) + " FROM a r")
def p17(spark, sf_dir):
    df = anchored(rated(spark, sf_dir), "p", ["y", "middle"], 0.05)
    return _with(df, {f"form_{t}_{k}": F.round(F.col(f"panchor_{t}_since"), 9) - F.col(f"p_prev{k}_{t}") for t in ("y", "middle") for k in (1, 3, 5)})


_BEST = "CASE WHEN f >= k AND f >= o THEN 'F' WHEN k >= o THEN 'B' ELSE 'O' END"


@register("p18_arsenal", f"WITH {RATED}, r AS (SELECT *, coalesce(p_fast_rate, -1) AS f, coalesce(p_breaking_rate, -1) AS k, coalesce(p_offspeed_rate, -1) AS o FROM rated) SELECT {ROW_SQL}, {_BEST} AS arsenal, {_BEST} || '|' || balls || '-' || strikes AS arsenal_count, {_BEST} || '|' || bhand AS arsenal_hand FROM r")
def p18(spark, sf_dir):
    best = R.first_largest({"F": F.col("p_fast_rate"), "B": F.col("p_breaking_rate"), "O": F.col("p_offspeed_rate")})
    return _with(rated(spark, sf_dir), {"arsenal": best, "arsenal_count": F.concat(best, F.lit("|"), F.concat_ws("-", "balls", "strikes")), "arsenal_hand": F.concat(best, F.lit("|"), "bhand")})


@register("p19_buckets", f"WITH {FACTS} SELECT {ROW_SQL}, greatest(least(score, 3), -3) AS score_bucket, CASE WHEN li IS NULL THEN -1 WHEN li <= 0.5 THEN 0 WHEN li <= 1 THEN 1 WHEN li <= 2 THEN 2 WHEN li <= 4 THEN 3 ELSE 4 END AS li_bucket FROM facts r")
def p19(spark, sf_dir):
    return _with(facts(spark, sf_dir), {"score_bucket": F.greatest(F.least("score", F.lit(3)), F.lit(-3)), "li_bucket": R.cut_right(F.col("li"), [0.5, 1.0, 2.0, 4.0])})


@register("p20_model_matrix", f"WITH {RATED} SELECT {ROW_SQL}, coalesce(bhand, '<MISSING>') AS bhand, coalesce(balls::varchar, '<MISSING>') AS balls, p_y_rate::float::double AS p_y_rate, CASE WHEN isinf(li / nullif(outs, 0)) THEN NULL ELSE li / nullif(outs, 0) END::float::double AS ratio FROM rated r")
def p20(spark, sf_dir):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(R.MISSING))
    number = lambda c: F.when(F.abs(c) == float("inf"), None).otherwise(c).try_cast("float").cast("double")
    ratio = F.try_divide(F.col("li"), F.col("outs").cast("double"))
    return rated(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "season", text("bhand").alias("bhand"), text("balls").alias("balls"), number(F.col("p_y_rate")).alias("p_y_rate"), number(ratio).alias("ratio"))


def _prior_sql() -> str:
    long = "coalesce((p_n * p_y_rate + 200 * mean) / (p_n + 200), mean)"
    known = " + ".join(f"coalesce(p_prev{k}_y, 0)" for k in (1, 3, 5))
    recent = f"coalesce(({known}) / nullif({' + '.join(f'(p_prev{k}_y IS NOT NULL)::int' for k in (1, 3, 5))}, 0), mean)"
    other = "coalesce(b_y_rate, mean)"
    base = f"(0.65 * {long} + 0.25 * {recent} + 0.10 * {other})"
    modes = {"flat": "mean", "pitch": long, "both": f"0.75 * {long} + 0.25 * {other}", "recent": base, "domain": f"CASE WHEN gt = 'F' THEN 0.5 * {long} + 0.4 * {recent} + 0.1 * {other} ELSE 0.5 * {long} + 0.3 * {recent} + 0.2 * {other} END"}
    return f"WITH {RATED}, r AS (SELECT *, (SELECT avg(y) FROM facts) AS mean FROM rated) SELECT {ROW_SQL}, {', '.join(r9(e, 'prior_' + n) for n, e in modes.items())} FROM r"


@register("p21_priors", _prior_sql())
def p21(spark, sf_dir):
    df = rated(spark, sf_dir)
    mean = facts(spark, sf_dir).agg(F.avg("y").alias("mean"))  # one row
    return _with(df.join(mean), {f"prior_{m}": R.prior(m) for m in ("flat", "pitch", "both", "recent", "domain")})


@register("p22_outcome_class", f"WITH {FACTS} SELECT {ROW_SQL}, CASE WHEN y = 1 THEN 0 WHEN reverse = 0 AND middle = 0 THEN 1 WHEN reverse = 1 AND middle = 0 THEN 2 WHEN reverse = 0 AND middle = 1 THEN 3 ELSE 4 END AS class FROM facts r")
def p22(spark, sf_dir):
    return _with(facts(spark, sf_dir), {"class": R.outcome_class(F.col("y"), F.col("reverse"), F.col("middle"))})


@register("p23_joint_code", f"WITH {FACTS}, r AS (SELECT *, reverse + 2 * middle + 4 * ball + 8 * strike AS code FROM facts), d AS (SELECT code, dense_rank() OVER (ORDER BY code) - 1 AS class FROM (SELECT DISTINCT code FROM r)) SELECT {ROW_SQL}, r.code, d.class::int AS class FROM r JOIN d ON r.code = d.code")
def p23(spark, sf_dir):
    from pyspark.sql import Window

    df = facts(spark, sf_dir).withColumn("code", R.bits(*[F.col(c) for c in ("reverse", "middle", "ball", "strike")]))
    codes = df.select("code").distinct().withColumn("class", (F.dense_rank().over(Window.orderBy("code")) - 1).cast("int"))  # 16 rows at most
    return rounded(df.join(codes, "code"), "code", "class")


@register("p24_weights_and_labels", f"WITH {FACTS} SELECT {ROW_SQL}, CASE WHEN gt = 'F' THEN 2.0::double ELSE 1.0::double END AS w_domain, CASE WHEN gt = 'F' AND season < {_RECENT} THEN 0.5::double ELSE 1.0::double END AS w_old, 8 * y + reverse + middle + ball + strike AS label_sum FROM facts r")
def p24(spark, sf_dir):
    f = F.col("gt") == "F"
    labels = F.concat(F.array_repeat("y", 8), F.array("reverse", "middle", "ball", "strike"))
    return _with(facts(spark, sf_dir), {"w_domain": F.when(f, 2.0).otherwise(1.0), "w_old": F.when(f & (F.col("season") < _RECENT), 0.5).otherwise(1.0), "label_sum": F.aggregate(labels, F.lit(0), lambda a, x: a + x)})


@register("p28_log_counts", f"WITH {RATED} SELECT {ROW_SQL}, {r9('ln(1 + p_n)', 'p_n')}, {r9('ln(1 + b_n)', 'b_n')}, {r9('p_y_rate', 'p_y_rate')} FROM rated r")
def p28(spark, sf_dir):
    import re

    df = rated(spark, sf_dir)
    counts = [c for c in df.columns if re.search(r"(^|_)n$|_count$", c)]
    return rounded(df.withColumns({c: F.when(F.col(c) < 0, F.raise_error(F.lit(f"negative {c}"))).otherwise(F.log1p(c)) for c in counts}), *counts, "p_y_rate")


_CANDIDATES = ["p_y_rate", "p_prev1_y", "b_y_rate", "p_n", "l_discount"]


@register("p29_history_columns", f"WITH {RATED} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS known, count(DISTINCT {c}) AS kinds, (count({c}) > 0 AND count(DISTINCT {c}) > 1) AS keep FROM rated" for c in [*_CANDIDATES, "nothing", "constant"]).replace("count(nothing)", "count(NULL)").replace("DISTINCT nothing", "DISTINCT NULL").replace("count(constant)", "count(1)").replace("DISTINCT constant", "DISTINCT 1"))
def p29(spark, sf_dir):
    df = rated(spark, sf_dir).select(*_CANDIDATES, F.lit(None).cast("int").alias("nothing"), F.lit(1).alias("constant"))
    one = df.agg(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("known"), F.count_distinct(c).alias("kinds")).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*df.columns)).alias("x")).select("x.*", ((F.col("x.known") > 0) & (F.col("x.kinds") > 1)).alias("keep"))


_RULES = {
    "run_total": ("r1 + r2 + r3 <> balls", "r1 + r2 + r3 != balls"),
    "parity": ("score % 2 <> outs % 2", "score % 2 != outs % 2"),
    "counts": ("balls NOT BETWEEN 0 AND 3", "balls not between 0 and 3"),
    "strikes": ("strikes NOT BETWEEN 0 AND 2", "strikes not between 0 and 2"),
    "domain": ("gt NOT IN ('R', 'F')", "gt not in ('R', 'F')"),
    "label": ("y IS NULL OR y NOT IN (0, 1)", "y is null or y not in (0, 1)"),
}


@register("v5_invariants", f"WITH {FACTS} SELECT {', '.join(f'count(*) FILTER ({s}) AS {n}' for n, (s, _) in _RULES.items())}, {r9('max(abs(home_we + (1 - home_we) - 1))', 'we_gap')} FROM facts")
def v5(spark, sf_dir):
    """All violations in one pass."""
    return rounded(facts(spark, sf_dir).agg(*[F.count_if(F.expr(e)).alias(n) for n, (_, e) in _RULES.items()], F.max(F.abs(F.col("home_we") + (1 - F.col("home_we")) - 1)).alias("we_gap")), *_RULES, "we_gap", keys=[])


@register("v6_valid_counts", f"WITH {RATED} SELECT season, count(*) FILTER (p_n * p_y_rate IS NOT NULL AND abs(p_n * p_y_rate - round_even(p_n * p_y_rate, 0)) <= 0.05) AS valid, count(*) AS n FROM rated GROUP BY season")
def v6(spark, sf_dir):
    return rated(spark, sf_dir).groupBy("season").agg(F.count_if(R.near_integer(F.col("p_n") * F.col("p_y_rate"))).alias("valid"), F.count("*").alias("n"))


@register("v11_fold_masks", f"WITH {FACTS}, f(fold, v, c) AS (VALUES ('forward_2000', 2000, 0), ('forward_2001', 2001, 0), ('within_2001', 2001, 6)) SELECT fold, count(*) FILTER (season < v OR (c > 0 AND season = v AND inning <= c)) AS train, count(*) FILTER (season >= v - 2 AND (season < v OR (c > 0 AND season = v AND inning <= c))) AS recent, count(*) FILTER (season = v AND inning > c) AS valid FROM facts, f GROUP BY fold")
def v11(spark, sf_dir):
    folds = spark.createDataFrame([("forward_2000", 2000, 0), ("forward_2001", 2001, 0), ("within_2001", 2001, 6)], "fold string, v int, c int")
    df = facts(spark, sf_dir).groupBy("season", "inning").count().join(folds)  # three folds
    train = (F.col("season") < F.col("v")) | ((F.col("c") > 0) & (F.col("season") == F.col("v")) & (F.col("inning") <= F.col("c")))
    total = lambda m: F.coalesce(F.sum(F.when(m, F.col("count"))), F.lit(0))
    return df.groupBy("fold").agg(total(train).alias("train"), total(train & (F.col("season") >= F.col("v") - 2)).alias("recent"), total((F.col("season") == F.col("v")) & (F.col("inning") > F.col("c"))).alias("valid"))
