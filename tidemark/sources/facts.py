"""The event table in its roles: entities p and b, period season, domain gt, label y and what goes with them.

The supplied order lines stand for events. Every operator works on roles, so another table needs another binding only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scans import FEW, Scan, large_entities, scanned

#: A row's identity and its total order.
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "season"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line, with context columns only: a scan of two tables and one join on the order."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER, "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    order = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    df = line.join(order, line["l_orderkey"] == order["o_orderkey"])
    flag = lambda c: F.when(c, 1).otherwise(0)
    bit = lambda k: F.shiftright("l_orderkey", k).bitwiseAND(F.lit(1)).cast("int")
    q = F.col("l_quantity").cast("int")
    return df.select(
        *ORDER,
        F.year("l_shipdate").alias("season"),
        F.month("l_shipdate").alias("inning"),
        F.col("l_suppkey").alias("p"),
        F.col("o_custkey").alias("b"),
        F.when(F.col("l_linestatus") == "O", "R").otherwise("F").alias("gt"),
        F.col("o_orderstatus").alias("half"),
        flag(F.col("l_returnflag") == "N").alias("y"),
        flag(F.col("l_discount") >= 0.09).alias("reverse"),
        flag(F.col("l_tax") >= 0.07).alias("middle"),
        flag(F.col("l_quantity") > 25).alias("ball"),
        flag(F.col("l_linenumber") % 2 == 0).alias("strike"),
        (F.col("l_linenumber") % 4).alias("balls"),
        (F.col("l_linenumber") % 3).alias("strikes"),
        (q % 3).alias("outs"),
        F.when(F.col("l_suppkey") % 2 == 0, "R").otherwise("L").alias("phand"),
        F.when(F.col("o_custkey") % 2 == 0, "R").otherwise("L").alias("bhand"),
        bit(0).alias("r1"),
        bit(1).alias("r2"),
        bit(2).alias("r3"),
        (F.col("l_suppkey") % 7).alias("pteam"),
        (F.col("o_custkey") % 7).alias("bteam"),
        (q - 25).alias("score"),
        (F.col("l_discount") * 50).alias("li"),
        (F.col("o_totalprice") / 500000).alias("home_we"),
        "l_discount",
        "l_tax",
    )


FACTS = """facts AS (SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, year(l_shipdate)::int AS season, month(l_shipdate)::int AS inning,
  l_suppkey AS p, o_custkey AS b, CASE WHEN l_linestatus = 'O' THEN 'R' ELSE 'F' END AS gt, o_orderstatus AS half,
  (l_returnflag = 'N')::int AS y, (l_discount >= 0.09)::int AS reverse, (l_tax >= 0.07)::int AS middle, (l_quantity > 25)::int AS ball, (l_linenumber % 2 = 0)::int AS strike,
  l_linenumber % 4 AS balls, l_linenumber % 3 AS strikes, trunc(l_quantity)::int % 3 AS outs,
  CASE WHEN l_suppkey % 2 = 0 THEN 'R' ELSE 'L' END AS phand, CASE WHEN o_custkey % 2 = 0 THEN 'R' ELSE 'L' END AS bhand,
  (l_orderkey & 1)::int AS r1, ((l_orderkey >> 1) & 1)::int AS r2, ((l_orderkey >> 2) & 1)::int AS r3, l_suppkey % 7 AS pteam, o_custkey % 7 AS bteam,
  trunc(l_quantity)::int - 25 AS score, l_discount * 50 AS li, o_totalprice / 500000 AS home_we, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

#: Rates that an event source supplies with each row: running means over the entity's earlier rows.
RATES = {"p": ["y", "reverse", "middle", "ball", "strike"], "b": ["y", "middle"]}


def _mix() -> dict[str, Column]:
    d = F.col("l_discount")
    return {"fast": F.when(d < 0.04, 1).otherwise(0), "breaking": F.when((d >= 0.04) & (d < 0.08), 1).otherwise(0), "offspeed": F.when(d >= 0.08, 1).otherwise(0)}


def day() -> Column:
    """The part of a large entity's order that one task holds."""
    return F.to_date("l_shipdate")


def large_of(df: DataFrame, few: int | None = None, most: int | None = None, entities: Iterable[str] = RATES) -> dict[str, Column | bool]:
    """Which rows' entities are too large for a task, for each entity; see scans.large_entities. most is a number that
    df's rows don't exceed, if one is known: under `few` there is nothing to count."""
    small = most is not None and most <= (FEW if few is None else few)
    return {e: False if small else large_entities(df, e, few) for e in entities}


def with_rates(df: DataFrame, few: int | None = None, most: int | None = None, large: dict[str, Column | bool] | None = None) -> DataFrame:
    """Adds {p,b}_n, {p,b}_{label}_rate, p_prev{1,3,5}_{y,middle}, and p_{fast,breaking,offspeed}_rate.

    An entity of more than `few` rows (scans.FEW) is many tasks' work: windows run within its days, and days carry
    totals on. large has what large_of says, if it is known, and names the entities (else both) whose columns are added.
    """
    large = large_of(df, few, most) if large is None else large
    out = df
    for e, labels in ((e, RATES[e]) for e in large):
        share = {f"{e}_{x}_rate": F.col(x) for x in labels} | ({f"p_{x}_rate": c for x, c in _mix().items()} if e == "p" else {})
        recent = {f"p_prev{k}_{x}": (F.col(x), k) for x in ("y", "middle") for k in (1, 3, 5)} if e == "p" else {}
        scan = Scan(totals={f"{e}_n": F.lit(1).cast("long")} | {c: v.cast("long") for c, v in share.items()}, recent=recent)
        found = scanned(out, [e], day(), ORDER, scan, large[e], df)
        rate = lambda c: F.try_divide(F.col(c).cast("double"), F.col(f"{e}_n").cast("double")).alias(c)  # noqa: B023, E731
        out = found.select(*out.columns, f"{e}_n", *[rate(c) for c in share], *[F.col(c)["mean"].alias(c) for c in recent])
    return out


def _rates_sql() -> str:
    order = ", ".join(ORDER)
    out = []
    for e, labels in RATES.items():
        w = f"OVER (PARTITION BY {e} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        out += [f"count(*) {w} AS {e}_n"] + [f"avg({x}) {w} AS {e}_{x}_rate" for x in labels]
    for x in ("y", "middle"):
        out += [f"avg({x}) OVER (PARTITION BY p ORDER BY {order} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS p_prev{k}_{x}" for k in (1, 3, 5)]
    for name, c in (("fast", "l_discount < 0.04"), ("breaking", "l_discount >= 0.04 AND l_discount < 0.08"), ("offspeed", "l_discount >= 0.08")):
        out.append(f"avg(CASE WHEN {c} THEN 1 ELSE 0 END) OVER (PARTITION BY p ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_{name}_rate")
    return f"rated AS (SELECT *, {', '.join(out)} FROM facts)"


RATED = f"{FACTS}, {_rates_sql()}"


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rates(facts(spark, sf_dir), most=most_rows(spark, sf_dir))


def most_rows(spark: SparkSession, sf_dir: str) -> int:
    """A number that facts' rows don't exceed: an order line has one order, and Parquet's footers say how many lines."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
