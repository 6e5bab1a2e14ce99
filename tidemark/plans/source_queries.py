"""Sources, sinks and guards (S, K, V3, V4, V12, D1 to D3) over the given tables: written, read again and compared."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import encoding as N
from tidemark.operators import suite as S
from tidemark.operators.audit import dependent_rows
from tidemark.operators.boosting import Options
from tidemark.operators.frozen import Profile, frozen_profiles
from tidemark.operators.ranges import bound, temporary
from tidemark.plans.common import FACTS, ROW, facts, r9, rated, rounded
from tidemark.plans.registry import register
from tidemark.sources import archives, bundles, io, store

_LINE = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
_LINE_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem"


def _table(spark: SparkSession, sf_dir: str, name: str, columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*[c.split()[0] for c in columns.split(", ")])


@register("s1_csv_round_trip", _LINE_SQL)
def s1(spark, sf_dir):
    """CSV with a header (K2), read by a schema; doubles come back as they were."""
    path = temporary(spark, "csv")
    io.write_csv(_table(spark, sf_dir, "lineitem", _LINE), path)
    return io.read_csv(spark, path, _LINE)


@register("k5_gzip_lossless", _LINE_SQL)
def k5(spark, sf_dir):
    path = temporary(spark, "gzip")
    io.write_csv(_table(spark, sf_dir, "lineitem", _LINE), path, compress=True)
    return io.read_csv(spark, path, _LINE)


@register("s10_equal_pair", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def s10(spark, sf_dir):
    """Two gzipped tables of equal length, joined on their key; unequal ones are an error."""
    df, left, right = spark.read.parquet(f"{sf_dir}/orders.parquet"), temporary(spark, "left"), temporary(spark, "right")
    io.write_csv(df.select("o_orderkey", "o_totalprice"), left, compress=True)
    io.write_csv(df.select("o_orderkey", "o_orderstatus"), right, compress=True)
    a, b = io.read_csv(spark, left, "o_orderkey long, o_totalprice double"), io.read_csv(spark, right, "o_orderkey long, o_orderstatus string")
    io.require_equal_rows(a, b)
    return a.join(b, "o_orderkey")


@register("s4_archives", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s4(spark, sf_dir):
    """An archive a nation, with a table and a decoy, written by tasks; each archive's table is found by its header (S3 to S6)."""
    folder = temporary(spark, "zips")
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")

    def pack(rows: pa.Table) -> pa.Table:
        import zipfile

        from pyarrow import csv, fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root)
        name = f"{root}/nation-{rows.column('c_nationkey')[0].as_py()}.zip"
        with target.open_output_stream(name) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.csv", "c_custkey,other\n1,2\n")
            with z.open("data/train.csv", "w") as member:
                csv.write_csv(rows, member)
        return pa.table({"path": [name]})

    df.groupBy("c_nationkey").applyInArrow(pack, "path string").count()
    return archives.read_archives(spark, folder, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string", "c_acctbal")


@register("s12_bundle_round_trip", "SELECT vec_id, label, i::bigint AS place, embedding[i + 1]::double AS value FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS i FROM embeddings)")
def s12(spark, sf_dir):
    """Vectors and labels as a bundle of arrays (K3), read again by stretches."""
    bundles.register(spark)
    path = temporary(spark, "bundle")
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").write.format("bundle").mode("overwrite").save(path)
    back = spark.read.format("bundle").load(path)
    return back.select("vec_id", "label", F.posexplode("embedding").alias("place", "v")).select("vec_id", "label", F.col("place").cast("long").alias("place"), F.col("v").cast("double").alias("value"))


@register("s9_cached_projection", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s9(spark, sf_dir):
    """The second call finds the table that the first one wrote."""
    source, columns = f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"]
    build = lambda: spark.read.parquet(source)
    store.cached(spark, "orders", [source], columns, "1", build)
    again = store.cached(spark, "orders", [source], columns, "1", build)
    if not again.reused:
        raise RuntimeError("a cached table was not found again")
    return again.rows


@register("k1_verified_table", f"WITH {FACTS} SELECT season, count(*) AS n, {r9('avg(y)', 'target_mean')} FROM facts GROUP BY season")
def k1(spark, sf_dir):
    """Facts saved with their manifest, verified by digest and by the source's files on the way back; counts from both must agree."""
    path, source = temporary(spark, "table"), f"{sf_dir}/orders.parquet"
    df = facts(spark, sf_dir).select(*ROW, "y")
    periods = [r[0] for r in df.select("season").distinct().collect()]  # years
    made = store.save_table(df, path, "season", "y", periods, source)
    out = store.load_table(spark, path, source).groupBy("season").agg(F.count("*").alias("n"), F.avg("y").alias("target_mean"))
    rows = list(made.periods.items())
    return rounded(out.join(spark.createDataFrame(rows, "p string, k long"), F.col("season").cast("string") == F.col("p")).where("n = k"), "season", "n", "target_mean", keys=[])


@register("k6_submission", "SELECT o_orderkey AS row_id, least(greatest(o_totalprice / 500000, 0), 1) AS control FROM orders")
def k6(spark, sf_dir):
    """Predictions for a sample's keys, checked, written in the sample's order and read again."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sample = df.select(F.col("o_orderkey").alias("row_id"))
    made = df.select(F.col("o_orderkey").alias("row_id"), F.least(F.greatest(F.col("o_totalprice") / 500000, F.lit(0.0)), F.lit(1.0)).alias("control"))
    path = temporary(spark, "submission")
    io.write_submission(made, sample, "row_id", "control", path, order="row_id")
    return io.read_csv(spark, path, "row_id long, control double")


@register("k12_keep_latest", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS run FROM orders")
def k12(spark, sf_dir):
    """Results of a first run and of a later one for some keys (S15): the newest of each key."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("value"), F.lit(1).alias("run"))
    more = df.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("value") + 1).alias("value"), F.lit(2).alias("run"))
    return io.append_latest(df, more, ["o_orderkey"], "run")


@register("v3_guards", f"WITH {FACTS} SELECT gt, half, count(*) AS n FROM facts GROUP BY gt, half")
def v3(spark, sf_dir):
    """Required columns (V4) and their domains, checked before anything is counted."""
    df = io.require_columns(facts(spark, sf_dir), [*ROW, "gt", "half", "y"])
    df = io.require_domain(io.require_domain(df, "gt", ["R", "F"]), "half", ["F", "O", "P"])
    return df.groupBy("gt", "half").agg(F.count("*").alias("n"))


_PARTS = 4


@register(
    "v12_independent_rows",
    f"""WITH {FACTS}, now AS (SELECT * FROM facts WHERE season >= 2001), a AS (SELECT p, avg(ball) AS t FROM now GROUP BY p), b AS (SELECT p, l_orderkey % {_PARTS} AS k, avg(ball) AS t FROM now GROUP BY ALL),
d AS (SELECT round(a.t, 12) <> round(b.t, 12) AS differs FROM now JOIN a ON now.p = a.p JOIN b ON now.p = b.p AND now.l_orderkey % {_PARTS} = b.k)
SELECT 'frozen' AS operator, 0::bigint AS dependent UNION ALL SELECT 'leaky', count(*) FILTER (differs) FROM d""",
)
def v12(spark, sf_dir):
    """Later rows among all and in four parts: frozen state gives each the same, a mean over its own period does not."""
    df = facts(spark, sf_dir).select("l_orderkey", "season", "p", "gt", "y", "ball", F.lit(0.5).alias("base"))
    # Written once, so that a row keeps its number; equal rows are told apart.
    df = bound(df.withColumn("id", F.monotonically_increasing_id()))
    past, now, part = df.where("season < 2001"), df.where("season >= 2001"), F.col("l_orderkey") % _PARTS
    frozen = lambda x: frozen_profiles(x, [Profile("z", ("p", "gt"), "base", 100)])
    leaky = lambda x: x.withColumn("z_rate", F.round(F.avg("ball").over(Window.partitionBy("p", F.col("season") >= 2001)), 12))
    count = lambda name, f: dependent_rows(f, past, now, ["id"], ["z_rate"], part, _PARTS).agg(F.lit(name).alias("operator"), F.count("*").alias("dependent"))
    # A row each, one after the other: what the first has shuffled goes before the second is begun.
    return bound(count("frozen", frozen)).unionAll(bound(count("leaky", leaky)))


_FOLDS = [S.Fold("forward_2000", "season < 2000", "season = 2000", 0.2), S.Fold("forward_2001", "season < 2001", "season = 2001", 0.3), S.Fold("within_2001", "season < 2001 or (season = 2001 and inning <= 6)", "season = 2001 and inning > 6", 0.5)]
_STATE, _CONTEXT = ["p_y_rate", "b_y_rate", "p_n", "b_n"], ["balls", "strikes", "outs", "score", "li"]
#: Few and shallow, for tables of a test's size.
_SMALL = Options(trees=2, depth=3, rate=0.5, l2=20.0, borders=32)


def _features(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """One table of features that all fits of a suite read; indicators of the few-valued categories."""
    df = rated(spark, sf_dir).select(*ROW, *_STATE, *_CONTEXT, "inning", "gt", "half", "y")
    names: list[str] = []
    for c in ("gt", "half"):
        values = N.few_values(df, c) or []
        df, names = N.indicators(df, c, values), names + [f"{c}_is_{i}" for i in range(len(values))]
    return bound(df), names


@register("d1_ablation")
def d1(spark, sf_dir):
    """Three variants over three folds, a fit each (D3 runs them at once and can resume), summed up against the first."""
    df, codes = _features(spark, sf_dir)
    variants = {"state": _STATE, "context": [*_STATE, *_CONTEXT], "all": [*_STATE, *_CONTEXT, *codes]}
    out = S.summary(S.ablation(df, variants, _FOLDS, "y", temporary(spark, "suite"), _SMALL), "state")
    return rounded(out, *out.columns, keys=[], digits=6)


@register("d2_fold_models")
def d2_models(spark, sf_dir):
    """A model fitted in each of the three folds, and its error beside that of the training rows' mean."""
    df, codes = _features(spark, sf_dir)
    out = S.ablation(df, {"all": [*_STATE, *_CONTEXT, *codes]}, _FOLDS, "y", temporary(spark, "folds"), _SMALL, F.when(F.col("gt") == "F", 2.0).otherwise(1.0))
    return rounded(out, *out.columns, keys=[], digits=6)
