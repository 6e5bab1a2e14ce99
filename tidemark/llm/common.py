"""What the operators share: shared checkpoints, components, and positions in groups of any size."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts into which a group is dealt before its rows are numbered.
SALTS = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir or, where it is unset, one in the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return sc.getCheckpointDir()


#: Whether Spark removes what a query has shuffled as soon as the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _clean_up(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a result that is written as a whole is not kept."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder; a lost executor costs no earlier work."""
    shared_dir(df.sparkSession)
    with _clean_up(df.sparkSession):
        out = df.checkpoint(eager=True)
    let_go(df.sparkSession)
    return out


#: Seconds between two collections that let_go asks for.
COLLECT_EVERY = 15.0
_collected = [0.0]


def let_go(spark: SparkSession) -> None:
    """Shuffled files that no plan refers to any more go at the driver's next collection: soon, not in half an hour."""
    if time.monotonic() - _collected[0] > COLLECT_EVERY:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed Parquet table in the shared folder. Unlike a checkpoint, it can be read column by column."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _clean_up(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    let_go(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Removes the files of what table() has written, once nothing that is still to run reads it."""
    for df in tables:
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else left alone."""
    return F.translate(c, UPPER, LOWER)


def crc32_of_text(c: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(c, F.lit("")).cast("binary"))


#: DuckDB's common table expressions for crc32_sql, to stand after `with recursive`; its one row is joined as `lookup`.
CRC32_LOOKUP = """rounds(i, c, k) as (
  select i, i, 0 from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from rounds where k < 8
), lookup as (select list(c order by i) as tab from rounds where k = 8)"""


def crc32_sql(text: str) -> str:
    """DuckDB's expression of the unsigned CRC-32 of a text's UTF-8 bytes, which DuckDB lacks."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::bigint"
    all_bytes = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte})"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {all_bytes}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::bigint)"


def stars(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(u, v), a table: each node that can reach a smaller one, and the smallest that it can reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A hub's links are never gathered: minima are
    partial aggregates and the joins are plain equi-joins, which adaptive execution splits where a hub makes them
    skewed. Self-links and nulls are ignored, an empty table gives an empty table.
    """
    e = table(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        # In a star a node has smaller neighbours or larger ones, and of smaller ones no two.
        less = F.when(F.col("v") < F.col("u"), F.col("v"))
        seen = both.groupBy("u").agg(F.min(less).alias("low"), F.max(less).alias("high"), F.max("v").alias("top"))
        if not seen.agg(F.count(F.when((F.col("low") < F.col("high")) | (F.col("low").isNotNull() & (F.col("top") > F.col("u"))), 1))).first()[0]:
            return e
        old = e  # its files go once the next round is written
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = table(e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct(), "edges")
        forget(old)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable. An empty table gives an empty table."""
    e = stars(edges, a, b, most_rounds)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def position_in_group(df: DataFrame, keys: list[str], order: list[str], row: str, out: str, of: str | None = None, salts: int = SALTS) -> DataFrame:
    """Adds `out`: the row's place in its group from 0 or, with `of`, the sum of `of` over the rows before it.

    A group is dealt to `salts` parts by `row`, a column that is different in each row; parts are ordered one after
    the other and rows within a part by `order`. So no task sees a whole group. df is read twice: checkpoint it first.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    amount = F.coalesce(F.col(of), F.lit(0)) if of else F.lit(1)
    part = Window.partitionBy(*keys, "_part").orderBy(*order, row).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys, "_part").agg(F.sum(amount).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = dealt.withColumn("_inside", F.coalesce(F.sum(amount).over(part), F.lit(0)))
    same = [inside[k].eqNullSafe(starts[k]) for k in keys] + [inside["_part"] == starts["_part"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return inside.join(starts, on).select(*[inside[c] for c in df.columns], (F.col("_start") + F.col("_inside")).cast("long").alias(out))


def sieve(keys: DataFrame, key: str, bits: int = 1 << 23) -> Callable[[Column], Column]:
    """A test for longs that lets all of keys[key] through and few others: a bit for each key, in one row of fixed size.

    It only spares a shuffle what an exact join after it would drop; more keys let more through. It is a scalar
    subquery of bits / 64 numbers, whatever the number of keys.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.lit("sieve"), c), F.lit(bits))
    place = slot(F.col(key))
    marked = keys.select(F.shiftright(place, 6).alias("_at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("_bit"))
    marked = marked.groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))
    cells = keys.sparkSession.range(bits // 64).select(F.col("id").alias("_at")).join(marked, "_at", "left")
    row = cells.agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_bits", F.lit(0)).alias("_bits"))))["_bits"].alias("_all"))
    whole = checkpoint(row).scalar()

    def test(c: Column) -> Column:
        word = F.get(whole, F.shiftright(slot(c), 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, F.pmod(slot(c), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test
