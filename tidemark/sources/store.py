"""Tables that Spark has written for itself: found again by what they were made from, verified by digests, and removed."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranges import delete, exists, shared_folder

_MASK = (1 << 64) - 1


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of every file under a path, listed by Spark; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file under a path, up to 2 GB each."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def _two_sums(parts: list[Column]) -> list[Column]:
    """Two sums of 64-bit hashes over all rows: whole numbers, so that neither order nor partitions matter."""
    return [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (0, 1)]


def _text(row) -> str:
    return "".join(f"{int(row[f's{seed}'] or 0) & _MASK:016x}" for seed in (0, 1))


def content_digest(df: DataFrame) -> str:
    """128 bits of the rows of df as a multiset, with the names and types of its columns; one aggregate.

    The same after any repartition, sort or renaming of files; another after a changed cell, a row more or less, or a
    null in place of a value. Columns may stand in any order.
    """
    kinds = sorted(df.dtypes)
    cells: list[Column] = []
    for name, kind in kinds:
        c = F.col(f"`{name}`")
        cells += [c.isNull(), F.to_json(F.struct(c)) if "map<" in kind else c]
    row = df.agg(F.count("*").alias("n"), *_two_sums(cells)).first()
    head = df.sparkSession.range(1).select(F.xxhash64(F.lit(json.dumps(kinds))).alias("h")).first()["h"]
    return f"{row['n']}-{head & _MASK:016x}-{_text(row)}"


@dataclass(frozen=True)
class Manifest:
    """What is known of a table: where from, rows and columns, rows a period, the target's mean, and its digest."""

    sources: dict[str, str]
    columns: list[str]
    periods: dict[str, int]
    target_mean: float | None
    digest: str

    def json(self) -> str:
        return json.dumps({"sources": self.sources, "rows": sum(self.periods.values()), "columns": self.columns, "seasons": self.periods, "target_mean": self.target_mean, "digest": self.digest}, sort_keys=True)


def describe(df: DataFrame, period: str, target: str, sources: dict[str, str] | None = None) -> Manifest:
    """A manifest by two aggregates; a row a period comes to the driver."""
    each = df.groupBy(F.col(period).cast("string").alias("p")).agg(F.count("*").alias("n"), F.sum(target).alias("s"), F.count(target).alias("k")).collect()
    known = sum(r["k"] for r in each)
    mean = float(sum(r["s"] or 0 for r in each) / known) if known else None
    return Manifest(sources or {}, sorted(df.columns), {str(r["p"]): r["n"] for r in sorted(each, key=lambda r: str(r["p"]))}, mean, content_digest(df))


def require_periods(df: DataFrame, period: str, expected: list) -> DataFrame:
    """df, or ValueError with the periods that are missing or not expected (null is not)."""
    found = {r[0] for r in df.select(period).distinct().limit(len(expected) + 100).collect()}
    if found != set(expected):
        raise ValueError(f"{period}: missing {sorted(set(expected) - found)}, not expected {sorted(found - set(expected), key=str)}")
    return df


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_table(df: DataFrame, path: str, period: str, target: str, expected: list | None = None, source: str | None = None) -> Manifest:
    """df as Parquet in path/rows, what it is in path/manifest. The digest is of the rows as written.

    Periods are checked before anything is written; the files of `source` are named with their SHA-256.
    """
    spark = df.sparkSession
    if expected is not None:
        require_periods(df, period, expected)
    df.write.mode("overwrite").parquet(f"{path}/rows")
    named = {r["path"]: r["sha256"] for r in file_digests(spark, source).collect()} if source else {}
    made = describe(spark.read.schema(df.schema).parquet(f"{path}/rows"), period, target, named)
    _write_text(spark, f"{path}/manifest", made.json())
    return made


def load_table(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The rows of save_table, or ValueError if they, or the files they were made from, are not those of the manifest."""
    known = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    df = spark.read.parquet(f"{path}/rows")
    if (found := content_digest(df)) != known["digest"]:
        raise ValueError(f"{path}: rows have digest {found}, the manifest {known['digest']}")
    if source and (now := {r["path"]: r["sha256"] for r in file_digests(spark, source).collect()}) != known["sources"]:
        raise ValueError(f"{path}: made from other files than {sorted(now)}")
    return df


@dataclass(frozen=True)
class Cached:
    rows: DataFrame
    path: str
    reused: bool


def fingerprint(spark: SparkSession, sources: list[str], columns: list[str], version: str) -> str:
    """What a cached table is made from: names, sizes and times of the source files, columns and the plan's version."""
    parts = []
    for path in sources:
        row = files(spark, path).agg(F.count("*").alias("n"), *_two_sums([F.col("path"), F.col("length"), F.unix_micros("modificationTime")])).first()
        parts.append(f"{row['n']}:{_text(row)}")
    key = json.dumps([parts, columns, version])
    return f"{spark.range(1).select(F.sha2(F.lit(key), 256).alias('h')).first()['h'][:32]}"


def cached(spark: SparkSession, name: str, sources: list[str], columns: list[str], version: str, build: Callable[[], DataFrame], days: float = 7.0) -> Cached:
    """The columns of build(), from the shared folder if they were written before from the same files by the same version.

    A table is written under a name of its own and takes its place when it is whole, so that a run that is lost leaves
    none, and of two at once the first stays. Tables older than `days` are written anew.
    """
    place = f"{shared_folder(spark)}/cache-{name}-{fingerprint(spark, sources, columns, version)}"
    made = _made_at(spark, place)
    if made is not None and time.time() - made <= days * 86400:
        return Cached(spark.read.parquet(place), place, True)
    if made is not None:
        delete(spark, place)
    draft = f"{place}.{uuid.uuid4().hex}"
    build().select(*columns).write.parquet(draft)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(draft).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if exists(spark, place) or not fs.rename(path(draft), path(place)):
        delete(spark, draft)
    return Cached(spark.read.parquet(place), place, False)


def _made_at(spark: SparkSession, place: str) -> float | None:
    """When a cached table was finished, in seconds; None if it isn't there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(done).getModificationTime() / 1000 if fs.exists(done) else None


def expire(spark: SparkSession, days: float = 7.0) -> list[str]:
    """Removes cached tables older than `days`, and drafts of lost runs as old; names what went."""
    gone = []
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("cache-") and time.time() - status.getModificationTime() / 1000 > days * 86400:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return gone
