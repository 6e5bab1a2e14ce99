"""CSV tables inside archives: ZIP, TAR (plain, gzip, bzip2, xz), gzip, or the file itself.

Spark lists and reads the files; members are opened and streamed in tasks, in batches of rows, so only an archive's
compressed bytes (up to 2 GB) are held, never a member. An archive is one task's work, many archives are many.
"""

from __future__ import annotations

import csv
import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.io import nulls_for_nan

#: Rows in a batch; the name that is preferred among members with the wanted column.
BATCH, PREFERRED = 5_000, "train.csv"
_MEMBERS = "path string, member string, size long, header array<string>, problem string"


def _kind(content: bytes) -> str:
    if content[:2] == b"PK" and zipfile.is_zipfile(io.BytesIO(content)):
        return "zip"
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            t.next()
            return "tar"
    except tarfile.TarError:
        return "gzip" if content[:2] == b"\x1f\x8b" else "plain"


def _names(content: bytes, kind: str) -> list[tuple[str, int]]:
    """(member, size) of the files of an archive; a file that is none has the empty name."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
    if kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            return [(i.name, i.size) for i in t if i.isfile()]
    return [("", len(content))]


@contextmanager
def _opened(content: bytes, kind: str, member: str) -> Iterator[io.TextIOBase]:
    """A member as a stream of text without a byte-order mark. Nothing is written, so a member's name leads nowhere."""
    raw = io.BytesIO(content)
    holder = zipfile.ZipFile(raw) if kind == "zip" else tarfile.open(fileobj=raw) if kind == "tar" else None
    try:
        stream = holder.open(member) if kind == "zip" else holder.extractfile(member) if kind == "tar" else gzip.open(raw) if kind == "gzip" else raw
        with io.TextIOWrapper(stream, "utf-8-sig", newline="") as text:
            yield text
    finally:
        if holder is not None:
            holder.close()


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size, header, problem) of every member of every file under path; header is the first record.

    A member without a record has an empty header; one that is not text, or an archive that is broken, says its problem.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                found = []
                try:
                    content = content.as_py()
                    kind = _kind(content)
                    for member, size in _names(content, kind):
                        try:
                            with _opened(content, kind, member) as text:
                                found.append((name, member, size, next(csv.reader(text), []), None))
                        except (UnicodeDecodeError, csv.Error, OSError, zipfile.BadZipFile, RuntimeError) as e:
                            found.append((name, member, size, [], str(e)))
                except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError) as e:
                    found.append((name, None, None, [], str(e)))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in found], schema)

    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("header", pa.list_(pa.string())), ("problem", pa.string())])
    return _contents(spark, path).mapInArrow(task, _MEMBERS)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def chosen(found: DataFrame, column: str, preferred: str = PREFERRED) -> DataFrame:
    """(path, member) for each file that has a member with the column: the preferred name, else the shortest, then the first."""
    base = F.element_at(F.split("member", "/"), -1)
    rank = F.struct((base != preferred).alias("other"), F.length("member").alias("length"), F.col("member"))
    return found.where(F.array_contains("header", column)).groupBy("path").agg(F.min_by("member", rank).alias("member"))


def read_archives(spark: SparkSession, path: str, schema: StructType | str, column: str, preferred: str = PREFERRED) -> DataFrame:
    """The rows of the chosen member of every file under path, by the names of its header, as schema.

    A column that a header lacks is null, further ones are left out; a value that is not of its type is an error, the
    empty text null; NaN and infinities are null. Records may hold quoted separators and line ends; a shorter record
    ends in nulls. FileNotFoundError if no file has a member with the column.
    """
    typed = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    picked = chosen(members(spark, path), column, preferred)
    if picked.isEmpty():
        raise FileNotFoundError(f"no member with a column {column} under {path}")
    names = typed.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, member in zip(b.column(0), b.column(1).to_pylist()):
                content = content.as_py()
                with _opened(content, _kind(content), member) as text:
                    records = csv.reader(text)
                    header = next(records)
                    place = [header.index(n) if n in header else None for n in names]
                    held: list[list[str | None]] = []
                    for record in records:
                        if record:  # a blank line is none
                            held.append([record[p] or None if p is not None and p < len(record) else None for p in place])
                        if len(held) >= BATCH:
                            yield _texts(held)
                            held = []
                    yield _texts(held)

    def _texts(held: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.string()) for i in range(len(names))], names)

    both = _contents(spark, path).join(picked, "path").select("content", "member")
    # Large rows: a file at a time in a task's batch.
    texts = both.mapInArrow(task, ", ".join(f"`{n}` string" for n in names))
    return nulls_for_nan(texts.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in typed]))
