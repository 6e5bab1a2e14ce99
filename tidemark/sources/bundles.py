"""Bundles of aligned arrays (NPZ files) as a Spark source and sink: spark.read.format("bundle"), df.write.format("bundle").

A bundle is one NPZ file, or a folder of them with bundle.json, which names its parts in order. Tasks read stretches of
rows: of a stored array they seek, of a compressed one they skip. The sink writes parts of bounded size under a
temporary name; only a job that has ended well moves them and writes bundle.json, so that a failed one leaves nothing.
Paths are of any store that pyarrow opens (local or mounted folders, hdfs://, s3://), seen by all executors.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Rows a reading task has, rows in a batch, rows in a written part.
STRETCH, BATCH, PART = 1 << 20, 1 << 14, 1 << 20
#: Arrays of marks beside a column that has nulls and cannot hold them itself.
NULLS = "__null"
_INDEX = "bundle.json"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _parts(path: str) -> list[str]:
    """The NPZ files of a bundle in order."""
    store, root = _store(path)
    if store.get_file_info(root).type == fs.FileType.File:
        return [root]
    if store.get_file_info(f"{root}/{_INDEX}").type == fs.FileType.File:
        with store.open_input_stream(f"{root}/{_INDEX}") as f:
            return [f"{root}/{p['name']}" for p in json.loads(f.read())["parts"]]
    found = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.path.endswith(".npz")]
    if not found:
        raise FileNotFoundError(f"no bundle at {path}")
    return sorted(found)


def _header(stream: io.BufferedIOBase) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(stream)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if kind.hasobject:
        raise ValueError("an array of Python objects is not read")
    if by_column and len(shape) > 1:
        raise ValueError("an array in Fortran order is not read")
    return shape, kind


def _shapes(path: str, store: fs.FileSystem) -> dict[str, tuple[tuple[int, ...], np.dtype]]:
    with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        out = {}
        for name in z.namelist():
            with z.open(name) as member:
                out[name.removesuffix(".npy")] = _header(member)
        return out


def _kind_of(shape: tuple[int, ...], kind: np.dtype) -> pa.DataType:
    one = pa.string() if kind.kind in "US" else pa.from_numpy_dtype(kind.newbyteorder("="))
    one = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.float16(): pa.float32()}.get(one, one)
    if len(shape) > 2 or one == pa.uint64():
        raise ValueError(f"an array of shape {shape} and kind {kind} is no column")
    return pa.list_(one) if len(shape) == 2 else one


@dataclass
class _Stretch(InputPartition):
    path: str
    start: int
    stop: int


def _rows(path: str, shapes: dict[str, tuple[tuple[int, ...], np.dtype]], columns: list[str]) -> int:
    """The columns' common length; ValueError if they have none."""
    lengths = {c: shapes[c][0][0] if c in shapes and shapes[c][0] else None for c in columns}
    if len(set(lengths.values())) > 1 or None in lengths.values():
        raise ValueError(f"{path}: columns are not aligned: {lengths}")
    return next(iter(lengths.values()), 0)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, stretch: int) -> None:
        self.path, self.schema, self.stretch = path, schema, stretch

    def partitions(self) -> list[InputPartition]:
        store, _ = _store(self.path)
        out: list[InputPartition] = []
        for part in _parts(self.path):
            n = _rows(part, _shapes(part, store), self.schema.names)
            out += [_Stretch(part, s, min(n, s + self.stretch)) for s in range(0, n, self.stretch)]
        return out or [_Stretch("", 0, 0)]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        if partition.stop <= partition.start:
            return
        store, _ = _store(self.path)
        schema, names = to_arrow_schema(self.schema), self.schema.names
        with store.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            there = set(z.namelist())
            open_ = {n: z.open(f"{n}.npy") for c in names for n in (c, c + NULLS) if f"{n}.npy" in there}
            heads = {n: _header(s) for n, s in open_.items()}
            width = {n: int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize for n, (shape, kind) in heads.items()}
            for n, s in open_.items():
                s.seek(partition.start * width[n], 1)
            for low in range(partition.start, partition.stop, BATCH):
                count = min(BATCH, partition.stop - low)
                got = {n: np.frombuffer(s.read(count * width[n]), heads[n][1]).reshape(count, *heads[n][0][1:]) for n, s in open_.items()}
                yield pa.RecordBatch.from_arrays([_column(got[c], got.get(c + NULLS), field.type) for c, field in zip(names, schema)], schema=schema)


def _column(x: np.ndarray, nulls: np.ndarray | None, kind: pa.DataType) -> pa.Array:
    if x.dtype.kind in "US":
        x = np.char.decode(x, "utf-8") if x.dtype.kind == "S" else x
        return pa.array(x.tolist(), kind, mask=nulls)
    if x.ndim == 2:
        values = pa.array(x.ravel().astype(x.dtype.newbyteorder("="))).cast(kind.value_type)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), values, mask=None if nulls is None else pa.array(nulls))
    return pa.array(x.astype(x.dtype.newbyteorder("=")), mask=nulls).cast(kind)


@dataclass
class _Written(WriterCommitMessage):
    parts: list[tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, part: int, compress: bool) -> None:
        self.path, self.schema, self.overwrite, self.part, self.compress = path, schema, overwrite, part, compress
        self.draft = f"_draft-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        task, held, rows, done = TaskContext.get(), [], 0, []

        def close() -> None:
            name = f"part-{task.partitionId():05d}-{len(done):04d}-{task.taskAttemptId()}.npz"
            store.create_dir(f"{root}/{self.draft}")
            with store.open_output_stream(f"{root}/{self.draft}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED if self.compress else zipfile.ZIP_STORED) as z:
                for key, x in _arrays(pa.Table.from_batches(held)).items():
                    with z.open(f"{key}.npy", "w", force_zip64=True) as member:
                        np.lib.format.write_array(member, x, allow_pickle=False)
            done.append((name, rows))

        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, self.part - rows)
                held.append(b.slice(0, take))
                rows, b = rows + take, b.slice(take)
                if rows == self.part:
                    close()
                    held, rows = [], 0
        if rows:
            close()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        store, root = _store(self.path)
        store.create_dir(root)
        there = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".npz")]
        if there and not self.overwrite:
            old = [p.removeprefix(f"{root}/") for p in _parts(self.path)]
        else:
            old = []
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        for name, _ in parts:
            store.move(f"{root}/{self.draft}/{name}", f"{root}/{self.draft[7:15]}-{name}")
        named = [*({"name": n} for n in old), *({"name": f"{self.draft[7:15]}-{n}", "rows": k} for n, k in parts)]
        # Readers follow the index: until it is replaced they see the bundle as it was.
        with store.open_output_stream(f"{root}/{_INDEX}") as f:
            f.write(json.dumps({"columns": self.schema.names, "parts": named}).encode())
        if self.overwrite:
            for p in there:
                store.delete_file(p)
        self._clean(store, root)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self._clean(*_store(self.path))

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.draft}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.draft}")


def _arrays(t: pa.Table) -> dict[str, np.ndarray]:
    out: dict[str, np.ndarray] = {}
    for name, column in zip(t.column_names, t.columns):
        c = column.combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        nulls = np.asarray(c.is_null())
        if pa.types.is_list(c.type):
            lengths = set(np.asarray(c.value_lengths().fill_null(-1)).tolist()) - {-1}
            if len(lengths) > 1:
                raise ValueError(f"{name}: lists of lengths {sorted(lengths)[:5]} are no array")
            width = lengths.pop() if lengths else 0
            x = np.zeros((len(c), width), c.type.value_type.to_pandas_dtype())
            x[~nulls] = c.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int((~nulls).sum()), width)
        elif pa.types.is_string(c.type):
            x = np.array(c.fill_null("").to_pylist(), dtype="U") if len(c) else np.zeros(0, "U1")
            if any(v.endswith("\0") for v in c.drop_null().to_pylist()):
                raise ValueError(f"{name}: a text that ends in a zero character can't be kept in an array")
        elif pa.types.is_boolean(c.type) or pa.types.is_integer(c.type) or pa.types.is_floating(c.type):
            zero = pa.scalar(0, pa.int8()).cast(c.type)
            x = c.fill_null(zero).to_numpy(zero_copy_only=False)
        else:
            raise ValueError(f"{name}: {c.type} is no array")
        out[name] = x
        if nulls.any():
            out[name + NULLS] = nulls
    return out


class BundleSource(DataSource):
    """Options: columns (names, comma-separated; else all arrays of the first part), stretch, part, compression (none or deflate)."""

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> StructType:
        store, _ = _store(self.options["path"])
        shapes = _shapes(_parts(self.options["path"])[0], store)
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else [c for c in shapes if not c.endswith(NULLS)]
        if missing := [c for c in names if c not in shapes]:
            raise ValueError(f"no arrays {missing}, but {sorted(shapes)}")
        return from_arrow_schema(pa.schema([pa.field(c, _kind_of(*shapes[c])) for c in names]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("stretch", STRETCH)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite, int(self.options.get("part", PART)), self.options.get("compression", "deflate") != "none")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BundleSource)
