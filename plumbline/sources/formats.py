"""Data sources of archives: ``npz`` (named arrays, read and written) and ``zip`` (members).

    register(spark)
    spark.read.format("npz").schema("case_id string, block array<double>").load(path)
    df.write.format("npz").option("rowsPerArchive", 10_000).mode("append").save(path)
    spark.read.format("zip").option("pattern", r"results/.*[.]csv").load(path)

An archive's directory, which is at its end, tells its members and their sizes, so plans are made without data. A scan of
``npz`` splits each archive into row ranges and reads only the members that the schema names; where a member is stored
as it is, a range is a seek away, where it is deflated, what is before it is inflated and dropped. A scan of ``zip`` deals
members to tasks by their bytes. Files are opened by their URI (local paths and the stores that Arrow knows); archives in
a store that only Spark reads go through ``archives``, a whole archive a task.

Writers put archives beside the target under names of their own, move them in when all tasks are done, and never
overwrite: a name that is taken, a failed task or an aborted job leaves the target as it was.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

BATCH = 4096


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def _archives(path: str, suffix: str) -> list[str]:
    """The archives below a folder, hidden ones and those of unfinished writers left out, or the file itself."""
    store, at = _opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    below = lambda p: p[len(at.rstrip("/")) + 1 :].split("/")
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not any(part.startswith(("_", ".")) for part in below(f.path)))


def _header(member: io.IOBase) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(member)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(member) if version == (1, 0) else np.lib.format.read_array_header_2_0(member)
    if fortran and len(shape) > 1:
        raise ValueError("arrays in column order can't be read by rows")
    if dtype.hasobject:
        raise ValueError("arrays of objects are never read")
    return shape, dtype


@dataclass
class Rows(InputPartition):
    path: str
    lo: int
    hi: int


class NpzReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.members = [f.name for f in schema.fields if f.name not in ("path", "row_ord")]
        if not self.members:
            raise ValueError("the schema names no member")

    def partitions(self) -> list[Rows]:
        store, _ = _opened(self.options["path"])
        per, out = int(self.options.get("rowsperpartition", 65_536)), []
        for path in _archives(self.options["path"], ".npz"):
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                sizes = set()
                for m in self.members:
                    with z.open(f"{m}.npy") as member:
                        shape, _ = _header(member)
                        sizes.add(shape[0] if shape else 1)
            if len(sizes) > 1:
                raise ValueError(f"members of {path} differ in their number of rows: {sorted(sizes)}")
            n = sizes.pop()
            out += [Rows(path, lo, min(lo + per, n)) for lo in range(0, n, per)]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.options["path"])
        types = to_arrow_schema(self.schema)
        with store.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            streams, forms = {}, {}
            for m in self.members:
                streams[m] = z.open(f"{m}.npy")
                shape, dtype = _header(streams[m])
                width = int(np.prod(shape[1:], dtype=int))
                forms[m] = width, dtype
                streams[m].seek(part.lo * width * dtype.itemsize, io.SEEK_CUR)
            for lo in range(part.lo, part.hi, BATCH):
                n, columns = min(BATCH, part.hi - lo), []
                for field, kind in zip(self.schema.fields, types, strict=True):
                    if field.name in ("path", "row_ord"):
                        columns.append(pa.array([part.path] * n if field.name == "path" else range(lo, lo + n), kind.type))
                        continue
                    width, dtype = forms[field.name]
                    flat = np.frombuffer(self._exactly(streams[field.name], n * width * dtype.itemsize), dtype)
                    values = pa.array(flat.astype(np.float32) if dtype == np.float16 else flat)
                    if isinstance(field.dataType, ArrayType):
                        columns.append(pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width or 1, dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32), values.cast(kind.type.value_type)))
                    elif width != 1:
                        raise ValueError(f"{field.name} has {width} values a row")
                    else:
                        columns.append(values.cast(kind.type))
                yield pa.record_batch([c.cast(k.type) for c, k in zip(columns, types, strict=True)], schema=types)
            for s in streams.values():
                s.close()

    @staticmethod
    def _exactly(stream: io.IOBase, n: int) -> bytes:
        out = stream.read(n)
        if len(out) != n:
            raise ValueError("an archive ends before its rows do")
        return out


@dataclass
class Put(WriterCommitMessage):
    """What a task has written below the folder of the job."""

    names: list[str]


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("archives are never overwritten: append, or write to a new folder")
        self.schema, self.options, self.job = schema, options, uuid.uuid4().hex
        self.per = int(options.get("rowsperarchive", 65_536))
        self.types = dict(pair.split("=") for pair in options.get("dtypes", "").split(",") if pair)

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        store, at = _opened(self.options["path"])
        return store, at.rstrip("/"), f"{at.rstrip('/')}/_{self.job}"

    def _array(self, name: str, column: pa.ChunkedArray, of_array: bool) -> np.ndarray:
        values = column.to_pylist()
        if of_array:
            if len({len(v) for v in values if v is not None}) > 1 or any(v is None for v in values):
                raise ValueError(f"{name} needs arrays of one length")
            found = np.array(values, float if column.type.value_type in (pa.float32(), pa.float64()) else None).reshape(len(values), -1)
        else:
            if any(v is None for v in values) and not pa.types.is_floating(column.type):
                raise ValueError(f"{name} misses values, which only floating numbers may")
            found = np.array([np.nan if v is None else v for v in values])
        if found.dtype.hasobject:
            raise ValueError(f"{name} can't be an array")
        return found.astype(self.types[name]) if name in self.types else found

    def write(self, batches: Iterator[pa.RecordBatch]) -> Put:
        store, _, job = self._folders()
        store.create_dir(job, recursive=True)
        held, n, names = [], 0, []

        def put(table: pa.Table) -> None:
            names.append(f"{uuid.uuid4().hex}.npz")  # an attempt's own, so that a second attempt meets nothing
            made = io.BytesIO()
            with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED if self.options.get("compression", "deflate") == "deflate" else zipfile.ZIP_STORED) as z:
                for f in self.schema.fields:
                    with z.open(f"{f.name}.npy", "w", force_zip64=True) as member:
                        np.lib.format.write_array(member, np.ascontiguousarray(self._array(f.name, table.column(f.name), isinstance(f.dataType, ArrayType))), allow_pickle=False)
            with store.open_output_stream(f"{job}/{names[-1]}") as out:
                out.write(made.getvalue())

        for b in batches:
            held.append(b)
            n += b.num_rows
            while n >= self.per:
                table = pa.Table.from_batches(held)
                put(table.slice(0, self.per))
                held, n = table.slice(self.per).to_batches(), n - self.per
        if n:
            put(pa.Table.from_batches(held))
        return Put(names)

    def commit(self, messages: list[Put | None]) -> None:
        store, at, job = self._folders()
        store.create_dir(at, recursive=True)
        moves = [(f"{job}/{name}", f"{at}/part-{i:05}-{self.job}-{k}.npz") for i, m in enumerate(messages) if m is not None for k, name in enumerate(m.names)]
        if any(store.get_file_info(new).type != fs.FileType.NotFound for _, new in moves):
            self.abort(messages)
            raise ValueError("an archive of this name is there")
        for old, new in moves:
            store.move(old, new)
        self.abort(messages)

    def abort(self, messages: list[Put | None]) -> None:
        """The job's own folder goes, with whatever attempts have left in it."""
        store, _, job = self._folders()
        if store.get_file_info(job).type == fs.FileType.Directory:
            store.delete_dir(job)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        raise ValueError("state the schema: it names the members that are read")

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(schema, self.options, overwrite)


@dataclass
class Members(InputPartition):
    path: str
    names: list[str]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Members]:
        """Members whose whole name matches, in turn to tasks of about ``bytesPerPartition``."""
        store, _ = _opened(self.options["path"])
        match, most, out = re.compile(self.options.get("pattern", ".*")).fullmatch, int(self.options.get("bytesperpartition", 64 << 20)), []
        for path in _archives(self.options["path"], ".zip"):
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                size = most
                for m in z.infolist():
                    if m.is_dir() or not match(m.filename):
                        continue
                    if size >= most:
                        out.append(Members(path, []))
                        size = 0
                    out[-1].names.append(m.filename)
                    size += m.file_size
        return out

    def read(self, part: Members) -> Iterator[tuple]:
        store, _ = _opened(self.options["path"])
        with store.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
            for name in part.names:
                content = z.read(name)
                yield part.path, name, content, hashlib.sha256(content).hexdigest()


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return "archive string, member string, content binary, digest string"

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (NpzSource, ZipSource):
        spark.dataSource.register(source)
