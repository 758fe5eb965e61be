"""Library files (SQLite) as a Spark data source: ``spark.read.format("dlib")``.

Reading: a large file is cut into rowid ranges, one task each, and small files are
read several to a task; ``columns`` limits what is selected and simple filters
become a WHERE clause.

Writing: every task writes complete library files of bounded size (shards with all
three tables), which the driver only renames on commit. SQLite has a single writer,
so one file for a whole library would be one task.

Shards are made in memory, and files on a remote file system are read into memory (and
refused beyond 1 GB), so no task needs a folder of its own. Paths are full URIs: ``read_dlib`` and
``write_dlib`` resolve a plain path by the cluster's own file system settings.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ionloom import constants as K
from ionloom.session import qualified
from ionloom.sources.schemas import LIBRARY_TABLES, table_schema

SUFFIX = ".dlib"
ROWS_PER_PARTITION = 100_000
ROWS_PER_SHARD = 50_000
SHARD_BYTES = 16 << 20          # of the batches in a shard, which is in memory twice while it is stored
ROWS_PER_BATCH = 2_048
LARGE_BYTES = 128 << 20         # a larger file on a local disk is read by ranges of rows
PACKED_BYTES = 8 << 20          # smaller files are read together, about so many bytes a task
REMOTE_BYTES = 1 << 30          # a larger file that is not on a local disk is refused; export shards instead
RANGE_BYTES = 1 << 20           # of a file for each of its ranges at least, however sparse its row numbers are
SQL_TYPES = {"integer": "int", "double": "double", "string": "string", "binary": "blob", "boolean": "boolean"}
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

PATH, ROW = "_path", "_rowid"
PROVENANCE = [StructField(PATH, StringType()), StructField(ROW, LongType())]


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a full URI (see ``session.qualified``) and the path in it."""
    scheme, found, _ = path.partition("://")
    if not found:
        raise ValueError(f"not a full URI: {path}")
    if scheme == "file":
        return pafs.LocalFileSystem(), path.removeprefix("file://")
    # the same store by the name that this library knows
    return pafs.FileSystem.from_uri("s3" + path[len(scheme) :] if scheme in ("s3a", "s3n") else path)


def _library_files(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a library file, or of those in a folder."""
    fs, inner = _file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(inner))
    names = sorted((f.base_name, f.size) for f in found if f.base_name.endswith(SUFFIX))
    return [(f"{path.rstrip('/')}/{name}", size) for name, size in names]


def _connect(path: str) -> sqlite3.Connection:
    """A library file for reading: in place on a local disk, else from memory."""
    fs, inner = _file_system(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return sqlite3.connect(f"file:{quote(inner)}?mode=ro", uri=True)
    size = fs.get_file_info(inner).size
    if size > REMOTE_BYTES:
        raise ValueError(f"{path} has {size} bytes; a library file that is not on a local disk may have {REMOTE_BYTES}")
    con = sqlite3.connect(":memory:")
    with fs.open_input_stream(inner) as source:
        con.deserialize(source.read())
    return con


@dataclass
class RowRange:
    path: str
    start: int | None = None
    stop: int | None = None


@dataclass
class Ranges(InputPartition):
    """What one task reads: a range of rows of a large file, or several small files."""

    ranges: list[RowRange]


class LibraryReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.table = options.get("table", "entries")
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", (None,))
            known = len(name) == 1 and name[0] in self.schema.names and name[0] not in (PATH, ROW)
            if known and type(f) in COMPARISONS:
                self.where.append(f'"{name[0]}" {COMPARISONS[type(f)]} ?')
                self.values.append(f.value)
            elif known and isinstance(f, In):
                self.where.append(f'"{name[0]}" IN ({",".join("?" * len(f.value))})')
                self.values.extend(f.value)
            elif known and isinstance(f, IsNotNull):
                self.where.append(f'"{name[0]}" IS NOT NULL')
            else:
                yield f

    def partitions(self):
        step = self.options.get("rows_per_partition")
        out, held, size = [], [], 0
        for path, n_bytes in _library_files(self.options["path"]):
            local = isinstance(_file_system(path)[0], pafs.LocalFileSystem)
            if local and (step or n_bytes > LARGE_BYTES):   # only large files are opened here
                rows = int(step or ROWS_PER_PARTITION)
                with closing(_connect(path)) as con:
                    first, last = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
                if first is not None:
                    if not step:
                        rows = max(rows, -(-(last - first + 1) // max(n_bytes // RANGE_BYTES, 1)))
                    out += [Ranges([RowRange(path, lo, lo + rows)]) for lo in range(first, last + 1, rows)]
                continue
            held.append(RowRange(path))
            size += n_bytes
            if size >= PACKED_BYTES:
                out.append(Ranges(held))
                held, size = [], 0
        return out + [Ranges(held)] if held or not out else out

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for found in part.ranges:
            yield from self._read_range(found)

    def _read_range(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        # where a row comes from is no column of the file
        parts = {PATH: f"'{part.path.replace(chr(39), chr(39) * 2)}'", ROW: "rowid"}
        names = ", ".join(parts.get(n, f'"{n}"') for n in self.schema.names)
        where, values = list(self.where), list(self.values)
        if part.start is not None:
            where = ["rowid >= ?", "rowid < ?", *where]
            values = [part.start, part.stop, *values]
        sql = f'SELECT {names} FROM "{self.table}"' + (f" WHERE {' AND '.join(where)}" if where else "")
        booleans = {i for i, f in enumerate(self.schema.fields) if f.dataType.typeName() == "boolean"}
        # SQLite turns a text that looks like a number into one
        texts = {i for i, f in enumerate(self.schema.fields) if f.dataType.typeName() == "string"}
        with closing(_connect(part.path)) as con:
            cursor = con.execute(sql, values)
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                columns = [
                    [None if v is None else bool(v) for v in column]
                    if i in booleans
                    else [v if v is None else str(v) for v in column]
                    if i in texts
                    else column
                    for i, column in enumerate(zip(*rows))
                ]
                arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


@dataclass
class Shards(WriterCommitMessage):
    names: list[str]


class LibraryWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.overwrite = schema, overwrite
        self.table = options.get("table", "entries")
        self.path = options["path"].rstrip("/")
        self.job, self.shards = uuid.uuid4().hex, 0
        table_schema(self.table)

    def _pending(self, name: str) -> str:
        return f"{self.path}/.pending-{self.job}/{name}"

    def _shard(self) -> sqlite3.Connection:
        """An empty library in memory."""
        con = sqlite3.connect(":memory:")
        for table in LIBRARY_TABLES:
            columns = ", ".join(
                f'"{f.name}" {SQL_TYPES[f.dataType.typeName()]}' for f in table_schema(table).fields
            )
            con.execute(f'CREATE TABLE "{table}" ({columns})')
        if self.table != "metadata":
            con.execute("INSERT INTO metadata VALUES ('version', ?)", (K.LIBRARY_VERSION,))
        return con

    def _store(self, con: sqlite3.Connection) -> str:
        # a task that runs twice writes two names; only the committed one is renamed
        # names order like the tasks and their shards, so that rows keep their order in a folder
        self.shards += 1
        context = TaskContext.get()     # None outside a task
        task = context.partitionId() if context else 0
        name = f"{self.table}-{task:06d}-{self.shards:06d}-{uuid.uuid4().hex}{SUFFIX}"
        con.commit()
        fs, inner = _file_system(self._pending(name))
        fs.create_dir(os.path.dirname(inner), recursive=True)
        image = con.serialize()
        con.close()     # the rows are in memory twice only while they are serialised
        with fs.open_output_stream(inner) as out:
            out.write(image)
        return name

    def write(self, batches: Iterator[pa.RecordBatch]) -> Shards:
        """Shards of bounded size, made in memory, so that no task needs a folder of its own."""
        names = ", ".join(f'"{n}"' for n in self.schema.names)
        marks = ", ".join("?" * len(self.schema.names))
        insert = f'INSERT INTO "{self.table}" ({names}) VALUES ({marks})'
        done, con, count, size = [], None, 0, 0
        # few rows at a time become Python objects, however many a batch holds
        parts = (batch.slice(i, ROWS_PER_BATCH) for batch in batches for i in range(0, batch.num_rows, ROWS_PER_BATCH))
        for part in parts:
            if con is None:
                con, count, size = self._shard(), 0, 0
            con.executemany(insert, zip(*[c.to_pylist() for c in part.columns]))
            count += part.num_rows
            size += part.nbytes
            if count >= ROWS_PER_SHARD or size >= SHARD_BYTES:
                done.append(self._store(con))
                con = None
        if con is not None and count:
            done.append(self._store(con))
        return Shards(done)

    def commit(self, messages) -> None:
        fs, base = _file_system(self.path)
        fs.create_dir(base, recursive=True)
        old = _library_files(self.path) if self.overwrite else []
        for name in [n for message in messages if message is not None for n in message.names]:
            fs.move(_file_system(self._pending(name))[1], f"{base}/{name}")
        for path, _ in old:
            fs.delete_file(_file_system(path)[1])
        self._drop_pending()

    def abort(self, messages) -> None:
        self._drop_pending()

    def _drop_pending(self) -> None:
        fs, inner = _file_system(f"{self.path}/.pending-{self.job}")
        if fs.get_file_info(inner).type == pafs.FileType.Directory:
            fs.delete_dir(inner)


class LibraryFiles(DataSource):
    """Options: ``path`` (full URI of a file or folder), ``table``, ``columns``, ``rows_per_partition``,
    ``provenance`` (``true``: also the file and the row number each row comes from)."""

    @classmethod
    def name(cls) -> str:
        return "dlib"

    def schema(self) -> StructType:
        full = table_schema(self.options.get("table", "entries"))
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        chosen = [full[c] for c in wanted] if wanted else full.fields
        return StructType([*chosen, *PROVENANCE] if self.options.get("provenance") == "true" else chosen)

    def reader(self, schema: StructType) -> LibraryReader:
        return LibraryReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> LibraryWriter:
        return LibraryWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LibraryFiles)


def read_dlib(spark: SparkSession, path: str, table: str = "entries", columns: list[str] | None = None, provenance: bool = False):
    """Rows of library files; with ``provenance`` also ``_path`` and ``_rowid``, which order all rows of a folder."""
    register(spark)
    reader = spark.read.format("dlib").option("path", qualified(spark, path)).option("table", table)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    if provenance:
        reader = reader.option("provenance", "true")
    return reader.load()


def write_dlib(df, path: str, table: str = "entries", overwrite: bool = True) -> None:
    from ionloom.sources.library import conform

    register(df.sparkSession)
    conform(df, table, packed=True).write.format("dlib").option("path", qualified(df.sparkSession, path)).option("table", table).mode(
        "overwrite" if overwrite else "append"
    ).save()
