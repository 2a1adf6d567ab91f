"""SQLite files as a Spark source and sink: spark.dataSource.register(SqliteSource), then format("recordloom-sqlite").

Reading: `path` is a file or a folder of files, `table` its table. A file is cut into ranges of row ids, a partition
each, so a large file is read by many tasks. Writing: each partition is a file of its own in the folder `path`, written beside its
final name; the commit moves the files of the tasks that succeeded into place and then writes a manifest, and an aborted
job leaves none. Files must lie where all executors see them, as any input does: SQLite opens files, not streams.

Types: whole numbers INTEGER, float and double REAL, string TEXT, binary BLOB, boolean INTEGER 0/1, timestamps and
dates ISO text. Others are refused before anything is written."""

from __future__ import annotations

import datetime
import glob
import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType

_KINDS = {ByteType: "INTEGER", ShortType: "INTEGER", IntegerType: "INTEGER", LongType: "INTEGER", BooleanType: "INTEGER", FloatType: "REAL", DoubleType: "REAL", StringType: "TEXT", BinaryType: "BLOB", TimestampType: "TEXT", TimestampNTZType: "TEXT", DateType: "TEXT"}
MANIFEST = "manifest.json"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError("SQLite files must lie in a file system that all executors mount")
    return path.removeprefix("file://")


def _files(path: str) -> list[str]:
    return sorted(glob.glob(f"{path}/*.sqlite")) if os.path.isdir(path) else [path]


def _open(file: str) -> sqlite3.Connection:
    if not os.path.exists(file):
        raise FileNotFoundError(file)
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordloom-sqlite"

    def _about(self) -> tuple[str, str]:
        return _local(self.options["path"]), self.options.get("table", "rows")

    def schema(self) -> StructType:
        path, table = self._about()
        files = _files(path)
        if not files:
            raise FileNotFoundError(f"no SQLite file in {path}")
        db = _open(files[0])
        try:
            known = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        finally:
            db.close()
        if not known:
            raise ValueError(f"no table {table} in {files[0]}")
        kinds = {"INTEGER": LongType(), "REAL": DoubleType(), "BLOB": BinaryType()}
        return StructType([StructField(c[1], kinds.get(c[2].upper(), StringType())) for c in known])

    def reader(self, schema: StructType) -> DataSourceReader:
        path, table = self._about()
        return _Reader(path, table, schema, int(self.options.get("rows", "100000")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path, table = self._about()
        return _Writer(path, table, schema, overwrite)


@dataclass
class _Range(InputPartition):
    file: str
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, rows: int):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows

    def partitions(self) -> list[_Range]:
        out = []
        for file in _files(self.path):
            db = _open(file)
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()  # two looks at the tree
            finally:
                db.close()
            if low is not None:
                out += [_Range(file, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        if part is None:
            return
        from_text = [_reads(f) for f in self.schema.fields]
        db = _open(part.file)
        try:
            columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
            for row in db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (part.low, part.high)):
                yield tuple(v if v is None or read is None else read(v) for v, read in zip(row, from_text))
        finally:
            db.close()


def _reads(field: StructField):
    kind = type(field.dataType)
    if kind in (TimestampType, TimestampNTZType):
        return datetime.datetime.fromisoformat
    return datetime.date.fromisoformat if kind is DateType else bool if kind is BooleanType else float if kind in (FloatType, DoubleType) else None


@dataclass
class _Written(WriterCommitMessage):
    made: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, table: str, schema: StructType, overwrite: bool):
        for f in schema.fields:
            if type(f.dataType) not in _KINDS:
                raise ValueError(f"{f.name}: {f.dataType.simpleString()} has no place in SQLite")
        self.path, self.table, self.schema, self.overwrite, self.job = path, table, schema, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        made = f"{self.path}/.{self.job}-{uuid.uuid4().hex}"
        db = sqlite3.connect(made)
        n = 0
        try:
            db.execute("PRAGMA journal_mode = OFF")  # the file is thrown away unless it is whole
            db.execute("PRAGMA synchronous = OFF")
            columns = ", ".join(f"{_quoted(f.name)} {_KINDS[type(f.dataType)]}" for f in self.schema.fields)
            db.execute(f"CREATE TABLE {_quoted(self.table)} ({columns})")
            put = f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(self.schema.fields))})"
            held = []
            for row in rows:
                held.append(tuple(v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else int(v) if isinstance(v, bool) else bytes(v) if isinstance(v, bytearray) else v for v in row))
                n += 1
                if len(held) == 10_000:
                    db.executemany(put, held)
                    held = []
            db.executemany(put, held)
            db.commit()
        finally:
            db.close()
        return _Written(made, n)

    def commit(self, messages: list) -> None:
        old = _files(self.path) if self.overwrite else []
        known = {} if self.overwrite or not os.path.exists(f"{self.path}/{MANIFEST}") else json.load(open(f"{self.path}/{MANIFEST}"))
        files = dict(known.get("files", {}))
        for i, m in enumerate(m for m in messages if m is not None):
            name = f"part-{self.job}-{i:05d}.sqlite"
            os.replace(m.made, f"{self.path}/{name}")
            files[name] = m.rows
        beside = f"{self.path}/.{self.job}-manifest"
        with open(beside, "w") as f:
            json.dump({"table": self.table, "rows": sum(files.values()), "files": files}, f)
        os.replace(beside, f"{self.path}/{MANIFEST}")
        for f in old:
            os.unlink(f)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Also what tasks that were run twice have left."""
        for f in glob.glob(f"{self.path}/.{self.job}-*"):
            os.unlink(f)


def manifest(path: str) -> dict:
    with open(f"{_local(path)}/{MANIFEST}") as f:
        return json.load(f)
