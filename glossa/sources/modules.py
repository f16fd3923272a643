"""SQLite files as a Spark data source, read in ranges of rowid by many tasks.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite_rows").option("table", "Bible").option("parts", 8).load("/shared/module.sqlite")

Every executor must see the files under the same path. Files are opened for reading only; a lost task reads its range again.
"""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Rows that a task holds at a time.
ROWS = 10_000
# Kinds of SQLite columns by what their declared type holds (its affinity rules).
KINDS = [("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType())]


def connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = lambda raw: raw.decode("utf-8", errors="replace")
    return con


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class SqliteSource(DataSource):
    """Option ``table``, ``parts`` (ranges of each file, 8 unless told); ``path`` may be a pattern of files with the same table."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def _files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        return sorted(glob.glob(path)) or [path]

    def schema(self) -> StructType:
        con = connect(self._files()[0])
        try:
            columns = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        finally:
            con.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']!r}")
        kind = lambda declared: next((k for mark, k in KINDS if mark in (declared or "").upper()), StringType())
        return StructType([StructField(c[1], kind(c[2])) for c in columns])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self._files(), self.options["table"], schema, int(self.options.get("parts", "8")))


class SqliteReader(DataSourceReader):
    def __init__(self, files: list[str], table: str, schema: StructType, parts: int) -> None:
        self.files, self.table, self.fields, self.parts = files, table, [(f.name, f.dataType) for f in schema.fields], parts

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.files:
            con = connect(path)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            finally:
                con.close()
            if low is None:
                continue
            width = -(-(high - low + 1) // self.parts)
            out += [Range(path, at, min(at + width - 1, high)) for at in range(low, high + 1, width)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition is None or not hasattr(partition, "path"):  # a table without rows has no ranges
            return
        con = connect(partition.path)
        casts = [{LongType: int, DoubleType: float, StringType: str}[type(k)] for _, k in self.fields]
        try:
            cursor = con.execute(f"SELECT {', '.join(quoted(n) for n, _ in self.fields)} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (partition.first, partition.last))
            while rows := cursor.fetchmany(ROWS):
                for row in rows:
                    yield tuple(_value(v, c) for v, c in zip(row, casts, strict=True))
        finally:
            con.close()


def _value(value, cast):
    """``value`` as the column's kind; what is none of it, as SQLite allows, is null."""
    if value is None or isinstance(value, bytes) and cast is not str:
        return None
    try:
        return value.decode("utf-8", errors="replace") if isinstance(value, bytes) else cast(value)
    except ValueError:
        return None
