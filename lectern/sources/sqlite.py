"""SQLite files as a batch source. A file is read on one executor by its path; a locked one is read from a copy."""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {"INT": "bigint", "BIGINT": "bigint", "BOOL": "bigint", "REAL": "double", "FLOAT": "double", "DOUBLE": "double", "BLOB": "binary"}
#: Row ids in a range, and ranges at most, unless a number of partitions is asked for.
ROWS, MOST_PARTS = 200_000, 256


def connect(path: str) -> tuple[sqlite3.Connection, str | None]:
    """A read-only connection, and the folder of the copy if one had to be made. Only a lock leads to a copy."""
    if os.path.isdir(path):
        path = os.path.join(path, "metadata.db")
    open_ro = lambda p: sqlite3.connect(f"file:{quote(p)}?mode=ro", uri=True)
    con = open_ro(path)
    try:
        con.execute("SELECT 1 FROM sqlite_master LIMIT 1").fetchone()
        return con, None
    except sqlite3.OperationalError as e:
        con.close()
        if "locked" not in str(e) and "busy" not in str(e):
            raise
    folder = tempfile.mkdtemp(prefix="lectern-")
    for suffix in ("", "-wal", "-shm"):
        if os.path.exists(path + suffix):
            shutil.copy2(path + suffix, os.path.join(folder, "copy.db" + suffix))
    return open_ro(os.path.join(folder, "copy.db")), folder


def _with(path: str, use):
    con, folder = connect(path)
    try:
        return use(con)
    finally:
        con.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def resolve(explicit: str | None = None, saved: str | None = None, places: tuple[str, ...] = ("metadata.db",)) -> str:
    """The path of a catalog: the one that is named, which must be there, else the saved one, else the first of the places that
    there is. A folder stands for the metadata.db in it."""
    for place in (explicit,) if explicit else (saved, *places):
        path = os.path.expanduser(place or "")
        path = os.path.join(path, "metadata.db") if os.path.isdir(path) else path
        if place and os.path.exists(path):
            return os.path.abspath(path)
    raise FileNotFoundError(f"no catalog at {explicit}" if explicit else "no catalog; name its path")


class _Range(InputPartition):
    def __init__(self, low, high):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema, parts: int):
        self.path, self.table, self.fields, self.parts = path, table, schema.fields, parts

    def partitions(self):
        """Ranges of row ids: as many as asked for, else one for each ROWS ids. A table without row ids is one range."""
        try:
            low, high = _with(self.path, lambda c: c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone())
        except sqlite3.OperationalError as e:
            if "rowid" not in str(e):
                raise
            return [_Range(None, None)]
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // (self.parts or min(MOST_PARTS, -(-(high - low + 1) // ROWS)))))
        return [_Range(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition):
        casts = {"bigint": int, "double": float, "string": str}
        kinds = [casts.get(f.dataType.simpleString(), lambda v: v) for f in self.fields]
        names = ", ".join(f'"{f.name}"' for f in self.fields)
        con, folder = connect(self.path)
        try:
            text = f'SELECT {names} FROM "{self.table}"'
            # A cursor is read row by row, so that a task holds no more than a batch.
            rows = con.execute(text) if partition.low is None else con.execute(f"{text} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            for row in rows:
                yield tuple(None if v is None else k(v) for k, v in zip(kinds, row))
        finally:
            con.close()
            if folder:
                shutil.rmtree(folder, ignore_errors=True)


class SqliteSource(DataSource):
    """spark.read.format("lectern_sqlite").option("path", ...).option("table", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "lectern_sqlite"

    def schema(self) -> str:
        table = self.options["table"]
        columns = _with(self.options["path"], lambda c: c.execute(f'PRAGMA table_info("{table}")').fetchall())
        if not columns:
            raise LookupError(f"no table {table}")
        kind = lambda declared: next((v for k, v in _KINDS.items() if k in (declared or "").upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", 0)))


def table_names(path: str) -> list[str]:
    return [r[0] for r in _with(path, lambda c: c.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall())]


def read_table(spark: SparkSession, path: str, name: str, partitions: int = 0) -> DataFrame:
    """One table; a table that is not there is a LookupError."""
    if name not in table_names(path):
        raise LookupError(f"no table {name}")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("lectern_sqlite").option("path", path).option("table", name).option("partitions", partitions).load()
