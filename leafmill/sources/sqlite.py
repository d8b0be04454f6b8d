"""SQLite files as tables, read in parallel by row id, and copied with their row counts checked."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.sources import files

#: Rows of an Arrow batch.
BATCH = 4096
#: Parts of SQLite's type names to types of Spark, in the order in which SQLite looks for them.
KINDS = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}


def connected(path: str) -> closing:
    """A connection that can't write."""
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind_of(declared: str) -> str:
    """The type of a column by its declaration; dates, decimals and unknown ones are read as text."""
    return next((kind for part, kind in KINDS.items() if part in declared.upper()), "string")


def exists(path: str, table: str) -> bool:
    """Whether a file has a table."""
    with connected(path) as db:
        return db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [table]).fetchone() is not None


class Rows(InputPartition):
    """A range of row ids; without ends all rows (tables that have no row id)."""

    def __init__(self, first: int | None, last: int | None) -> None:
        self.first, self.last = first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict, columns: dict[str, str]) -> None:
        self.path, self.table, self.parts, self.columns = options["path"], options["table"], int(options.get("partitions", "8")), columns

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids of equal length; ids that were deleted make some of them shorter."""
        with connected(self.path) as db:
            try:
                first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # WITHOUT ROWID
                return [Rows(None, None)]
        if first is None:
            return [Rows(0, -1)]
        step = max(1, -(-(last - first + 1) // self.parts))
        return [Rows(a, min(a + step - 1, last)) for a in range(first, last + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        names = ", ".join(map(quoted, self.columns))
        where = "" if partition.first is None else f" WHERE rowid BETWEEN {partition.first} AND {partition.last}"
        kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
        with connected(self.path) as db:
            found = db.execute(f"SELECT {names} FROM {quoted(self.table)}{where}")
            while rows := found.fetchmany(BATCH):
                columns = [[cast(v, kind) for v in column] for column, kind in zip(zip(*rows), self.columns.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, self.columns.values())], names=list(self.columns))


def cast(value: object, kind: str) -> object:
    """A value as its column's type; SQLite lets a column hold anything, and what doesn't fit is null."""
    if value is None:
        return None
    try:
        if kind == "bigint":
            return int(value)
        if kind == "double":
            return float(value)
        if kind == "binary":
            return value if isinstance(value, bytes) else str(value).encode()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (ValueError, OverflowError):
        return None


class Source(DataSource):
    """``spark.read.format("sqlite").option("path", file).option("table", name)``; the file has to be on storage that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def columns(self) -> dict[str, str]:
        with connected(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']}")
        return {name: kind_of(declared or "") for _, name, declared, *_ in found}

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self.columns().items())

    def reader(self, schema: object) -> Reader:
        return Reader(dict(self.options), self.columns())


def table(spark: SparkSession, path: str, name: str, partitions: int = 8) -> DataFrame:
    """A table of an SQLite file."""
    spark.dataSource.register(Source)
    return spark.read.format("sqlite").option("path", path).option("table", name).option("partitions", partitions).load()


def migrated(spark: SparkSession, path: str, to: str, dates: dict[str, list[str]], default: str) -> DataFrame:
    """Copy the tables named in ``dates`` (table to its date columns) as Parquet; (table, source_rows, target_rows, complete) of each.

    Tables that the file lacks are left out. What is no date becomes ``default``.
    Numbers are milliseconds since 1970. Each table is counted on both sides.
    """
    report = []
    for name, columns in dates.items():
        if not exists(path, name):
            continue
        source = table(spark, path, name)
        texts = {c: F.when(F.col(c).rlike("^-?[0-9]+$"), F.timestamp_millis(F.col(c).try_cast("bigint")).cast("string")).otherwise(F.col(c)) for c in columns}
        files.copied(source.withColumns(texts), columns, default).write.mode("overwrite").parquet(f"{to}/{name}")
        with connected(path) as db:
            n = db.execute(f"SELECT count(*) FROM {quoted(name)}").fetchone()[0]
        copied = spark.read.parquet(f"{to}/{name}").count()
        report.append((name, n, copied, n == copied))
    return spark.createDataFrame(report, "table string, source_rows long, target_rows long, complete boolean")
