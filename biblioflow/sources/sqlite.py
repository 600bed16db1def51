"""A Python data source over SQLite files: spark.read.format("sqlite").option("path", …).option("table", …).

Large tables are read in ranges of rowid, one partition each.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

# Declared column types of SQLite by their beginnings.
KINDS = [("INT", LongType()), ("BOOL", LongType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()), ("BLOB", BinaryType())]


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _connect(self.options["path"]) as db:
            columns = db.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        kind = lambda t: next((k for p, k in KINDS if (t or "").upper().startswith(p)), StringType())
        return StructType([StructField(c[1], kind(c[2])) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.size = int(options.get("rowsperpartition", 100_000))

    def partitions(self) -> list[InputPartition]:
        with _connect(self.path) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        return [Rows(i, min(i + self.size, high + 1)) for i in range(low, high + 1, self.size)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        make = [{"bigint": int, "double": float, "string": str}.get(f.dataType.simpleString(), bytes) for f in self.schema.fields]
        with _connect(self.path) as db:
            for row in db.execute(f"select {columns} from {_quoted(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high)):
                yield tuple(None if v is None else m(v) for m, v in zip(make, row))


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).load()


def schema_version(path: str) -> int:
    """The version that the database's owner gave its schema."""
    with _connect(path) as db:
        return db.execute("pragma user_version").fetchone()[0]


def intact(path: str) -> bool:
    with _connect(path) as db:
        return db.execute("pragma integrity_check").fetchone()[0] == "ok"
