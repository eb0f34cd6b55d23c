"""An index in a SQLite file, of this layout or an older one, as a Spark data source.

    spark.dataSource.register(SqliteTable)
    spark.read.format("strandloom_sqlite").option("path", file).option("table", "calls").load()

Tasks read ranges of row numbers, so a large table is read in parallel; all executors must
see the file.
"""

from __future__ import annotations

import datetime
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom import schema as S
from strandloom.sources.catalog import Catalog, Index, conform

#: Values of columns that older layouts lack, where they aren't empty.
_OLD = {("calls", "kind"): "call", ("unresolved_calls", "reason"): "unresolved"}
#: Row numbers in a partition, and rows in a batch.
RANGE, BATCH = 500_000, 10_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def _columns(path: str, table: str) -> list[str]:
    with _open(path) as db:
        return [r[1] for r in db.execute(f"PRAGMA table_info({table})")]


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.types = path, table, [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def partitions(self) -> list[_Range]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        return [] if low is None else [_Range(a, min(a + RANGE - 1, high)) for a in range(low, high + 1, RANGE)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
        convert = {"boolean": bool, "timestamp": lambda v: datetime.datetime.fromisoformat(v.replace("Z", "+00:00"))}
        with _open(self.path) as db:
            rows = db.execute(f"SELECT {', '.join(n for n, _ in self.types)} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last))
            while batch := rows.fetchmany(BATCH):
                columns = [[None if v is None or v == "" and kind == "timestamp" else convert.get(kind, lambda x: x)(v) for v in values] for values, (_, kind) in zip(zip(*batch), self.types)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, self.types)], [n for n, _ in self.types])


class SqliteTable(DataSource):
    """Options: ``path`` of the file and ``table``. The columns are those of the layout that the file has."""

    @classmethod
    def name(cls) -> str:
        return "strandloom_sqlite"

    def schema(self) -> T.StructType:
        table, have = self.options["table"], None
        if table in S.SCHEMAS:
            have = set(_columns(self.options["path"], table))
        if not have:
            raise ValueError(f"no table {table} of the index in {self.options['path']}")
        return T.StructType([f for f in S.SCHEMAS[table].fields if f.name in have])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema)


def read_sqlite(spark: SparkSession, path: str, table: str):
    """A table of the file with the columns of this layout; one that an older layout lacks is empty."""
    from pyspark.sql import functions as F

    have = _columns(path, table)
    if not have:
        return spark.createDataFrame([], S.SCHEMAS[table])
    spark.dataSource.register(SqliteTable)
    df = spark.read.format("strandloom_sqlite").option("path", path).option("table", table).load()
    for (t, column), value in _OLD.items():
        if t == table and column not in have:
            df = df.withColumn(column, F.lit(value))
    return conform(df, table)


def import_sqlite(catalog: Catalog, path: str) -> None:
    """Replaces the modules of the file in the index, and adds its runs."""
    tables = {name: read_sqlite(catalog.spark, path, name) for name in Index.__dataclass_fields__}
    runs = tables.pop("index_meta")
    catalog.migrate()
    catalog.replace(tables)
    catalog.append("index_meta", runs)
