"""SQLite mail files as a Spark data source, for turning a folder of them into Parquet tables.

    spark.dataSource.register(MailFiles)
    spark.read.format("mailfiles").schema(MESSAGES).option("table", "messages").load("/share/mail/*.db")

Each file is read in row-id ranges sized by ``rangebytes``, so one big file is shared by many tasks.
The driver lists names and sizes only; the range bounds are looked up inside the tasks.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

IMPLICIT_COLUMNS = {"rowid"}


@dataclass
class FileRange(InputPartition):
    path: str
    part: int
    parts: int


class MailFileReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.fieldNames()
        self.table = options.get("table", "messages")
        if not re.fullmatch(r"[A-Za-z_]\w*", self.table):
            raise ValueError(f"bad table name {self.table!r}")
        self.pattern = options["path"]
        self.range_bytes = int(options.get("rangebytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        paths = sorted(glob.glob(self.pattern))
        if not paths:
            raise FileNotFoundError(f"no mail files at {self.pattern}")
        ranges = []
        for path in paths:
            parts = max(1, -(-os.path.getsize(path) // self.range_bytes))
            ranges += [FileRange(path, part, parts) for part in range(parts)]
        return ranges

    def read(self, partition: FileRange) -> Iterator[tuple]:
        mail = sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)
        try:
            mail.execute("PRAGMA query_only = 1")
            mail.execute("PRAGMA busy_timeout = 5000")
            low, high = mail.execute(f'SELECT MIN(rowid), MAX(rowid) FROM "{self.table}"').fetchone()
            if low is None:
                return
            stored = {row[1] for row in mail.execute(f'PRAGMA table_info("{self.table}")')} | IMPLICIT_COLUMNS
            wanted = ", ".join(f'"{c}"' if c in stored else "NULL" for c in self.columns)
            size = high - low + 1
            start = low + size * partition.part // partition.parts
            stop = low + size * (partition.part + 1) // partition.parts
            query = f'SELECT {wanted} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?'
            yield from mail.execute(query, (start, stop))
        finally:
            mail.close()


class MailFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailfiles"

    def reader(self, schema: StructType) -> MailFileReader:
        return MailFileReader(schema, self.options)


def ingest(spark, pattern: str, table: str, schema: StructType, out: str, range_bytes: int = 64 << 20) -> None:
    """Copy one table of every mail file at ``pattern`` into a Parquet folder."""
    spark.dataSource.register(MailFiles)
    rows = spark.read.format("mailfiles").schema(schema).option("table", table).option("rangebytes", range_bytes)
    rows.load(pattern).write.mode("overwrite").parquet(out)
