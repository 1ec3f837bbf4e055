"""Mail tables kept as Parquet, one folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.functions.dates import utc_month
from mailspark.operators.index import with_index, with_instant
from mailspark.schemas import INDEX, MESSAGES, TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A mail table with its fixed schema; a missing folder is an ``AnalysisException``."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_messages(spark: SparkSession, root: str) -> DataFrame:
    """Messages as ingested, with ``ts``, the instant of the stored date text."""
    return with_instant(read_table(spark, root, "messages"))


def write_indexed(messages: DataFrame, path: str) -> None:
    """Store messages with their search index, by month of their date and sorted by instant inside a file.

    Date filters then skip month folders and row groups. Tasks get equal ranges of (month, instant, row
    id), so a month or a second holding much of the mail is shared by many tasks. The index is computed
    after that shuffle, which therefore moves the text once and not twice.
    """
    dated = with_instant(messages)
    dated = dated.withColumn("month", F.coalesce(utc_month(F.col("ts")), F.lit("none")))
    ranged = dated.repartitionByRange("month", "ts", "rowid")
    with_index(ranged).sortWithinPartitions("month", "ts").write.mode("overwrite").partitionBy("month").parquet(path)


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{MESSAGES}, {INDEX}").parquet(path)
