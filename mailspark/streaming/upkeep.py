"""Keeping the stored search index and the unread counters in step with a stream of changes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailspark.operators.counters import after_changes, unread_deltas
from mailspark.operators.index import apply_changes, index_table, newest_changes, search_text
from mailspark.operators.postings import add_changes
from mailspark.schemas import mailbox_key

# Rows per bucket. New mail has new row ids, so a batch of changes touches few buckets.
BUCKET_ROWS = 1 << 20
# Tasks that share the rows of a bucket, each by its own file.
SHARES = 64


def _bucket(bucket_rows: int):
    return F.floor(F.col("rowid") / bucket_rows)


def _shared(placed: DataFrame) -> DataFrame:
    """Rows dealt by bucket and share of a bucket, so that no task holds a whole one."""
    return placed.repartition("bucket", F.pmod(F.xxhash64("rowid"), F.lit(SHARES)))


def write_buckets(table: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """Store a table by ranges of row ids; changes later rewrite only the buckets they touch."""
    placed = table.withColumn("bucket", _bucket(bucket_rows))
    _shared(placed).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _is_complete(spark: SparkSession, folder: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def upsert(spark: SparkSession, path: str, changes: DataFrame, change_set: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """Apply message changes (``op``, ``seq``, message columns) to the index stored at ``path``.

    New bucket contents are written aside first and then moved in by a partition overwrite. A
    ``change_set`` that was cut off while moving is finished from the files written aside, so a rerun
    is safe; its name must not be used for other changes.
    """
    staged = f"{path}/_staged/{change_set}"
    if not _is_complete(spark, staged):
        newest = newest_changes(changes)
        texts = search_text(newest).join(newest.select("rowid", "op", "seq"), "rowid")
        rows = index_table(texts).join(texts.select("rowid", "op", "seq"), "rowid")
        touched = newest.select(_bucket(bucket_rows).alias("bucket")).distinct()
        current = spark.read.parquet(path).filter(F.col("rowid").isNotNull()).join(touched, "bucket", "left_semi").drop("bucket")
        after = apply_changes(current, rows).withColumn("bucket", _bucket(bucket_rows))
        after.unionByName(touched, allowMissingColumns=True).write.mode("overwrite").parquet(staged)
    out = _shared(spark.read.parquet(staged)).write.mode("overwrite").partitionBy("bucket")
    out.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; rows that only mark an emptied bucket are left out."""
    return spark.read.parquet(path).filter(F.col("rowid").isNotNull()).drop("bucket")


def follow_changes(changes: DataFrame, path: str, checkpoint: str, bucket_rows: int = BUCKET_ROWS) -> StreamingQuery:
    """Apply a stream of message changes to the stored index."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()

    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.sparkSession, path, batch, f"{stream}-{batch_id}", bucket_rows)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def follow_postings(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add a stream of message changes to the stored postings, one generation a batch; a batch that comes again is not added twice."""
    stream = hashlib.md5(checkpoint.encode()).hexdigest()

    def add(batch: DataFrame, batch_id: int) -> None:
        add_changes(batch.sparkSession, path, batch, f"{stream}-{batch_id}")

    writer = changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def follow_unread(
    changes: DataFrame, folders: DataFrame, start: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Unread counters kept by a stream of changes: ``start`` (folder_id, unread_count) plus all steps so far, never below zero on the way.

    Each batch reads the counters of the batch before and writes its own (one row per folder), so the cost of a batch does not grow
    with the stream, and a repeated batch gives the same counters. Steps are folded in blocks of their sequence, so one busy folder is
    shared by many tasks. Batches must come in the order of ``seq``.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = start if batch_id == 0 else spark.read.parquet(f"{sink}/batch={batch_id - 1}")
        after = after_changes(before.select(*mailbox_key(before), "folder_id", "unread_count"), unread_deltas(batch, folders))
        after.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_unread(spark: SparkSession, sink: str) -> DataFrame:
    """folder_id (with its mailbox, where there are several) and unread_count as of the last batch."""
    stored = spark.read.option("basePath", sink).parquet(sink)
    last = stored.agg(F.max("batch")).scalar()
    return stored.filter(F.col("batch") == last).select(*mailbox_key(stored), "folder_id", "unread_count")
