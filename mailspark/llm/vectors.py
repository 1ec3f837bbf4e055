"""What the vector operators share: rows in blocks, a stated set of query rows met with every block, best rows of each query.

Blocks are table rows that hold a few thousand vectors as binary columns. A set of query rows is cut into groups the same way, and every
group meets every block by an equi-join on the group's number. The groups are broadcast only when their bytes, counted beforehand, are few;
otherwise blocks are dealt over salted keys, so that one group is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and queries of a group.
BLOCK_ROWS, GROUP_ROWS = 4096, 512
#: Groups of all queries together are broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20
#: Tasks that share one group when it is not broadcast.
SPREAD = 16


def finite(vector: str) -> Column:
    """Whether a vector column holds a vector without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows of doubles; shorter ones are filled with zeros."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(sizes) * width and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task as batches of ``rows``, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            some = batch.slice(0, rows - n)
            held.append(some)
            n += some.num_rows
            batch = batch.slice(some.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def one_row(**columns: object) -> pa.RecordBatch:
    """A batch of one row; arrays become binary values."""
    raw = {k: pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v], pa.int64()) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(raw.values()), names=list(raw))


def row_of(batch: pa.RecordBatch, k: int) -> dict:
    """Row ``k`` of a batch as Python values; binary ones as bytes."""
    return {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def grouped(queries: DataFrame, count: int, *order: str) -> DataFrame:
    """``queries`` dealt into groups of about GROUP_ROWS by ranges of ``order``, numbered from 0 in column ``group_no``."""
    return queries.repartitionByRange(max(1, -(-count // GROUP_ROWS)), *order).withColumn("group_no", F.spark_partition_id())


def met(blocks: DataFrame, groups: DataFrame, keys: list[str], bytes_of_groups: int) -> DataFrame:
    """Every block beside every group that has the same ``keys``. ``bytes_of_groups`` bounds what a broadcast would send."""
    if bytes_of_groups <= BROADCAST_BYTES:
        return blocks.join(F.broadcast(groups), keys)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return blocks.withColumn("salt", F.pmod(F.xxhash64("block_no"), F.lit(SPREAD)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def met_by_all(blocks: DataFrame, groups: DataFrame, bytes_of_groups: int) -> DataFrame:
    """Every block beside every group."""
    last = groups.agg(F.max("group_no")).first()[0]
    numbers = F.sequence(F.lit(0), F.lit(last)) if last is not None else F.array().cast("array<int>")
    return met(blocks.withColumn("group_no", F.explode(numbers)), groups, ["group_no"], bytes_of_groups)


def best(found: DataFrame, keys: list[str], order: list[Column], count: int, rank: str = "rank") -> DataFrame:
    """The first ``count`` rows of every key. Spark cuts each task's rows to as many before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn(rank, place).filter(F.col(rank) <= count)


def top(score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` highest scores, ties by smaller id; any order."""
    if len(score) <= count:
        return np.arange(len(score))
    least = np.partition(score, len(score) - count)[len(score) - count]
    sure, level = np.flatnonzero(score > least), np.flatnonzero(score == least)
    return np.concatenate([sure, level[np.argsort(ids[level], kind="stable")[: count - len(sure)]]])
