"""Hard-negative mining with exact integer inner products, several candidates to a multiplication.

Components become integers. A *word* holds the same component of several candidates, each raised by a bias so that it is not negative
and put into a field of its own bits. Multiplying a word by an anchor's (raised) component multiplies every field at once, and adding
up the products over all components leaves each candidate's sum in its field, as the fields are as wide as the largest possible sum.
Taking the biases out again gives the exact inner product.

Rows lie in blocks by label. Anchors, in groups, meet every block twice: first to find their positives (only the rows of a block that
share a label with the group are multiplied), then, knowing the positives' scores, to find the negatives. Each task keeps the first few
rows of every anchor, or of every anchor and positive, and Spark merges those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import stored
from mailspark.llm.vectors import BLOCK_ROWS, best, cut, finite, grouped, matrix, met_by_all, one_row, row_of, top

LONG = (1 << 63) - 1
#: Sums of at most this many bits are multiplied as 64-bit words, so that 100 times a score still fits; wider ones as Python integers.
NARROW = 56
#: Fields of a word of Python integers.
WIDE_FIELDS = 8


class Packing:
    """How components from ``low`` to ``high`` of vectors of ``size`` components lie in words."""

    def __init__(self, low: int, high: int, size: int) -> None:
        self.bias, self.size = -low, size
        self.bits = max(1, (size * (high - low) ** 2).bit_length())
        self.narrow = self.bits <= NARROW
        self.fields = 64 // self.bits if self.narrow else WIDE_FIELDS

    def raised(self, rows: np.ndarray) -> np.ndarray:
        """Components plus the bias; ``rows`` are doubles that hold integers."""
        if self.narrow:
            return (rows.astype(np.int64) + self.bias).astype(np.uint64)
        return np.array([[int(x) + self.bias for x in row] for row in rows], dtype=object).reshape(rows.shape)

    def packed(self, raised: np.ndarray) -> np.ndarray:
        """Words (rows / fields, components)."""
        missing = -len(raised) % self.fields
        filled = np.concatenate([raised, np.zeros((missing, self.size), dtype=raised.dtype)])
        words = np.zeros((len(filled) // self.fields, self.size), dtype=raised.dtype)
        for k in range(self.fields):
            words |= filled[k :: self.fields] << self._shift(k)
        return words

    def _shift(self, k: int) -> object:
        return np.uint64(k * self.bits) if self.narrow else k * self.bits

    def scores(self, words: np.ndarray, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Inner products (row, anchor); ``rows`` and ``anchors`` are raised components, ``words`` the packed rows."""
        products = words @ anchors.T
        out = np.zeros((len(words) * self.fields, len(anchors)), dtype=products.dtype)
        mask = np.uint64((1 << self.bits) - 1) if self.narrow else (1 << self.bits) - 1
        for k in range(self.fields):
            out[k :: self.fields] = (products >> self._shift(k)) & mask
        kind = np.int64 if self.narrow else object
        # sum (a + b)(c + b) = sum ac + b (sum (a + b) + sum (c + b)) - size b^2
        extra = self.bias * (rows.sum(1).astype(kind)[:, None] + anchors.sum(1).astype(kind)[None, :]) - self.size * self.bias**2
        return out[: len(rows)].astype(kind) - extra


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _block_task(size: int) -> Callable:
    """Blocks of rows (vec_id, label, anchor, vector) that come by label."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(cut(batches, BLOCK_ROWS)):
            yield one_row(
                block_no=(part << 32) + k, vec_ids=_longs(batch.column(0)), labels=_longs(batch.column(1)),
                anchors=batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), rows=np.floor(256 * matrix(batch.column(3), size)),
            )

    return task


BLOCKS = "block_no bigint, vec_ids binary, labels binary, anchors binary, rows binary"


class Block:
    """The arrays of a stored block."""

    def __init__(self, row: dict, size: int) -> None:
        self.ids, self.labels = np.frombuffer(row["vec_ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.rows = np.frombuffer(row["rows"], np.float64).reshape(-1, size)
        self.keys = row["block_no"] * BLOCK_ROWS + np.arange(len(self.ids))


def _anchor_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor_key, anchor_id, label, vector) of the anchors in blocks; a key names one row of the table."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = row_of(batch, k)
            at = np.flatnonzero(np.frombuffer(row["anchors"], np.uint8))
            width = len(row["rows"]) // max(1, len(row["anchors"]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["block_no"] * BLOCK_ROWS + at, pa.int64()), pa.array(np.frombuffer(row["vec_ids"], np.int64)[at]),
                    pa.array(np.frombuffer(row["labels"], np.int64)[at]), pa.array([row["rows"][i * width : (i + 1) * width] for i in at.tolist()], pa.binary()),
                ],
                names=["anchor_key", "anchor_id", "label", "vector"],
            )


class Group:
    """Anchors of a group row; ``wanted`` holds each one's positives as (id, score) when they are known."""

    def __init__(self, row: dict, packing: Packing) -> None:
        self.keys, self.ids, self.labels = row["anchor_keys"], row["anchor_ids"], np.array(row["anchor_labels"], dtype=np.int64)
        self.raised = packing.raised(np.frombuffer(b"".join(row["vectors"]), np.float64).reshape(-1, packing.size))
        self.wanted = row.get("wanted")


def _long(scores: list) -> pa.Array:
    return pa.array([max(-LONG - 1, min(LONG, int(s))) for s in scores], pa.int64())


def _positive_task(packing: Packing, count: int) -> Callable:
    """(anchor_key, anchor_id, positive_id, exact, positive_score): the first ``count`` rows of each anchor's label in a block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = row_of(batch, k)
                block, group = Block(row, packing.size), Group(row, packing)
                keys, anchors, found, scores = [], [], [], []
                for label in np.intersect1d(block.labels, group.labels):
                    here, there = np.flatnonzero(block.labels == label), np.flatnonzero(group.labels == label)
                    raised = packing.raised(block.rows[here])
                    table = packing.scores(packing.packed(raised), raised, group.raised[there])
                    for column, a in enumerate(there.tolist()):
                        others = here != group.keys[a] - row["block_no"] * BLOCK_ROWS
                        score, ids = table[others, column], block.ids[here[others]]
                        some = top(score, ids, count)
                        keys += [group.keys[a]] * len(some)
                        anchors += [group.ids[a]] * len(some)
                        found += ids[some].tolist()
                        scores += score[some].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(anchors, pa.int64()), pa.array(found, pa.int64()), pa.array(map(_sortable, scores), pa.string())],
                    names=["anchor_key", "anchor_id", "positive_id", "exact"],
                )

    return task


def _sortable(score: int) -> str:
    """Text that sorts as the numbers do, for integers of any size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


def _number(text: str) -> int:
    """Inverse of ``_sortable``."""
    return int(text[5:]) if text[0] == "1" else -int("".join(str(9 - int(d)) for d in text[5:]))


def _negative_task(packing: Packing, count: int, low: int, high: int) -> Callable:
    """(anchor_key, anchor_id, positive_no, positive_id, negative_id, exact, positive_score, negative_score) of a block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = row_of(batch, k)
                block, group = Block(row, packing.size), Group(row, packing)
                raised = packing.raised(block.rows)
                table = packing.scores(packing.packed(raised), raised, group.raised)
                out = [[] for _ in range(7)]
                for a, wanted in enumerate(group.wanted):
                    score = table[:, a]
                    other = np.flatnonzero(block.labels != group.labels[a])
                    score, ids = score[other], block.ids[other]
                    hundred = 100 * score
                    for positive in wanted or ():
                        exact = _number(positive["exact"])
                        fits = np.flatnonzero((hundred >= low * exact) & (hundred <= high * exact))
                        some = fits[top(score[fits], ids[fits], count)]
                        n = len(some)
                        for held, more in zip(out, ([group.keys[a]] * n, [group.ids[a]] * n, [positive["rank"]] * n, [positive["positive_id"]] * n, ids[some].tolist(), score[some].tolist(), [exact] * n)):
                            held += more
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x, pa.int64()) for x in out[:2]), pa.array(out[2], pa.int32()), *(pa.array(x, pa.int64()) for x in out[3:5]),
                        pa.array(map(_sortable, out[5]), pa.string()), _long(out[6]), _long(out[5]),
                    ],
                    names=["anchor_key", "anchor_id", "positive_no", "positive_id", "negative_id", "exact", "positive_score", "negative_score"],
                )

    return task


def hard_negatives(
    spark: SparkSession, table: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """Negatives of other labels that score between ``low`` and ``high`` percent of an anchor's positive.

    ``table`` has vec_id, label and embedding; other columns are not read, whatever their names. ``anchors`` says which rows are anchors
    (null: not). A component x counts as floor(256 x). An anchor's positives are its ``positives`` best other rows of the same
    label; for each, the first ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive are
    returned as anchor_id, positive_id, rank, negative_id, positive_score, negative_score, best first, ties by smaller id.

    Rows without vec_id or label, or whose vector is null or has a null or non-finite component (also after the multiplication by
    256) take no part. A shorter vector counts as filled up with zeros. Repeated ids are rows of their own, so they may be each other's
    positives and their results come once for each. Scores are compared exactly at any size; those beyond 64 bits are
    returned as the nearest long. An empty table, or one without anchors, gives no rows.
    """
    rows = table.select("vec_id", "label", F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("vector"))
    largest = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(256 * x))), F.lit(0.0))
    rows = rows.filter(largest < F.lit(float("inf")))
    # extremes of 256 x; floor moves the lower one by less than one
    facts = rows.agg(F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector")), F.count_if("anchor")).first()
    size, least, most, count = max(1, facts[0] or 0), facts[1] or 0.0, facts[2] or 0.0, facts[3]
    packing = Packing(min(0, int(np.floor(256 * least))), max(0, int(np.floor(256 * most))), size)

    ranged = rows.repartitionByRange("label", "vec_id", F.xxhash64("vector")).sortWithinPartitions("label")
    blocks = stored(spark, ranged.select("vec_id", F.col("label").cast("long"), "anchor", "vector").mapInArrow(_block_task(size), BLOCKS), "vector-blocks")
    picked = blocks.mapInArrow(_anchor_task, "anchor_key bigint, anchor_id bigint, label bigint, vector binary")
    dealt = stored(spark, grouped(picked, count, "label", "anchor_key"), "anchors")
    columns = [F.collect_list(F.struct("anchor_key", "anchor_id", "label", "vector", *extra)).alias("members") for extra in ((), ("wanted",))]

    def groups(members: DataFrame, column: Column) -> DataFrame:
        # a group is one partition of ``grouped``, about GROUP_ROWS anchors
        return members.groupBy("group_no").agg(column).select(
            "group_no", *[F.col("members")[old].alias(new) for old, new in (("anchor_key", "anchor_keys"), ("anchor_id", "anchor_ids"), ("label", "anchor_labels"), ("vector", "vectors"))],
            *([F.col("members")["wanted"].alias("wanted")] if column is columns[1] else []),
        )

    weight = count * (8 * size + 64)
    first = met_by_all(blocks, groups(dealt, columns[0]), weight).mapInArrow(
        _positive_task(packing, positives), "anchor_key bigint, anchor_id bigint, positive_id bigint, exact string"
    )
    chosen = best(first, ["anchor_key"], [F.desc("exact"), F.asc("positive_id")], positives)
    chosen = chosen.groupBy("anchor_key").agg(F.collect_list(F.struct("rank", "positive_id", "exact")).alias("wanted"))
    known = stored(spark, dealt.join(chosen, "anchor_key"), "positives")
    schema = "anchor_key bigint, anchor_id bigint, positive_no int, positive_id bigint, negative_id bigint, exact string, positive_score bigint, negative_score bigint"
    second = met_by_all(blocks, groups(known, columns[1]), weight + count * positives * 64).mapInArrow(_negative_task(packing, negatives, low, high), schema)
    ranked = best(second, ["anchor_key", "positive_no"], [F.desc("exact"), F.asc("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
