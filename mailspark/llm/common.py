"""Helpers the operators share: bulk word splitting over Arrow buffers, hashes, shared scratch tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.scratch import scratch_dir

#: Text bytes that are handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


#: Bytes of words: everything but white space, or letters, digits and all of non-ASCII (which is whole in UTF-8).
NOT_BLANK = ~byte_class(b" \t\n\r\x0b\x0c")
LETTERS = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    """The rows, computed once into a table of the shared scratch folder and read back from there."""
    path = scratch_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, INVERSE)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


@dataclass
class Words:
    """Words of some texts in order. doc: index of the text; start, end: byte offsets in data; lead: prefix sums for hashes."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    lead: np.ndarray

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand."""
        return mixed((self.lead[end] - self.lead[start]) * POWERS.upto(len(self.lead))[1][start] + (end - start).astype(np.uint64))


def split_words(data: np.ndarray, bounds: np.ndarray, members: np.ndarray) -> Words:
    """Maximal runs of member bytes within each text; data is lower-cased in ASCII."""
    data = LOWER_TABLE[data]
    inside = members[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    lead = np.zeros(len(data) + 1, dtype=np.uint64)
    # each byte value is spread over 64 bits first, so short words differ in all bits
    np.cumsum(SPREAD[data] * POWERS.upto(len(data) + 1)[0][: len(data)], dtype=np.uint64, out=lead[1:])
    doc = np.searchsorted(bounds, start, side="right") - 1
    return Words(data, doc, start, end, bounds, lead)


SPREAD = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, byte bounds of the rows) of a string column, about BLOCK_BYTES at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1)
        last = min(last, len(column))
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a two-dimensional array as one binary value."""
    n, width = len(rows), rows.itemsize * rows.shape[1]
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def from_fixed_binary(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Inverse of fixed_binary; width counts numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)
