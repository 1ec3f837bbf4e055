"""Token ids in compact files: length-limited canonical Huffman codes from global counts.

A token file set is a folder with two Parquet tables. ``codes`` (id, length) has the code length of each id; canonical codes follow from
the lengths. ``chunks`` has rows (part, chunk, ids of documents, token counts, checkpoints, bits): chunks in order of (part, chunk)
hold the documents in ascending order of doc_id, whole documents each. Within a chunk every block of ``BLOCK`` ids has a
checkpoint, the bit where it begins, so that blocks are decoded independently, all of a chunk side by side, with one table look-up
of ``LIMIT`` bits per id.

Spark does the order: texts are tokenized where they are read, and only the packed ids are dealt out by ranges of doc_id. Global
data on the driver are the id counts and code lengths, as many as the vocabulary has.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailspark.llm.common import stored, text_blocks
from mailspark.llm.pieces import Coder, kept
from mailspark.scratch import scratch_dir

LIMIT = 20
BLOCK = 256
CHUNK_IDS = 1 << 18
END_ID = 2
#: Pieces that are encoded as lines of one text.
LINES = 250
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


# --- tokenizing


@functools.cache
def code_point_classes() -> np.ndarray:
    import unicodedata

    table = np.zeros(0x110000, dtype=np.uint8)
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    table[[k == "L" for k in kinds]] = LETTER
    table[[k == "N" for k in kinds]] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def piece_starts(points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level BPE begin, for texts laid end to end (row_starts: flags, a text's first point).

    A piece is a contraction, or a run of letters, of numbers or of other marks with the one blank before it; white space
    leaves its last character to what follows.
    """
    kind = code_point_classes()[points]
    n = len(points)
    new = row_starts.copy()
    new[1:] |= kind[1:] != kind[:-1]
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = (points[:-1] == 32) & ~row_starts[1:]
    white = kind == SPACE
    # the last white character before something else of the same text
    last_white = np.zeros(n, dtype=bool)
    last_white[:-1] = white[:-1] & ~white[1:] & ~row_starts[1:]
    starts = (new & white) | last_white | (new & ~white & ~blank_before)
    marks = np.flatnonzero((points == 0x27) & new & ~blank_before)
    padded = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
    ends = np.concatenate([row_starts, np.ones(3, dtype=bool)])
    for word in CONTRACTIONS:
        hit = marks
        for k, letter in enumerate(word, 1):
            hit = hit[(padded[hit + k] == ord(letter)) & ~ends[hit + k]]
        starts[hit + 1] = False
        after = hit + 1 + len(word)
        after = after[after < n]
        starts[after[~row_starts[after] & ~white[after]]] = True
    return starts


class PieceCoder(Coder):
    """Ids of byte-level BPE of the tokenizers library.

    The strings of special tokens in a text become those tokens, as is the library's way, unless ``special_as_text``; such texts are
    encoded one by one.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.break_id = self.tokenizer.encode("\n", add_special_tokens=False).ids[-1]
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole_tokens = [t.content.encode() for t in added if not (t.special and special_as_text)]

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and whether they end in white space."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        first_byte = np.flatnonzero((data & 0xC0) != 0x80)
        row_points = np.searchsorted(first_byte, bounds)
        row_starts = np.zeros(len(points), dtype=bool)
        row_starts[row_points[:-1][row_points[:-1] < len(points)]] = True
        first_point = np.flatnonzero(piece_starts(points, row_starts))
        white = code_point_classes()[points[np.append(first_point[1:], len(points)) - 1]] == SPACE
        return first_byte[first_point], white

    def ids_of_pieces(self, pieces: list[bytes], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that do not end in white space are encoded as the lines of one text: a line break is a piece of its own between any two."""
        sizes = np.zeros(len(pieces), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for alone in (False, True):
            some = np.flatnonzero(marks == alone)
            for first in range(0, len(some), LINES):
                at = some[first : first + LINES]
                ids, begin, each = self._encoded([pieces[k] for k in at.tolist()], alone)
                sizes[at] = each
                parts.append((at, ids, begin))
        ahead = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        for at, ids, begin in parts:
            inside = np.arange(int(sizes[at].sum())) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
            out[np.repeat(ahead[at], sizes[at]) + inside] = ids[np.repeat(begin, sizes[at]) + inside]
        # byte-level tokens spell every text
        return out, sizes, np.ones(len(pieces), dtype=bool)

    def _encoded(self, pieces: list[bytes], alone: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each piece's first, number of each piece's)."""
        if not alone:
            ids = np.array(self._library([b"\n".join(pieces).decode()])[0], dtype=np.uint32)
            breaks = np.flatnonzero(ids == self.break_id)
            if len(breaks) == len(pieces) - 1:
                begin = np.concatenate([[0], breaks + 1])
                return ids, begin, np.append(breaks, len(ids)) - begin
        each = self._library([p.decode() for p in pieces])
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return np.array([k for e in each for k in e], dtype=np.uint32), np.cumsum(sizes) - sizes, sizes

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        ids, sizes, _ = self.encode_whole(data, bounds)
        raw = data.tobytes()
        if not any(token in raw for token in self.whole_tokens):
            return ids, sizes
        each = np.split(ids, np.cumsum(sizes)[:-1])
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if any(token in raw[a:b] for token in self.whole_tokens):
                each[k] = np.array(self._library([raw[a:b].decode()])[0], dtype=np.uint32)
        return np.concatenate(each), np.array([len(e) for e in each], dtype=np.int64)


def tokenize_task(path: str, end_id: int) -> Callable:
    """(doc_id, text_key, n_tokens, packed) of rows (doc_id, text_key, text)."""

    job = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, press = kept(job, PieceCoder, path), zstandard.ZstdCompressor(level=1)
        width = np.uint16 if max(end_id, coder.tokenizer.get_vocab_size()) < 1 << 16 else np.uint32
        for batch in batches:
            for first, rows, data, bounds in text_blocks(batch.column(2)):
                ids, sizes = coder.encode(data, bounds)
                packed = [press.compress(np.append(x, np.uint32(end_id)).astype(width).tobytes()) for x in np.split(ids, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(sizes + 1), pa.array(packed, pa.binary())],
                    names=["doc_id", "text_key", "n_tokens", "packed"],
                )

    return task


def unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, dtype=np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.uint32)


def id_counts_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) over the rows (n_tokens, packed) of one task."""
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for n, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.bincount(unpacked(packed.as_py(), n), minlength=len(total))
            counts[: len(total)] += total
            total = counts
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])


# --- codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge; one symbol gets one bit."""
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    packages, is_leaf = np.zeros(0), []
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        place = np.argsort(merged, kind="stable")
        is_leaf.append(place < n)
        merged = merged[place]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.zeros(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        widths = np.uint64(1) << (LIMIT - self.lengths).astype(np.uint64)
        left = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.uint64) if len(ids) else np.zeros(0, dtype=np.uint64)
        self.codes = left >> (LIMIT - self.lengths).astype(np.uint64)
        self.widths = widths

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        codes, lengths = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        codes[self.ids], lengths[self.ids] = self.codes, self.lengths
        return codes, lengths

    def decoder(self) -> np.ndarray:
        """For each LIMIT bits: id * 32 + length of the code they begin with."""
        table = np.ones(1 << LIMIT, dtype=np.int64)
        filled = np.repeat(self.ids.astype(np.int64) * 32 + self.lengths, self.widths.astype(np.int64))
        table[: len(filled)] = filled
        return table


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(bits as big-endian 32-bit words, checkpoints as unsigned 64-bit bit offsets)."""
    if not len(ids):
        return b"", b""
    size = lengths[ids]
    end = np.cumsum(size)
    begin = end - size
    word, inside = begin >> 5, (begin & 31).astype(np.uint64)
    value = codes[ids] << (np.uint64(64) - size.astype(np.uint64) - inside)
    first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    words = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(value >> np.uint64(32), first)
    words[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), begin[::BLOCK].astype("<u8").tobytes()


def decode_bits(bits: bytes, checkpoints: bytes, n: int, table: np.ndarray) -> np.ndarray:
    """The n ids; all blocks advance side by side."""
    if not n:
        return np.zeros(0, dtype=np.uint32)
    at = np.frombuffer(checkpoints, dtype="<u8").astype(np.int64)
    words = np.concatenate([np.frombuffer(bits, dtype=">u4").astype(np.uint64), np.zeros(2, dtype=np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    out, last = np.zeros((BLOCK, len(at)), dtype=np.uint32), len(pairs) - 1
    shift = np.uint64(64 - LIMIT)
    for k in range(min(BLOCK, n)):
        window = (pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> shift
        entry = table[window]
        out[k] = entry >> 5
        at = at + (entry & 31)
    return out.T.ravel()[:n]


CHUNKS = "part int, chunk int, doc_ids array<{id}>, sizes array<bigint>, checkpoints binary, bits binary"


def chunk_task(ids: np.ndarray, lengths: np.ndarray) -> Callable:
    """Chunks of rows (doc_id, n_tokens, packed) that come in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes_of = Code(ids, lengths).encoder()
        part, chunk, total, held, sizes, keys, kind = TaskContext.get().partitionId(), 0, 0, [], [], [], None

        def closed() -> pa.RecordBatch:
            bits, checkpoints = encode_bits(np.concatenate(held), codes, sizes_of)
            columns = [
                pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([keys], pa.list_(kind)),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([checkpoints]), pa.array([bits]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "doc_ids", "sizes", "checkpoints", "bits"])

        for batch in batches:
            kind = batch.column(0).type
            for key, n, packed in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                held.append(unpacked(packed.as_py(), n))
                sizes.append(n)
                keys.append(key.as_py())
                total += n
                if total >= CHUNK_IDS:
                    yield closed()
                    chunk, total, held, sizes, keys = chunk + 1, 0, [], [], []
        if held:
            yield closed()

    return task


def read_task(ids: np.ndarray, lengths: np.ndarray) -> Callable:
    """(part, chunk, doc_id, ahead, n_tokens, ids_crc32) of chunk rows; ahead counts the ids before in the chunk."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Code(ids, lengths).decoder()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                sizes = np.asarray(row["sizes"].values)
                end = np.cumsum(sizes)
                tokens = decode_bits(row["bits"].as_py(), row["checkpoints"].as_py(), int(end[-1]), table).astype("<u4")
                raw = memoryview(tokens.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), sizes.tolist())]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["chunk"].as_py()] * n, pa.int32()), row["doc_ids"].values,
                        pa.array(end - sizes), pa.array(sizes), pa.array(crc, pa.int64()),
                    ],
                    names=["part", "chunk", "doc_id", "ahead", "n_tokens", "ids_crc32"],
                )

    return task


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Tokenize every text of ``docs`` (doc_id, text; null text is empty), append ``end_id``, and write the files in order of doc_id.

    Rows of one doc_id come in order of a hash of their texts, null ids first. Repeated rows are written as often as they come; other
    columns are not read; an empty table gives files without chunks.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    packed = stored(spark, rows.mapInArrow(tokenize_task(tokenizer, end_id), f"doc_id {id_type}, text_key bigint, n_tokens bigint, packed binary"), "token-ids")
    counts = packed.select("n_tokens", "packed").mapInArrow(id_counts_task, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    ids, lengths = counts["id"].to_numpy(dtype=np.int64), code_lengths(counts["n"].to_numpy(dtype=np.int64))
    spark.createDataFrame(pa.table({"id": pa.array(ids), "length": pa.array(lengths)})).write.parquet(f"{path}/codes")
    ordered = packed.repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    chunks = ordered.select("doc_id", "n_tokens", "packed").mapInArrow(chunk_task(ids, lengths), CHUNKS.format(id=id_type))
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").toPandas()
    chunks = spark.read.parquet(f"{path}/chunks")
    id_type = chunks.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = chunks.select("part", "chunk", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n"))
    # one row per part, as many as the writer had partitions; then chunks within their part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = sizes.withColumn("chunk_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "chunk", (F.col("part_start") + F.col("chunk_start")).alias("chunk_start"))
    columns = f"part int, chunk int, doc_id {id_type}, ahead bigint, n_tokens bigint, ids_crc32 bigint"
    rows = chunks.mapInArrow(read_task(codes["id"].to_numpy(dtype=np.int64), codes["length"].to_numpy(dtype=np.int64)), columns)
    return rows.join(starts, ["part", "chunk"]).select("doc_id", (F.col("chunk_start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files to a new scratch folder and read them back."""
    path = scratch_dir(spark, "token-files")
    write_token_files(spark, docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
