"""Alignment of the tokens of two tokenizers over the same bytes.

Each text, with a blank before it, is cut by a byte-level BPE (A) and by a sentencepiece model (B). Where tokens of both end at the same
byte there is a *link* between the two and a *cut*; cuts part the text into groups of tokens that say the same.

Texts of a task are merged in lockstep: one vector holds every text's place in A and in B. A step compares the ends of all current tokens at
once, moves on in whichever list is behind (in both where they meet, which emits a link and a cut), and takes finished texts out of the vector.
How often two ids are linked in the whole corpus is counted by Spark: a batch of texts sends each distinct pair once with its number of links, counts
are summed by pair, and every batch gets back the counts of its own pairs. No table of pairs is broadcast or held whole in one place.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import stored
from mailspark.llm.pieces import Coder, SentenceCoder, kept
from mailspark.llm.token_files import PieceCoder

#: Text bytes that are merged at once; a longer text is a batch of its own.
LOCKSTEP_BYTES = 4 << 20
#: Decimal ids and a separator are written into eight bytes.
MOST_IDS = 10**7


def token_sizes(coder: Coder) -> np.ndarray:
    """Bytes of every id of a coder."""
    if isinstance(coder, SentenceCoder):
        return np.array([len(b) for b in coder.bytes], dtype=np.int64)
    # in a byte-level vocabulary every character of a token stands for one byte
    vocabulary = coder.tokenizer.get_vocab()
    sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
    return sizes


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, stop_a: np.ndarray) -> np.ndarray:
    """For each A token the B token that ends at the same byte, or -1.

    Ends of the texts' tokens stand one text after the other; a text's A tokens are ``first_a`` up to ``stop_a``, its B tokens begin at ``first_b``, and
    the last ones of both end together.
    """
    partner = np.full(len(end_a), -1, dtype=np.int32 if len(end_b) < 1 << 31 else np.int64)
    alive = first_a < stop_a
    a, b, stop = first_a[alive], first_b[alive], stop_a[alive]
    while len(a):
        ends_a, ends_b = end_a[a], end_b[b]
        same = ends_a == ends_b
        partner[a[same]] = b[same]
        a = a + (ends_a <= ends_b)
        b = b + (ends_b <= ends_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return partner


def decimal_words(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(decimal text of 0 to n - 1 in the low bytes of a little-endian word, the bits it takes)."""
    if n > MOST_IDS:
        raise ValueError(f"ids of up to {MOST_IDS} are supported")
    ids = np.arange(n, dtype=np.uint64)
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
    words = np.zeros(n, dtype=np.uint64)
    for place in range(7):
        # the digit that stands ``place`` bytes from the beginning
        power = np.uint64(10) ** np.maximum(digits - 1 - place, 0).astype(np.uint64)
        letter = (ids // power) % np.uint64(10) + np.uint64(48)
        words |= np.where(place < digits, letter << np.uint64(8 * place), np.uint64(0))
    return words, (8 * digits).astype(np.uint64)


class Batch:
    """Some texts, aligned. ``a`` and ``b`` are the ids of all texts in a row, ``edge_a`` and ``edge_b`` where each text's begin, ``links`` the places in a and in b that are linked."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, coders: tuple[Coder, Coder], sizes: tuple[np.ndarray, np.ndarray]) -> None:
        ids, counts, whole = zip(*(c.encode_whole(data, bounds) for c in coders))
        good = whole[0] & whole[1]
        self.a, self.b = (x[np.repeat(good, n)] for x, n in zip(ids, counts))
        self.edge_a, self.edge_b = (np.concatenate([[0], np.cumsum(np.where(good, n, 0))]) for n in counts)
        # bytes of left-out texts are left out too, so both lists end alike
        width = np.int32 if len(data) < 1 << 31 else np.int64
        ends = [np.cumsum(s[x], dtype=width) for s, x in zip(sizes, (self.a, self.b))]
        partner = lockstep(*ends, self.edge_a[:-1], self.edge_b[:-1], self.edge_a[1:])
        at = np.flatnonzero(partner >= 0)
        self.links = at, partner[at]
        self.ends = ends[0][at]
        self.edge_links = np.searchsorted(at, self.edge_a)

    def groups(self, words: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text; ``words`` are decimal_words of enough ids."""
        text, bits = words
        (at_a, at_b), n_a, n_b = self.links, len(self.a), len(self.b)
        begin_a, begin_b = np.concatenate([[0], at_a + 1]), np.concatenate([[0], at_b + 1])
        mark_a, mark_b = np.full(n_a, ord(","), dtype=np.uint64), np.full(n_b, ord(","), dtype=np.uint64)
        mark_a[at_a], mark_b[at_b] = ord("|"), ord(";")
        last = self.edge_b[1:][np.diff(self.edge_b) > 0] - 1
        mark_b[last] = 0
        out = np.zeros(n_a + n_b, dtype="<u8")
        group_a, group_b = (np.repeat(np.arange(len(at_a)), np.diff(begin)) for begin in (begin_a, begin_b))
        # a group's A tokens come before its B tokens
        out[np.arange(n_a) + begin_b[group_a]] = text[self.a] | (mark_a << bits[self.a])
        out[np.arange(n_b) + begin_a[group_b + 1]] = text[self.b] | (mark_b << bits[self.b])
        edge = (self.edge_a + self.edge_b).tolist()
        raw = out.tobytes()
        return [raw[8 * x : 8 * y].translate(None, b"\0") for x, y in zip(edge, edge[1:])]


def blocks_of(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, bounds) of about ``size`` bytes at a time, a blank before each text that is not empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    spaced = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
    offsets = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    raw = spaced.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(spaced):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows (doc_id, text) of a task, batches put together until they hold ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(1).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _coders(job: str, path_a: str, path_b: str) -> tuple[tuple[Coder, Coder], tuple[np.ndarray, np.ndarray]]:
    coders = kept(job, PieceCoder, path_a, True), kept(job, SentenceCoder, path_b)
    return coders, tuple(map(token_sizes, coders))


def _aligned(batches: Iterator[pa.RecordBatch], coders: tuple[Coder, Coder], sizes: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[pa.Array, Batch]]:
    for table in gathered(batches, LOCKSTEP_BYTES):
        for some in table.to_batches():
            for first, rows, data, bounds in blocks_of(some.column(1), LOCKSTEP_BYTES):
                yield some.column(0).slice(first, rows), Batch(data, bounds, coders, sizes)


BATCHES = (
    "batch_no bigint, doc_ids array<{id}>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, groups_sha256 array<string>,"
    " pairs array<bigint>, pair_links array<bigint>, link_numbers binary"
)


def _batch_task(path_a: str, path_b: str) -> Callable:
    """One row for each batch of texts: what is known of them, the distinct pairs of linked ids (A id * 2^32 + B id), and each link's place in that list."""

    job = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, press = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        coders, sizes = _coders(job, path_a, path_b)
        words = decimal_words(max(map(len, sizes)))
        for k, (doc_ids, batch) in enumerate(_aligned(batches, coders, sizes)):
            linked = (batch.a[batch.links[0]].astype(np.int64) << 32) | batch.b[batch.links[1]]
            pairs, number, links = np.unique(linked, return_inverse=True, return_counts=True)
            written = [hashlib.sha256(g).hexdigest() if g else "" for g in batch.groups(words)]
            lists = [np.diff(batch.edge_a), np.diff(batch.edge_b), np.diff(batch.edge_links), written, pairs, links]
            kinds = [*[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + k]), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                    *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in zip(lists, kinds)),
                    pa.array([press.compress(number.astype("<u4").tobytes())], pa.binary()),
                ],
                names=["batch_no", "doc_ids", "n_a", "n_b", "n_links", "groups_sha256", "pairs", "pair_links", "link_numbers"],
            )

    return task


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one batch, with its pairs' counts (number, count, is_best) summed over their links."""
    row = {name: left.column(name)[0] for name in left.column_names}
    counts, best = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=np.int64)
    at = right.column("number").to_numpy()
    counts[at], best[at] = right.column("count").to_numpy(), right.column("is_best").to_numpy()
    number = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["link_numbers"].as_py()), dtype="<u4")
    edges = np.concatenate([[0], np.cumsum(np.asarray(row["n_links"].values))])
    totals = [np.diff(np.concatenate([[0], np.cumsum(x[number])])[edges]) for x in (best, counts)]
    links = row["n_links"].values
    return pa.table(
        {
            "doc_id": row["doc_ids"].values, "n_a": row["n_a"].values, "n_b": row["n_b"].values, "n_groups": links, "n_links": links,
            "n_best": pa.array(totals[0]), "count_sum": pa.array(totals[1]), "groups_sha256": row["groups_sha256"].values,
        }
    )


def aligned_batches(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The aligned batches of all texts, written once (columns BATCHES)."""
    schema = BATCHES.format(id=docs.schema["doc_id"].dataType.simpleString())
    return stored(spark, docs.select("doc_id", "text").mapInArrow(_batch_task(path_a, path_b), schema), "aligned")


def pair_counts(batches: DataFrame) -> DataFrame:
    """pair, count, is_best (1 where no other A id is linked with the pair's B id more often, else 0) over the whole corpus."""
    each = batches.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.pair_links").alias("links"))
    totals = each.groupBy("pair").agg(F.sum("links").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    # one row for each pair of ids at most, so a B id has no more rows than A has ids
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    return totals.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("is_best"))


def alignments(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text).

    ``path_a`` is a byte-level BPE file of the tokenizers library, ``path_b`` a sentencepiece model; strings of special tokens in texts are plain text. A pair's
    count is the number of links of its two ids in all texts; ``n_best`` counts a text's links whose count is the highest of their B id.
    A text that is null or empty, or that the tokens of A or B do not spell, has no tokens: zeros, and '' for the groups.
    Repeated rows count as often as they come; null ids are kept; other columns are not read, whatever their names; an empty
    table gives no rows. Texts of any length are whole: a long one is merged in a batch of its own.
    """
    batches = aligned_batches(spark, docs, path_a, path_b)
    totals = stored(spark, pair_counts(batches), "pair-counts")
    own = batches.select("batch_no", F.posexplode("pairs").alias("number", "pair")).join(totals, "pair").select(F.col("batch_no").alias("of_batch"), "number", "count", "is_best")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    rows = batches.select("batch_no", "doc_ids", "n_a", "n_b", "n_links", "groups_sha256", "link_numbers")
    return rows.groupBy("batch_no").cogroup(own.groupBy("of_batch")).applyInArrow(_summed, schema)


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_index, b_index, a_id, b_id, end: every link of every text, with the tokens' numbers in their text and the byte (of blank and text) where they end."""

    job = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, batch in _aligned(batches, *_coders(job, path_a, path_b)):
            at_a, at_b = batch.links
            text = np.repeat(np.arange(len(doc_ids)), np.diff(batch.edge_links))
            last = np.concatenate([[0], batch.ends])[batch.edge_links[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.take(pa.array(text)), pa.array(at_a - batch.edge_a[text]), pa.array(at_b - batch.edge_b[text]),
                    pa.array(batch.a[at_a].astype(np.int64)), pa.array(batch.b[at_b].astype(np.int64)), pa.array(batch.ends - last[text]),
                ],
                names=["doc_id", "a_index", "b_index", "a_id", "b_id", "end"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {id_type}, a_index bigint, b_index bigint, a_id bigint, b_id bigint, end bigint")
