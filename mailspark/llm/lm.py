"""LM scoring with a hierarchical Pitman-Yor model of word pairs.

The restaurants are

* one per word, and one for the start of a text; its customers are the words that follow in training texts, or the text's end,
* their parent, whose customers are the tables of the others; its base is uniform over all training words, the end, and one unknown.

Every distinct word is a dish and has a restaurant of its own. Seating is sampled by Gibbs: in a sweep all customers of a restaurant sit
down anew, as ``seating`` has it. A round is ``SWEEPS`` sweeps of the parent, as many of the ``LISTED`` words' restaurants, and one of
the others'. After ``ROUNDS`` rounds comes a last one, and shares are averaged over its last ``KEPT`` sweeps.

A pair that occurs once has one table in any seating. All there is to know of a seating is so how many tables fewer than customers the
other pairs have, summed by first word and by second word: the savings.

The ``LISTED`` most frequent words (a fixed number) have small codes, and counts, variables and savings on the driver. Other words are
dealt to buckets by hash, each with the pairs in which it comes second, or first before a listed word. Pairs of two listed words are
dealt by both. Pairs of two others are drawn in the buckets of both: these tell each other once a round what the draw needs. Tokens that
are pairs of two of the ``SYMBOLS`` most frequent words, which may be very many for one pair, stay with their texts and are scored from a
square of probabilities; their counts are added up like all others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import BASE, NOT_BLANK, mixed, remainder, signed, split_words, stored, text_blocks
from mailspark.llm.seating import Alike, drawn, gammas, uniform

SYMBOLS = 1_024
LISTED = 1 << 17
#: Discount and strength of context restaurants and of their parent.
CONTEXT, PARENT = (0.6, 2.0), (0.5, 2.0)
ROUNDS, SWEEPS, KEPT = 3, 6, 3
#: Distinct words gathered before they leave a task.
GATHERED = 1 << 20
#: Tokens that a task gathers, and tokens of a bucket.
CHUNK, BUCKET = 1 << 20, 1 << 20
#: Codes of words that aren't listed have this bit; the end of a text, which is also the start, is code 0.
UNLISTED = np.uint64(1 << 63)
#: Words whose sums are one row.
SLICE = 1 << 14
#: Active pairs whose tables are drawn at once.
DRAWN = 1 << 21
#: Logarithms are kept as whole multiples of one part in so many.
PARTS = 2.0**30


def block_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, number of its distinct word, hashes of the distinct words)."""
    words = split_words(data, bounds, NOT_BLANK)
    distinct, which = np.unique(words.hashes(words.start, words.end) | UNLISTED, return_inverse=True)
    return words.doc, which, distinct


def word_counts_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) over texts; words are hashes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        word, n = (np.concatenate(x) for x in zip(*held))
        distinct, which = np.unique(word, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(distinct)), pa.array(np.bincount(which, weights=n).astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for _, _, data, bounds in text_blocks(batch.column(0)):
            _, which, distinct = block_words(data, bounds)
            held.append((distinct, np.bincount(which, minlength=len(distinct))))
            if sum(len(h[0]) for h in held) > GATHERED:
                yield merged()
                held.clear()
    if held:
        yield merged()


@dataclass
class Vocabulary:
    """Listed words: sorted hashes, their codes, counts by code. n: training tokens, v: distinct ones, ends: training texts."""

    words: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    named: int
    n: int
    v: int
    ends: int

    @property
    def size(self) -> int:
        """Of the square of symbols."""
        return self.named + 1

    @property
    def base(self) -> float:
        return 1 / (self.v + 1)

    def find(self, distinct: np.ndarray) -> np.ndarray:
        """Codes of distinct words: 1 and up where listed, by frequency, else the hash."""
        codes = distinct.copy()
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
            listed = self.words[at] == distinct
            codes[listed] = self.codes[at[listed]]
        return codes


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    listed = counts.orderBy(F.desc("n"), "word").limit(LISTED).toPandas()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    words = listed["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    by_code = np.concatenate([[ends], listed["n"].to_numpy(dtype=np.int64)])
    return Vocabulary(words[order], (order + 1).astype(np.uint64), by_code, min(SYMBOLS, len(listed)), total["n"] + ends, total["v"] + (ends > 0), ends)


# --- rows of numbers


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, 0 at least, as one value: differences where ascending, in as many byte planes as the largest needs."""
    head, planes = [len(columns)], []
    for column in columns:
        values = column.astype(np.uint64)
        ascending = int(len(values) > 1 and bool((values[1:] >= values[:-1]).all()))
        if ascending:
            values = np.concatenate([values[:1], np.diff(values)])
        width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        head += [len(values), width, ascending]
        planes.append(values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    body = b"".join([np.array(head, dtype=np.int64).tobytes(), *planes])
    return np.int64(len(body)).tobytes() + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def unpacked(value: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(value, dtype=np.int64, count=1)[0])
    body = np.frombuffer(pa.Codec("zstd").decompress(memoryview(value)[8:], decompressed_size=size), dtype=np.uint8)
    columns = int(body[:8].view(np.int64)[0])
    at = 8 + 24 * columns
    out = []
    for size, width, ascending in body[8:at].view(np.int64).reshape(-1, 3):
        planes = np.zeros((size, 8), dtype=np.uint8)
        planes[:, :width] = body[at : at + size * width].reshape(width, size).T
        at += size * width
        values = planes.reshape(-1).view(np.uint64)
        out.append(np.cumsum(values, dtype=np.uint64) if ascending else values)
    return out


def joined(values: list[bytes], columns: int) -> list[np.ndarray]:
    """Columns of several packed values, one after the other."""
    parts = [unpacked(value) for value in values]
    return [np.concatenate([part[k] for part in parts]) if parts else np.zeros(0, dtype=np.uint64) for k in range(columns)]


def values_of(column: pa.ChunkedArray) -> list[bytes]:
    return [v for v in column.to_pylist() if v is not None]


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the place of each value; fast for ascending runs."""
    order = np.argsort(values, kind="stable")
    ascending = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ascending[1:] != ascending[:-1]
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ascending[new], place


def batch_of(schema: pa.Schema, rows: int, **columns: object) -> pa.RecordBatch:
    """Rows of a schema; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def bucket_of(u: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each pair: of its second word unless that is listed, else of its first one unless that is, else of both."""
    key = np.where(w >= UNLISTED, w, np.where(u >= UNLISTED, u, mixed((u << np.uint64(32) | w) * BASE)))
    return (mixed(key * BASE) >> np.uint64(33)) % np.uint64(buckets)


def key_of(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a pair's random numbers are made of."""
    return mixed(u * BASE) + w


# --- tokens


@dataclass
class Chunk:
    """Tokens of some texts: codes of the distinct words; of each token the text and the places of its word and the one before."""

    codes: np.ndarray
    doc: np.ndarray
    before: np.ndarray
    own: np.ndarray
    parts: list[tuple[pa.RecordBatch, int, int]]
    rows: int


def chunks(vocab: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Of texts in the first column; a text begins after an end, and its own end is its last token."""
    held: list[tuple] = []
    size = 0

    def whole() -> Chunk:
        codes, place = numbered(np.concatenate([np.zeros(1, dtype=np.uint64), *(h[2] for h in held)]))
        docs, befores, owns, parts, rows, at = [], [], [], [], 0, 1
        for doc, which, distinct, part in held:
            own = np.zeros(len(doc) + part[2], dtype=np.int64)
            own[np.arange(len(doc)) + doc] = place[at : at + len(distinct)][which]
            at += len(distinct)
            docs.append((rows + np.repeat(np.arange(part[2]), np.bincount(doc, minlength=part[2]) + 1)).astype(np.int32))
            own = own.astype(np.int32)
            befores.append(np.concatenate([np.zeros(1, dtype=np.int32), own[:-1]]))
            owns.append(own)
            parts.append(part)
            rows += part[2]
        return Chunk(codes, np.concatenate(docs), np.concatenate(befores), np.concatenate(owns), parts, rows)

    for batch in batches:
        for first, rows, data, bounds in text_blocks(batch.column(0)):
            doc, which, distinct = block_words(data, bounds)
            if held and size + len(doc) + rows > CHUNK:
                full = whole()
                # not kept while the chunk is worked on
                held, size = [], 0
                yield full
                del full
            held.append((doc, which, vocab.find(distinct), (batch, first, rows)))
            size += len(doc) + rows
    if held:
        full = whole()
        held = []
        yield full


def shared(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its rows in order)."""
    # numbers of 16 bits are sorted much faster
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    for number, rows in zip(found, np.split(order, first[1:])):
        yield int(number), rows


# --- counts of pairs


def pair_counts_task(vocab: Vocabulary, buckets: int) -> Callable:
    """(bucket, payload) over training texts: pairs of listed words and their counts, other pairs and theirs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(vocab, batches):
            bits = len(chunk.codes).bit_length()
            pair, n = np.unique(chunk.before.astype(np.int64) << bits | chunk.own, return_counts=True)
            u, w = chunk.codes[pair >> bits], chunk.codes[pair & (1 << bits) - 1]
            listed = (u < UNLISTED) & (w < UNLISTED)
            out = []
            for number, rows in shared(bucket_of(u, w, buckets)):
                a, b = rows[listed[rows]], rows[~listed[rows]]
                out.append((number, packed(u[a] << np.uint64(32) | w[a], n[a], u[b], w[b], n[b])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], type=pa.int64()), pa.array([r[1] for r in out], type=pa.binary())], names=["bucket", "payload"])

    return task


#: Rows of buckets. A role of STATE has all a bucket knows of its words, TO_SECOND and TO_FIRST tell the bucket of a pair's second or
#: first word of a pair and the number of tables or of customers of the other word, SAVED has sums of a slice of listed words (the
#: bucket), OFTEN a change of how many words have so many tables. Counted buckets have pairs of listed words too.
STATE, TO_SECOND, TO_FIRST, SAVED, OFTEN = range(5)
STEPS = "bucket bigint, role int, u bigint, w bigint, value bigint, payload binary"
COUNTED = f"{STEPS}, active binary, square binary"


def arrow_schema(columns: str, **types: pa.DataType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()} | types
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in columns.split(", "))])


@dataclass
class Words:
    """What a bucket knows of its unlisted words.

    Of each that comes in an active pair: count, savings as first and as second word before the last step and after it. Of active pairs:
    those of a listed and an own word, those of an own and a listed one, those whose second and whose first word is own. ``other`` is
    what the other word's bucket told before the last step, ``tables`` what was drawn there.
    """

    code: np.ndarray
    n: np.ndarray
    first_was: np.ndarray
    second_was: np.ndarray
    first: np.ndarray
    second: np.ndarray
    after: np.ndarray
    after_u: np.ndarray
    after_n: np.ndarray
    before: np.ndarray
    before_w: np.ndarray
    before_n: np.ndarray
    seconds: np.ndarray
    seconds_u: np.ndarray
    seconds_n: np.ndarray
    seconds_other: np.ndarray
    seconds_tables: np.ndarray
    firsts: np.ndarray
    firsts_w: np.ndarray
    firsts_n: np.ndarray
    firsts_other: np.ndarray

    @classmethod
    def of(cls, payload: bytes) -> Words:
        codes = {"code", "seconds_u", "firsts_w"}
        return cls(*(v if f.name in codes else v.astype(np.int64) for f, v in zip(fields(cls), unpacked(payload))))

    def packed(self) -> bytes:
        return packed(*(getattr(self, f.name) for f in fields(self)))

    def rows(self, schema: pa.Schema, bucket: int, buckets: int, more: list[dict]) -> pa.Table:
        """Its state, what it tells other buckets, and further rows."""
        out = [{"bucket": [bucket], "role": [STATE], "payload": [self.packed()]}, *more]
        for role, at, u, w, value in (
            (TO_SECOND, self.firsts, self.code[self.firsts], self.firsts_w, self.n - self.first),
            (TO_FIRST, self.seconds, self.seconds_u, self.code[self.seconds], self.n - self.second),
        ):
            to = w if role == TO_SECOND else u
            out.append({"bucket": bucket_of(to, to, buckets).astype(np.int64), "role": np.full(len(at), role, dtype=np.int32), "u": signed(u), "w": signed(w), "value": value[at]})
        return pa.Table.from_batches([batch_of(schema, len(r["bucket"]), **r) for r in out], schema=schema)


def counted(vocab: Vocabulary, buckets: int) -> Callable:
    """Adds up a bucket's pairs. Its state is the words' codes and counts and the pairs that are active; those of two unlisted words are also told to the first one's bucket."""
    schema = arrow_schema(COUNTED)

    def add(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        key, times, u, w, pair_times = joined(values_of(table.column("payload")), 5)
        key, which = numbered(key)
        n = np.bincount(which, weights=times, minlength=len(key)).astype(np.int64)
        square = (key >> np.uint64(32) <= vocab.named) & (key & np.uint64(0xFFFFFFFF) <= vocab.named)
        u, w, pair_n, _ = summed_pairs(u, w, pair_times.astype(np.int64))
        code, place = np.unique(w[w >= UNLISTED], return_inverse=True)
        count = np.bincount(place, weights=pair_n[w >= UNLISTED], minlength=len(code)).astype(np.int64)
        # a word that comes in an active pair occurs more than once
        code, count = code[count > 1], count[count > 1]
        active = pair_n > 1
        u, w, pair_n = u[active], w[active], pair_n[active]
        one = batch_of(schema, 1, bucket=[bucket], role=[STATE], payload=[packed(code, count, u, w, pair_n)], active=[packed(key[n > 1], n[n > 1])], square=[packed(key[square], n[square])])
        both = (u >= UNLISTED) & (w >= UNLISTED)
        tell = batch_of(
            schema, int(both.sum()), bucket=bucket_of(u[both], u[both], buckets).astype(np.int64), role=np.full(int(both.sum()), TO_FIRST, dtype=np.int32),
            u=signed(u[both]), w=signed(w[both]), value=pair_n[both],
        )
        return pa.Table.from_batches([one, tell], schema=schema)

    return add


def summed_pairs(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, their sums, and the place of each row's pair."""
    order = np.lexsort((w, u))
    new = np.ones(len(u), dtype=bool)
    new[1:] = (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])
    place = np.empty(len(u), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return u[order][new], w[order][new], np.bincount(place, weights=n, minlength=int(new.sum())).astype(np.int64), place


# --- restaurants of unlisted words


def told(table: pa.Table, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, w, value) of a role's rows, in order of the pair."""
    rows = np.flatnonzero(table.column("role").to_numpy() == role)
    some = table.select(["u", "w", "value"]).take(pa.array(rows))
    u, w = (some.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("u", "w"))
    order = np.lexsort((w, u))
    return u[order], w[order], some.column("value").to_numpy().astype(np.int64)[order]


def state_of(table: pa.Table) -> list[bytes]:
    return [p for p, role in zip(table.column("payload").to_pylist(), table.column("role").to_pylist()) if role == STATE]


def opened(buckets: int, listed: int) -> Callable:
    """First state of a bucket, from what ``counted`` has: each pair has one table."""
    schema = arrow_schema(STEPS)

    def start(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        code, count, u, w, n = joined(state_of(table), 5)
        n = n.astype(np.int64)
        theirs_u, theirs_w, theirs_n = told(table, TO_FIRST)
        own_w, own_u = w >= UNLISTED, (u >= UNLISTED) & (w < UNLISTED)
        used = np.unique(np.concatenate([w[own_w], u[own_u], theirs_u]))
        count = count.astype(np.int64)[np.searchsorted(code, used)] if len(used) else np.zeros(0, dtype=np.int64)
        after, seconds = np.flatnonzero(own_w & (u < UNLISTED)), np.flatnonzero(own_w & (u >= UNLISTED))
        seconds = seconds[np.lexsort((w[seconds], u[seconds]))]
        none = np.zeros(len(used), dtype=np.int64)
        own = Words(
            used, count, none, none, none, none, np.searchsorted(used, w[after]), u[after].astype(np.int64), n[after],
            np.searchsorted(used, u[own_u]), w[own_u].astype(np.int64), n[own_u], np.searchsorted(used, w[seconds]), u[seconds], n[seconds],
            np.zeros(len(seconds), dtype=np.int64), np.zeros(len(seconds), dtype=np.int64), np.searchsorted(used, theirs_u), theirs_w, theirs_n, np.zeros(len(theirs_u), dtype=np.int64),
        )
        own.first = own.first_was = saved(len(used), (own.before, own.before_n - 1), (own.firsts, own.firsts_n - 1))
        own.second = own.second_was = saved(len(used), (own.after, own.after_n - 1), (own.seconds, own.seconds_n - 1))
        more = saved_rows(saved(listed, (own.after_u, own.after_n - 1)), saved(listed, (own.before_w, own.before_n - 1)))
        return own.rows(schema, bucket, buckets, [*more, often_rows(own)])

    return start


def saved(size: int, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    total = np.zeros(size, dtype=np.int64)
    for at, n in parts:
        total += np.bincount(at, weights=n, minlength=size).astype(np.int64)
    return total


def saved_rows(first: np.ndarray, second: np.ndarray) -> list[dict]:
    starts = range(0, len(first), SLICE)
    return [{"bucket": [k // SLICE for k in starts], "role": [SAVED] * len(starts), "payload": [packed(first[k : k + SLICE], second[k : k + SLICE]) for k in starts]}]


def often_rows(own: Words) -> dict:
    """Words have fewer tables to serve them than occurrences, by their savings: (tables, change of the number of words)."""
    moved = own.second > 0
    m, place = np.unique(np.concatenate([own.n[moved], (own.n - own.second)[moved]]), return_inverse=True)
    change = np.bincount(place, weights=np.repeat([-1, 1], int(moved.sum())), minlength=len(m)).astype(np.int64)
    return {"bucket": np.full(len(m), -1), "role": np.full(len(m), OFTEN, dtype=np.int32), "u": m, "value": change}


@dataclass
class Parent:
    """Chance of each listed word, and of any word by the number of its tables (0 for the unknown)."""

    listed: np.ndarray
    tables: np.ndarray
    chances: np.ndarray

    def of(self, tables: np.ndarray) -> np.ndarray:
        return self.chances[np.searchsorted(self.tables, tables)]


#: A sweep: its number, and the variables of the listed words' restaurants.
Sweep = tuple[int, np.ndarray]


def seated(u: np.ndarray, w: np.ndarray, n: np.ndarray, x: np.ndarray, chance: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of pairs with n customers."""
    return drawn(n, np.log(CONTEXT[0] * x * chance), CONTEXT[0], uniform(key_of(u, w), sweep))


def variables(tables: np.ndarray, codes: np.ndarray, sweep: int) -> np.ndarray:
    """The variable of each restaurant, by its number of tables."""
    return gammas(CONTEXT[1] / CONTEXT[0] + tables, codes.astype(np.uint64), sweep)


def stepped(buckets: int, listed: int, sweeps: list[Sweep], parent: Parent) -> Callable:
    """One sweep of a bucket's restaurants, or several from the same state, whose savings are added up."""
    schema = arrow_schema(STEPS)

    def step(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        own = Words.of(state_of(table)[0])
        own.seconds_other, own.firsts_other = told(table, TO_SECOND)[2], told(table, TO_FIRST)[2]
        own.first_was, own.second_was = own.first, own.second
        chance = parent.of(own.n - own.second)
        size = len(own.code)
        own.first, own.second, own.seconds_tables = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros(len(own.seconds), dtype=np.int64)
        first, second = np.zeros(listed, dtype=np.int64), np.zeros(listed, dtype=np.int64)
        for sweep, x in sweeps:
            own_x = variables(own.n - own.first_was, own.code, sweep)
            after = own.after_n - seated(own.after_u.astype(np.uint64), own.code[own.after], own.after_n, x[own.after_u], chance[own.after], sweep)
            before = own.before_n - seated(own.code[own.before], own.before_w.astype(np.uint64), own.before_n, own_x[own.before], parent.listed[own.before_w], sweep)
            other_x = variables(own.seconds_other, own.seconds_u, sweep)
            tables = seated(own.seconds_u, own.code[own.seconds], own.seconds_n, other_x, chance[own.seconds], sweep)
            firsts = own.firsts_n - seated(own.code[own.firsts], own.firsts_w, own.firsts_n, own_x[own.firsts], parent.of(own.firsts_other), sweep)
            own.seconds_tables += tables
            own.first += saved(size, (own.before, before), (own.firsts, firsts))
            own.second += saved(size, (own.after, after), (own.seconds, own.seconds_n - tables))
            first += saved(listed, (own.after_u, after))
            second += saved(listed, (own.before_w, before))
        # after several sweeps the savings are sums, and nothing follows
        more = [*saved_rows(first, second), often_rows(own)] if len(sweeps) == 1 else saved_rows(first, second)
        return own.rows(schema, bucket, buckets, more)

    return step


def slice_sums_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, payload) with the savings of each slice, added up."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts = unpacked(payload)
            sums[number] = [x + y for x, y in zip(sums[number], parts)] if number in sums else parts
    yield pa.RecordBatch.from_arrays([pa.array([*sums], type=pa.int64()), pa.array([packed(*x) for x in sums.values()], type=pa.binary())], names=["bucket", "payload"])


def slice_sums(rows: DataFrame, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """Savings by first and by second listed word, from rows (bucket, payload) with those of a slice: added up in as many tasks as the root of the cores, then here."""
    few = math.isqrt(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    out = np.zeros((2, listed), dtype=np.int64)
    for row in rows.select("bucket", "payload").repartition(few).mapInArrow(slice_sums_task, "bucket bigint, payload binary").collect():
        for total, part in zip(out, unpacked(bytes(row["payload"]))):
            total[row["bucket"] * SLICE :][: len(part)] += part.astype(np.int64)
    return out[0], out[1]


# --- all restaurants


class Pairs:
    """Pairs that ``fit`` has seated, in the buckets that ``counted`` made."""

    def __init__(self, spark: SparkSession, buckets: DataFrame, number: int, vocab: Vocabulary, words: DataFrame) -> None:
        self.spark, self.buckets, self.number, self.vocab = spark, buckets, number, vocab
        self.listed, self.tasks = len(vocab.counts), max(1, spark.sparkContext.defaultParallelism)
        often = words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).toPandas()
        self.often = dict(zip(often["n"].tolist(), often["k"].tolist()))
        for n in vocab.counts[1:].tolist():
            self.often[n] -= 1
        self.state = buckets

    def _grouped(self, step: Callable) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        rows = self.state.filter(F.col("role").isin(STATE, TO_SECOND, TO_FIRST)).select([part.split()[0] for part in STEPS.split(", ")])
        self.state = stored(self.spark, rows.groupBy("bucket").applyInArrow(step, STEPS), "restaurants")
        often = dict(self.often)
        for row in self.state.filter(F.col("role") == OFTEN).groupBy("u").agg(F.sum("value").alias("k")).collect():
            often[row["u"]] = often.get(row["u"], 0) + row["k"]
        return *slice_sums(self.state.filter(F.col("role") == SAVED).coalesce(self.tasks), self.listed), often

    def start(self) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """Savings of pairs with unlisted words if each has one table, by listed word, and how many unlisted words have so many tables."""
        return self._grouped(opened(self.number, self.listed))

    def step(self, sweeps: list[Sweep], parent: Parent) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """The same after a sweep, or summed over several from the same state."""
        return self._grouped(stepped(self.number, self.listed, sweeps, parent))

    def sweep(self, sweep: Sweep | None, parent: Parent | None) -> tuple[np.ndarray, np.ndarray]:
        """Savings of pairs of listed words, seated anew or with one table each."""
        listed, held = self.listed, self.spark.sparkContext.broadcast((sweep, parent and parent.listed))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, some, size = (np.zeros(listed, dtype=np.int64), np.zeros(listed, dtype=np.int64)), [], 0

            def add() -> None:
                key, n = (np.concatenate(x) for x in zip(*some))
                for total, part in zip(sums, listed_savings(key, n.astype(np.int64), listed, *held.value)):
                    total += part

            for batch in batches:
                for value in batch.column(0).to_pylist():
                    some.append(unpacked(value))
                    size += len(some[-1][0])
                    if size > DRAWN:
                        add()
                        some, size = [], 0
            if some:
                add()
            row = saved_rows(*sums)[0]
            yield pa.RecordBatch.from_arrays([pa.array(row["bucket"], type=pa.int64()), pa.array(row["payload"], type=pa.binary())], names=["bucket", "payload"])

        active = self.buckets.filter(F.col("active").isNotNull()).select("active").coalesce(self.tasks)
        out = slice_sums(active.mapInArrow(task, "bucket bigint, payload binary"), listed)
        held.destroy()
        return out


def listed_savings(key: np.ndarray, n: np.ndarray, size: int, sweep: Sweep | None, chance: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Savings by first and by second word of active pairs of codes below ``size``."""
    u, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    tables = 1
    if sweep:
        tables = seated(u.astype(np.uint64), w.astype(np.uint64), n, sweep[1][u], chance[w], sweep[0])
    return saved(size, (u, n - tables)), saved(size, (w, n - tables))


@dataclass
class Model:
    """The kept sweeps, their parent, and the listed words' counts as first words and tables on average."""

    sweeps: list[Sweep]
    parent: Parent
    counts: np.ndarray
    tables: np.ndarray

    def rest(self) -> np.ndarray:
        """Share of the parent in each listed word's restaurant."""
        return (CONTEXT[1] + CONTEXT[0] * self.tables) / (CONTEXT[1] + self.counts)

    def shares(self, u: np.ndarray, w: np.ndarray, n: np.ndarray, x: Callable, chance: np.ndarray) -> np.ndarray:
        """Customers less discounts, averaged over the kept sweeps; x: sweep's number and variables to those of the rows."""
        out = np.where(n > 0, n - CONTEXT[0], 0.0)
        several = np.flatnonzero(n > 1)
        tables = np.zeros(len(several))
        for sweep, listed in self.sweeps:
            tables += seated(u[several], w[several], n[several], x(sweep, listed)[several], chance[several], sweep)
        out[several] = n[several] - CONTEXT[0] * tables / len(self.sweeps)
        return out

    def square(self, key: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        """Probability of each of the first ``size`` words after each of them, given all such pairs."""
        u, w = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = self.rest()[:size, None] * self.parent.listed[None, :size]
        own = self.shares(u.astype(np.uint64), w.astype(np.uint64), n, lambda _, x: x[u], self.parent.listed[w])
        out[u, w] += own / (CONTEXT[1] + self.counts[u])
        return out


def parent_of(listed: np.ndarray, often: dict[int, int], base: float, seed: list[int]) -> Parent:
    """From the numbers of customers of listed words, and how many others have so many. Words of as many customers have the same tables, on average over them and the kept sweeps."""
    discount, strength = PARENT
    unlisted = np.array(sorted(k for k, v in often.items() if v > 0 and k > 0), dtype=np.int64)
    m, place = np.unique(np.concatenate([listed[listed > 0], unlisted]), return_inverse=True)
    times = np.bincount(place, weights=np.concatenate([np.ones(int((listed > 0).sum())), [often[k] for k in unlisted.tolist()]]), minlength=len(m)).astype(np.int64)
    rng, total, customers = np.random.default_rng(seed), int(times.sum()), int(m @ times)
    words = Alike(m, times, discount, rng)
    chances = np.zeros(len(m) + 1)
    for sweep in range(SWEEPS):
        x = rng.standard_gamma(strength / discount + total)
        tables = words.mean_tables(float(np.log(discount * x * base)))
        total = round(float(tables @ times))
        if sweep >= SWEEPS - KEPT:
            rest = (strength + discount * total) * base
            chances += (np.concatenate([[0.0], m - discount * tables]) + rest) / (strength + customers) / min(KEPT, SWEEPS)
    known = np.concatenate([[0], m])
    return Parent(chances[np.searchsorted(known, listed)], known, chances)


def fit(pairs: Pairs, firsts: np.ndarray, seconds: np.ndarray, base: float) -> Model:
    """firsts, seconds: how often each listed word comes first and second in pairs."""
    codes = np.arange(len(firsts))
    first, second = pairs.sweep(None, None)
    rest_first, rest_second, often = pairs.start()
    for number in range(ROUNDS + 1):
        parent = parent_of(seconds - second - rest_second, often, base, [11, number])
        done = []
        for sweep in range(number * SWEEPS, (number + 1) * SWEEPS):
            x = variables(firsts - first - rest_first, codes, sweep)
            first, second = pairs.sweep((sweep, x), parent)
            done.append(((sweep, x), first))
        kept = done[-KEPT:] if number == ROUNDS else done[-1:]
        rest_first, rest_second, often = pairs.step([k[0] for k in kept], parent)
    tables = firsts - np.mean([k[1] for k in kept], axis=0) - rest_first / len(kept)
    return Model([k[0] for k in kept], parent, firsts, tables)


class HeldPairs:
    """Pairs of few words, on the driver."""

    def __init__(self, key: np.ndarray, n: np.ndarray, size: int) -> None:
        self.key, self.n, self.size = key[n > 1], n[n > 1], size

    def sweep(self, sweep: Sweep | None, parent: Parent | None) -> tuple[np.ndarray, np.ndarray]:
        return listed_savings(self.key, self.n, self.size, sweep, parent and parent.listed)

    def start(self) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        return np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=np.int64), {}

    def step(self, sweeps: list[Sweep], parent: Parent) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        return self.start()


def fitted(pairs: DataFrame, size: int) -> np.ndarray:
    """Predictive probability of each symbol after each context, from all their pairs (context, symbol, n); for few symbols."""
    rows = pairs.toPandas().sort_values(["context", "symbol"])
    u, w, n = (rows[c].to_numpy(dtype=np.int64) for c in ("context", "symbol", "n"))
    key = (u << 32 | w).astype(np.uint64)
    model = fit(HeldPairs(key, n, size), saved(size, (u, n)), saved(size, (w, n)), 1 / size)
    return model.square(key, n, size).astype(np.float32)

# --- scores

DEALT = "bucket bigint, chunk bigint, payload binary, ids array<{id}>, held array<boolean>"
FOUND = "chunk bigint, payload binary, ids array<{id}>, held array<boolean>, ref bigint, times bigint, u bigint, own double, chance double"
SCORED = "doc_id {id}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def parts_of(logs: np.ndarray) -> np.ndarray:
    return np.round(np.maximum(-logs, 0) * PARTS)


def deal_task(vocab: Vocabulary, buckets: int) -> Callable:
    """Tokens (text, id, held out) by bucket, with their text's place in its chunk; a bucket of its own has a chunk's texts, their sums over listed words, and their pairs of symbols."""
    floor = np.log10(vocab.n + 0.1 * (vocab.v + 1))
    listed_logs = np.log10(vocab.counts + 0.1) - floor

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in enumerate(chunks(vocab, batches)):
            name = (TaskContext.get().partitionId() << 32) + number
            ids = pa.concat_arrays([batch.column(1).slice(first, rows) for batch, first, rows in chunk.parts])
            held = pa.concat_arrays([batch.column(2).slice(first, rows) for batch, first, rows in chunk.parts])
            size, rows = len(chunk.codes), chunk.rows
            listed = np.flatnonzero(chunk.codes < UNLISTED)
            known, logs = np.zeros(size), np.zeros(size)
            known[listed] = vocab.counts[chunk.codes[listed].astype(np.int64)] > 0
            logs[listed] = -parts_of(listed_logs[chunk.codes[listed].astype(np.int64)])
            sums = [np.bincount(chunk.doc, minlength=rows), np.bincount(chunk.doc, weights=known[chunk.own], minlength=rows), -np.bincount(chunk.doc, weights=logs[chunk.own], minlength=rows)]
            bits, row_bits = size.bit_length(), rows.bit_length()
            token, times = np.unique((chunk.before.astype(np.int64) << bits | chunk.own) << row_bits | chunk.doc, return_counts=True)
            pair, ref = token >> row_bits, (token & (1 << row_bits) - 1).astype(np.int32)
            u, w = chunk.codes[pair >> bits], chunk.codes[pair & (1 << bits) - 1]
            del token, pair
            times = times * 2 + np.asarray(held)[ref]
            both = (u < UNLISTED) & (w < UNLISTED)
            symbols = both & (np.maximum(u, w) <= vocab.named)
            out = [(-1 - name, packed(*sums, ref[symbols], u[symbols] * np.uint64(vocab.size) + w[symbols], times[symbols] // 2))]
            others = np.flatnonzero(~symbols)
            for bucket, at in shared(bucket_of(u[others], w[others], buckets)):
                at = others[at]
                a, b = at[both[at]], at[~both[at]]
                out.append((bucket, packed(u[a] << np.uint64(32) | w[a], ref[a], times[a], u[b], w[b], ref[b], times[b])))
            lists = [pa.ListArray.from_arrays(pa.array([0, rows] + [rows] * (len(out) - 1), type=pa.int32()), x, mask=pa.array([False] + [True] * (len(out) - 1))) for x in (ids, held)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], type=pa.int64()), pa.array([name] * len(out), type=pa.int64()), pa.array([r[1] for r in out], type=pa.binary()), *lists], names=["bucket", "chunk", "payload", "ids", "held"])

    return task


def scored(vocab: Vocabulary, model: Model) -> Callable:
    """Scores of a bucket's tokens, summed by text; those of two unlisted words lack the first one's numbers and are rows of their own."""
    floor = np.log10(vocab.n + 0.1 * (vocab.v + 1))
    (discount, strength), kept, listed_rest = CONTEXT, len(model.sweeps), model.rest()

    def score(table: pa.Table) -> pa.Table:
        lists = {"ids": table.schema.field("ids").type, "held": table.schema.field("held").type}
        schema = pa.schema([pa.field(f.split()[0], lists.get(f.split()[0], pa.float64() if f.endswith("double") else pa.binary() if f.endswith("binary") else pa.int64())) for f in FOUND.split(", ")])
        if table.column("bucket")[0].as_py() < 0:
            return pa.Table.from_arrays([table.column(f.name) if f.name in table.schema.names else pa.nulls(len(table), f.type) for f in schema], schema=schema)
        names, payloads = table.column("chunk").to_pylist(), table.column("payload").to_pylist()
        own = next((Words.of(p) for c, p in zip(names, payloads) if c is None), None) or Words(*(np.zeros(0, dtype=np.int64) for _ in fields(Words)))
        names, parts = [c for c in names if c is not None], [unpacked(p) for c, p in zip(names, payloads) if c is not None]
        if not parts:
            return schema.empty_table()
        ends, pair_ends = (np.cumsum([0, *(len(p[k]) for p in parts)]) for k in (0, 3))
        key, u, w = (np.concatenate([p[k] for p in parts]) for k in (0, 3, 4))
        ref, times, pair_ref, pair_times = (np.concatenate([p[k].astype(np.uint32) for p in parts]) for k in (1, 2, 5, 6))
        parts = [None] * len(parts)

        # pairs of listed words
        key, which = numbered(key)
        n = np.bincount(which, weights=np.where(times & 1, 0, times >> 1), minlength=len(key)).astype(np.int64)
        first, second = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        share = model.shares(first.astype(np.uint64), second.astype(np.uint64), n, lambda _, x: x[first], model.parent.listed[second])
        logs = np.log10(share / (strength + model.counts[first]) + listed_rest[first] * model.parent.listed[second])
        scores = parts_of(logs)[which] * (times >> 1)

        # other pairs: each has an unlisted word of this bucket
        u, w, n, place = summed_pairs(u, w, np.where(pair_times & 1, 0, pair_times >> 1))
        ends_here, listed = w >= UNLISTED, u < UNLISTED
        code, word = np.unique(w[ends_here], return_inverse=True)
        count = np.bincount(word, weights=n[ends_here], minlength=len(code)).astype(np.int64)
        first_was, first_now, second_was = (np.zeros(len(code), dtype=np.int64) for _ in range(3))
        drawn_at = np.searchsorted(code, own.code)
        for all_of, some in ((first_was, own.first_was), (first_now, own.first), (second_was, own.second_was)):
            all_of[drawn_at] = some
        chance = np.zeros(len(u))
        chance[ends_here] = model.parent.of(count - second_was)[word]
        chance[~ends_here] = model.parent.listed[w[~ends_here].astype(np.int64)]
        logs, shares = np.zeros(len(u)), np.zeros(len(u))
        kind = np.flatnonzero(ends_here & listed)
        before = u[kind].astype(np.int64)
        shares[kind] = model.shares(u[kind], w[kind], n[kind], lambda _, x: x[before], chance[kind])
        logs[kind] = np.log10(shares[kind] / (strength + model.counts[before]) + listed_rest[before] * chance[kind])
        kind = np.flatnonzero(~ends_here)
        before = np.searchsorted(code, u[kind])
        tables = (count - first_was)[before]
        shares[kind] = model.shares(u[kind], w[kind], n[kind], lambda sweep, _: variables(tables, u[kind], sweep), chance[kind])
        logs[kind] = np.log10((shares[kind] + (strength + discount * (count - first_now / kept)[before]) * chance[kind]) / (strength + count[before]))
        kind = np.flatnonzero(ends_here & ~listed)
        shares[kind] = np.where(n[kind] > 0, n[kind] - discount, 0.0)
        several = kind[n[kind] > 1]
        shares[several] = n[several] - discount * own.seconds_tables / kept

        base = np.zeros(len(u))
        base[ends_here] = parts_of(np.log10(count + 0.1) - floor)[word]
        known = np.zeros(len(u))
        known[ends_here] = (count > 0)[word]
        repeats = (pair_times >> 1).astype(np.int64)
        pair_scores, base, known = parts_of(logs)[place] * repeats, base[place] * repeats, known[place] * repeats
        out = []
        for k in range(len(parts)):
            a, b = slice(ends[k], ends[k + 1]), slice(pair_ends[k], pair_ends[k + 1])
            refs, slot = np.unique(np.concatenate([ref[a], pair_ref[b]]), return_inverse=True)
            sums = np.bincount(slot, weights=np.concatenate([scores[a], pair_scores[b]]), minlength=len(refs))
            slot = slot[ends[k + 1] - ends[k] :]
            out.append(packed(refs, sums, *(np.bincount(slot, weights=x[b], minlength=len(refs)) for x in (base, known))))
        late = np.flatnonzero((ends_here & ~listed)[place])
        rows = batch_of(schema, len(out), chunk=names, payload=out)
        open_rows = batch_of(
            schema, len(late), chunk=np.array(names)[np.searchsorted(pair_ends, late, side="right") - 1], ref=pair_ref[late].astype(np.int64), times=repeats[late], u=signed(u[place[late]]),
            own=shares[place[late]], chance=chance[place[late]],
        )
        return pa.Table.from_batches([rows, open_rows], schema=schema)

    return score


def assembled(vocab: Vocabulary, square: np.ndarray) -> Callable:
    """Rows of a chunk's texts from all their sums."""
    total = vocab.n

    def assemble(table: pa.Table) -> pa.Table:
        payloads, texts = table.column("payload").to_pylist(), table.column("ids").is_valid().to_pylist()
        tokens, known, base, ref, key, times = unpacked(payloads[texts.index(True)])
        rows = len(tokens)
        logs = parts_of(np.log10(square)).ravel()
        score = np.bincount(ref.astype(np.int64), weights=logs[key.astype(np.int64)] * times, minlength=rows)
        known, base = known.astype(np.float64), base.astype(np.float64)
        for payload in (p for p, text in zip(payloads, texts) if p is not None and not text):
            refs, *sums = unpacked(payload)
            for whole, some in zip((score, base, known), sums):
                whole[refs.astype(np.int64)] += some
        ref, late = table.column("late").combine_chunks().drop_null().flatten().flatten()
        score = -score / PARTS + np.bincount(ref.to_numpy(zero_copy_only=False).astype(np.int64), weights=late.to_numpy(zero_copy_only=False), minlength=rows)
        ids, held = (table.column(c).combine_chunks().drop_null().flatten() for c in ("ids", "held"))
        columns = [ids, held, pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(rows, total, dtype=np.int64)), pa.array(-base / PARTS), pa.array(score)]
        return pa.Table.from_arrays(columns, names=[part.split()[0] for part in SCORED.split(", ")])

    return assemble


def savings_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, saved) of the unlisted words in states."""
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            own = Words.of(payload)
            yield pa.RecordBatch.from_arrays([pa.array(signed(own.code)), pa.array(own.first)], names=["u", "saved"])


def scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    Learnt from rows whose crc32(doc_id) mod 10 is not 0. A null text is empty and has one token, its end. Repeated rows are
    counted and scored as often as they come; a null doc_id counts as the empty text for the fold. Other columns are not read. Without
    training rows all words are unknown. Words are told apart by 63 bits of a hash.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held"))
    training = rows.filter(~F.col("held")).select("text")
    words = stored(spark, training.mapInArrow(word_counts_task, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    vocab = vocabulary(words, training.count())
    number = vocab.n // BUCKET + 1
    shuffled = training.mapInArrow(pair_counts_task(vocab, number), "bucket bigint, payload binary")
    buckets = stored(spark, shuffled.groupBy("bucket").applyInArrow(counted(vocab, number), COUNTED), "pair-counts")
    pairs = Pairs(spark, buckets, number, vocab, words)
    model = fit(pairs, vocab.counts, vocab.counts, vocab.base)
    square = [unpacked(bytes(row["square"])) for row in buckets.filter(F.col("square").isNotNull()).select("square").collect()]
    key, n = (np.concatenate([np.zeros(0, dtype=np.uint64), *(part[k] for part in square)]) for k in (0, 1))
    chances = model.square(key, n.astype(np.int64), vocab.size)

    dealt = rows.mapInArrow(deal_task(vocab, number), DEALT.format(id=id_type))
    states = pairs.state.filter(F.col("role") == STATE).select("bucket", "payload")
    together = dealt.unionByName(states, allowMissingColumns=True)
    found = stored(spark, together.groupBy("bucket").applyInArrow(scored(vocab, model), FOUND.format(id=id_type)), "score-sums")
    saved_by = states.select("payload").mapInArrow(savings_task, "u bigint, saved bigint").filter("saved > 0")
    late = found.filter(F.col("u").isNotNull()).join(words.withColumnRenamed("word", "u"), "u", "left").join(saved_by, "u", "left")
    n, saved_n = F.coalesce("n", F.lit(0)), F.coalesce("saved", F.lit(0)) / len(model.sweeps)
    discount, strength = CONTEXT
    chance = (F.col("own") + (strength + discount * (n - saved_n)) * F.col("chance")) / (strength + n)
    late = late.groupBy("chunk").agg(F.collect_list(F.struct("ref", (F.col("times") * F.log10(chance)).alias("score"))).alias("late"))
    whole = found.filter(F.col("u").isNull()).select("chunk", "payload", "ids", "held").unionByName(late, allowMissingColumns=True)
    return whole.groupBy("chunk").applyInArrow(assembled(vocab, chances), SCORED.format(id=id_type))


# --- one restaurant, customer by customer


class Restaurant:
    """Tables of one restaurant: ``dish`` and ``size`` of each, in order of dish. Dishes are numbered within the restaurant.

    Customers move one at a time: far slower than ``seating``, whose draws are tested against it.
    """

    def __init__(self, customers: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> None:
        self.customers, self.base, self.d, self.s, self.rng = customers.astype(np.int64), base, discount, strength, rng
        self.dish, self.size = np.arange(len(customers)), self.customers.copy()

    def tables(self) -> np.ndarray:
        return np.bincount(self.dish, minlength=len(self.customers))

    def move(self, active: np.ndarray) -> None:
        """One customer of each active dish leaves and sits down again; all see the number of tables from before."""
        first = np.searchsorted(self.dish, active)
        reach = np.concatenate([[0], np.cumsum(self.size)])
        leave = np.searchsorted(reach, reach[first] + self.rng.integers(0, self.customers[active]), side="right") - 1
        self.size[leave] -= 1
        room = np.where(self.size > 0, self.size - self.d, 0.0)
        reach = np.concatenate([[0.0], np.cumsum(room)])
        last = np.searchsorted(self.dish, active, side="right")
        join = reach[last] - reach[first]
        fresh = (self.s + self.d * int((self.size > 0).sum())) * self.base[active]
        drawn = self.rng.random(len(active)) * (join + fresh)
        opens = drawn >= join
        stay = np.flatnonzero(~opens)
        seat = np.clip(np.searchsorted(reach, reach[first[stay]] + drawn[stay], side="right") - 1, first[stay], last[stay] - 1)
        # a rounding at the border of an empty table would seat someone there: those open a table of one again
        self.size[seat] += 1
        dish, size = np.concatenate([self.dish, active[opens]]), np.concatenate([self.size, np.ones(int(opens.sum()), dtype=np.int64)])
        used = np.flatnonzero(size > 0)
        order = used[np.argsort(dish[used], kind="stable")]
        self.dish, self.size = dish[order], size[order]

    def sweep(self, moves: int) -> None:
        """Up to ``moves`` customers of each dish move; dishes of one customer have only one seating."""
        for k in range(1, moves + 1):
            active = np.flatnonzero((self.customers > 1) & (self.customers >= k))
            if not len(active):
                return
            self.move(active)


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, texts, tokens, perplexity and base_perplexity of the rows of ``scores``."""
    per = lambda name: F.pow(F.lit(10.0), -F.sum(name) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
