"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings, hashed to buckets. A text's score is the logistic of
w0 + sum w_j + sum over pairs <v_j, v_k> for the distinct selected terms j, k it has, so that a pair of terms can count for more or less than
the two alone. Terms are selected by chi-square on the training rows.

Training uses at most ``SAMPLE`` labelled rows, those with the smallest hashes of their ids; that bounds what is broadcast
(ids and labels) and what reaches the driver (selected terms of those rows). Scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.common import LETTERS, remainder, split_words, text_blocks

SAMPLE = 20_000
BUCKETS = 1 << 22
TERMS = 2_048
FACTORS = 8
#: Deviation of the factors at the start; at 0 they stay 0, which is a linear model.
SPREAD = 0.05
PREFIXES = (4, 5, 7)
ROUNDS = 250
THRESHOLD = 0.3


def term_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and word beginning, repeats included."""
    words = split_words(data, bounds, LETTERS)
    docs, buckets = [words.doc], [words.hashes(words.start, words.end) % np.uint64(BUCKETS)]
    for size in PREFIXES:
        longer = np.flatnonzero(words.end - words.start > size)
        docs.append(words.doc[longer])
        # one more bit keeps a beginning apart from the same word
        buckets.append((words.hashes(words.start[longer], words.start[longer] + size) ^ np.uint64(0x2A5)) % np.uint64(BUCKETS))
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def distinct_pairs(doc: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc.astype(np.int64) * width + term)
    return both // width, both % width


def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic rows, clean rows) over the rows of (toxic, text) of one task, null labels left out before."""
    for batch in batches:
        toxic = np.asarray(batch.column(0)).astype(bool)
        for first, rows, data, bounds in text_blocks(batch.column(1)):
            doc, bucket = distinct_pairs(*term_buckets(data, bounds), BUCKETS)
            found, place = np.unique(bucket, return_inverse=True)
            marked = toxic[first : first + rows][doc]
            bad = np.bincount(place, weights=marked, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(bad), pa.array(np.bincount(place, minlength=len(found)) - bad)], names=["bucket", "bad", "good"])


def selected_task(table: np.ndarray) -> Callable:
    """(toxic, terms): indices of the selected terms of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = bucket_index(table)
        for batch in batches:
            for first, rows, data, bounds in text_blocks(batch.column(1)):
                doc, term = selected(data, bounds, index)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(rows + 1)).astype(np.int32)), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows).cast(pa.int32()), lists], names=["toxic", "terms"])

    return task


def bucket_index(table: np.ndarray) -> np.ndarray:
    index = np.full(BUCKETS, -1, dtype=np.int16)
    index[table] = np.arange(len(table))
    return index


def selected(data: np.ndarray, bounds: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc, bucket = term_buckets(data, bounds)
    term = index[bucket]
    known = term >= 0
    return distinct_pairs(doc[known], term[known], max(1, TERMS))


@dataclass
class Machine:
    """A trained factorization machine; without terms it gives every text the rate of its training rows."""

    table: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, doc: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """For pairs in order of text."""
        total = self.bias + np.bincount(doc, weights=self.linear[term], minlength=rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            total += 0.5 * (np.bincount(doc, weights=v, minlength=rows) ** 2 - np.bincount(doc, weights=v * v, minlength=rows))
        return total


def fit(table: np.ndarray, doc: np.ndarray, term: np.ndarray, toxic: np.ndarray) -> Machine:
    """Adam on the logistic loss of all rows at once, weights shrunk a little; the start is drawn with a fixed seed."""
    rows, terms = len(toxic), len(table)
    rate = np.clip(toxic.mean() if rows else 0.0, 1e-3, 1 - 1e-3)
    rng = np.random.default_rng(7)
    m = Machine(table, float(np.log(rate / (1 - rate))), np.zeros(terms), rng.normal(0, SPREAD, (terms, FACTORS)))
    if not rows or not terms:
        return m
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (np.zeros(1), m.linear, m.factors)]
    for step in range(1, ROUNDS + 1):
        sums = np.stack([np.bincount(doc, weights=m.factors[term, f], minlength=rows) for f in range(FACTORS)], axis=1)
        error = 1 / (1 + np.exp(-m.margin(doc, term, rows))) - toxic
        each = error[doc] / rows
        pull = each[:, None] * (sums[doc] - m.factors[term])
        gradients = [
            np.array([error.mean()]),
            np.bincount(term, weights=each, minlength=terms) + 1e-5 * m.linear,
            np.stack([np.bincount(term, weights=pull[:, f], minlength=terms) for f in range(FACTORS)], axis=1) + 1e-5 * m.factors,
        ]
        moves = []
        for (first, second), g in zip(moments, gradients):
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            moves.append(0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8))
        m.bias -= float(moves[0][0])
        m.linear -= moves[1]
        m.factors -= 0.3 * moves[2]
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fitted on labelled rows of ``docs`` whose crc32(doc_id) mod 4 is not 2, at most ``sample`` of them.

    A doc_id with several labels counts as toxic if one is; of several texts of a doc_id the first in order is learnt from.
    """
    usable = labels.filter("toxic is not null and doc_id is not null").filter(remainder(F.col("doc_id"), 4) != 2)
    chosen = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # one text for each id: repeated rows are reduced before the shuffle and neither learnt from nor brought to the driver
    matched = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = matched.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text")
    counts = rows.mapInArrow(count_task, "bucket bigint, bad bigint, good bigint").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = chosen.agg(F.sum("label"), F.count(F.lit(1))).first()
    bad, all_rows = float(total[0] or 0), float(total[1] or 0)
    seen, expected = F.col("bad") + F.col("good"), (F.col("bad") + F.col("good")) * (bad / max(all_rows, 1))
    gain = (F.col("bad") - expected) * (F.col("bad") - expected) / (expected + 1)
    best = counts.filter(seen >= 4).orderBy(gain.desc(), "bucket").limit(TERMS).select("bucket").toPandas()
    table = np.sort(best["bucket"].to_numpy(dtype=np.int64))
    found = rows.mapInArrow(selected_task(table), "toxic int, terms array<int>").toArrow()
    lists = found.column("terms").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, dtype=np.int64)
    return fit(table, np.repeat(np.arange(len(sizes)), sizes), np.asarray(lists.flatten()).astype(np.int64), np.asarray(found.column("toxic").combine_chunks()).astype(float))


def score_of(text: Column, machine: Machine) -> Column:
    """Chance of label 1, 0 to 1; a null text counts as empty."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = bucket_index(machine.table)
        for texts in batches:
            out = [1 / (1 + np.exp(-machine.margin(*selected(data, bounds, index), rows))) for _, rows, data, bounds in text_blocks(texts)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(F.coalesce(text, F.lit("")))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text). Only text and labels are learnt from.

    Repeated rows are scored alike and learnt from once; a null doc_id is scored and never trained on. Without labels every score is 0.001;
    an empty table gives no rows. Whole texts are scored, a block of them or one longer text at a time. Columns of other names, also of those
    returned, are not read.
    """
    machine = train(docs, labels)
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), score_of(F.col("text"), machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    return docs.filter(score_of(F.col("text"), train(docs, labels)) < THRESHOLD)
