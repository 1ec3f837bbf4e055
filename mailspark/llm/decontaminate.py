"""Benchmark decontamination by winnowing.

k-grams of words are hashed, in every window of ``w`` neighbouring k-grams the smallest hash is kept, and k + w - 1 equals the
``span`` of words that counts as contamination: two texts that share ``span`` words in a row share a kept hash at the same place. Kept
hashes of documents and benchmark items are joined, and each hit is extended word by word as far as ``span`` allows. An
item of fewer words than ``span`` gets a window of its own length, so that the whole item is found.

What goes through Python is one pass over the texts in blocks of about a megabyte. A bitmap of ``FILTER_BITS`` bits (its size
does not depend on the data) tells which hashes can be in the benchmark; the rest never leave the task. No document or
fingerprint list is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailspark.llm.common import LETTERS, Words, fixed_binary, from_fixed_binary, mixed, signed, split_words, stored, text_blocks

FILTER_BITS = 1 << 20
NO_WORD = {"document": np.uint64(0), "item": np.uint64(1)}
GRAMS = "text_key bigint, words bigint, level int, gram bigint, position bigint, context binary"


def gram_sizes(level: int, k: int) -> tuple[int, int]:
    """(k, w) of a level: the number of words that a shared span has."""
    size = min(k, level)
    return size, level - size + 1


def grams(words: Words, hashes: np.ndarray, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k-gram that begins at each word, and whether it lies in one text."""
    size, _ = gram_sizes(level, k)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    total = np.full(n, np.uint64(level + 1))
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mixed(total), words.doc[:n] == words.doc[size - 1 :]


def kept(gram: np.ndarray, doc: np.ndarray, valid: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Which of the k-grams ``at`` are the leftmost smallest of some window of w k-grams of one text."""
    left, right = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    on_left, on_right = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    n = len(gram)
    for j in range(1, w):
        p = np.maximum(at - j, 0)
        on_left &= (at - j >= 0) & (doc[p] == doc[at]) & (gram[p] > gram[at])
        left += on_left
        p = np.minimum(at + j, n - 1)
        on_right &= (at + j < n) & (doc[p] == doc[at]) & valid[p] & (gram[p] >= gram[at])
        right += on_right
    return left + right + 1 >= w


def contexts(words: Words, hashes: np.ndarray, at: np.ndarray, span: int, k: int, outside: np.uint64) -> np.ndarray:
    """Word hashes around the k-grams: span - k words before, span words from the first word on."""
    place = at[:, None] + np.arange(k - span, span)[None, :]
    clipped = np.clip(place, 0, len(hashes) - 1)
    same = (place == clipped) & (words.doc[clipped] == words.doc[at][:, None])
    return np.where(same, np.maximum(hashes[clipped], np.uint64(2)), outside)


def fingerprint_task(side: str, span: int, k: int, levels: list[int] | None, slots: np.ndarray | None) -> Callable:
    """One row per text (level -1) and one per kept k-gram. levels: those looked for, or None for the level of each text itself."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None
        if slots is not None:
            bitmap = np.zeros(FILTER_BITS, dtype=bool)
            bitmap[slots] = True
        for batch in batches:
            ids, text_keys = batch.column(0), np.asarray(batch.column(1))
            for first, rows, data, bounds in text_blocks(batch.column(2)):
                words = split_words(data, bounds, LETTERS)
                hashes = words.hashes(words.start, words.end)
                counts = np.bincount(words.doc, minlength=rows)[:rows]
                begin = np.concatenate([[0], np.cumsum(counts)])
                out = [(np.arange(rows), np.full(rows, -1), text_keys[first : first + rows], np.full(rows, -1), None)]
                for level in levels if levels is not None else sorted({min(int(c), span) for c in counts if c}):
                    gram, valid = grams(words, hashes, level, k)
                    doc = words.doc[: len(gram)]
                    use = valid if levels is not None else valid & (np.minimum(counts, span)[doc] == level)
                    at = np.flatnonzero(use & bitmap[gram % np.uint64(FILTER_BITS)] if bitmap is not None else use)
                    if len(at):
                        at = at[kept(gram, doc, valid, at, gram_sizes(level, k)[1])]
                    if len(at):
                        around = contexts(words, hashes, at, span, k, NO_WORD[side])
                        out.append((doc[at], np.full(len(at), level), signed(gram[at]), at - begin[doc[at]], around))
                for doc, level, gram, position, around in out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(first + doc)), pa.array(text_keys[first + doc]), pa.array(counts[doc].astype(np.int64)),
                            pa.array(level.astype(np.int32)), pa.array(gram), pa.array(position.astype(np.int64)),
                            pa.nulls(len(doc), pa.binary()) if around is None else fixed_binary(around),
                        ],
                        names=["doc_id", *(part.split()[0] for part in GRAMS.split(", "))],
                    )

    return task


def extend_task(span: int, k: int) -> Callable:
    """Hits that reach a whole window: (doc_id, text_key, item_class, begin, finish), words counted from 0, finish exclusive."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * span - k
        before = span - k
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            same = from_fixed_binary(col["context"], np.uint64, width) == from_fixed_binary(col["item_context"], np.uint64, width)
            left = np.cumprod(same[:, :before][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, before:], axis=1).sum(axis=1)
            need = np.minimum(np.asarray(col["item_words"]), span)
            good = np.flatnonzero((left + right >= need) & (right > 0))
            position = np.asarray(col["position"])[good]
            keep = [col[name].take(pa.array(good)) for name in ("doc_id", "text_key", "item_class")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(position - left[good]), pa.array(position + right[good])],
                names=["doc_id", "text_key", "item_class", "begin", "finish"],
            )

    return task


def same_text(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, text_key), null ids included; the key columns of ``left`` stay."""
    other = right.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    joined = left.join(other, left["doc_id"].eqNullSafe(other["_id"]) & (left["text_key"] == other["_key"]), how)
    return joined.drop("_id", "_key")


def text_key() -> Column:
    """Tells texts apart beside the id; null and the empty text differ."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


def find_overlaps(spark: SparkSession, docs: DataFrame, items: DataFrame, span: int = 13, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, hits, members): every document, the word ranges that benchmark items share with it, the ids of each item class.

    docs: doc_id, text; items: item_id, text; other columns are not read. texts: doc_id, text_key, words, one row per document row.
    hits: doc_id, text_key, item_class, begin, finish, without repeats. members: item_class, item. Items of the same text are one
    class; rows repeated in either table change nothing but the number of rows in ``texts``. Null and empty texts have no words and
    no hits. An empty table gives empty results.
    """
    named = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    item_rows = stored(
        spark,
        named.select(F.lit(0).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
        .dropDuplicates(["text_key"]).mapInArrow(fingerprint_task("item", span, k, None, None), f"doc_id int, {GRAMS}"),
        "benchmark-grams",
    )
    item_grams = item_rows.filter("level >= 0")
    levels = sorted(row[0] for row in item_grams.select("level").distinct().limit(span + 1).collect())
    slots = item_grams.select(F.expr(f"cast(gram & {FILTER_BITS - 1} as int)").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = stored(
        spark,
        docs.select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(fingerprint_task("document", span, k, levels, slots), f"doc_id {id_type}, {GRAMS}"),
        "document-grams",
    )
    probes = item_grams.select(
        "level", "gram", F.col("text_key").alias("item_class"), F.col("words").alias("item_words"), F.col("context").alias("item_context")
    )
    joined = found.filter("level >= 0").join(probes, ["level", "gram"])
    hits = joined.select("doc_id", "text_key", "item_class", "position", "context", "item_context", "item_words").mapInArrow(
        extend_task(span, k), f"doc_id {id_type}, text_key bigint, item_class bigint, begin bigint, finish bigint"
    ).distinct()
    members = named.filter("item is not null").select(F.xxhash64("text").alias("item_class"), "item").distinct()
    return found.filter("level < 0").select("doc_id", "text_key", "words"), hits, members


def overlap_counts(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Per document with hits: n_hit (words in any hit range), items (sorted ids as strings)."""
    order = Window.partitionBy("doc_id", "text_key").orderBy("begin", "finish")
    ranges = hits.select("doc_id", "text_key", "begin", "finish").distinct()
    reached = F.coalesce(F.max("finish").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = ranges.withColumn("new", F.greatest(F.lit(0), F.col("finish") - F.greatest("begin", reached)))
    n_hit = covered.groupBy("doc_id", "text_key").agg(F.sum("new").alias("n_hit"))
    pairs = hits.select("doc_id", "text_key", "item_class").distinct().join(members, "item_class", "left")
    named = pairs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return same_text(n_hit, named, "inner")


def hit_too_much() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("words"))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, span: int = 13, k: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more is hit).

    Nulls, repeated rows, empty tables and other columns: see ``find_overlaps``. Items without id are found but not listed.
    """
    texts, hits, members = find_overlaps(spark, docs, items, span, k)
    joined = same_text(texts, overlap_counts(hits, members), "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint")))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", F.col("words").alias("n_words"), "n_hit", F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), hit_too_much().alias("contaminated"),
    )


def decontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, span: int = 13, k: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't contaminated. Rows of the same id and text go or stay together."""
    texts, hits, members = find_overlaps(spark, docs, items, span, k)
    bad = same_text(texts, overlap_counts(hits, members), "inner").filter(hit_too_much())
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (text_key() == bad["_bad_key"]), "left_anti")
