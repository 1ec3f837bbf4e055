"""SpotSigs document fingerprints: chains of content words behind anchors, compared by pruned Jaccard.

Anchors are common words of the four languages of the corpus, the beginning of the text, and one content word in ``EVERY`` by hash, so
that tables and lists, which have no common words, get signatures as well. A signature is the anchor with the next ``CHAIN`` content
words (fewer at a text's end). The set of a text's signatures, as 32-bit hashes in order, is its fingerprint. A text without words has
one signature, its own bytes.

Likeness is the Jaccard coefficient, exact for the pairs that ``fingerprints`` is asked for. ``similar`` searches: sets are put into partitions
by length so that sets of likeness ``least`` or more lie in the same or in neighbouring partitions, each set is posted under its rarest
signatures only, as many as a set that like cannot miss, and only sets that meet in a partition under a signature are compared.

``successors`` finds each document's neighbour in order of id: rows are cut into ranges of ids by quantiles, every range also gets the first
row of the range that follows, and each range is walked in order. Only range bounds and first ids reach the driver, as many as
there are ranges; texts are shuffled once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import LETTERS, mixed, split_words, stored, text_blocks

#: Fixed list of common words: English, German, French, Spanish.
COMMON = (
    "the of and to in a is that it for on was be with as by this an at are "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de et un une du est que pour dans qui par plus sur au ce il pas "
    "el los las y en del se por con no para su al lo como más pero sus o"
).split()
CHAIN = 2
EVERY = 16
LEAST = 0.8
LOWEST = -(1 << 63)
#: Bytes of text that a task works on at once.
GROUP_BYTES = 4 << 20


def _common_hashes() -> np.ndarray:
    texts = pa.array(COMMON, pa.string())
    (_, _, data, bounds), = text_blocks(texts)
    words = split_words(data, bounds, LETTERS)
    return np.unique(words.hashes(words.start, words.end))


def signature_sets(texts: list[str], chain: int = CHAIN) -> list[np.ndarray]:
    """Sorted distinct signatures of each text."""
    out: list[np.ndarray] = []
    common = _common_hashes()
    for first, rows, data, bounds in text_blocks(pa.array(texts, pa.large_string())):
        words = split_words(data, bounds, LETTERS)
        hashes = words.hashes(words.start, words.end)
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        stop = common[at] == hashes
        content = np.flatnonzero(~stop)
        anchors = np.flatnonzero(stop | (hashes % np.uint64(EVERY) == 0))
        begin = np.flatnonzero(np.diff(np.concatenate([[-1], words.doc])))
        doc = np.concatenate([words.doc[anchors], words.doc[begin]])
        total = np.concatenate([hashes[anchors], np.zeros(len(begin), dtype=np.uint64)])
        # place in the list of content words of the first one behind the anchor; a text's beginning has its first word behind it
        follow = np.concatenate([np.searchsorted(content, anchors, side="right"), np.searchsorted(content, begin)])
        for k in range(chain):
            place = np.minimum(follow + k, max(0, len(content) - 1))
            word = content[place] if len(content) else np.zeros(len(place), dtype=np.int64)
            inside = (follow + k < len(content)) & (words.doc[word] == doc) if len(words.doc) else np.zeros(len(place), dtype=bool)
            total = mixed(total * np.uint64(31) + np.where(inside, hashes[word] if len(hashes) else np.uint64(0), np.uint64(1)))
        pairs = np.unique((doc.astype(np.uint64) << np.uint64(32)) | (total >> np.uint64(32)))
        cut = np.searchsorted(pairs >> np.uint64(32), np.arange(rows + 1, dtype=np.uint64))
        values = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for k in range(rows):
            found = values[cut[k] : cut[k + 1]]
            if not len(found):
                own = hashlib.sha256(texts[first + k].encode()).digest()[:4]
                found = np.frombuffer(own, dtype="<u4")
            out.append(found)
    return out


def written(signatures: np.ndarray) -> str:
    """The set as text: its numbers in order, little-endian, in base64."""
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# --- neighbours in order of id


def ranges_task(bounds: np.ndarray, firsts: dict[int, int]) -> Callable:
    """Ranges a row goes to: its own, and the one before if it is the first of its range. Range 0 has the largest ids."""

    def places(ids: pa.Array) -> pa.Array:
        values = np.asarray(ids.fill_null(LOWEST)).astype(np.int64)
        own = len(bounds) - np.searchsorted(bounds, values, side="left")
        lists = [[o, firsts[v]] if v in firsts else [o] for o, v in zip(own.tolist(), values.tolist())]
        return pa.array(lists, pa.list_(pa.int32()))

    return places


def successors(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows (range, ghost, doc_id, text), sorted within partitions: by range, ghosts last, then descending doc_id.

    A ghost is the first row of what follows its range. Null ids count as smallest; rows of one id are in order of a hash of their texts.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col("doc_id"), F.lit(LOWEST))
    shares = [k / number for k in range(1, number)]
    cuts = rows.agg(F.percentile_approx(order, shares or [0.5], 10_000)).first()[0] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64))
    # a row above bounds[k] and not above bounds[k + 1] is in range len(bounds) - k - 1
    own = F.arrow_udf(lambda ids: pa.array(len(bounds) - np.searchsorted(bounds, np.asarray(ids), side="left"), pa.int32()), "int")
    tops = sorted((row["range"], row["top"]) for row in rows.select(own(order).alias("range"), order.alias("id")).groupBy("range").agg(F.max("id").alias("top")).collect())
    firsts = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}
    places = F.arrow_udf(ranges_task(bounds, firsts), "array<int>")
    placed = rows.withColumn("places", places("doc_id")).select("doc_id", "text", F.posexplode("places").alias("ghost", "range"))
    placed = placed.select("range", (F.col("ghost") > 0).alias("ghost"), "doc_id", "text")
    # the range's number is the partition's: a hash of it would put some ranges together and leave partitions empty
    return placed.repartitionById(number, F.col("range")).sortWithinPartitions("range", "ghost", order.desc(), F.xxhash64("text"))


def print_task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the rows of ``successors``, which come in order."""
    held: list[tuple] = []
    size = 0

    def worked() -> pa.RecordBatch:
        """All held rows but the last, each with the row behind it."""
        pairs = [(a, b) for a, b in zip(held, held[1:]) if not a[1] and a[0] == b[0]]
        ids = pa.array([a[2] for a, _ in pairs], kind)
        changed = [edited(a[3], b[3]) for a, b in pairs]
        sets = signature_sets([a[3] for a, _ in pairs] + changed + [b[3] for _, b in pairs])
        n = len(pairs)
        own, new, following = sets[:n], sets[n : 2 * n], sets[2 * n :]
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                pa.array(map(written, own), pa.string()), pa.array(map(written, new), pa.string()),
                pa.array(map(likeness, own, new), pa.float64()), pa.array(map(likeness, own, following), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in rows:
        kind = batch.column(2).type
        for row in zip(*(batch.column(k) for k in range(4))):
            row = tuple(x.as_py() for x in row)
            held.append(row)
            size += len(row[3])
            if size > GROUP_BYTES and len(held) > 1:
                yield worked()
                held, size = held[-1:], len(held[-1][3])
    if len(held) > 1:
        yield worked()


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty. A single row follows itself. Repeated rows follow each other. Other columns are not read; an empty
    table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = (
        f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return successors(spark, docs).mapInArrow(print_task, columns)


# --- search by length partitions


def sets_task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, asked, signatures) of rows of (doc_id, asked, text)."""
    for batch in rows:
        for first in range(0, batch.num_rows, 64):
            part = batch.slice(first, 64)
            sets = signature_sets(part.column(2).to_pylist())
            lists = pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "asked", "signatures"])


def length_partition(size: Column, least: float) -> Column:
    """Number of the length partition: each is 1 / least times as wide as the one before, so sets alike lie one apart at most."""
    return F.floor(F.ln(size.cast("double")) / F.ln(F.lit(1 / least))).cast("int")


def prefix_size(size: Column, least: float) -> Column:
    """How many signatures a set is posted under: sets that share none of them, in one order of all signatures, are less alike than ``least``."""
    return size - F.ceil(size * least - 1e-9).cast("int") + 1


def classes(spark: SparkSession, docs: DataFrame, asked: Column) -> tuple[DataFrame, DataFrame]:
    """(members, sets): doc_id and class_id of each row; class_id, asked, signatures of each distinct set.

    A class is named by its smallest doc_id and is asked for if a member is. Rows without doc_id take no part.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter("doc_id is not null").select("doc_id", F.coalesce(asked, F.lit(False)).alias("asked"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(spark, rows.mapInArrow(sets_task, f"doc_id {id_type}, asked boolean, signatures array<bigint>"), "spotsigs-sets")
    sets = stored(spark, found.groupBy("signatures").agg(F.min("doc_id").alias("class_id"), F.max("asked").alias("asked")), "spotsigs-classes")
    return found.join(sets.select("signatures", "class_id"), "signatures").select("doc_id", "class_id"), sets


def similar(spark: SparkSession, docs: DataFrame, asked: Column, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members, links): doc_id and class_id of each row, and (query_id, class_id, likeness) of classes alike by ``least`` or more.

    Documents with equal sets form a class, named by its smallest doc_id. query_id is a class with a row for which ``asked``, a condition on
    ``docs``, holds; links of a class to itself are left out. ``least`` is above 0 and below 1. Null texts count as empty, rows without
    doc_id take no part, repeated rows fall into one class, other columns are read by ``asked`` alone; an empty table gives no rows.
    Frequent signatures come last in the order of a set, so a signature that very many sets have is rarely posted.
    """
    members, sets = classes(spark, docs, asked)
    single = sets.select("class_id", "asked", F.size("signatures").alias("size"), F.explode("signatures").alias("signature"))
    often = single.groupBy("signature").agg(F.count(F.lit(1)).alias("often"))
    ordered = single.join(often, "signature").groupBy("class_id", "asked", "size").agg(F.sort_array(F.collect_list(F.struct("often", "signature"))).alias("ordered"))
    first = F.slice("ordered", F.lit(1), prefix_size(F.col("size"), least))
    posted = stored(
        spark,
        ordered.select("class_id", "asked", "size", length_partition(F.col("size"), least).alias("part"), F.explode(first).alias("of"))
        .select("class_id", "asked", "size", "part", F.col("of.signature").alias("signature")),
        "spotsigs-postings",
    )
    near = F.explode(F.array(*(F.col("part") + k for k in (-1, 0, 1))))
    probes = posted.filter("asked").select(F.col("class_id").alias("query_id"), F.col("size").alias("query_size"), near.alias("part"), "signature")
    close = F.least("size", "query_size") >= F.greatest("size", "query_size") * least - 1e-9
    met = probes.join(posted.drop("asked"), ["part", "signature"]).filter(close & (F.col("query_id") != F.col("class_id")))
    pairs = met.select("query_id", "class_id").distinct()
    own = sets.select(F.col("class_id").alias("query_id"), F.col("signatures").alias("query_signatures"))
    both = pairs.join(own, "query_id").join(sets.select("class_id", "signatures"), "class_id")
    shared = F.size(F.array_intersect("signatures", "query_signatures"))
    value = shared / (F.size("signatures") + F.size("query_signatures") - shared)
    return members, both.select("query_id", "class_id", value.alias("likeness")).filter(F.col("likeness") >= least - 1e-9)
