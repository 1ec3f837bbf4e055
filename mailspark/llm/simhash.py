"""SimHash near-dedup: fingerprints, and links by the generalised pigeonhole principle.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes of the text's word shingles, repeats included. Linked are
fingerprints that differ in at most ``distance`` bits. Search runs over distinct fingerprints:

1. Correlated bits are grouped into partitions, from counts over all fingerprints.
2. Thresholds t_i of the partitions, -1 (not probed) up to the distance, have the sum distance - partitions + 1. Two fingerprints within
   the distance then differ by at most t_i bits in some partition i. Dynamic programming picks the cheapest thresholds from estimated
   candidates (exact counts of equal values, spread to larger radii by the bits' own rates) and probe keys; the number of
   partitions is picked the same way.
3. Each fingerprint is stored under its value in each probed partition and probes all values within t_i. Candidates are verified by
   the bits that differ.
4. Buckets of more than ``BUCKET`` fingerprints would make a square of candidates. Everything that is in or probes one of them goes
   another exact way: two fingerprints within 2 bits have a common neighbour at 1 bit or less, so each is listed under
   itself and its 64 neighbours, and a list (65 members at most, all within 2 bits of each other) needs only links to its smallest member.
   For larger distances the neighbourhood grows with it.

Components of the links then give each document its class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from mailspark.llm.common import signed, stored
from mailspark.llm.components import components

BITS = 64
BUCKET = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Majority of the hash bits over shingles of words; a text of fewer words is one shingle, one of none is zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for first in range(0, len(hashes), PIECE):
        some = hashes[first : first + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_task(shingle: int, seed: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            prints = np.array([fingerprint(x.as_py(), shingle, seed) for x in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(signed(prints))], names=[*batch.schema.names[:-1], "print"])

    return task


def fingerprints(docs: DataFrame, keys: dict[str, Column], shingle: int = 3, seed: int = 42) -> DataFrame:
    """``keys`` (name: column of docs) and ``print`` (signed 64 bits) for each row; a null text counts as empty."""
    rows = docs.select(*(c.alias(name) for name, c in keys.items()), F.coalesce("text", F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(fingerprint_task(shingle, seed), f"{schema}, print bigint")


# --- statistics over all fingerprints


def _bit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for batch in batches:
        values = np.asarray(batch.column(0)).view(np.uint64)
        for first in range(0, len(values), PIECE):
            bits = np.unpackbits(values[first : first + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    i, j = (x.ravel() for x in np.indices(total.shape))
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(number, how often two bits are both set): 64 times 64 counts, whatever the data."""
    rows = prints.mapInArrow(_bit_pairs, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((BITS, BITS))
    both[rows["i"], rows["j"]] = rows["n"]
    return prints.count(), both


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of nearly equal size; each takes the free bit most correlated with those it has."""
    rate = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    correlation = np.abs(both / max(n, 1) - np.outer(rate, rate)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    free, out = set(range(BITS)), []
    for p in range(parts):
        size = BITS * (p + 1) // parts - BITS * p // parts
        group = [max(sorted(free), key=lambda b: correlation[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: correlation[b, group].sum())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def radius_counts(rates: np.ndarray, distance: int) -> np.ndarray:
    """Chance that two fingerprints differ by at most t of the bits, t = 0 .. distance, for independent bits."""
    chance = np.zeros(distance + 1)
    chance[0] = 1
    for q in 2 * rates * (1 - rates):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.cumsum(chance)


def thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Cheapest t_i with the sum ``total``; costs[i][t + 1] is partition i's cost at threshold t, from -1 on."""
    best = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (price, chosen) in best.items():
            for t, c in enumerate(cost, -1):
                if spent + t not in step or price + c < step[spent + t][0]:
                    step[spent + t] = (price + c, [*chosen, t])
        best = step
    return best[total]


def mask(bits: list[int] | tuple[int, ...]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def plan(prints: DataFrame, distance: int) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the probed partitions."""
    n, both = bit_statistics(prints)
    rate = np.diag(both) / max(n, 1)
    layouts = {parts: grouped_bits(both, n, parts) for parts in range(2, distance + 3)}
    pieces = [mask(bits) for layout in layouts.values() for bits in layout]
    values = prints.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.expr(f"print & {m}L").alias("v")) for k, m in enumerate(pieces)))).alias("x"))
    squares = dict(values.groupBy("x.k", "x.v").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("k").agg(F.sum(F.col("c") * F.col("c"))).collect())
    options, at = [], 0
    for parts, layout in layouts.items():
        costs = []
        for bits in layout:
            equal = squares.get(at, 0.0) / max(n, 1)
            at += 1
            near = radius_counts(rate[bits], distance)
            keys = np.cumsum([len(list(combinations(bits, t))) for t in range(distance + 1)])
            costs.append([0.0, *(equal * near / max(near[0], 1e-12) + keys)])
        price, chosen = thresholds(costs, distance - parts + 1)
        options.append((price, [(bits, t) for bits, t in zip(layout, chosen) if t >= 0]))
    return min(options, key=lambda option: option[0])[1]


def links(spark: SparkSession, prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``print``) whose components are those of all pairs within ``distance`` bits.

    Pairs outside full buckets are all there; a fingerprint of a full bucket is linked to the smallest of each neighbourhood.
    """
    layout = plan(prints, distance)
    stores = F.array(*(F.struct(F.lit(k).alias("part"), F.expr(f"print & {mask(bits)}L").alias("value")) for k, (bits, _) in enumerate(layout)))
    index = prints.select("print", F.explode(stores).alias("x")).select("print", "x.part", "x.value")
    probes = prints.select("print", F.explode(F.array(*(
        F.struct(F.lit(k).alias("part"), F.expr(f"(print & {mask(bits)}L) ^ {mask(flip)}L").alias("value"))
        for k, (bits, t) in enumerate(layout) for size in range(t + 1) for flip in combinations(bits, size)
    ))).alias("x")).select(F.col("print").alias("probe"), "x.part", "x.value")
    full = stored(spark, index.groupBy("part", "value").count().filter(F.col("count") > bucket).select("part", "value"), "full-buckets")
    pairs = (
        index.join(full, ["part", "value"], "left_anti").join(probes.join(full, ["part", "value"], "left_anti"), ["part", "value"])
        .filter((F.col("probe") != F.col("print")) & (F.bit_count(F.col("probe").bitwiseXOR(F.col("print"))) <= distance))
        .select(F.least("probe", "print").alias("a"), F.greatest("probe", "print").alias("b"))
    )
    crowded = probes.join(full, ["part", "value"], "left_semi").select("probe").distinct()
    reach = (distance + 1) // 2
    flips = [mask(flip) for size in range(reach + 1) for flip in combinations(range(BITS), size)]
    listed = crowded.select("probe", F.explode(F.array(*(F.lit(f) for f in flips))).alias("flip")).select("probe", F.expr("probe ^ flip").alias("meeting"))
    # an odd distance meets at one bit less on one side
    if distance % 2:
        listed = listed.withColumn("far", F.bit_count(F.col("probe").bitwiseXOR(F.col("meeting"))) == reach)
        near = listed.filter("not far").groupBy("meeting").agg(F.min("probe").alias("least"))
        stars = listed.join(near, "meeting").select(F.col("least").alias("a"), F.col("probe").alias("b"))
    else:
        met = listed.groupBy("meeting").agg(F.min("probe").alias("least"), F.collect_list("probe").alias("all")).filter("size(all) > 1")
        stars = met.select(F.col("least").alias("a"), F.explode("all").alias("b"))
    return pairs.union(stars).filter("a <> b").distinct()


def classes(spark: SparkSession, prints: DataFrame, distance: int = 2) -> DataFrame:
    """(print, class): class is the smallest fingerprint linked to it; fingerprints without links are their own class."""
    distinct = stored(spark, prints.select("print").distinct(), "prints")
    found = components(links(spark, distinct, distance)).withColumnRenamed("component", "class")
    joined = distinct.join(found, distinct["print"] == found["node"], "left").drop("node")
    return joined.select("print", F.coalesce("class", "print").alias("class"))


def near_duplicates(spark: SparkSession, docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Equal fingerprints are one node, so copies cost no pairs. A null text counts as empty; a null doc_id is the smallest only where
    a component has no other. Other columns are not read. An empty table gives no rows.
    """
    marked = stored(spark, fingerprints(docs, {"doc_id": F.col("doc_id")}, shingle, seed), "simhash")
    named = class_ids(spark, marked, distance)
    return marked.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def class_ids(spark: SparkSession, marked: DataFrame, distance: int) -> DataFrame:
    """(print, component_id) for rows of (doc_id, print)."""
    least = stored(spark, marked.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "print-ids")
    grouped = classes(spark, least, distance).join(least, "print")
    ids = grouped.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(ids, "class").select("print", "component_id")


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row. Maps, which Spark does not hash, count as their JSON text."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*parts)


def deduplicated(spark: SparkSession, docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row of each near-duplicate class, all columns: the one with the smallest (doc_id, hash of all its columns).

    Rows repeated in all columns count as copies. Null ids come after all others. Columns may have any names and types. Rows are reduced to
    the first of each fingerprint before anything is joined, so a fingerprint of very many rows is one row from then on.
    """
    own = row_hash(docs)
    marked = fingerprints(docs, {"doc_id": F.col("doc_id"), "row_key": own}, shingle, seed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_key"))).alias("first")
    firsts = stored(spark, marked.groupBy("print").agg(first), "simhash-firsts")
    grouped = firsts.join(classes(spark, firsts, distance), "print").groupBy("class").agg(F.min("first").alias("first"))
    free = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    kept = stored(spark, grouped.select(F.col("first.doc_id").alias(f"{free}id"), F.col("first.row_key").alias(f"{free}key")), "simhash-kept")
    joined = docs.withColumn(f"{free}own", own).join(kept, F.col("doc_id").eqNullSafe(F.col(f"{free}id")) & (F.col(f"{free}own") == F.col(f"{free}key")), "left_semi")
    return joined.dropDuplicates(["doc_id", f"{free}own"]).drop(f"{free}own")
