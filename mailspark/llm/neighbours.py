"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred and rotated so that the signs of their components keep most of what they say (iterative quantization on a bounded
sample); the signs are a code of at most 64 bits. Codes are split into substrings, and each substring is an index of its own: rows lie in
shards by the first bits of the substring, in blocks sorted by its value. Two codes within the radius differ in at most a few bits of
some substring (pigeonhole), so a query goes to the shards that may hold such substrings, probes their buckets, and keeps rows whose whole code is
within the radius. Those are ranked by the distance of the vectors themselves. A row that several substrings find is taken at the first.

The radius is set on the sample: neighbours there lie farther apart than among all rows, so recall on all rows is no lower than wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import stored
from mailspark.llm.vectors import BLOCK_ROWS, GROUP_ROWS, best, cut, finite, matrix, met, row_of, top

#: Rows that the rotation and the radius are fitted on; every row is indexed.
SAMPLE = 20_000
#: Sample rows that serve as queries when the radius is set, and the share of their neighbours it has to reach.
TRIALS, RECALL = 400, 0.98
ROUNDS = 40
LARGEST = 1e100
#: Rows of a shard, on average, when shards are as many as they may be.
SHARD_ROWS = 1 << 14


@dataclass
class Codes:
    """mean and rotation make codes; substrings have (first bit, bits, greatest distance that is probed, -1: none)."""

    size: int
    mean: np.ndarray
    rotation: np.ndarray
    radius: int
    substrings: list[tuple[int, int, int]]
    prefix: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            signs = ((vectors - self.mean) @ self.rotation > 0).astype(np.uint64)
        return (signs << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def part(self, codes: np.ndarray, k: int) -> np.ndarray:
        first, bits, _ = self.substrings[k]
        return (codes >> np.uint64(first)) & np.uint64((1 << bits) - 1)

    def everything(self) -> Codes:
        """The same index, probed for codes at any distance: the first substring alone finds them all."""
        whole = [(first, bits, bits if k == 0 else -1) for k, (first, bits, _) in enumerate(self.substrings)]
        return Codes(self.size, self.mean, self.rotation, self.bits, whole, self.prefix)


def rotation(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, rotation to at most 64 components) of the sample, by iterative quantization."""
    mean = vectors.mean(0) if len(vectors) else np.zeros(vectors.shape[1])
    centred = vectors - mean
    width = min(64, vectors.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    main = axes[:, ::-1][:, :width]
    projected = centred @ main
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(width, width)))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = right.T @ left.T
    return mean, main @ turn


def fitted(vectors: np.ndarray, rows: int, count: int) -> Codes:
    """Codes for ``rows`` rows, from the sample ``vectors``; ``count`` neighbours are wanted."""
    size = vectors.shape[1]
    # squares of larger components would overflow; such rows are indexed, but nothing is learnt from them
    vectors = vectors[(np.abs(vectors) < LARGEST).all(1)]
    mean, turn = rotation(vectors)
    bits = turn.shape[1]
    codes = Codes(size, mean, turn, bits, [], 0)
    made, distances = codes.of(vectors), []
    squares = (vectors**2).sum(1)
    for k in range(min(TRIALS, len(vectors))):
        far = squares - 2 * vectors @ vectors[k]
        far[k] = np.inf
        near = np.argsort(far, kind="stable")[: min(count, len(vectors) - 1)]
        distances.append(np.bitwise_count(made[near] ^ made[k]))
    if distances and len(np.concatenate(distances)):
        codes.radius = int(np.quantile(np.concatenate(distances), RECALL, method="higher"))
    parts = max(1, round(bits / min(16, max(8, log2(max(rows, 2))))))
    bounds = [bits * k // parts for k in range(parts + 1)]
    # pigeonhole: sum of (reach + 1) is radius + 1
    reach = [(codes.radius + 1) // parts + (k < (codes.radius + 1) % parts) - 1 for k in range(parts)]
    codes.substrings = [(a, b - a, min(t, b - a)) for a, b, t in zip(bounds, bounds[1:], reach)]
    codes.prefix = max(0, min(round(log2(max(1, rows / SHARD_ROWS))), min(b for _, b, _ in codes.substrings)))
    return codes


def _code_task(codes: Codes) -> Callable:
    """(row_key, vec_id, asked, code, vector as bytes) of rows (vec_id, asked, vector)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = matrix(batch.column(2), codes.size)
            keys = pa.array(np.arange(ahead, ahead + len(rows)))
            ahead += len(rows)
            raw = pa.array([x.tobytes() for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column(0), batch.column(1), pa.array(codes.of(rows).view(np.int64)), raw], names=["row_key", "vec_id", "asked", "code", "vector"]
            )

    return task


def _block_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (block_no, shard, row_keys, vec_ids, codes, vectors) of rows (shard, row_key, vec_id, code, vector) that come by shard and substring."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in cut(batches, BLOCK_ROWS):
        shards = batch.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            some = batch.slice(a, b - a)
            columns = [some.column(k).to_numpy().tobytes() for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made]), pa.array([int(shards[a])], pa.int32()), *(pa.array([c], pa.binary()) for c in columns), pa.array([b"".join(some.column(4).to_pylist())], pa.binary())],
                names=["block_no", "shard", "row_keys", "vec_ids", "codes", "vectors"],
            )
            made += 1


def probed(directory: np.ndarray, value: int, reach: int, bits: int, masks: np.ndarray) -> np.ndarray:
    """Places in the sorted ``directory`` of the buckets at most ``reach`` bits from ``value``: each such value is looked up, or where there are fewer buckets, each bucket compared."""
    if len(masks) < len(directory):
        wanted = np.uint64(value) ^ masks
        at = np.minimum(np.searchsorted(directory, wanted), len(directory) - 1)
        return at[directory[at] == wanted]
    return np.flatnonzero(np.bitwise_count(directory ^ np.uint64(value)) <= reach)


def distance(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added from the first component to the last."""
    total = np.zeros(len(rows))
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            total += (rows[:, k] - query[k]) ** 2
    return np.sqrt(total)


def _search_task(codes: Codes, count: int) -> Callable:
    """(query_key, query_id, vec_id, score): the nearest ``count`` rows of a block within the radius, for each query of a group."""
    values = [np.arange(1 << bits, dtype=np.uint64) if bits <= 16 else np.zeros(0, np.uint64) for _, bits, _ in codes.substrings]
    masks = [v[np.bitwise_count(v) <= reach] if reach >= 0 else v[:0] for v, (_, _, reach) in zip(values, codes.substrings)]

    def search(row: dict) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        k = row["shard"] >> codes.prefix
        _, bits, reach = codes.substrings[k]
        keys, ids = np.frombuffer(row["row_keys"], np.int64), np.frombuffer(row["vec_ids"], np.int64)
        stored_codes, vectors = np.frombuffer(row["codes"], np.uint64), np.frombuffer(row["vectors"], np.float64).reshape(-1, codes.size)
        directory, start = np.unique(codes.part(stored_codes, k), return_index=True)
        end = np.append(start[1:], len(stored_codes))
        queries = np.frombuffer(b"".join(row["query_vectors"]), np.float64).reshape(-1, codes.size)
        asked = np.array(row["query_codes"], np.int64).view(np.uint64)
        for q, value in enumerate(codes.part(asked, k).tolist()):
            hit = probed(directory, value, reach, bits, masks[k])
            sizes = end[hit] - start[hit]
            at = np.repeat(start[hit] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            apart = stored_codes[at] ^ asked[q]
            near = (np.bitwise_count(apart) <= codes.radius) & (keys[at] != row["query_keys"][q])
            for earlier in range(k):
                near &= np.bitwise_count(codes.part(apart, earlier)).astype(np.int64) > codes.substrings[earlier][2]
            at = at[near]
            if not len(at):
                continue
            if len(at) > count:
                # rough squares first; rounding moves them by far less than the allowance
                gap = vectors[at] - queries[q]
                rough = np.einsum("ij,ij->i", gap, gap)
                at = at[rough <= np.partition(rough, count - 1)[count - 1] * (1 + 1e-9)]
            score = distance(vectors[at], queries[q])
            some = top(-score, ids[at], count)
            yield row["query_keys"][q], row["query_ids"][q], ids[at[some]], score[some]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = list(search(row_of(batch, k)))
                sizes = [len(f[2]) for f in found]
                lists = [np.repeat(np.array([f[k] for f in found], dtype=np.int64), sizes) for k in (0, 1)]
                lists += [np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in ((2, np.int64), (3, np.float64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in lists], names=["query_key", "query_id", "vec_id", "score"])

    return task


def _probes(queries: DataFrame, codes: Codes) -> DataFrame:
    """Queries in groups beside the shards that may hold a substring near theirs."""
    numbers = F.sequence(F.lit(0).cast("long"), F.lit((1 << codes.prefix) - 1).cast("long"))

    def shards(k: int) -> Column:
        first, bits, reach = codes.substrings[k]
        own = F.shiftrightunsigned("code", first + bits - codes.prefix).bitwiseAND((1 << codes.prefix) - 1)
        near = F.filter(numbers, lambda x: F.bit_count(x.bitwiseXOR(own)) <= reach)
        return F.transform(near, lambda x: (x + F.lit(k << codes.prefix)).cast("int"))

    dealt = queries.withColumn("shard", F.explode(F.concat(*map(shards, range(len(codes.substrings))))))
    members = F.collect_list(F.struct("row_key", "vec_id", "code", "vector")).alias("m")
    names = (("row_key", "query_keys"), ("vec_id", "query_ids"), ("code", "query_codes"), ("vector", "query_vectors"))
    return dealt.groupBy("shard", "group_no").agg(members).select("shard", *[F.col("m")[old].alias(new) for old, new in names])


def nearest(spark: SparkSession, table: DataFrame, queries: Column, count: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``count`` nearest rows found for every row for which ``queries`` holds, nearest first.

    ``table`` has vec_id and embedding; other columns are not read, whatever their names. Candidates are all rows but the query's
    own; score is the Euclidean distance of the vectors in double precision, ties go to the smaller vec_id. Rows without
    vec_id, and vectors that are null, all zero, or hold null or non-finite components take no part; a shorter vector counts as
    filled up with zeros. Repeated ids are rows of their own. Fewer candidates than ``count`` are all returned: a query for which the radius holds too
    few is compared with every row. No rows, or no queries, give no rows.
    """
    rows = table.select("vec_id", F.coalesce(queries, F.lit(False)).alias("asked"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite("vector") & F.exists("vector", lambda x: x != 0))
    n, size, n_queries = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.count_if("asked")).first()
    size = max(1, size or 0)
    # a row's place takes part, so that repeated rows are drawn one by one
    draw = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(1 << 40))
    drawn = rows.select("vector", draw.alias("draw")).filter(F.col("draw") < int(min(1.0, 1.2 * SAMPLE / max(n, 1)) * (1 << 40)))
    sample = matrix(drawn.orderBy("draw").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks(), size)
    codes = fitted(sample, n, count)

    schema = "row_key bigint, vec_id bigint, asked boolean, code bigint, vector binary"
    coded = stored(spark, rows.select(F.col("vec_id").cast("long"), "asked", "vector").mapInArrow(_code_task(codes), schema), "codes")
    places = []
    for k, (first, bits, _) in enumerate(codes.substrings):
        value = F.shiftrightunsigned("code", first).bitwiseAND((1 << bits) - 1)
        places.append(F.struct(((k << codes.prefix) + F.shiftrightunsigned(value, bits - codes.prefix)).cast("int").alias("shard"), value.alias("value")))
    placed = coded.withColumn("place", F.explode(F.array(*places))).select("place.*", "row_key", "vec_id", "code", "vector")
    ordered = placed.repartitionByRange("shard", "value", "row_key").sortWithinPartitions("shard", "value").drop("value")
    blocks = stored(spark, ordered.mapInArrow(_block_task, "block_no bigint, shard int, row_keys binary, vec_ids binary, codes binary, vectors binary"), "substring-blocks")

    asked = coded.filter("asked").withColumn("group_no", F.pmod(F.xxhash64("row_key"), F.lit(max(1, -(-n_queries // GROUP_ROWS)))))
    found_schema = "query_key bigint, query_id bigint, vec_id bigint, score double"
    order = [F.asc("score"), F.asc("vec_id")]

    def searched(some: DataFrame, how: Codes) -> DataFrame:
        weight = n_queries * (8 * size + 64) * len(how.substrings) << how.prefix
        found = met(blocks, _probes(some, how), ["shard"], weight).mapInArrow(_search_task(how, count), found_schema)
        return best(found, ["query_key"], order, count)

    first = stored(spark, searched(asked, codes), "found")
    enough = first.groupBy("query_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(count, max(n - 1, 0)))
    few = asked.join(enough.select(F.col("query_key").alias("row_key")), "row_key", "left_anti")
    result = first
    if codes.radius < codes.bits and few.limit(1).count():
        rest = searched(few, codes.everything())
        result = first.join(few.select(F.col("row_key").alias("query_key")), "query_key", "left_anti").unionByName(rest)
    return result.select("query_id", "rank", "vec_id", "score")
