"""Connected components by alternating large-star and small-star steps, DataFrame operations only.

Both steps replace each node's links by links to the smallest node it sees, until every node links to the smallest node of
its component. A node with very many links is reduced by partial aggregation before the shuffle; the join that hands the
minimum back is left to adaptive skew join. Each round is cut with ``checkpoint()``, so lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROUNDS = 100


def _linked(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return _linked(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a")
    return _linked(moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b) the smallest node it is linked to. Null ends and self links add nothing.

    Nodes may be of any ordered type. Repeated links count once. No edges give no rows.
    """
    current = _linked(edges.select("a", "b").dropna()).checkpoint()
    before = None
    for _ in range(MAX_ROUNDS):
        # order-free sum of hashes as exact decimal: the same links give the same value
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        current = _small_star(_large_star(current)).checkpoint()
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
