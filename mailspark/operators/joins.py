"""Key joins that stay even when one key holds a large share of the rows.

The left side gets a salt from a column that differs between rows, the key side is repeated once
per salt. A key with a third of all rows is then spread over ``SALTS`` shuffle partitions, and Spark's
adaptive skew join cuts those further to its target size. When the key side is small Spark broadcasts
it by its own size check and the salt costs one hash per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.schemas import mailbox_key

SALTS = 16


def salt_of(spread: Column) -> Column:
    return F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")


def salted_join(left: DataFrame, keys: DataFrame, on: str, key: str, spread: str, how: str) -> DataFrame:
    """Join ``left.on = keys.key`` with hot values of ``left.on`` spread by ``spread``, inside a mailbox where both sides name it."""
    boxed = mailbox_key(left, keys)
    salted = left.withColumn("_salt", salt_of(F.col(spread)))
    repeated = keys.withColumnsRenamed({key: "_key"} | {c: "_key_box" for c in boxed})
    repeated = repeated.withColumn("_key_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = (salted[on] == repeated["_key"]) & (salted["_salt"] == repeated["_key_salt"])
    if boxed:
        match = match & salted["mailbox"].eqNullSafe(repeated["_key_box"])
    joined = salted.join(repeated, match, how).drop("_salt")
    return joined if how in ("left_semi", "left_anti") else joined.drop("_key", "_key_salt", "_key_box")


def matched(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join on ``on``, inside a mailbox where both sides name it (a null mailbox is one of its own)."""
    boxed = mailbox_key(left, right)
    keys = right.select(F.col(on).alias("_other"), *[F.col(c).alias("_other_box") for c in boxed])
    match = left[on] == keys["_other"]
    return left.join(keys, match & left["mailbox"].eqNullSafe(keys["_other_box"]) if boxed else match, how)
