"""Unread counters of folders, from scratch and from a list of changes.

A drafts folder counts its unread drafts, every other folder its unread messages that are no drafts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.operators.joins import salted_join
from mailspark.schemas import mailbox_key

# Changes of one folder are first folded in blocks of this many sequence numbers.
BLOCK = 1 << 16


def folder_rules(folders: DataFrame) -> DataFrame:
    """Which messages a folder counts. A folder without a type but named like drafts counts both kinds."""
    drafts_name = F.col("name").ilike("%draft%")
    drafts = (F.col("type") == "drafts") | drafts_name
    others = F.col("type").isNull() | ((F.col("type") != "drafts") & ~drafts_name)
    return folders.select(
        *mailbox_key(folders),
        F.col("id").alias("folder_id"),
        F.coalesce(drafts, F.lit(False)).alias("counts_drafts"),
        F.coalesce(others, F.lit(False)).alias("counts_others"),
    )


def _counted(is_draft: Column) -> Column:
    draft = F.coalesce(is_draft, F.lit(0))
    return (F.col("counts_drafts") & (draft == 1)) | (F.col("counts_others") & (draft == 0))


def folder_unread(messages: DataFrame, folders: DataFrame) -> DataFrame:
    """Unread counter of every folder. Messages are counted before the join."""
    draft = F.coalesce(F.col("is_draft"), F.lit(0))
    boxed = mailbox_key(messages, folders)
    unread = messages.filter(F.col("is_read") == 0).groupBy(*boxed, "folder_id").agg(
        F.count_if(draft == 1).alias("drafts"), F.count_if(draft == 0).alias("others")
    )
    amount = F.when(F.col("counts_drafts"), F.col("drafts")).otherwise(F.lit(0)) + F.when(
        F.col("counts_others"), F.col("others")
    ).otherwise(F.lit(0))
    joined = folder_rules(folders).join(unread, [*boxed, "folder_id"], "left")
    return joined.select(*boxed, "folder_id", F.coalesce(amount, F.lit(0)).alias("unread_count"))


def unread_deltas(changes: DataFrame, folders: DataFrame) -> DataFrame:
    """Steps of +1 and -1 per folder, in ``seq`` order.

    ``changes`` has ``seq``, ``op`` (insert, update, delete), ``folder_id``, ``is_draft``,
    ``old_is_read`` and ``is_read``; folder and draft mark are those after an update. An update
    counts only when the read mark changes.
    """
    step = (
        F.when((F.col("op") == "insert") & (F.col("is_read") == 0), 1)
        .when((F.col("op") == "delete") & (F.col("old_is_read") == 0), -1)
        .when((F.col("op") == "update") & (F.col("old_is_read") == 0) & (F.col("is_read") == 1), -1)
        .when((F.col("op") == "update") & (F.col("old_is_read") == 1) & (F.col("is_read") == 0), 1)
    )
    steps = changes.withColumn("step", step.cast("long")).filter(F.col("step").isNotNull())
    rules = folder_rules(folders).withColumnRenamed("folder_id", "rule_folder")
    matched = salted_join(steps, rules, "folder_id", "rule_folder", "seq", "inner")
    return matched.filter(_counted(F.col("is_draft"))).select(*mailbox_key(changes, folders), "folder_id", "seq", "step")


def after_changes(counters: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters after all steps, never going below zero on the way.

    A walk held at zero ends at ``sum + max(start, -lowest running sum)``. Running sums are built in
    two levels, inside blocks of sequence numbers and then over block totals, so a folder that takes
    most of the changes is shared by many tasks.
    """
    block = F.floor(F.col("seq") / BLOCK).alias("block")
    folder = [*mailbox_key(deltas, counters), "folder_id"]
    steps = deltas.select(*folder, block, "seq", "step")
    inside = Window.partitionBy(*folder, "block").orderBy("seq")
    blocks = (
        steps.withColumn("running", F.sum("step").over(inside))
        .groupBy(*folder, "block")
        .agg(F.sum("step").alias("total"), F.min("running").alias("lowest"))
    )
    earlier = Window.partitionBy(*folder).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        blocks.withColumn("lowest", F.coalesce(F.sum("total").over(earlier), F.lit(0)) + F.col("lowest"))
        .groupBy(*folder)
        .agg(F.sum("total").alias("total"), F.min("lowest").alias("lowest"))
    )
    final = F.col("total") + F.greatest(F.col("unread_count"), -F.col("lowest"))
    return counters.join(ends, folder, "left").select(*folder, F.coalesce(final, F.col("unread_count")).alias("unread_count"))
