"""The profile as a rollup: one additive row per (mailbox,) folder and month, kept in Parquet and added up as wanted.

Every measure of a cell merges with that of another: counts and sums add, bounds take the outermost, and distinct values are
HyperLogLog sketches, whose union estimates the distinct values of both. New mail is rolled up by itself and
merged; the messages behind a stored rollup are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.schemas import mailbox_key

LENGTHS = ("subject", "body_text", "snippet")
RECIPIENTS = ("to", "cc", "bcc")

#: Sketched columns by the name of their count; empty ids count as none, an empty address is an address.
DISTINCT = {"distinct_message_id": "message_id", "distinct_thread_id": "thread_id", "distinct_senders": "from_address"}

#: 2^14 registers: a standard error below 1 %.
SKETCH_BITS = 14

SUMS = (
    "total", "is_read_sum", "marked_unread", "is_flagged_sum", "has_attachments_sum", "is_draft_sum", "with_html", "with_text",
    *[f"{c}_{part}" for c in LENGTHS for part in ("chars", "count")],
    *[f"{kind}_people" for kind in RECIPIENTS],
)
LEAST = ("first_date", *[f"{c}_min" for c in LENGTHS])
MOST = ("last_date", *[f"{c}_max" for c in LENGTHS])


def distinct_value(column: str) -> Column:
    """What is told apart in a column: any address, but only ids that are not empty."""
    return F.col(column) if column == "from_address" else F.nullif(F.col(column), F.lit(""))


def sketch(column: str) -> Column:
    """Sketch of a column's distinct values; a sketch leaves empty text out, so each value has a mark in front."""
    return F.hll_sketch_agg(F.concat(F.lit("="), distinct_value(column)), SKETCH_BITS)


def _measures() -> dict[str, Column]:
    def marks(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("long")), F.lit(0))

    def filled(name: str) -> Column:
        return F.count_if(F.coalesce(F.col(name), F.lit("")) != "")

    found = {"total": F.count(F.lit(1)), "marked_unread": F.count_if(F.col("is_read") == 0)}
    found |= {f"{c}_sum": marks(c) for c in ("is_read", "is_flagged", "has_attachments", "is_draft")}
    found |= {"with_html": filled("body_html"), "with_text": filled("body_text")}
    for c in LENGTHS:
        size = F.length(c).cast("long")
        found |= {f"{c}_min": F.min(size), f"{c}_max": F.max(size), f"{c}_count": F.count(size)}
        found[f"{c}_chars"] = F.coalesce(F.sum(size), F.lit(0))
    for kind in RECIPIENTS:
        found[f"{kind}_people"] = F.coalesce(F.sum(F.json_array_length(f"{kind}_addresses").cast("long")), F.lit(0))
    found |= {"first_date": F.min("date"), "last_date": F.max("date")}
    return found | {name: sketch(column) for name, column in DISTINCT.items()}


def _merged() -> list[Column]:
    sums = [F.sum(c).alias(c) for c in SUMS]
    bounds = [F.min(c).alias(c) for c in LEAST] + [F.max(c).alias(c) for c in MOST]
    return sums + bounds + [F.hll_union_agg(c).alias(c) for c in DISTINCT]


def mailbox_rollup(messages: DataFrame) -> DataFrame:
    """One row of additive measures per folder and month (of the date text), and per mailbox where there are several.

    Messages are scanned once and reduced where they are read, so a folder with most of the mail costs its months.
    Null columns, folders and dates are measured like any other; no messages give no rows.
    """
    cells = messages.groupBy(*mailbox_key(messages), "folder_id", F.substring("date", 1, 7).alias("month"))
    return cells.agg(*[column.alias(name) for name, column in _measures().items()])


def merge_rollups(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The rollup of all messages behind these rollups; a message must be behind one of them only."""
    rows = first
    for more in others:
        rows = rows.unionByName(more)
    return rows.groupBy(*mailbox_key(rows), "folder_id", "month").agg(*_merged())


def rolled_up(rollup: DataFrame, *by: str) -> DataFrame:
    """The rollup by fewer keys, for example ``rolled_up(r, "month")``, or ``rolled_up(r)`` for one row of all."""
    return rollup.groupBy(*by).agg(*_merged())


def write_rollup(rollup: DataFrame, path: str) -> None:
    rollup.write.mode("overwrite").parquet(path)


def totals(rollup: DataFrame, *by: str) -> DataFrame:
    """Counts, flag sums, date bounds, lengths, recipients, and estimates of the distinct values, by these keys; one row without keys."""
    rows = rolled_up(rollup, *by)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    read = F.coalesce(F.col("is_read_sum"), F.lit(0))
    mean = lambda part, whole, name: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0)).alias(name)
    lengths = [
        column
        for c in LENGTHS
        for column in (zero(f"{c}_min"), zero(f"{c}_max"), mean(f"{c}_chars", f"{c}_count", f"{c}_avg"))
    ]
    named = {"flagged": "is_flagged_sum", "has_attachments": "has_attachments_sum", "drafts": "is_draft_sum"}
    return rows.select(
        *by,
        zero("total"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("first_date", "last_date")],
        read.alias("read"),
        (F.coalesce("total", F.lit(0)) - read).alias("unread"),
        *[F.coalesce(c, F.lit(0)).alias(name) for name, c in named.items()],
        zero("with_html"),
        zero("with_text"),
        *lengths,
        *[mean(f"{kind}_people", "total", f"{kind}_avg") for kind in RECIPIENTS],
        *[F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(c) for c in DISTINCT],
    )
