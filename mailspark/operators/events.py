"""JSON forms of results and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.operators.search import with_position
from mailspark.schemas import DETAIL_COLUMNS, LIST_COLUMNS, result_column

# Fixed value: the one kind of event.
NEW_MESSAGE = "new-message"

MESSAGE = (
    "id string, date string, is_read boolean, is_flagged boolean, has_attachments boolean, from_name string,"
    " from_address string, subject string, snippet string, to_addresses string, body_text string, body_html string"
)
CORRUPT = "_corrupt"


def message_struct(available: list[str]) -> Column:
    """Message as sent in an event; recipients and bodies are left out when empty or not at hand."""
    fields = [result_column(c) for c in LIST_COLUMNS]
    extra = [c for c in DETAIL_COLUMNS[len(LIST_COLUMNS):] if c in available]
    return F.struct(*fields, *[F.nullif(F.col(c), F.lit("")).alias(c) for c in extra])


def to_events(messages: DataFrame, query: str, source: str = "") -> DataFrame:
    """One ``new-message`` event per row, its message as a JSON payload, with ready-made marks."""
    def bit(name: str, set_when: int) -> Column:
        on = (F.coalesce(F.col(name).cast("int"), F.lit(0)) != 0) == F.lit(bool(set_when))
        return F.when(on, F.lit("1")).otherwise(F.lit("0"))

    return messages.select(
        F.lit(NEW_MESSAGE).alias("name"),
        F.lit(query).alias("query"),
        F.lit(source).alias("source"),
        F.col("id"),
        bit("is_read", 0).alias("unread"),
        bit("is_flagged", 1).alias("flagged"),
        bit("has_attachments", 1).alias("attachments"),
        F.to_json(message_struct(messages.columns)).alias("payload"),
    )


def decode_events(events: DataFrame, strict: bool = True) -> DataFrame:
    """Events with their payload as a ``message`` struct.

    Bad JSON fails the job when ``strict``, else it is kept in ``message._corrupt``. A blank payload
    gives a message built from the event's own columns.
    """
    if strict:
        parsed = F.from_json("payload", MESSAGE, {"mode": "FAILFAST"})
    else:
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        parsed = F.from_json("payload", f"{MESSAGE}, {CORRUPT} string", options)
    bare = F.from_json(
        F.to_json(
            F.struct(
                "id",
                (F.col("unread") != "1").alias("is_read"),
                (F.col("flagged") == "1").alias("is_flagged"),
                (F.col("attachments") == "1").alias("has_attachments"),
            )
        ),
        MESSAGE if strict else f"{MESSAGE}, {CORRUPT} string",
    )
    blank = F.trim("payload") == ""
    return events.withColumn("message", F.when(blank, bare).otherwise(parsed)).drop("payload")


def result_json(page: DataFrame, order: tuple, limit: int) -> DataFrame:
    """The first ``limit`` rows as one JSON array in list order, ``[]`` when empty; ``result_lines`` takes results of any size."""
    names = [c for c in page.columns if c != "position"]
    numbered = with_position(page, order, limit)
    entries = F.array_sort(F.collect_list(F.struct("position", F.struct(*names).alias("m"))))
    return numbered.agg(F.to_json(F.transform(entries, lambda e: e["m"])).alias("result"))


def result_lines(rows: DataFrame) -> DataFrame:
    """Results of any size as one JSON object per row, for ``write.text``."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
