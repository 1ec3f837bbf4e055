"""Content-free statistics of a mailbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.operators import rollup
from mailspark.schemas import SIDE_TABLES, mailbox_key, schema_status
from mailspark.scratch import scratch_dir


def _total(name: str) -> Column:
    return F.coalesce(F.sum(F.col(name).cast("long")), F.lit(0))


def _filled(name: str) -> Column:
    return F.count_if(F.coalesce(F.col(name), F.lit("")) != "")


def _totals() -> list[Column]:
    read = _total("is_read")
    return [
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.min("date"), F.lit("")).alias("first_date"),
        F.coalesce(F.max("date"), F.lit("")).alias("last_date"),
        read.alias("read"),
        (F.count(F.lit(1)) - read).alias("unread"),
        _total("is_flagged").alias("flagged"),
        _total("has_attachments").alias("has_attachments"),
        _filled("body_html").alias("with_html"),
        _filled("body_text").alias("with_text"),
        _total("is_draft").alias("drafts"),
    ]


def _lengths() -> list[Column]:
    def span(name: str) -> list[Column]:
        size = F.length(name)
        return [
            F.coalesce(F.min(size), F.lit(0)).cast("long").alias(f"{name}_min"),
            F.coalesce(F.max(size), F.lit(0)).cast("long").alias(f"{name}_max"),
            F.coalesce(F.avg(size), F.lit(0.0)).alias(f"{name}_avg"),
        ]

    return span("subject") + span("body_text") + span("snippet")


def _recipients() -> list[Column]:
    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.coalesce(F.json_array_length(name), F.lit(0))), F.lit(0.0))

    return [mean(f"{kind}_addresses").alias(f"{kind}_avg") for kind in ("to", "cc", "bcc")]


def profile_messages(messages: DataFrame) -> DataFrame:
    """One row of counts, flag sums and the first and last date text."""
    return messages.agg(*_totals())


def profile_distinct(messages: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct message ids, thread ids (empty text is none) and sender addresses.

    Exact counts take one pass over each column alone, grouped where it is read. ``approximate`` counts all three in one pass
    by sketches, as the rollup does.
    """
    if approximate:
        return messages.agg(*[F.hll_sketch_estimate(rollup.sketch(c)).alias(name) for name, c in rollup.DISTINCT.items()])
    counts = None
    for name, column in rollup.DISTINCT.items():
        one = messages.select(rollup.distinct_value(column).alias("value")).distinct().agg(F.count("value").alias(name))
        counts = one if counts is None else counts.select("*", one.scalar().alias(name))
    return counts


def profile_lengths(messages: DataFrame) -> DataFrame:
    """Shortest, longest and mean length in characters of subjects, text bodies and snippets."""
    return messages.agg(*_lengths())


def profile_recipients(messages: DataFrame) -> DataFrame:
    """Mean number of recipients; missing lists and text that is no list count as none."""
    return messages.agg(*_recipients())


def folder_profile(messages: DataFrame, folders: DataFrame) -> DataFrame:
    """Messages and unread messages of every folder, empty folders included.

    Messages are counted per folder before the join, so a folder with most of the mail costs one row.
    """
    boxed = mailbox_key(messages, folders)
    counts = messages.groupBy(*boxed, F.col("folder_id").alias("id")).agg(
        F.count("id").alias("messages"), F.count_if(F.col("is_read") == 0).alias("unread")
    )
    return folders.select(*boxed, "id", "type").join(counts, [*boxed, "id"], "left").select(
        *boxed,
        F.col("id").alias("folder_id"),
        F.coalesce("type", F.lit("(null)")).alias("type"),
        F.coalesce("messages", F.lit(0)).alias("messages"),
        F.coalesce("unread", F.lit(0)).alias("unread"),
    )


def per_month(messages: DataFrame) -> DataFrame:
    return messages.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("messages"))


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the side tables that exist."""
    counts = [
        tables[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in SIDE_TABLES
        if name in tables
    ]
    if not counts:
        raise ValueError("no side tables given")
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


def profile_document(tables: dict[str, DataFrame], cells: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """The whole profile as one nested row.

    ``cells`` is the stored rollup of the messages (``rollup.mailbox_rollup``); without it the messages are scanned once for a rollup
    that is written to scratch storage. Folder list, month list and totals are rolled up from its cells. Distinct counts are exact, from the message
    table's three columns, or ``approximate``, from the rollup. Lists are as long as the mailbox has folders and months.
    """
    messages, folders = tables["messages"], tables["folders"]
    if cells is None:
        path = scratch_dir(messages.sparkSession, "rollup")
        rollup.write_rollup(rollup.mailbox_rollup(messages), path)
        cells = messages.sparkSession.read.parquet(path)
    stats = rollup.totals(cells).select(F.struct("*")).scalar()
    distinct = stats if approximate else profile_distinct(messages).select(F.struct("*")).scalar()

    by_folder = cells.groupBy(F.col("folder_id").alias("id")).agg(F.sum("total").alias("messages"), F.sum("marked_unread").alias("unread"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sized = folders.select("id", "type").join(by_folder, "id", "left").select(
        F.col("id").alias("folder_id"), F.coalesce("type", F.lit("(null)")).alias("type"), zero("messages"), zero("unread")
    )
    sized = sized.select(F.struct((-F.col("messages")).alias("order"), "folder_id", "type", "messages", "unread").alias("f"))
    ranked = F.array_sort(F.collect_list("f"))
    folder_list = F.transform(ranked, lambda f: F.struct(f["type"].alias("type"), f["messages"].alias("messages"), f["unread"].alias("unread")))
    months = cells.groupBy("month").agg(F.sum("total").alias("messages")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("month", F.lit("")), "messages"))))
    )
    counted = table_rows({k: v for k, v in tables.items() if k in SIDE_TABLES}) if any(k in SIDE_TABLES for k in tables) else None
    rows = (
        counted.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "row_count"))))).scalar()
        if counted is not None
        else F.create_map().cast("map<string,bigint>")
    )
    version = schema_status(tables["settings"]).select("got").scalar() if "settings" in tables else F.lit(None).cast("int")
    accounts = tables["accounts"].agg(F.count(F.lit(1))).scalar() if "accounts" in tables else F.lit(0).cast("long")

    def span(name: str) -> Column:
        return F.struct(
            stats[f"{name}_min"].alias("min"), stats[f"{name}_max"].alias("max"), stats[f"{name}_avg"].alias("avg")
        ).alias(f"{name}_len")

    names = ("read", "unread", "flagged", "has_attachments", "with_html", "with_text", "drafts")
    document = sized.agg(folder_list.alias("folders"))
    return document.select(
        F.coalesce(version, F.lit(0)).alias("schema_version"),
        accounts.alias("accounts"),
        "folders",
        F.struct(
            stats["total"].alias("total"),
            *[distinct[c].alias(c) for c in ("distinct_message_id", "distinct_thread_id", "distinct_senders")],
            stats["first_date"].alias("first_date"),
            stats["last_date"].alias("last_date"),
            *[stats[c].alias(c) for c in names],
            months.scalar().alias("per_month"),
            *[span(c) for c in ("subject", "body_text", "snippet")],
            F.struct(*[stats[c].alias(c) for c in ("to_avg", "cc_avg", "bcc_avg")]).alias("recipients"),
        ).alias("messages"),
        rows.alias("table_rows"),
    )
