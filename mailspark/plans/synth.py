"""Synthetic mailboxes that follow a profile.

Every random choice is a hash of (seed, row number, purpose), so the mailbox does not depend on how
Spark splits the work, and an All-Mail copy is made by computing its original again instead of
joining a pool of earlier rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.functions.dates import instant, utc_text
from mailspark.functions.display import snippet

ACCOUNT = "acc-1"
CHUNK = 1 << 16


@dataclass(frozen=True)
class Pools:
    """What senders, subjects and bodies are drawn from; ``%d`` in a subject becomes a number."""

    me: tuple[str, str] = ("Robin Vale", "robin@vale.example")
    people: tuple[tuple[str, str], ...] = (
        ("Ana Costa", "ana@harbor.example"),
        ("Ben Okafor", "ben@harbor.example"),
        ("Chloe Martin", "chloe@fields.example"),
        ("Deniz Aydin", "deniz@fields.example"),
        ("Emi Sato", "emi@orchard.example"),
    )
    others: tuple[tuple[str, str], ...] = (
        ("City Library", "notices@library.example"),
        ("Weekly Garden", "letter@garden.example"),
        ("Power Company", "billing@power.example"),
        ("Train Tickets", "tickets@rail.example"),
        ("Lucky Draw", "winner@draw.example"),
    )
    subjects: tuple[str, ...] = (
        "Plan for the garden day", "Invoice %d is ready", "Your ticket %d", "Books due next week",
        "Notes from Tuesday", "Can we move the call?", "Offer %d ends today", "Photos from the trip",
    )
    bodies: tuple[str, ...] = (
        "The list is attached. Please add what you can bring.",
        "Thank you for your payment. The invoice is attached.",
        "Your seat is confirmed. Show this mail on the train.",
        "Two books are due on Friday. You can renew them once.",
        "Here is what we agreed on. Tell me if I missed something.",
        "Could we talk an hour later? I have to finish the report first.",
    )


def uniform(seed: int, row: Column, purpose: str) -> Column:
    """A number in [0, 1) that depends only on seed, row and purpose."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(purpose)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _pick(seed: int, row: Column, purpose: str, size: int) -> Column:
    """Position in a pool, counted from 1."""
    return (F.floor(uniform(seed, row, purpose) * size) + 1).cast("int")


def folder_plan(profile: DataFrame) -> DataFrame:
    """One folder per profile entry, with the row numbers its messages get.

    Archive folders ("All Mail") come last so that copies can point back at every other message.
    A profile lists the folders of one mailbox; numbering them in one window is bounded by that.
    """
    entries = profile.select("messages", F.posexplode("folders").alias("position", "folder"))
    kind = F.col("folder.type")
    stored = F.when(kind.isin("inbox", "sent", "drafts", "trash", "spam", "custom"), kind).when(
        ~kind.isin("(null)", ""), F.lit("custom")
    )
    label = (
        F.when(kind == "inbox", "INBOX")
        .when(kind.isin("sent", "drafts", "trash", "spam"), F.initcap(kind))
        .when(kind == "archive", "All Mail")
    )
    numbered = F.col("position").cast("string")
    order = Window.orderBy(kind == "archive", "position")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return entries.select(
        F.format_string("f-%03d", "position").alias("id"),
        F.coalesce(label, F.concat(F.lit("Folder "), numbered)).alias("name"),
        F.coalesce(label, F.concat(F.lit("Folder/"), numbered)).alias("path"),
        stored.alias("type"),
        kind.alias("profile_type"),
        F.col("folder.messages").alias("count"),
        F.col("folder.unread").alias("unread"),
        F.coalesce(F.sum("folder.messages").over(before), F.lit(0)).alias("first_row"),
        F.col("messages").alias("stats"),
    )


def synth_folders(profile: DataFrame) -> DataFrame:
    return folder_plan(profile).select("id", F.lit(ACCOUNT).alias("account_id"), "name", "path", "type")


def synth_rows(profile: DataFrame, tasks: int = 64) -> DataFrame:
    """Row numbers and read marks: exactly the messages and unread messages of each profile folder.

    Folders are cut into chunks, chunks are spread over ``tasks``, and each chunk makes its rows.
    """
    plan = folder_plan(profile).drop("name", "path")
    everything = Window.partitionBy()
    real, copies = (F.sum(F.when((F.col("profile_type") == "archive") == F.lit(a), F.col("count"))) for a in (False, True))
    bounds = F.collect_list(
        F.when(F.col("profile_type") != "archive", F.struct("first_row", "count", "profile_type"))
    )
    plan = plan.withColumns(
        {
            "pool": F.coalesce(real.over(everything), F.lit(0)),
            "archived": F.coalesce(copies.over(everything), F.lit(0)),
            "bounds": bounds.over(everything),
        }
    )
    last_chunk = F.floor((F.col("count") - 1) / CHUNK)
    chunks = plan.filter(F.col("count") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), last_chunk)))
    spread = chunks.repartition(tasks, "id", "chunk")
    start = F.col("chunk") * CHUNK + 1
    numbers = F.explode(F.sequence(start, F.least(start + CHUNK - 1, F.col("count"))))
    rows = spread.withColumn("place", numbers)
    return rows.select(
        (F.col("first_row") + F.col("place")).alias("rowid"),
        F.col("id").alias("folder_id"),
        "profile_type",
        (F.col("place") > F.col("unread")).cast("int").alias("is_read"),
        "pool",
        "archived",
        "bounds",
        "stats",
    )


def _date_bounds(now: datetime) -> tuple[Column, Column]:
    """First and last second of the profile; the year up to ``now`` when the profile has no usable range."""
    first, last = instant(F.col("stats.first_date")), instant(F.col("stats.last_date"))
    usable = F.coalesce(first < last, F.lit(False))
    ago = now.replace(year=now.year - 1) if (now.month, now.day) != (2, 29) else now - timedelta(days=365)
    limit = [F.timestamp_seconds(F.lit(int(t.replace(tzinfo=timezone.utc).timestamp()))) for t in (ago, now)]
    return F.when(usable, first).otherwise(limit[0]), F.when(usable, last).otherwise(limit[1])


def synth_messages(
    profile: DataFrame, seed: int, now: datetime, pools: Pools = Pools(), tasks: int = 64
) -> DataFrame:
    """Messages for a profile (one row, as read by ``read_profile`` or made by ``profile_document``)."""
    rows = synth_rows(profile, tasks)
    row, total = F.col("rowid"), F.greatest(F.col("stats.total"), F.lit(1)).cast("double")
    archive = F.col("profile_type") == "archive"
    repeated = F.greatest(F.col("stats.total") - F.col("stats.distinct_message_id"), F.lit(0))
    share = F.least(repeated / F.greatest(F.col("archived"), F.lit(1)), F.lit(1.0))
    copied = archive & (F.col("pool") > 0) & (uniform(seed, row, "copy") < share)
    origin = F.when(copied, (F.floor(uniform(seed, row, "origin") * F.col("pool")) + 1).cast("long")).otherwise(row)
    rows = rows.withColumn("copied", copied).withColumn("origin", origin)

    src = F.col("origin")
    home = F.filter("bounds", lambda b: (b["first_row"] < src) & (src <= b["first_row"] + b["count"]))[0]["profile_type"]
    rows = rows.withColumn("kind", F.when(F.col("copied"), home).otherwise(F.col("profile_type")))

    def person(entry: tuple[str, str]) -> Column:
        return F.struct(F.lit(entry[0]).alias("name"), F.lit(entry[1]).alias("address"))

    def ratio(name: str) -> Column:
        return F.col(f"stats.{name}") / total

    def drawn(purpose: str, values: list[Column]) -> Column:
        return F.element_at(F.array(*values), _pick(seed, src, purpose, len(values)))

    me = person(pools.me)
    senders = [person(p) for p in pools.people + pools.others]
    mine = F.col("kind").isin("sent", "drafts")
    first, last = _date_bounds(now)
    seconds = F.unix_timestamp(first) + F.floor(
        uniform(seed, src, "date") * (F.unix_timestamp(last) - F.unix_timestamp(first))
    )
    number = (F.floor(uniform(seed, src, "number") * 9000) + 1000).cast("string")
    rows = rows.select(
        "*",
        F.when(mine, me).otherwise(drawn("sender", senders)).alias("from"),
        F.when(mine, drawn("recipient", [person(p) for p in pools.people])).otherwise(me).alias("to"),
        F.replace(drawn("subject", [F.lit(s) for s in pools.subjects]), F.lit("%d"), number).alias("subject"),
        drawn("body", [F.lit(b) for b in pools.bodies]).alias("body"),
        utc_text(F.timestamp_seconds(seconds)).alias("date"),
    )
    identity = F.format_string("<gen-%06d@example.com>", src)
    markup = F.concat(F.lit("<html><body><h1>"), "subject", F.lit("</h1><p>"), "body", F.lit("</p></body></html>"))
    return rows.select(
        "rowid",
        F.format_string("msg-%06d", row).alias("id"),
        F.lit(ACCOUNT).alias("account_id"),
        "folder_id",
        identity.alias("message_id"),
        identity.alias("thread_id"),
        F.col("from.address").alias("from_address"),
        F.col("from.name").alias("from_name"),
        F.to_json(F.array("to")).alias("to_addresses"),
        F.lit(None).cast("string").alias("cc_addresses"),
        F.lit(None).cast("string").alias("bcc_addresses"),
        "subject",
        snippet(F.col("body")).alias("snippet"),
        F.when(uniform(seed, src, "text") < ratio("with_text"), F.col("body")).alias("body_text"),
        F.when(uniform(seed, src, "html") < ratio("with_html"), markup).alias("body_html"),
        "date",
        F.col("is_read"),
        (uniform(seed, src, "flagged") < ratio("flagged")).cast("int").alias("is_flagged"),
        (uniform(seed, src, "attachments") < ratio("has_attachments")).cast("int").alias("has_attachments"),
        (F.col("kind") == "drafts").cast("int").alias("is_draft"),
    )


PROFILE = (
    "schema_version int, accounts bigint, folders array<struct<type:string,messages:bigint,unread:bigint>>,"
    " messages struct<total:bigint,distinct_message_id:bigint,distinct_thread_id:bigint,distinct_senders:bigint,"
    "first_date:string,last_date:string,read:bigint,unread:bigint,flagged:bigint,has_attachments:bigint,"
    "with_html:bigint,with_text:bigint,drafts:bigint,per_month:map<string,bigint>,"
    "subject_len:struct<min:bigint,max:bigint,avg:double>,body_text_len:struct<min:bigint,max:bigint,avg:double>,"
    "snippet_len:struct<min:bigint,max:bigint,avg:double>,"
    "recipients:struct<to_avg:double,cc_avg:double,bcc_avg:double>>, table_rows map<string,bigint>"
)


def write_profile(profile: DataFrame, path: str) -> None:
    profile.select(F.to_json(F.struct("*"))).write.mode("overwrite").text(path)


def read_profile(spark, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).option("multiLine", True).json(path)
