"""Fixed table layouts and the version gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the table version this library reads.
SUPPORTED_VERSION = 13

MESSAGES = (
    "rowid bigint, id string, account_id string, folder_id string, message_id string, thread_id string,"
    " from_address string, from_name string, to_addresses string, cc_addresses string,"
    " bcc_addresses string, subject string, snippet string, body_text string, body_html string,"
    " date string, is_read int, is_flagged int, has_attachments int, attachments string,"
    " raw_headers string, uid bigint, created_at string, is_draft int, draft_reply_to_id string,"
    " draft_reply_type string, auth_trust_level string, auth_results string,"
    " auth_client_verified int, is_answered int, is_forwarded int, read_receipt_requested int,"
    " read_receipt_sent int, reply_to_addresses string"
)
FOLDERS = (
    "id string, account_id string, name string, path string, type string, selectable int,"
    " unread_count bigint, total_count bigint, last_synced string, special_use string"
)
ACCOUNTS = "id string, name string, email string, type string"
SETTINGS = "key string, value string"
SEARCH_HISTORY = (
    "pk_search_history bigint, search_history_term string, search_history_date_last_used string"
)
TABLES = {
    "messages": MESSAGES,
    "folders": FOLDERS,
    "accounts": ACCOUNTS,
    "settings": SETTINGS,
    "search_history": SEARCH_HISTORY,
}

# Columns added when messages are stored with their index.
INDEX = (
    "ts timestamp, pad_subject string, pad_from_name string, pad_from_address string, pad_to_text string,"
    " pad_snippet string, pad_body_text string, doc_len bigint, month string"
)

ADDRESSES = "array<struct<name:string,address:string>>"

LIST_COLUMNS = (
    "id", "date", "is_read", "is_flagged", "has_attachments", "from_name", "from_address", "subject", "snippet",
)
DETAIL_COLUMNS = LIST_COLUMNS + ("to_addresses", "body_text", "body_html")
FLAG_COLUMNS = ("is_read", "is_flagged", "has_attachments")

# Names of the side tables whose rows are only counted.
SIDE_TABLES = (
    "contacts", "blocked_senders", "trusted_senders", "sender_stats", "trust_activity_log", "outbox_messages",
    "deferred_sync_queue", "search_history", "inbox_rules", "aliases", "account_canonical_folders", "settings",
)


def mailbox_key(*frames: DataFrame) -> list[str]:
    """``["mailbox"]`` if all frames tell mailboxes apart by a column of that name, else no key: they hold one mailbox.

    Row ids, folder ids and message ids are unique in a mailbox only, so every key has this one in front. A mailbox column holds no nulls.
    """
    first, *others = frames
    if "mailbox" not in first.columns and any("mailbox" in frame.columns for frame in others):
        raise ValueError("mailboxes are told apart on one side only: the messages have no mailbox column")
    return ["mailbox"] if all("mailbox" in frame.columns for frame in frames) else []


def result_column(name: str) -> Column:
    """A stored column as it appears in results: flags as booleans, missing text as empty text."""
    if name in FLAG_COLUMNS:
        return (F.coalesce(F.col(name), F.lit(0)) != 0).alias(name)
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def schema_status(settings: DataFrame, by: str | None = None, want: int = SUPPORTED_VERSION) -> DataFrame:
    """Version found in ``settings`` against the supported one: one row, or one per ``by`` value.

    A missing row or a value that is no whole number counts as not found.
    """
    version = F.when(F.col("key") == "schema_version", F.trim("value").try_cast("int"))
    groups = settings.groupBy(*([by] if by else []))
    status = groups.agg(F.max(version).alias("got"))
    return status.select(
        *([by] if by else []),
        F.col("got").isNotNull().alias("found"),
        "got",
        F.lit(want).alias("want"),
        F.coalesce(F.col("got") == want, F.lit(False)).alias("ok"),
    )


def require_version(settings: DataFrame, by: str | None = None, want: int = SUPPORTED_VERSION) -> DataFrame:
    """``schema_status`` that fails the job when a version is missing or different."""
    problem = F.when(
        ~F.col("found"), F.lit(f"could not determine the schema version (this build supports {want})")
    ).otherwise(F.format_string(f"unsupported schema version %d (this build supports {want})", F.col("got")))
    checked = F.when(F.col("ok"), F.col("ok")).otherwise(F.raise_error(problem).cast("boolean"))
    return schema_status(settings, by, want).withColumn("ok", checked)
