"""Search text and its padded-token form, built once and stored next to the messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.functions.dates import instant
from mailspark.functions.text import TEXT_COLUMNS, pad, token_array, token_count
from mailspark.operators.joins import matched
from mailspark.schemas import ADDRESSES, mailbox_key


def _recipients(column: str) -> Column:
    people = F.from_json(F.coalesce(F.col(column), F.lit("[]")), ADDRESSES)
    named = F.transform(
        people,
        lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit(" "), F.coalesce(p["address"], F.lit(""))),
    )
    return F.coalesce(F.concat_ws(" ", named), F.lit(""))


def to_text() -> Column:
    """All to, cc and bcc recipients as ``name address`` text."""
    lists = [_recipients(c) for c in ("to_addresses", "cc_addresses", "bcc_addresses")]
    return F.trim(F.concat_ws(" ", *lists))


def text_column(messages: DataFrame, name: str) -> Column:
    return to_text() if name == "to_text" and "to_text" not in messages.columns else F.col(name)


def search_text(messages: DataFrame) -> DataFrame:
    """The searchable text row of every message, keyed by row id."""
    return messages.select("rowid", *[text_column(messages, c).alias(c) for c in TEXT_COLUMNS])


def padded(messages: DataFrame, column: str) -> Column:
    """Stored padded column if there is one, else computed from the text."""
    stored = f"pad_{column}"
    return F.col(stored) if stored in messages.columns else pad(text_column(messages, column))


def doc_length(messages: DataFrame) -> Column:
    """Tokens of a message over all text columns."""
    if "doc_len" in messages.columns:
        return F.col("doc_len")
    return sum((token_count(padded(messages, c)) for c in TEXT_COLUMNS[1:]), token_count(padded(messages, TEXT_COLUMNS[0])))


def with_instant(messages: DataFrame) -> DataFrame:
    """Messages with ``ts``, the instant of the stored date text."""
    return messages if "ts" in messages.columns else messages.withColumn("ts", instant(F.col("date")))


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once per row however often they are used.

    Catalyst copies the expression of a plain column into every filter and projection above it. A
    column out of ``inline`` is not copied, and filters on other columns still move below it.
    """
    if not columns:
        return rows
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_pads(messages: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Messages plus the padded form of these text columns, where it is not stored already."""
    missing = [c for c in TEXT_COLUMNS if c in set(columns) and f"pad_{c}" not in messages.columns]
    return once(messages, {f"pad_{c}": pad(text_column(messages, c)) for c in missing})


def with_index(messages: DataFrame) -> DataFrame:
    """Messages plus padded columns and document length; store this once, search it many times."""
    indexed = with_pads(messages, TEXT_COLUMNS)
    return indexed.withColumn("doc_len", doc_length(indexed))


def index_table(texts: DataFrame) -> DataFrame:
    """Only row id, padded columns and document length, for keeping apart from the messages."""
    return with_index(texts).select("rowid", *[f"pad_{c}" for c in TEXT_COLUMNS], "doc_len")


def token_stats(messages: DataFrame) -> DataFrame:
    """Token count of each text column, of the whole message, and distinct tokens of the body."""
    indexed = with_index(messages)
    counts = [token_count(F.col(f"pad_{c}")).alias(f"{c}_tokens") for c in TEXT_COLUMNS]
    distinct = F.size(F.array_distinct(token_array(F.col("pad_body_text")))).cast("long")
    return indexed.select("rowid", *counts, distinct.alias("body_distinct"), "doc_len")


def newest_changes(changes: DataFrame, key: str = "rowid", order: str = "seq") -> DataFrame:
    """Last change per key of a mailbox. Aggregates before the shuffle, so a key changed very often is no hot spot."""
    keys = [*mailbox_key(changes), key]
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in rest])


def apply_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """``current`` after inserts, updates and deletes; ``changes`` has ``op``, ``seq`` and the row columns.

    Rows are matched by ``rowid`` (and ``mailbox``, where mailboxes are told apart); of several changes to one row the highest ``seq`` wins. The same
    changes applied twice give the same table.
    """
    newest = newest_changes(changes)
    kept = matched(current, newest, "rowid", "left_anti")
    return kept.unionByName(newest.filter(F.col("op") != "delete").select(*current.columns))
