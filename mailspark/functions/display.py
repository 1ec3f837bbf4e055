"""Listing columns: sender labels, badges, subjects, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailspark.functions.dates import display_date, truncate
from mailspark.functions.text import strip


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sender_label() -> Column:
    """``Name <address>``, or whichever of the two is there."""
    name, address = _text("from_name"), _text("from_address")
    both = F.concat(name, F.lit(" <"), address, F.lit(">"))
    return F.when((name != "") & (address != ""), both).when(name != "", name).otherwise(address)


def sender_short() -> Column:
    name = _text("from_name")
    return F.when(name != "", name).otherwise(_text("from_address"))


def badge() -> Column:
    """``[U*@]``: unread, flagged, has attachments; a blank for each unset mark."""
    on = lambda name: F.coalesce(F.col(name).cast("int"), F.lit(0)) != 0
    mark = lambda test, sign: F.when(test, F.lit(sign)).otherwise(F.lit(" "))
    return F.concat(
        F.lit("["),
        mark(~on("is_read"), "U"),
        mark(on("is_flagged"), "*"),
        mark(on("has_attachments"), "@"),
        F.lit("]"),
    )


def subject_or_placeholder() -> Column:
    subject = _text("subject")
    return F.when(strip(subject) != "", subject).otherwise(F.lit("(no subject)"))


def subject_line(size: int = 72) -> Column:
    """Trimmed subject for one-line event logs."""
    subject = strip(_text("subject"))
    return F.when(subject == "", F.lit("(no subject)")).otherwise(truncate(subject, size))


def snippet(body: Column) -> Column:
    """Preview of a body: one line of at most 140 characters, null when blank."""
    line = strip(F.replace(body, F.lit("\n"), F.lit(" ")))
    return truncate(F.nullif(line, F.lit("")), 140)


def listing_columns() -> list[Column]:
    """The columns of a printed result list."""
    return [
        F.col("id"),
        badge().alias("badge"),
        display_date(F.col("date")).alias("shown_date"),
        sender_label().alias("sender"),
        sender_short().alias("sender_short"),
        subject_or_placeholder().alias("shown_subject"),
        subject_line().alias("log_subject"),
        truncate(_text("snippet"), 100).alias("shown_snippet"),
    ]
