"""Search terms as plain values. A search is a list of terms that all have to hold.

    [text("invoice", field="subject"), flag("unread"), since("2months"), ~folder("trash")]
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime

from mailspark.functions import dates
from mailspark.functions.text import TEXT_COLUMNS, fold_value, needle

# Search fields and the text columns they cover.
TEXT_FIELDS = {
    "subject": ("subject",),
    "sender": ("from_name", "from_address"),
    "from": ("from_name", "from_address"),
    "recipient": ("to_text",),
    "to": ("to_text",),
    "snippet": ("snippet",),
    "body": ("body_text",),
}

# Flag fields with their column and the value that means "set".
FLAG_FIELDS = {
    "unread": ("is_read", 0),
    "read": ("is_read", 1),
    "flagged": ("is_flagged", 1),
    "starred": ("is_flagged", 1),
    "attachments": ("has_attachments", 1),
    "attachment": ("has_attachments", 1),
}

# Date fields by direction.
SINCE_FIELDS = ("after", "since", "newer", "newer_than")
BEFORE_FIELDS = ("before", "until", "older", "older_than")

# Folder fields and the folder types they accept.
FOLDER_FIELDS = ("in", "folder")
FOLDER_TYPES = ("inbox", "sent", "drafts", "trash", "spam")


@dataclass(frozen=True)
class Text:
    columns: tuple[str, ...]
    wanted: str  # padded tokens to find, empty when the value holds no token
    negated: bool = False

    def __invert__(self) -> Text:
        return replace(self, negated=not self.negated)


@dataclass(frozen=True)
class Flag:
    column: str
    value: int

    def __invert__(self) -> Flag:
        return replace(self, value=1 - self.value)


@dataclass(frozen=True)
class When:
    since: bool  # at or after the cutoff, else before it
    value: str | datetime | date

    def cutoff(self, now: datetime | None) -> datetime:
        return dates.cutoff(self.value, now)

    def __invert__(self) -> When:
        return replace(self, since=not self.since)


@dataclass(frozen=True)
class Folder:
    type: str
    negated: bool = False

    def __invert__(self) -> Folder:
        return replace(self, negated=not self.negated)


Term = Text | Flag | When | Folder


def text(value: str, field: str | None = None, phrase: bool = False, prefix: bool = False) -> Text:
    """Words in any text column or in ``field``; several words must stand side by side, in order.

    A trailing ``*`` makes the last word a prefix unless ``phrase`` is set.
    """
    if field is not None and field not in TEXT_FIELDS:
        raise ValueError(f'unknown field: "{field}"')
    value = value.strip()
    if not value:
        raise ValueError(f'field "{field}" requires a value' if field else "a text term requires a value")
    if not phrase and len(value) > 1 and value.endswith("*"):
        value, prefix = value[:-1], True
    tokens = fold_value(value)
    columns = TEXT_FIELDS[field] if field else TEXT_COLUMNS
    return Text(columns, needle(tokens, prefix) if tokens else "")


def flag(name: str, value: bool = True) -> Flag:
    if name not in FLAG_FIELDS:
        raise ValueError(f'unknown field: "{name}"')
    column, present = FLAG_FIELDS[name]
    return Flag(column, present if value else 1 - present)


def since(value: str | datetime | date) -> When:
    dates.cutoff(value)
    return When(True, value)


def before(value: str | datetime | date) -> When:
    dates.cutoff(value)
    return When(False, value)


def folder(type: str) -> Folder:
    kind = type.strip().lower()
    if kind not in FOLDER_TYPES:
        raise ValueError(f'unknown folder "{kind}" (want {", ".join(FOLDER_TYPES)})')
    return Folder(kind)


# Ready-made filters.
UNREAD = flag("unread")
SENT = folder("sent")
