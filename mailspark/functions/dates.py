"""Dates: stored text to instants, display text, and cutoffs relative to a reference time."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date spellings that count as readable (date, optional time, fraction and zone).
READABLE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?$"

# Spellings of relative time units.
UNITS = {
    "hours": ("h", "hr", "hrs", "hour", "hours"),
    "days": ("d", "day", "days"),
    "weeks": ("w", "wk", "week", "weeks"),
    "months": ("m", "mo", "mon", "month", "months"),
    "years": ("y", "yr", "year", "years"),
}

# Absolute dates accepted as cutoffs.
ABSOLUTE = r"^(\d{4}-\d{2}-\d{2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?|\d{4}/\d{2}/\d{2})$"


def instant(col: Column) -> Column:
    """Timestamp of a stored date text, null when it cannot be read."""
    text = F.trim(col)
    return F.when(text.rlike(READABLE), utc_instant(text))


def utc_instant(text: Column) -> Column:
    """Timestamp of a date text that is meant in UTC unless it names a zone, in a session of any zone; null when it is no date."""
    named = text.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    minutes = text.rlike(r"[ T]\d{1,2}:\d{2}$")
    rest = F.when(named, "").when(F.length(text) == 10, " 00:00:00Z").when(minutes, ":00Z").otherwise("Z")
    full = F.concat(text, rest)
    return F.try_to_timestamp(full)


def utc_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of an instant in UTC."""
    seconds = F.unix_seconds(ts)
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    clock = [F.lpad((F.pmod(seconds, F.lit(size * top)) / size).cast("int").cast("string"), 2, "0") for size, top in ((3600, 24), (60, 60), (1, 60))]
    return F.concat(day.cast("string"), F.lit(" "), F.concat_ws(":", *clock))


def utc_month(ts: Column) -> Column:
    """``yyyy-MM`` of an instant in UTC."""
    return F.substring(utc_text(ts), 1, 7)


def display_date(col: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` as written (the zone is not applied); other text is cut to 16 characters."""
    clock = F.regexp_replace(F.regexp_replace(col, r"(Z|[+-]\d{2}:\d{2})$", ""), "T", " ")
    shown = F.concat(F.substring(clock, 1, 10), F.lit(" "), F.coalesce(F.nullif(F.substring(clock, 12, 5), F.lit("")), F.lit("00:00")))
    text = F.coalesce(col, F.lit(""))
    return F.coalesce(F.when(text.rlike(READABLE) & utc_instant(clock).isNotNull(), shown), truncate(text, 16))


def truncate(col: Column, size: int) -> Column:
    """At most ``size`` characters, the last one an ellipsis when text was cut."""
    cut = F.concat(F.substring(col, 1, size - 1), F.lit("…"))
    return F.when(F.length(col) <= size, col).otherwise(cut)


def cutoff(value: str | datetime | date, now: datetime | None = None) -> datetime:
    """UTC instant of a cutoff: a datetime, an absolute date text, or an amount such as ``2months``.

    Months and years step the calendar fields and let a day that does not exist run over into the
    next month: one month before 31 March 2024 is 2 March 2024.
    """
    if isinstance(value, datetime):
        return _utc(value)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    text = value.strip()
    if not text:
        raise ValueError("requires a date or duration value")
    relative = re.fullmatch(r"([0-9]+)\s*([A-Za-z]+)", text)
    unit = relative and next((u for u, names in UNITS.items() if relative[2].lower() in names), None)
    if unit:
        return _back(_utc(now or datetime.now(timezone.utc)), unit, int(relative[1]))
    if re.fullmatch(ABSOLUTE, text):
        try:
            return datetime.fromisoformat(_two_digit_hour(text.replace("/", "-"))).replace(microsecond=0)
        except ValueError:
            pass
    raise ValueError(f'invalid date or duration "{text}"')


def _two_digit_hour(text: str) -> str:
    return re.sub(r"([ T])(\d):", r"\g<1>0\2:", text)


def _utc(value: datetime) -> datetime:
    naive = value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    return naive.replace(microsecond=0)


def _back(now: datetime, unit: str, amount: int) -> datetime:
    if unit in ("months", "years"):
        months = now.year * 12 + now.month - 1 - amount * (12 if unit == "years" else 1)
        first = now.replace(year=months // 12, month=months % 12 + 1, day=1)
        return first + timedelta(days=now.day - 1)
    return now - timedelta(**{unit: amount})


def cutoff_column(value: Column, now: datetime) -> Column:
    """Same rule for a column of cutoff texts; null when the text is no cutoff."""
    now = _utc(now)
    text = F.trim(value)
    amount = F.regexp_extract(text, r"^([0-9]+)\s*[A-Za-z]+$", 1).try_cast("int")
    word = F.lower(F.regexp_extract(text, r"^[0-9]+\s*([A-Za-z]+)$", 1))
    is_unit = {unit: word.isin(*names) for unit, names in UNITS.items()}
    months = F.when(is_unit["months"], amount).when(is_unit["years"], amount * 12)
    month_no = F.lit(now.year * 12 + now.month - 1) - months
    first = F.make_date(F.floor(month_no / 12).cast("int"), F.pmod(month_no, F.lit(12)) + 1, F.lit(1))
    shifted = F.date_add(first, now.day - 1)
    clock = F.lit(now.strftime("%H:%M:%S"))
    by_month = utc_instant(F.concat(shifted.cast("string"), F.lit(" "), clock))
    hours = (
        F.when(is_unit["hours"], amount.cast("long"))
        .when(is_unit["days"], amount.cast("long") * 24)
        .when(is_unit["weeks"], amount.cast("long") * 24 * 7)
    )
    by_clock = F.timestamp_seconds(F.lit(int(now.replace(tzinfo=timezone.utc).timestamp())) - hours * 3600)
    absolute = F.when(
        text.rlike(ABSOLUTE),
        F.timestamp_seconds(F.unix_seconds(utc_instant(F.replace(text, F.lit("/"), F.lit("-"))))),
    )
    return F.when(months.isNotNull(), by_month).when(hours.isNotNull(), by_clock).otherwise(absolute)
