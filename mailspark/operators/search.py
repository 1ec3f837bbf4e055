"""Searches over messages, the mailbox view, paging and lookups.

Messages are any DataFrame with the message columns. Stored index columns (``pad_*``, ``doc_len``,
``month``) are used when they are there and computed from the text columns when they are not.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.operators.index import with_index, with_instant, with_pads
from mailspark.operators.joins import SALTS, matched, salt_of, salted_join
from mailspark.operators.postings import Postings, ranked_rows, term_hits
from mailspark.operators.rank import bm25, corpus_stats, matches
from mailspark.operators.terms import Flag, Folder, Term, Text, When
from mailspark.schemas import DETAIL_COLUMNS, LIST_COLUMNS, mailbox_key, result_column

NEWEST = (("date", False), ("id", False))
BEST = (("score", True), ("id", True))


# --- filters -------------------------------------------------------------------------------------


def predicate(messages: DataFrame, terms: Iterable[Term], now: datetime | None = None) -> Column:
    """All terms but folders as one boolean column."""
    parts = []
    for term in terms:
        match term:
            case Text(wanted="", negated=True):
                continue
            case Text(negated=True):
                parts.append(~matches(messages, term))
            case Text():
                parts.append(matches(messages, term))
            case Flag():
                parts.append(F.col(term.column) == term.value)
            case When():
                parts += _date_parts(messages, term, now)
    return reduce(Column.__and__, parts, F.lit(True))


def _date_parts(messages: DataFrame, term: When, now: datetime | None) -> list[Column]:
    cutoff = term.cutoff(now)
    limit = F.timestamp_seconds(F.lit(int(cutoff.replace(tzinfo=timezone.utc).timestamp())))
    parts = [F.col("ts") >= limit if term.since else F.col("ts") < limit]
    if "month" in messages.columns:  # lets whole month folders be skipped
        month = F.lit(cutoff.strftime("%Y-%m"))
        parts.append(F.col("month") >= month if term.since else F.col("month") <= month)
    return parts


def in_folders(messages: DataFrame, folders: DataFrame, type: str, negated: bool = False) -> DataFrame:
    """Messages whose folder has this type, or has it not (folders without a type stay)."""
    ids = folders.filter(F.col("type") == type).select(*mailbox_key(messages, folders), F.col("id").alias("folder_key"))
    return salted_join(messages, ids, "folder_id", "folder_key", "rowid", "left_anti" if negated else "left_semi")


def filtered(
    messages: DataFrame, terms: Iterable[Term], folders: DataFrame | None = None, now: datetime | None = None
) -> DataFrame:
    """Messages for which every term holds, all columns kept."""
    terms = list(terms)
    result = with_instant(messages)
    result = with_pads(result, {c for t in terms if isinstance(t, Text) and t.wanted for c in t.columns})
    result = result.filter(predicate(result, terms, now))
    for term in terms:
        if isinstance(term, Folder):
            if folders is None:
                raise ValueError("a folder term needs the folders table")
            result = in_folders(result, folders, term.type, term.negated)
    return result


# --- mailbox view --------------------------------------------------------------------------------


def _has_identity() -> Column:
    return F.coalesce(F.col("message_id"), F.lit("")) != ""


def spam_ids(messages: DataFrame, folders: DataFrame) -> DataFrame:
    """Message ids with a copy in a spam folder, each once in its mailbox."""
    return in_folders(messages.filter(_has_identity()), folders, "spam").select(*mailbox_key(messages), "message_id").distinct()


def hide_spam(messages: DataFrame, folders: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """Drop every copy, in any folder, of a message that has a copy in a spam folder.

    ``everything`` is the whole mailbox when ``messages`` is already filtered. Rows without a
    message id stay and are spread by row id; a message id with very many copies is salted.
    """
    spam = spam_ids(messages if everything is None else everything, folders)
    boxed = mailbox_key(messages, spam)
    spam = spam.withColumnsRenamed({"message_id": "spam_id", "mailbox": "spam_box"})
    repeated = spam.withColumn("spam_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own_salt = F.when(_has_identity(), salt_of(F.col("rowid")).cast("long")).otherwise(F.col("rowid"))
    keyed = messages.withColumns({"_id": F.coalesce("message_id", F.lit("")), "_spread": own_salt})
    same = (keyed["_id"] == repeated["spam_id"]) & (keyed["_spread"] == repeated["spam_salt"])
    if boxed:
        same = same & keyed["mailbox"].eqNullSafe(repeated["spam_box"])
    return keyed.join(repeated, same, "left_anti").drop("_id", "_spread")


def dup_representatives(messages: DataFrame) -> DataFrame:
    """Smallest row id of every message id of a mailbox."""
    return messages.filter(_has_identity()).groupBy(*mailbox_key(messages), "message_id").agg(F.min("rowid").alias("rowid"))


def visible_rows(messages: DataFrame, folders: DataFrame | None) -> DataFrame:
    """Row ids left in the mailbox view: the first copy of each message, none of a spam message.

    Of several mailboxes each has its own copies and its own spam, and row ids come with their ``mailbox``. One narrow aggregation decides copies and spam together. Rows without a message id form groups
    of their own. ``folders=None`` keeps spam.
    """
    boxed = mailbox_key(messages)
    narrow = messages.select(
        *boxed,
        "rowid",
        F.coalesce("message_id", F.lit("")).alias("identity"),
        F.when(~_has_identity(), F.col("rowid")).alias("alone"),
        "folder_id",
    )
    if folders is None:
        marked = narrow.withColumn("spam", F.lit(False))
    else:
        spam = folders.filter(F.col("type") == "spam").select(
            *mailbox_key(messages, folders), F.col("id").alias("folder_key"), F.lit(True).alias("spam")
        )
        marked = salted_join(narrow, spam, "folder_id", "folder_key", "rowid", "left")
    in_spam = F.coalesce(F.col("spam"), F.lit(False)) & F.col("alone").isNull()
    groups = marked.groupBy(*boxed, "identity", "alone").agg(F.min("rowid").alias("rowid"), F.max(in_spam).alias("spam"))
    return groups.filter(~F.col("spam")).select(*boxed, "rowid")


def dedup(messages: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """First copy of each message. Which copy is first is decided over ``everything``, before filters."""
    return matched(messages, visible_rows(messages if everything is None else everything, None), "rowid", "left_semi")


# --- searches ------------------------------------------------------------------------------------


def search(
    messages: DataFrame,
    terms: Iterable[Term] = (),
    *,
    folders: DataFrame | None = None,
    now: datetime | None = None,
    limit: int = 0,
    offset: int = 0,
    columns: Iterable[str] = LIST_COLUMNS,
) -> DataFrame:
    """Messages matching all terms: best first when there is positive text, else newest first.

    ``limit=0`` means no limit. No copies are removed and no spam is hidden; see ``search_view``.
    """
    terms = list(terms)
    messages = with_index(messages) if _ranked(terms) else messages
    return _ordered_rows(messages, filtered(messages, terms, folders, now), terms, limit, offset, columns)


def search_view(
    messages: DataFrame,
    folders: DataFrame,
    terms: Iterable[Term] = (),
    *,
    include_spam: bool = False,
    now: datetime | None = None,
    limit: int = 0,
    offset: int = 0,
    columns: Iterable[str] = LIST_COLUMNS,
) -> DataFrame:
    """``search`` without copies, and without spam unless asked for.

    A search inside a folder sees all copies there, and a search inside spam sees spam.
    """
    terms = list(terms)
    messages = with_index(messages) if _ranked(terms) else messages
    inside = {t.type for t in terms if isinstance(t, Folder) and not t.negated}
    remove_copies = not inside
    remove_spam = not include_spam and "spam" not in inside
    found = filtered(messages, terms, folders, now)
    if remove_copies:
        found = matched(found, visible_rows(messages, folders if remove_spam else None), "rowid", "left_semi")
    elif remove_spam:
        found = hide_spam(found, folders, everything=messages)
    return _ordered_rows(messages, found, terms, limit, offset, columns)


def _ranked(terms: list[Term]) -> list[Text]:
    """The positive text terms; with none of them results come newest first."""
    return [t for t in terms if isinstance(t, Text) and not t.negated]


def _ordered_rows(
    messages: DataFrame, found: DataFrame, terms: list[Term], limit: int, offset: int, columns: Iterable[str]
) -> DataFrame:
    wanted = _ranked(terms)
    columns = list(columns)
    if wanted:
        stats = corpus_stats(messages, wanted)
        rows = found.select(*[result_column(c) for c in columns], *_hidden(found), bm25(found, wanted, stats).alias("score"))
        return _shown(take(rows, _tie_order(found, ("score", "_id"), True), limit, offset))
    rows = found.select(*[result_column(c) for c in columns], *_hidden(found))
    return _shown(take(rows, _tie_order(found, ("_date", "_id"), False), limit, offset))


def _hidden(found: DataFrame) -> list[Column]:
    """Sort keys beside the shown columns."""
    return [F.coalesce(c, F.lit("")).alias(f"_{c}") for c in ("date", "id", *mailbox_key(found))]


def _tie_order(found: DataFrame, names: tuple, up: bool) -> tuple:
    """These keys, and the mailbox where ids of several mailboxes may be alike."""
    return tuple((c, up) for c in (*names, *[f"_{c}" for c in mailbox_key(found)]))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.drop("_date", "_id", "_mailbox")


def filtered_stored(
    index: Postings, messages: DataFrame, terms: Iterable[Term], folders: DataFrame | None = None, now: datetime | None = None, limit: int = 0
) -> DataFrame:
    """Messages for which every term holds, text terms looked up in the stored index, with their ``score`` if there is a positive one.

    With a ``limit``, messages that cannot be among the best ``limit`` ones may be left out. Text columns of ``messages`` are not read.
    """
    terms = list(terms)
    texts = [t for t in terms if isinstance(t, Text)]
    others = [t for t in terms if not isinstance(t, Text)]
    rows = filtered(messages, others, folders, now)
    if _ranked(terms):
        return rows.join(ranked_rows(index, texts, limit, rows if others else None), "rowid")
    for term in texts:
        if term.wanted:
            rows = rows.join(term_hits(index, term).select("rowid"), "rowid", "left_anti")
    return rows


def search_stored(
    index: Postings,
    messages: DataFrame,
    terms: Iterable[Term] = (),
    *,
    folders: DataFrame | None = None,
    now: datetime | None = None,
    limit: int = 0,
    offset: int = 0,
    columns: Iterable[str] = LIST_COLUMNS,
) -> DataFrame:
    """The rows of ``search``, from the stored index: a search reads the postings of its own tokens, and of a limited one only promising blocks."""
    terms = list(terms)
    found = filtered_stored(index, messages, terms, folders, now, limit + offset if limit else 0)
    rows = [*[result_column(c) for c in columns], *_hidden(found)]
    if _ranked(terms):
        return _shown(take(found.select(*rows, "score"), _tie_order(found, ("score", "_id"), True), limit, offset))
    return _shown(take(found.select(*rows), _tie_order(found, ("_date", "_id"), False), limit, offset))


#: Up to this many sort keys may be ranked by one task; deeper places are found by counting.
BLOCK = 1 << 16

#: Rows drawn to part the others by; a round of counting leaves about one in this many.
PIVOTS = 64


def take(rows: DataFrame, order: tuple, limit: int, offset: int = 0) -> DataFrame:
    """Ordered rows after ``offset``, at most ``limit`` of them (0 = all)."""
    sort = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    if limit > 0 and offset <= BLOCK:
        return rows.orderBy(*sort).offset(offset).limit(limit)
    rest = (skip(rows, order, offset) if offset > 0 else rows).orderBy(*sort)
    return rest.limit(limit) if limit > 0 else rest


def skip(rows: DataFrame, order: tuple, count: int, block: int = BLOCK) -> DataFrame:
    """Rows after the first ``count``, without moving all rows through one task.

    All keys of ``order`` point the same way and hold no nulls. Up to ``block`` keys are ranked by one task, and the other rows are
    compared with the last of them. A deeper place is found by counting (``place``), in jobs that run while the result is
    being planned. Of rows with equal keys on both sides of the place any may be left out. ``keyset_page`` has no such cost.
    """
    keys = [c for c, _ in order]
    if count > block:
        found = place(rows.select(*keys), order, count, block)
        if found is None:
            return rows.limit(0)
        values, gone, enough = [F.lit(v) for v in found[0]], F.lit(found[1]), F.lit(True)
    else:
        up = order[0][1]
        key = F.struct(*keys).alias("key")
        first = rows.select(key).orderBy(F.col("key").asc() if up else F.col("key").desc()).limit(count)
        equal = first.groupBy("key").agg(F.count(F.lit(1)).alias("gone"))
        last = (F.max if up else F.min)(F.struct("key", "gone"))["key"], (F.max_by if up else F.min_by)("gone", "key")
        bound = equal.agg(F.struct(F.sum("gone").alias("found"), last[0].alias("last"), last[1].alias("gone"))).scalar()
        values, gone, enough = [bound["last"][c] for c in keys], bound["gone"], bound["found"] == count
    behind = rows.filter(enough & after(order, values))
    tied = rows.filter(enough & reduce(Column.__and__, [F.col(c) == v for c, v in zip(keys, values)]))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return behind.unionByName(tied.withColumn("_tied", number).filter(F.col("_tied") > gone).drop("_tied"))


def place(keys: DataFrame, order: tuple, count: int, block: int = BLOCK) -> tuple | None:
    """The sort key in place ``count``, and how many rows with this key are among the first ``count``; ``None`` when there are fewer rows.

    Each round draws ``PIVOTS`` keys by hash, counts the rows between them, and goes on in the one range that holds the place, until
    ``block`` rows or fewer are left to be ranked. Only pivots and their counts come to the driver.
    """
    names = [c for c, _ in order]
    types = dict(keys.dtypes)

    def literal(row) -> Column:
        return F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(names, row)])

    size = total = keys.count()
    if total < count:
        return None
    up = order[0][1]
    wanted = count if up else total - count + 1  # from the smallest key on
    below, low, high = 0, None, None

    def answer(key, equal: int) -> tuple:
        before = below if up else total - below - equal
        return tuple(key), count - before

    while True:
        left = keys.select(F.struct(*names).alias("k"), F.col(names[0]).alias("_first"))
        if low is not None:
            left = left.filter((F.col("_first") >= low[0]) & (F.col("k") > literal(low)))
        if high is not None:
            left = left.filter((F.col("_first") <= high[0]) & (F.col("k") < literal(high)))
        left = left.select("k")
        if size <= block:
            counted = left.groupBy("k").agg(F.count(F.lit(1)).alias("equal"))
            running = counted.withColumn("upto", F.sum("equal").over(Window.orderBy("k")))
            hit = running.filter(F.col("upto") >= wanted - below).orderBy("k").first()
            below += hit.upto - hit.equal
            return answer(hit.k, hit.equal)
        pivots = sorted({tuple(r.k) for r in left.orderBy(F.xxhash64("k")).limit(PIVOTS).collect()})
        drawn = F.array(*[literal(p) for p in pivots])
        at = F.size(F.filter(drawn, lambda p: p <= F.col("k"))).alias("at")
        hit_pivot = F.array_contains(drawn, F.col("k")).alias("equal")
        counts = {(r.at, r.equal): r["n"] for r in left.groupBy(at, hit_pivot).agg(F.count(F.lit(1)).alias("n")).collect()}
        for n in range(len(pivots) + 1):
            equal = counts.get((n, True), 0)
            if equal and below + equal >= wanted:
                return answer(pivots[n - 1], equal)
            below += equal
            size = counts.get((n, False), 0)
            if below + size >= wanted:
                low, high = pivots[n - 1] if n else low, pivots[n] if n < len(pivots) else high
                break
            below += size


def after(order: tuple, values: list) -> Column:
    """Whether a row sorts behind the row with these key values."""
    (column, up), *rest = order
    value, *others = values
    behind = F.col(column) > value if up else F.col(column) < value
    return behind | ((F.col(column) == value) & after(tuple(rest), others)) if rest else behind


def page(rows: DataFrame, size: int, offset: int = 0) -> DataFrame:
    """A page of a newest-first list."""
    return take(rows, NEWEST, size, offset)


def keyset_page(rows: DataFrame, size: int, last: tuple[str, str] | None = None) -> DataFrame:
    """The page behind the row with (date, id) ``last``; cost does not grow with the depth."""
    behind = rows if last is None else rows.filter(after(NEWEST, [F.lit(v) for v in last]))
    return take(behind, NEWEST, size)


def with_position(result: DataFrame, order: tuple, limit: int, offset: int = 0) -> DataFrame:
    """Number the first ``limit`` rows, counting on from ``offset``; one page, so one task numbers it."""
    sort = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    number = F.row_number().over(Window.orderBy(*sort)).cast("long") + offset
    return take(result, order, limit).withColumn("position", number)


def list_rows(messages: DataFrame) -> DataFrame:
    return messages.select(*[result_column(c) for c in LIST_COLUMNS])


def load(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Whole messages, bodies included, for a table of ids (column ``id``, and ``mailbox`` where mailboxes are told apart)."""
    return matched(messages, ids, "id", "left_semi").select(*[result_column(c) for c in DETAIL_COLUMNS])


def load_one(messages: DataFrame, id: str) -> DataFrame:
    """One whole message; the job fails when there is none."""
    row = messages.filter(F.col("id") == id).select(*[result_column(c) for c in DETAIL_COLUMNS])
    found = row.agg(F.max(F.struct(*DETAIL_COLUMNS)).alias("m"))
    missing = F.raise_error(F.lit(f'load message "{id}": no such message')).cast("string")
    checked = F.when(F.col("m").isNull(), missing).otherwise(F.col("m.id"))
    return found.select(checked.alias("id"), *[F.col("m")[c].alias(c) for c in DETAIL_COLUMNS[1:]])
