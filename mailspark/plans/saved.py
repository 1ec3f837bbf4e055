"""Saved searches as a table: read their terms, match all of them against all messages at once."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.functions.dates import cutoff_column
from mailspark.functions.text import SEPARATORS, TEXT_COLUMNS, WHITE, fold, strip, token_array
from mailspark.operators.index import with_index
from mailspark.operators.joins import salted_join
from mailspark.operators.terms import (
    BEFORE_FIELDS,
    FLAG_FIELDS,
    FOLDER_FIELDS,
    FOLDER_TYPES,
    SINCE_FIELDS,
    TEXT_FIELDS,
)

# Spellings of set and unset.
TRUE_WORDS = ("", "true", "1", "yes", "y", "on")
FALSE_WORDS = ("false", "0", "no", "n", "off")

# Fixed value: the shape of one term. An optional minus, then a quoted phrase, a field with a quoted
# or bare value, or a bare word; a quote without its partner takes the rest of the text.
# Terms are parted by white space of any script.
_FULL, _START = f"[^{WHITE}]", f'[^{WHITE}"]'
TERM = rf'-?(?:"[^"]*"|"[^"]*\z|[A-Za-z_]\w*:(?:"[^"]*"|"[^"]*\z|{_START}{_FULL}*|)|{_START}{_FULL}*)'
UNTERMINATED = r'^(?:[A-Za-z_]\w*:)?"[^"]*\z'

# What is said about a term that cannot be read.
FOLDER_LIST = ", ".join(FOLDER_TYPES)
UNTERMINATED_QUOTE = "unterminated quote in query"
UNKNOWN_FIELD = 'unknown field: "%s"'
TEXT_NEEDS_VALUE = 'field "%s" requires a value'
BAD_BOOLEAN = '%s: invalid boolean value "%s"'
DATE_NEEDS_VALUE = "%s: requires a date or duration value"
BAD_DATE = '%s: invalid date or duration "%s"'
FOLDER_NEEDS_VALUE = f"%s requires a folder ({FOLDER_LIST})"
UNKNOWN_FOLDER = f'unknown folder "%s" (want {FOLDER_LIST})'

COLUMN_BITS = {c: 1 << i for i, c in enumerate(TEXT_COLUMNS)}
ALL_BITS = sum(COLUMN_BITS.values())
FIELD_BITS = {field: sum(COLUMN_BITS[c] for c in columns) for field, columns in TEXT_FIELDS.items()}


def _lookup(key: Column, table: dict) -> Column:
    cases = [key == F.lit(k) for k in table]
    return reduce(lambda acc, kv: acc.when(kv[0], F.lit(kv[1])), zip(cases[1:], list(table.values())[1:]),
                  F.when(cases[0], F.lit(next(iter(table.values())))))


def parse_searches(searches: DataFrame, now: datetime, text: str = "search_text") -> DataFrame:
    """One row per term of every search: kind, what it looks for, or an ``error``.

    Blank bare terms give no row. ``searches`` has ``search_id`` and the search string.
    """
    raw = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TERM), F.lit(0))
    terms = searches.select("search_id", F.posexplode(raw).alias("term_no", "raw"))
    negated = (F.length("raw") > 1) & F.startswith("raw", F.lit("-"))
    terms = terms.withColumn("negated", negated)
    terms = terms.withColumn("body", F.when(F.col("negated"), F.substring("raw", 2, 1 << 30)).otherwise(F.col("raw")))
    terms = terms.withColumn("unterminated", F.col("body").rlike(UNTERMINATED))
    terms = terms.withColumn("field", F.lower(F.regexp_extract("body", r"^([A-Za-z_]\w*):", 1)))
    given = F.regexp_replace("body", r"^[A-Za-z_]\w*:", "")
    terms = terms.withColumn("quoted", F.startswith(given, F.lit('"')))
    plain = F.when(F.col("quoted"), F.regexp_replace(given, '^"|"$', "")).otherwise(given)
    terms = terms.withColumn("value", strip(plain))
    terms = terms.filter((F.col("field") != "") | (F.col("value") != "") | F.col("unterminated"))

    field, value, word = F.col("field"), F.col("value"), F.lower("value")
    kind = (
        F.when(F.col("unterminated"), "error")
        .when(field.isin("", *TEXT_FIELDS), "text")
        .when(field.isin(*FLAG_FIELDS), "flag")
        .when(field.isin(*SINCE_FIELDS, *BEFORE_FIELDS), "date")
        .when(field.isin(*FOLDER_FIELDS), "folder")
        .otherwise("error")
    )
    terms = terms.withColumn("kind", kind)
    is_kind = {k: F.col("kind") == k for k in ("text", "flag", "date", "folder")}
    terms = terms.withColumn("cutoff", F.when(is_kind["date"], cutoff_column(value, now)))
    flag_words = TRUE_WORDS + FALSE_WORDS
    blank = value == ""
    error = (
        F.when(F.col("unterminated"), UNTERMINATED_QUOTE)
        .when(F.col("kind") == "error", F.format_string(UNKNOWN_FIELD, field))
        .when(is_kind["text"] & blank, F.format_string(TEXT_NEEDS_VALUE, field))
        .when(is_kind["flag"] & ~word.isin(*flag_words), F.format_string(BAD_BOOLEAN, field, value))
        .when(is_kind["date"] & blank, F.format_string(DATE_NEEDS_VALUE, field))
        .when(is_kind["date"] & F.col("cutoff").isNull(), F.format_string(BAD_DATE, field, value))
        .when(is_kind["folder"] & blank, F.format_string(FOLDER_NEEDS_VALUE, field))
        .when(is_kind["folder"] & ~word.isin(*FOLDER_TYPES), F.format_string(UNKNOWN_FOLDER, word))
    )
    terms = terms.withColumn("error", error)
    good = F.col("error").isNull()
    prefix = ~F.col("quoted") & (F.length(value) > 1) & F.endswith(value, F.lit("*"))
    words = F.when(prefix, F.regexp_replace(value, r"\*$", "")).otherwise(value)
    spaced = F.concat(F.lit(" "), fold(words), F.lit(" "))
    phrase = F.trim(F.regexp_replace(spaced, SEPARATORS, " "))
    wants_set = word.isin(*TRUE_WORDS) != F.col("negated")
    present = _lookup(field, {f: v for f, (_, v) in FLAG_FIELDS.items()})
    since = field.isin(*SINCE_FIELDS) != F.col("negated")
    return terms.select(
        "search_id",
        "term_no",
        "kind",
        (F.col("negated") & F.col("kind").isin("text", "folder")).alias("negated"),
        F.when(good & is_kind["text"], F.when(field == "", F.lit(ALL_BITS)).otherwise(_lookup(field, FIELD_BITS))).alias("columns"),
        F.when(good & is_kind["text"], phrase).alias("phrase"),
        (good & is_kind["text"] & prefix).alias("prefix"),
        F.when(good & is_kind["flag"], _lookup(field, {f: c for f, (c, _) in FLAG_FIELDS.items()})).alias("flag_column"),
        F.when(good & is_kind["flag"], F.when(wants_set, present).otherwise(1 - present)).alias("flag_value"),
        F.when(good & is_kind["date"], F.when(since, F.lit(">=")).otherwise(F.lit("<"))).alias("date_op"),
        F.when(good, F.col("cutoff")).alias("cutoff"),
        F.when(good & is_kind["folder"], word).alias("folder"),
        "error",
    )


# --- matching --------------------------------------------------------------------------------------


def _postings(indexed: DataFrame) -> DataFrame:
    """Distinct tokens of each text column of each message, the column as a bit."""
    columns = F.array(
        *[
            F.struct(F.lit(bit).alias("bit"), F.array_distinct(token_array(F.col(f"pad_{c}"))).alias("tokens"))
            for c, bit in COLUMN_BITS.items()
        ]
    )
    by_column = indexed.select("rowid", F.explode(columns).alias("c"))
    return by_column.select("rowid", F.col("c.bit").alias("bit"), F.explode("c.tokens").alias("token"))


#: Bits of the filter of wanted keys; with very many distinct phrases it lets more through and results stay the same.
FILTER_BITS = 1 << 20


#: Messages whose pairs with searches one task holds. Shuffled pairs are small and large in memory, so their bytes say little.
ROWS_A_TASK = 8_192


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def _wanted_bits(keys: DataFrame, name: str) -> Column:
    """A bit for the slot of each key, as one array of longs (128 KB whatever the number of keys)."""
    slot = _slot(F.col(name))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    set_bits = keys.groupBy(F.floor(slot / 64).alias("id")).agg(F.bit_or(bit).alias("bits"))
    words = keys.sparkSession.range(FILTER_BITS // 64).join(set_bits, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return words.agg(ordered["bits"].alias("bits")).scalar()


def _may_be_wanted(bits: Column, key: Column) -> Column:
    slot = _slot(key)
    word = F.element_at(bits, (F.floor(slot / 64) + 1).cast("int"))
    return F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def _rarest(phrases: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Phrases with that of their ``whole`` tokens which the fewest messages hold."""
    kept = frequencies.groupBy(F.col("token").alias("kept_token")).agg(F.sum("holding").alias("holding"))
    parts = phrases.withColumn("part", F.explode_outer("whole"))
    rated = parts.join(kept, F.col("part") == F.col("kept_token"), "left")
    order = F.struct(F.coalesce("holding", F.lit(0)), -F.length("part"), "part")
    return rated.groupBy(*phrases.columns).agg(F.min_by("part", order).alias("best"))


def text_hits(messages: DataFrame, terms: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(search_id, term_no, negated, rowid) for every text term and message holding it.

    Each distinct phrase is looked up by one key: the rarest of its tokens by ``frequencies`` (token, holding, as kept by the
    stored index; only the speed depends on them), without them the longest, or ``inv*`` when it is a lone prefix. Messages offer
    each token, and its starts of the lengths that lone prefixes have; those no phrase wants are left out where they are read.
    One-token phrases are settled by the key; longer ones are checked against the padded text of the
    candidate messages only. ``terms`` is read several times: store it first.
    """
    indexed = with_index(messages)
    wanted = terms.filter((F.col("kind") == "text") & F.col("error").isNull() & (F.col("phrase") != ""))
    tokens = F.split("phrase", " ")
    whole = F.when(F.col("prefix"), F.slice(tokens, 1, F.size(tokens) - 1)).otherwise(tokens)
    longest = F.array_max(F.transform(whole, lambda t: F.struct(F.length(t).alias("size"), t.alias("token"))))["token"]
    phrases = wanted.select("columns", "phrase", "prefix", whole.alias("whole")).distinct()
    phrases = _rarest(phrases, frequencies) if frequencies is not None else phrases.withColumn("best", longest)
    lone_prefix = (F.size(tokens) == 1) & F.col("prefix")
    phrases = (
        phrases.withColumn("single", F.size(tokens) == 1)
        .withColumn("phrase_key", F.when(lone_prefix, F.concat("phrase", F.lit("*"))).otherwise(F.col("best")))
        .drop("whole", "best")
    )
    sizes = wanted.agg(F.concat(F.array(F.lit(0)), F.collect_set(F.when(lone_prefix, F.length("phrase"))))).scalar()
    starts = _postings(indexed).withColumn("size", F.explode(sizes)).filter(F.col("size") <= F.length("token"))
    start = F.concat(F.substring("token", F.lit(1), F.col("size")), F.lit("*"))
    keys = starts.withColumn("key", F.when(F.col("size") == 0, F.col("token")).otherwise(start))
    keys = keys.filter(_may_be_wanted(_wanted_bits(phrases, "phrase_key"), F.col("key")))
    found = (
        salted_join(keys, phrases, "key", "phrase_key", "rowid", "inner")
        .filter(F.col("columns").bitwiseAND(F.col("bit")) != 0)
        .select("rowid", "columns", "phrase", "prefix", "single")
        .distinct()
    )
    needle = F.concat(F.lit(" "), F.replace("phrase", F.lit(" "), F.lit("  ")), F.when(F.col("prefix"), "").otherwise(" "))
    holds = [
        (F.col("columns").bitwiseAND(F.lit(bit)) != 0) & F.contains(F.col(f"pad_{c}"), needle)
        for c, bit in COLUMN_BITS.items()
    ]
    pads = indexed.select("rowid", *[f"pad_{c}" for c in TEXT_COLUMNS])
    longer = found.filter(~F.col("single")).join(pads, "rowid").filter(reduce(Column.__or__, holds))
    settled = found.filter("single").unionByName(longer.select(*found.columns))
    key = F.concat_ws("|", "columns", "prefix", "phrase")
    named = wanted.select("search_id", "term_no", "negated", key.alias("named_key"))
    settled = settled.select("rowid", key.alias("term_key"))
    named_hits = salted_join(settled, named, "term_key", "named_key", "rowid", "inner")
    return named_hits.select("search_id", "term_no", "negated", "rowid")


def search_conditions(searches: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per search that can have hits: flags, date range, folders, number of positive text terms.

    A search without any term has no condition and matches everything.
    """
    def only(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    def flag(column: str) -> list[Column]:
        value = F.when(F.col("flag_column") == column, F.col("flag_value"))
        return [F.min(value).alias(f"{column}_low"), F.max(value).alias(f"{column}_high")]

    inside = only("folder", F.when(~F.col("negated"), F.col("folder")))
    outside = only("folder", F.when(F.col("negated"), F.col("folder")))
    positive = (F.col("kind") == "text") & ~F.col("negated")
    all_terms = searches.select("search_id").join(terms, "search_id", "left")
    grouped = all_terms.groupBy("search_id").agg(
        F.count("error").alias("errors"),
        F.count_if(positive).alias("text_terms"),
        F.count_if(positive & (F.col("phrase") == "")).alias("empty_terms"),
        *flag("is_read"),
        *flag("is_flagged"),
        *flag("has_attachments"),
        F.max(F.when(F.col("date_op") == ">=", F.col("cutoff"))).alias("from_ts"),
        F.min(F.when(F.col("date_op") == "<", F.col("cutoff"))).alias("to_ts"),
        F.min(inside).alias("inside"),
        F.max(inside).alias("inside_high"),
        F.collect_set(outside).alias("outside"),
    )
    agree = [
        F.coalesce(F.col(f"{c}_low") == F.col(f"{c}_high"), F.lit(True))
        for c in ("is_read", "is_flagged", "has_attachments")
    ]
    agree.append(F.coalesce(F.col("inside") == F.col("inside_high"), F.lit(True)))
    possible = reduce(Column.__and__, agree, (F.col("errors") == 0) & (F.col("empty_terms") == 0))
    return grouped.filter(possible).select(
        "search_id",
        "text_terms",
        *[F.col(f"{c}_low").alias(f"want_{c}") for c in ("is_read", "is_flagged", "has_attachments")],
        "from_ts",
        "to_ts",
        "inside",
        "outside",
    )


def _attributes(messages: DataFrame, folders: DataFrame) -> DataFrame:
    types = folders.select(F.col("id").alias("folder_key"), F.col("type").alias("folder_type"))
    narrow = messages.select("rowid", "folder_id", "ts", "is_read", "is_flagged", "has_attachments")
    return salted_join(narrow, types, "folder_id", "folder_key", "rowid", "left").drop("folder_id")


def _conditions_hold() -> Column:
    """Conditions of a search on the attributes of a message in the same row."""
    flags = [
        F.col(f"want_{c}").isNull() | F.coalesce(F.col(c) == F.col(f"want_{c}"), F.lit(False))
        for c in ("is_read", "is_flagged", "has_attachments")
    ]
    later = F.col("from_ts").isNull() | F.coalesce(F.col("ts") >= F.col("from_ts"), F.lit(False))
    earlier = F.col("to_ts").isNull() | F.coalesce(F.col("ts") < F.col("to_ts"), F.lit(False))
    inside = F.col("inside").isNull() | F.coalesce(F.col("folder_type") == F.col("inside"), F.lit(False))
    outside = ~F.coalesce(F.array_contains("outside", F.col("folder_type")), F.lit(False))
    return reduce(Column.__and__, flags, later & earlier & inside & outside)


ATTRIBUTES = ("is_read", "is_flagged", "has_attachments", "folder", "month")


def _attribute_key(parts: list[Column], pattern: Column) -> Column:
    """Attribute values joined to one key, ``*`` for those the pattern leaves open."""
    kept = [F.when(F.substring(pattern, i + 1, 1) == "1", p).otherwise(F.lit("*")) for i, p in enumerate(parts)]
    return F.concat_ws("|", *kept, pattern)


def _by_attributes(attributes: DataFrame, conditions: DataFrame) -> DataFrame:
    """Pairs for searches without positive text, by equality of the attributes a search names.

    A date range is turned into the months it covers, cut to the months that occur. A message is
    repeated only for combinations of named attributes that some search uses (at most 32).
    """
    months = attributes.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    first, last = (months.select(F.date_trunc("month", c)).scalar() for c in ("low", "high"))
    dated = F.col("from_ts").isNotNull() | F.col("to_ts").isNotNull()
    start = F.greatest(F.date_trunc("month", F.coalesce("from_ts", first)), first)
    stop = F.least(F.date_trunc("month", F.coalesce("to_ts", last)), last)
    spans = F.when(start <= stop, F.sequence(start, stop, F.expr("interval 1 month")))
    named = [F.col("want_is_read"), F.col("want_is_flagged"), F.col("want_has_attachments"), F.col("inside")]
    pattern = F.concat(*[F.when(c.isNotNull(), "1").otherwise("0") for c in named], F.when(dated, "1").otherwise("0"))
    undated = conditions.withColumn("pattern", pattern).filter(F.col("text_terms") == 0)
    wanted = undated.withColumn("span", F.explode(F.when(dated, spans).otherwise(F.array(F.lit(None).cast("timestamp")))))
    own = [*[c.cast("string") for c in named], F.date_format("span", "yyyy-MM")]
    wanted = wanted.withColumn("search_key", _attribute_key(own, F.col("pattern")))

    patterns = undated.agg(F.collect_set("pattern")).scalar()
    have = [F.col("is_read"), F.col("is_flagged"), F.col("has_attachments"), F.col("folder_type"), F.date_format("ts", "yyyy-MM")]
    rows = attributes.withColumn("pattern_here", F.explode(patterns))
    rows = rows.withColumn("row_key", _attribute_key([F.coalesce(c.cast("string"), F.lit("-")) for c in have], F.col("pattern_here")))
    pairs = salted_join(rows, wanted, "row_key", "search_key", "rowid", "inner")
    return pairs.filter(_conditions_hold()).select("search_id", "rowid")


def match_searches(
    searches: DataFrame, terms: DataFrame, messages: DataFrame, folders: DataFrame, frequencies: DataFrame | None = None
) -> DataFrame:
    """(search_id, rowid) of all hits of all searches; ``terms`` are those of ``parse_searches``, ``frequencies`` those of ``text_hits``.

    A search with an error in one of its terms has no hits.
    """
    conditions = search_conditions(searches, terms)
    attributes = _attributes(messages, folders)
    tasks = messages.count() // ROWS_A_TASK + 1
    counted = text_hits(messages, terms, frequencies).repartition(tasks, "search_id", "rowid").groupBy("search_id", "rowid").agg(
        F.count_if(~F.col("negated")).alias("found"), F.count_if(F.col("negated")).alias("barred")
    )
    with_text = salted_join(
        counted.filter((F.col("found") > 0) & (F.col("barred") == 0)),
        conditions.filter(F.col("text_terms") > 0).withColumnRenamed("search_id", "own_id"),
        "search_id", "own_id", "rowid", "inner",
    ).filter(F.col("found") == F.col("text_terms"))
    by_text = with_text.join(attributes, "rowid").filter(_conditions_hold()).select("search_id", "rowid")
    barred = counted.filter(F.col("barred") > 0).select("search_id", "rowid")
    by_attributes = _by_attributes(attributes, conditions).repartition(tasks, "search_id", "rowid").join(barred, ["search_id", "rowid"], "left_anti")
    return by_text.unionByName(by_attributes)


def hit_counts(searches: DataFrame, matches: DataFrame) -> DataFrame:
    """Hits of every search, with the words for them; searches with errors have no hits."""
    counts = matches.groupBy("search_id").agg(F.count(F.lit(1)).alias("hits"))
    hits = F.coalesce("hits", F.lit(0))
    words = F.when(hits == 1, F.lit("1 message")).otherwise(F.concat(hits.cast("string"), F.lit(" messages")))
    return searches.select("search_id").join(counts, "search_id", "left").select(
        "search_id", hits.alias("hits"), words.alias("shown")
    )
