"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from contract.view import FOLDER_ROWS, SIDE
from mailspark.functions import bodies
from mailspark.plans.saved import TERM
from mailspark.plans.synth import Pools

# The searched columns, and the words of a truth value.
TEXT_COLUMNS = ("subject", "from_name", "from_address", "to_text", "snippet", "body_text")
TRUE_WORDS, FALSE_WORDS = ("", "1", "on", "true", "y", "yes"), ("0", "false", "n", "no", "off")
# white space as Python counts it, without the four separators of files, groups, records and units
WHITE = "".join(c for c in map(chr, range(0x10000)) if c.isspace() and not "\x1c" <= c <= "\x1f")

NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(sql: str) -> str:
    return f"trim({sql}, {lit(WHITE)})"


def cut(sql: str, size: int) -> str:
    return f"CASE WHEN length({sql}) <= {size} THEN {sql} ELSE substr({sql}, 1, {size - 1}) || '…' END"


def snip(sql: str) -> str:
    line = f"nullif({strip(f'replace({sql}, chr(10), chr(32))')}, '')"
    return cut(line, 140)


def people(column: str) -> str:
    good = f"CASE WHEN json_valid({column}) THEN {column} ELSE '[]' END"
    shape = lit('[{"name":"VARCHAR","address":"VARCHAR"}]')
    named = f"list_transform(from_json({good}, {shape}), lambda x: coalesce(x.name, '') || ' ' || coalesce(x.address, ''))"
    return f"coalesce(array_to_string({named}, ' '), '')"


FOLDERS = "f AS (SELECT * FROM (VALUES " + ", ".join(
    f"({lit(i)}, {lit(n)}, {lit(t) if t else 'NULL'})" for i, n, t in FOLDER_ROWS
) + ") AS v(id, name, type))"

MESSAGES = f"""m AS (
  SELECT d.doc_id AS rowid, printf('msg-%06d', d.doc_id) AS id, 'acc-' || d.lang AS account_id,
    CASE d.doc_id % 10 WHEN 4 THEN 'f-none' WHEN 5 THEN 'f-sent' WHEN 6 THEN 'f-trash' WHEN 7 THEN 'f-spam'
      WHEN 8 THEN 'f-drafts' WHEN 9 THEN 'f-all' ELSE 'f-inbox' END AS folder_id,
    CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 19 = 0 THEN '' ELSE '<' || md5(d.text) || '@x>' END AS message_id,
    CASE WHEN d.doc_id % 23 = 0 THEN NULL WHEN d.doc_id % 29 = 1 THEN '' ELSE '<t' || (d.doc_id // 4) || '>' END AS thread_id,
    d.source || '@' || d.lang || '.example' AS from_address,
    CASE WHEN d.doc_id % 13 <> 0 THEN 'Sender ' || d.source END AS from_name,
    '[{{"name":"User ' || (d.doc_id % 40) || '","address":"u' || (d.doc_id % 40) || '@example.com"}}]' AS to_addresses,
    CASE WHEN d.doc_id % 3 = 0 THEN '[{{"name":"Team ' || (d.doc_id % 40) || '","address":"team@x.example"}},{{"address":"c'
      || (d.doc_id % 40) || '@x.example"}}]' END AS cc_addresses,
    CASE WHEN d.doc_id % 11 = 0 THEN 'n/a' WHEN d.doc_id % 7 = 0 THEN '[]' END AS bcc_addresses,
    CASE WHEN d.doc_id % 37 <> 5 THEN substr(split_part(d.text, chr(10), 1), 1, 60) END AS subject,
    {snip('d.text')} AS snippet,
    CASE WHEN d.doc_id % 29 <> 0 THEN d.text END AS body_text,
    p.html AS body_html,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id::BIGINT) AS ts,
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id::BIGINT), '%Y-%m-%d %H:%M:%S') AS date,
    coalesce(l.quality, 0) AS is_read, coalesce(l.toxic, 0) AS is_flagged,
    CASE WHEN d.n_chars % 7 = 0 THEN 1 ELSE 0 END AS has_attachments,
    CASE WHEN d.doc_id % 10 = 8 THEN 1 ELSE 0 END AS is_draft
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id)"""

TO_TEXT = f"trim({people('to_addresses')} || ' ' || {people('cc_addresses')} || ' ' || {people('bcc_addresses')})"


def pad(sql: str) -> str:
    folded = f"strip_accents(lower(coalesce({sql}, '')))"
    return f"regexp_replace(' ' || {folded} || ' ', '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+', '  ', 'g')"


def count_tokens(padded: str) -> str:
    return f"((length({padded}) - length(replace({padded}, '  ', ''))) // 2 - 1)"


PADS = "t AS (SELECT m.*, " + ", ".join(
    f"{pad(TO_TEXT if c == 'to_text' else c)} AS p_{c}" for c in TEXT_COLUMNS
) + " FROM m), tok AS (SELECT t.*, " + " + ".join(count_tokens(f"p_{c}") for c in TEXT_COLUMNS) + " AS doc_len FROM t)"

WITH = f"WITH {MESSAGES}, {FOLDERS}, {PADS} "

LIST = """id, date, is_read <> 0 AS is_read, is_flagged <> 0 AS is_flagged, has_attachments <> 0 AS has_attachments,
 coalesce(from_name, '') AS from_name, from_address, coalesce(subject, '') AS subject, coalesce(snippet, '') AS snippet"""


def has(needle: str, columns: tuple[str, ...] = TEXT_COLUMNS) -> str:
    return "(" + " OR ".join(f"contains(p_{c}, {lit(needle)})" for c in columns) + ")"


def rows(where: str) -> str:
    return f"{WITH} SELECT {LIST} FROM tok WHERE {where}"


SENDER = ("from_name", "from_address")
IN = "folder_id IN (SELECT id FROM f WHERE type = '{}')"
NOT_SPAM = """(coalesce(message_id, '') = '' OR message_id NOT IN (SELECT message_id FROM m
  WHERE coalesce(message_id, '') <> '' AND folder_id IN (SELECT id FROM f WHERE type = 'spam')))"""
FIRST_COPY = """(coalesce(message_id, '') = '' OR rowid IN
  (SELECT min(rowid) FROM m WHERE coalesce(message_id, '') <> '' GROUP BY message_id))"""

SQL: dict[str, str] = {
    "list_rows": rows("true"),
    "text_any_column": rows(has(" the ")),
    "text_subject": rows(has(" the ", ("subject",))),
    "text_sender": rows(has(" src1 ", SENDER)),
    "text_recipient": rows(has(" u7  example  com ", ("to_text",))),
    "text_body": rows(has(" of ", ("body_text",))),
    "text_phrase": rows(has(" of  the ")),
    "text_prefix": rows(has(" th", ("snippet",))),
    "text_and_flag": rows(f"{has(' the ')} AND {has(' que ')} AND is_flagged = 0"),
    "text_minus_text": rows(f"{has(' the ')} AND NOT ({has(' of  the ')} OR {has(' src3 ', SENDER)})"),
    "text_only_negated": rows(f"rowid NOT IN (SELECT rowid FROM tok WHERE {has(' the ')} OR {has(' que ')})"),
    "flag_unread": rows("is_read = 0"),
    "flag_flagged_attach": rows("is_flagged = 1 AND has_attachments = 1"),
    "date_range": rows("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07 12:30:00'"),
    "date_relative": rows("ts >= TIMESTAMP '2023-12-20' AND ts < TIMESTAMP '2024-01-18 12:00:00'"),
    "date_absolute": rows("ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09 06:00:01'"),
    "folder_in": rows(IN.format("sent")),
    "folder_not_in": rows(f"NOT {IN.format('trash')} AND NOT {IN.format('spam')}"),
    "search_view": rows(f"{NOT_SPAM} AND {FIRST_COPY}"),
    "search_view_with_spam": rows(FIRST_COPY),
    "view_in_spam": rows(IN.format("spam")),
    "view_not_in_spam": rows(f"{NOT_SPAM} AND {FIRST_COPY} AND NOT {IN.format('spam')} AND {has(' the ')}"),
    "view_in_inbox": rows(f"{NOT_SPAM} AND {IN.format('inbox')}"),
    "search_all": rows("true"),
    "search_joined": rows(f"{has(' the ')} AND {has(' que')} AND is_read = 0"),
    "view_hide_spam": rows(NOT_SPAM),
    "view_dedup": rows(FIRST_COPY),
    "search_limit": rows("true ORDER BY date DESC, id DESC LIMIT 25"),
    "search_page": rows("is_read = 0 ORDER BY date DESC, id DESC LIMIT 30 OFFSET 60"),
    "search_offset": rows("true ORDER BY date DESC, id DESC OFFSET 100"),
    "search_keyset_page": rows("(date, id) < ('2024-01-08 00:00:00', 'msg-000168') ORDER BY date DESC, id DESC LIMIT 40"),
}

SQL["scan_messages"] = f"""{WITH} SELECT rowid, id, folder_id, subject, date, strftime(ts, '%Y-%m') AS month,
  is_read, doc_len FROM tok"""
SQL["search_text"] = f"{WITH} SELECT rowid, subject, from_name, from_address, {TO_TEXT} AS to_text, snippet, body_text FROM m"
SQL["token_stats"] = (
    f"{WITH} SELECT rowid, "
    + ", ".join(f"{count_tokens(f'p_{c}')} AS {c}_tokens" for c in TEXT_COLUMNS)
    + ", len(list_distinct(list_filter(string_split(p_body_text, ' '), lambda x: x <> ''))) AS body_distinct, doc_len FROM tok"
)

CHANGED = f"""{WITH}, c AS (
  SELECT 'update' AS op, rowid * 4 + 1 AS seq, rowid, 'Changed ' || id AS subject, from_name, from_address, to_addresses,
    cc_addresses, bcc_addresses, snippet, body_text FROM m WHERE rowid % 3 = 0
  UNION ALL SELECT 'update', rowid * 4 + 2, rowid, subject, 'Last Writer', from_address, to_addresses, cc_addresses,
    bcc_addresses, snippet, body_text FROM m WHERE rowid % 6 = 0
  UNION ALL SELECT 'delete', rowid * 4 + 3, rowid, subject, from_name, from_address, to_addresses, cc_addresses,
    bcc_addresses, snippet, body_text FROM m WHERE rowid % 5 = 1
  UNION ALL SELECT 'insert', rowid * 4, rowid + 1000000000, subject, from_name, from_address, to_addresses, cc_addresses,
    bcc_addresses, snippet, body_text FROM m WHERE rowid % 4 = 2),
last AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY rowid ORDER BY seq DESC) = 1),
now_rows AS (SELECT rowid, subject, from_name, from_address, to_addresses, cc_addresses, bcc_addresses, snippet, body_text
  FROM m WHERE rowid NOT IN (SELECT rowid FROM last)
  UNION ALL SELECT rowid, subject, from_name, from_address, to_addresses, cc_addresses, bcc_addresses, snippet, body_text
  FROM last WHERE op <> 'delete') """
SQL["search_text_after_changes"] = f"{CHANGED} SELECT rowid, subject, from_name, from_address, {TO_TEXT} AS to_text, snippet, body_text FROM now_rows"
SQL["index_after_changes"] = (
    f"{CHANGED} SELECT rowid, {pad('subject')} AS pad_subject, {pad('from_name')} AS pad_from_name, "
    + " + ".join(count_tokens(pad(TO_TEXT if c == "to_text" else c)) for c in TEXT_COLUMNS)
    + " AS doc_len FROM now_rows"
)

SQL["result_json"] = f"""{WITH}, n AS (SELECT * FROM m WHERE is_read = 0 ORDER BY date DESC, id DESC LIMIT 50)
  SELECT '[' || coalesce(string_agg('{{"id":' || to_json(id) || ',"date":' || to_json(date) || ',"is_read":' ||
    CASE WHEN is_read <> 0 THEN 'true' ELSE 'false' END || ',"subject":' || to_json(coalesce(subject, '')) || '}}', ','
    ORDER BY date DESC, id DESC), '') || ']' AS result FROM n"""


def json_text(column: str) -> str:
    return f"""'"{column}":' || to_json(coalesce({column}, ''))"""


def json_flag(column: str) -> str:
    return f"""'"{column}":' || CASE WHEN {column} <> 0 THEN 'true' ELSE 'false' END"""


def payload(extra: bool) -> str:
    fields = [json_text("id"), json_text("date")]
    fields += [json_flag(c) for c in ("is_read", "is_flagged", "has_attachments")]
    fields += [json_text(c) for c in ("from_name", "from_address", "subject", "snippet")]
    body = " || ',' || ".join(fields)
    optional = "".join(
        f" || CASE WHEN coalesce({c}, '') <> '' THEN ',' || {json_text(c)} ELSE '' END"
        for c in (("to_addresses", "body_text", "body_html") if extra else ())
    )
    return "'{' || " + body + optional + " || '}'"


MARKS = """CASE WHEN is_read = 0 THEN '1' ELSE '0' END AS unread, CASE WHEN is_flagged = 1 THEN '1' ELSE '0' END AS flagged,
  CASE WHEN has_attachments = 1 THEN '1' ELSE '0' END AS attachments"""
SQL["event_payload"] = f"""{WITH} SELECT 'new-message' AS name, 'unread:' AS query, 'mail' AS source, id, {MARKS},
  {payload(True)} AS payload FROM m"""
SQL["event_roundtrip"] = f"""{WITH} SELECT 'new-message' AS name, 'unread:' AS query, id, date, is_read <> 0 AS is_read,
  has_attachments <> 0 AS has_attachments, coalesce(subject, '') AS subject, nullif(body_text, '') AS body_text FROM m"""
SQL["schema_gate"] = """WITH s AS (SELECT c_custkey AS mailbox, CASE WHEN c_custkey % 7 = 0 THEN 'theme' ELSE 'schema_version' END AS key,
    CASE c_custkey % 5 WHEN 0 THEN ' 13 ' WHEN 1 THEN '13' WHEN 2 THEN '12' WHEN 3 THEN 'x13' ELSE '14' END AS value FROM customer),
  g AS (SELECT mailbox, max(CASE WHEN key = 'schema_version' THEN try_cast(trim(value) AS INTEGER) END) AS got FROM s GROUP BY mailbox)
  SELECT mailbox, got IS NOT NULL AS found, got, 13 AS want, coalesce(got = 13, false) AS ok FROM g"""
SQL["load_message"] = f"""{WITH} SELECT {LIST}, to_addresses, coalesce(body_text, '') AS body_text,
  coalesce(body_html, '') AS body_html FROM m WHERE rowid IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
SQL["date_unreadable"] = f"""{WITH} SELECT id, 'all' AS list FROM m
  UNION ALL SELECT id, 'before' FROM m WHERE has_attachments = 0 AND ts < TIMESTAMP '2024-01-10'
  UNION ALL SELECT id, 'since' FROM m WHERE has_attachments = 0 AND ts >= TIMESTAMP '2024-01-10'"""
SQL["dup_representatives"] = f"""{WITH} SELECT message_id, min(rowid) AS rowid FROM m
  WHERE coalesce(message_id, '') <> '' GROUP BY message_id"""


# --- relevance ----------------------------------------------------------------------------------------


def occurrences(needle: str, columns: tuple[str, ...] = TEXT_COLUMNS) -> str:
    if needle == " the  the ":  # pairs in a run of n are n - 1: marks minus runs of marks
        mark = "replace(p_{0}, ' the ', '§')"
        one = f"length({mark}) - length(regexp_replace({mark}, '§+', '§', 'g'))"
        return " + ".join(one.format(c) for c in columns)
    return " + ".join(f"(length(p_{c}) - length(replace(p_{c}, {lit(needle)}, ''))) // {len(needle)}" for c in columns)


def scored(terms: list[tuple[str, tuple[str, ...]]], where: str) -> str:
    counts = ", ".join(f"{occurrences(n, c)} AS f{i}" for i, (n, c) in enumerate(terms))
    hits = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = ", ".join(
        f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END AS w{i}"
        for i in range(len(terms))
    )
    score = "".join(f" - w{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * doc_len / mean))" for i in range(len(terms)))
    needed = " AND ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""{WITH}, c AS (SELECT tok.*, {counts} FROM tok),
      s AS (SELECT count(*)::DOUBLE AS n, avg(doc_len) AS mean, {hits} FROM c), w AS (SELECT mean, {idf} FROM s),
      r AS (SELECT id, subject, round(0{score}, 10) AS score FROM c, w WHERE {needed} AND {where})"""


SQL["corpus_stats"] = f"""{WITH} SELECT count(*) AS messages, round(avg(doc_len), 6) AS mean_len,
  count(*) FILTER ({has(' the ')}) AS hits_0, count(*) FILTER ({has(' of  the ')}) AS hits_1,
  count(*) FILTER ({has(' th', ('subject',))}) AS hits_2 FROM tok"""
SQL["search_ranked"] = (
    scored([(" of  the ", TEXT_COLUMNS), (" and ", TEXT_COLUMNS)], "is_read = 0")
    + " SELECT row_number() OVER (ORDER BY score, id) AS position, id, coalesce(subject, '') AS subject, round(score, 6) AS score"
    " FROM r ORDER BY r.score, id LIMIT 50"
)
SQL["search_ranked_column"] = (
    scored([(" th", ("subject",)), (" the  the ", TEXT_COLUMNS)], f"NOT {has(' que ')}")
    + " SELECT row_number() OVER (ORDER BY score, id) AS position, id, coalesce(subject, '') AS subject, round(score, 6) AS score"
    " FROM r ORDER BY r.score, id LIMIT 40 OFFSET 5"
)
SQL["search_scores"] = (
    scored([(" the ", TEXT_COLUMNS), (" of  the ", ("body_text",))], "true") + " SELECT id, round(score, 6) AS score FROM r"
)
SQL["scan_text_any_column"], SQL["scan_text_minus_text"] = SQL["text_any_column"], SQL["text_minus_text"]
SQL["scan_scores"], SQL["kept_totals"] = SQL["search_scores"], SQL["corpus_stats"]
SQL["search_skipping"] = (
    scored([(" the ", TEXT_COLUMNS)], "true")
    + " SELECT row_number() OVER (ORDER BY score, id) AS position, id, coalesce(subject, '') AS subject, round(score, 6) AS score"
    " FROM r ORDER BY r.score, id LIMIT 10"
)
SQL["token_frequencies"] = (
    f"{WITH}, w AS (SELECT rowid, unnest(list_distinct(list_filter(string_split("
    + " || ' ' || ".join(f"p_{c}" for c in TEXT_COLUMNS)
    + ", ' '), lambda x: x <> ''))) AS token FROM tok) SELECT token, count(*) AS holding FROM w GROUP BY token"
)
AFTER = (
    f"{CHANGED}, p AS (SELECT rowid, "
    + ", ".join(f"{pad(TO_TEXT if c == 'to_text' else c)} AS p_{c}" for c in TEXT_COLUMNS)
    + " FROM now_rows), cc AS (SELECT *, "
    + " + ".join(count_tokens(f"p_{c}") for c in TEXT_COLUMNS)
    + f" AS doc_len, {occurrences(' the ')} AS f0 FROM p), s AS (SELECT count(*)::DOUBLE AS n, avg(doc_len) AS mean, count(*) FILTER (f0 > 0) AS n0 FROM cc)"
)
SQL["postings_after_changes"] = SQL["postings_compacted"] = SQL["postings_stream"] = f"""{AFTER} SELECT rowid, round(round(
  -(CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) > 0 THEN ln((n - n0 + 0.5) / (n0 + 0.5)) ELSE 1e-6 END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * doc_len / mean)), 10), 6) AS score
  FROM cc, s WHERE f0 > 0 AND NOT contains(p_subject, ' que ')"""


# --- profile and counters -----------------------------------------------------------------------------


def span(name: str) -> str:
    return f"""coalesce(min(length({name})), 0) AS {name}_min, coalesce(max(length({name})), 0) AS {name}_max,
      round(coalesce(avg(length({name})), 0), 6) AS {name}_avg"""


def mean_people(name: str, alias: str) -> str:
    size = f"CASE WHEN json_valid({name}) THEN json_array_length({name}) ELSE 0 END"
    return f"round(coalesce(avg(coalesce({size}, 0)), 0), 6) AS {alias}"


TOTALS = """count(*) AS total, coalesce(min(date), '') AS first_date, coalesce(max(date), '') AS last_date,
  sum(is_read)::BIGINT AS read, (count(*) - sum(is_read))::BIGINT AS unread, sum(is_flagged)::BIGINT AS flagged,
  sum(has_attachments)::BIGINT AS has_attachments, count(*) FILTER (coalesce(body_html, '') <> '') AS with_html,
  count(*) FILTER (coalesce(body_text, '') <> '') AS with_text, sum(is_draft)::BIGINT AS drafts"""
DISTINCT = """count(DISTINCT nullif(message_id, '')) AS distinct_message_id,
  count(DISTINCT nullif(thread_id, '')) AS distinct_thread_id, count(DISTINCT from_address) AS distinct_senders"""
BY_FOLDER = """SELECT f.id AS folder_id, coalesce(f.type, '(null)') AS type, count(m.id) AS messages,
  count(*) FILTER (m.is_read = 0) AS unread FROM f LEFT JOIN m ON m.folder_id = f.id GROUP BY f.id, f.type"""
COUNTS = " UNION ALL ".join(f"SELECT {lit(n)} AS table_name, count(*) AS row_count FROM {t}" for n, t in SIDE.items())

SQL["profile_messages"] = f"{WITH} SELECT {TOTALS} FROM m"
SQL["profile_distinct"] = f"{WITH} SELECT {DISTINCT} FROM m"
SQL["profile_lengths"] = f"{WITH} SELECT {span('subject')}, {span('body_text')}, {span('snippet')} FROM m"
SQL["profile_recipients"] = (
    f"{WITH} SELECT {mean_people('to_addresses', 'to_avg')}, {mean_people('cc_addresses', 'cc_avg')},"
    f" {mean_people('bcc_addresses', 'bcc_avg')} FROM m"
)
CELL = ", ".join(
    [f"coalesce(sum({c}), 0)::BIGINT AS {c}_sum" for c in ("is_read", "is_flagged", "has_attachments", "is_draft")]
    + [f"coalesce(sum(length({c})), 0)::BIGINT AS {c}_chars, count({c}) AS {c}_count, min(length({c})) AS {c}_min, max(length({c})) AS {c}_max"
       for c in ("subject", "body_text", "snippet")]
    + [f"coalesce(sum(CASE WHEN json_valid({c}_addresses) THEN json_array_length({c}_addresses) END), 0)::BIGINT AS {c}_people" for c in ("to", "cc", "bcc")]
)
SQL["profile_rollup"] = f"""{WITH} SELECT folder_id, substr(date, 1, 7) AS month, count(*) AS total,
  count(*) FILTER (is_read = 0) AS marked_unread, {CELL}, count(*) FILTER (coalesce(body_html, '') <> '') AS with_html,
  count(*) FILTER (coalesce(body_text, '') <> '') AS with_text, min(date) AS first_date, max(date) AS last_date FROM m GROUP BY 1, 2"""
SQL["profile_rollup_totals"] = f"""{WITH} SELECT {TOTALS}, {span('subject')}, {span('body_text')}, {span('snippet')},
  {mean_people('to_addresses', 'to_avg')}, {mean_people('cc_addresses', 'cc_avg')}, {mean_people('bcc_addresses', 'bcc_avg')} FROM m"""
SQL["profile_sketches"] = f"""{WITH} SELECT folder_id, count(DISTINCT nullif(message_id, '')) AS ids, count(DISTINCT nullif(thread_id, '')) AS threads,
  count(DISTINCT from_address) AS senders, true AS ids_near, true AS threads_near, true AS senders_near FROM m GROUP BY folder_id"""
SQL["folder_profile"] = f"{WITH} {BY_FOLDER}"
SQL["per_month"] = f"{WITH} SELECT substr(date, 1, 7) AS month, count(*) AS messages FROM m GROUP BY 1"
SQL["table_rows"] = COUNTS
SQL["profile_document"] = f"""{WITH}, bf AS ({BY_FOLDER}), pm AS (SELECT substr(date, 1, 7) AS month, count(*) AS n FROM m GROUP BY 1),
  tr AS ({COUNTS} UNION ALL SELECT 'settings', count(*) FROM region), s AS (SELECT {TOTALS}, {DISTINCT} FROM m)
  SELECT 13::BIGINT AS schema_version, (SELECT count(DISTINCT account_id) FROM m) AS accounts,
    (SELECT '[' || string_agg('{{"type":' || to_json(type) || ',"messages":' || messages || ',"unread":' || unread || '}}', ','
      ORDER BY messages DESC, folder_id) || ']' FROM bf) AS folders,
    total, distinct_message_id, first_date, last_date, unread, with_html,
    (SELECT '{{' || string_agg(to_json(month) || ':' || n, ',' ORDER BY month) || '}}' FROM pm) AS per_month,
    (SELECT round(avg(length(subject)), 6) FROM m) AS subject_avg,
    (SELECT round(avg(coalesce(json_array_length(cc_addresses), 0)), 6) FROM m) AS cc_avg,
    (SELECT '{{' || string_agg(to_json(table_name) || ':' || row_count, ',' ORDER BY table_name) || '}}' FROM tr) AS table_rows
  FROM s"""

SQL["search_offset_deep"] = f"""{WITH} SELECT {LIST} FROM m
  QUALIFY row_number() OVER (ORDER BY date DESC, id DESC) > (SELECT count(*) // 2 FROM m)"""

RULE = """((coalesce(f.type = 'drafts', false) OR f.name ILIKE '%draft%') AND coalesce(m.is_draft, 0) = 1)
  OR ((f.type IS NULL OR (f.type <> 'drafts' AND f.name NOT ILIKE '%draft%')) AND coalesce(m.is_draft, 0) = 0)"""
UNREAD = f"""SELECT f.id AS folder_id, count(m.id) AS unread_count FROM f LEFT JOIN m
  ON m.folder_id = f.id AND m.is_read = 0 AND ({RULE}) GROUP BY f.id"""
STEPS = f"""c AS (SELECT *, rowid % 4 AS k FROM m),
  st AS (SELECT m.rowid AS seq, f.id AS folder_id, CASE WHEN k = 0 AND is_read = 0 THEN 1 WHEN k = 1 AND is_read = 0 THEN -1
    WHEN k = 2 AND is_read = 1 THEN -1 WHEN k = 2 AND is_read = 0 THEN 1 END AS step
    FROM c m JOIN f ON f.id = m.folder_id WHERE {RULE})"""
SQL["folder_unread"] = f"{WITH} {UNREAD}"
TWO = f"""{WITH}, m2 AS (SELECT 'one' AS mailbox, * FROM m UNION ALL SELECT 'two', * REPLACE (
    CASE WHEN rowid % 3 = 0 THEN 0 ELSE is_read END AS is_read) FROM m WHERE rowid % 7 <> 3),
  f2 AS (SELECT 'one' AS mailbox, * FROM f UNION ALL SELECT 'two', id, name,
    CASE id WHEN 'f-spam' THEN 'custom' WHEN 'f-all' THEN 'spam' ELSE type END FROM f),
  sp AS (SELECT DISTINCT m2.mailbox, message_id FROM m2 JOIN f2 ON f2.mailbox = m2.mailbox AND f2.id = folder_id
    WHERE f2.type = 'spam' AND coalesce(message_id, '') <> ''),
  kept AS (SELECT m2.* FROM m2 LEFT JOIN sp USING (mailbox, message_id) WHERE sp.mailbox IS NULL)"""
SQL["hide_spam_two_mailboxes"] = f"{TWO} SELECT mailbox, id FROM kept"
SQL["view_two_mailboxes"] = f"""{TWO} SELECT mailbox, id, coalesce(subject, '') AS subject FROM kept
  QUALIFY coalesce(message_id, '') = '' OR row_number() OVER (PARTITION BY mailbox, message_id ORDER BY rowid) = 1"""
SQL["folders_two_mailboxes"] = f"""{TWO} SELECT m2.mailbox, m2.id FROM m2 JOIN f2 ON f2.mailbox = m2.mailbox AND f2.id = folder_id
  WHERE f2.type = 'spam'"""
SQL["unread_two_mailboxes"] = f"""{TWO} SELECT f.mailbox, f.id AS folder_id, count(m.id) AS unread_count FROM f2 f
  LEFT JOIN m2 m ON m.mailbox = f.mailbox AND m.folder_id = f.id AND m.is_read = 0 AND ({RULE}) GROUP BY f.mailbox, f.id"""
SQL["profile_two_mailboxes"] = f"""{TWO} SELECT f.mailbox, f.id AS folder_id, coalesce(f.type, '(null)') AS type, count(m.id) AS messages,
  count(*) FILTER (m.is_read = 0) AS unread FROM f2 f LEFT JOIN m2 m ON m.mailbox = f.mailbox AND m.folder_id = f.id
  GROUP BY f.mailbox, f.id, f.type"""
SQL["folder_unread_after_changes"] = f"""{WITH}, u AS ({UNREAD}), {STEPS},
  run AS (SELECT folder_id, step, sum(step) OVER (PARTITION BY folder_id ORDER BY seq) AS s FROM st WHERE step IS NOT NULL),
  ends AS (SELECT folder_id, sum(step) AS total, min(s) AS lowest FROM run GROUP BY folder_id)
  SELECT u.folder_id, coalesce(total + greatest(unread_count % 3, -lowest), unread_count % 3)::BIGINT AS unread_count
  FROM u LEFT JOIN ends USING (folder_id)"""
SQL["folder_unread_stream"] = SQL["folder_unread_after_changes"]


# --- text ---------------------------------------------------------------------------------------------

SENDER_LABEL = """CASE WHEN coalesce(from_name, '') <> '' AND from_address <> '' THEN from_name || ' <' || from_address || '>'
  WHEN coalesce(from_name, '') <> '' THEN from_name ELSE from_address END"""
SQL["listing"] = f"""{WITH}, n AS (SELECT m.*, {strip("coalesce(subject, '')")} AS line FROM m)
  SELECT id, '[' || CASE WHEN is_read = 0 THEN 'U' ELSE ' ' END || CASE WHEN is_flagged = 1 THEN '*' ELSE ' ' END
    || CASE WHEN has_attachments = 1 THEN '@' ELSE ' ' END || ']' AS badge, strftime(ts, '%Y-%m-%d %H:%M') AS shown_date,
    {SENDER_LABEL} AS sender, coalesce(nullif(from_name, ''), from_address) AS sender_short,
    CASE WHEN line <> '' THEN subject ELSE '(no subject)' END AS shown_subject,
    CASE WHEN line = '' THEN '(no subject)' ELSE {cut('line', 72)} END AS log_subject,
    {cut("coalesce(snippet, '')", 100)} AS shown_snippet FROM n"""
SQL["snippet"] = f"SELECT doc_id AS rowid, {snip('text')} AS snippet, {cut('text', 30)} AS cut FROM documents"


def steps(sql: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, replacement in pairs:
        sql = f"regexp_replace({sql}, {lit(pattern)}, {lit(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return sql


def html_text(sql: str) -> str:
    marked = steps(f"coalesce({sql}, '')", bodies.TO_MARKERS)
    for entity, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        marked = f"replace({marked}, '{entity}', '{char}')"
    return steps(marked, bodies.FROM_MARKERS)


def clean(sql: str) -> str:
    return strip(steps(f"coalesce({sql}, '')", bodies.PLAIN_STEPS))


SQL["html_to_text"] = f"SELECT page_id, {html_text('html')} AS body FROM pages"
SQL["clean_plain"] = f"SELECT doc_id, {clean('text')} AS body FROM documents"
SQL["readable_body"] = f"""{WITH} SELECT id, coalesce(nullif({clean("body_text")}, ''),
  nullif({html_text('body_html')}, ''), {clean('snippet')}) AS body FROM m"""


# --- saved searches -----------------------------------------------------------------------------------


def searches(table: str, key: str) -> str:
    pair = "(\\p{L}+)[^\\p{L}]+(\\p{L}+)"
    return f"""w AS (SELECT {key} AS k, regexp_extract(pair, '{pair}', 1) AS a, regexp_extract(pair, '{pair}', 2) AS b FROM (
    SELECT {key}, coalesce(list_max(regexp_extract_all(text, '{pair}')), '') AS pair FROM {table})),
  s AS (SELECT k AS search_id, CASE k % 20 WHEN 0 THEN a || ' ' || b WHEN 1 THEN 'subject:' || a || ' unread:' WHEN 2 THEN '-' || a
    WHEN 3 THEN '"' || a || ' ' || b || '" -in:trash' WHEN 4 THEN 'from:src' || (k % 20) || '  -Flagged:no'
    WHEN 5 THEN 'in:inbox newer:10d' WHEN 6 THEN 'in:SPAM' WHEN 7 THEN 'body:"' || a || ' ' || b || '" older:1w'
    WHEN 8 THEN substr(a, 1, 2) || '* read:true' WHEN 9 THEN 'snippet:' || a || ' -flagged:true'
    WHEN 10 THEN 'after:2024-01-05 before:2024-01-20' WHEN 11 THEN 'foo:' || a WHEN 12 THEN 'unread:maybe older:'
    WHEN 13 THEN 'after:soon subject:""' WHEN 14 THEN 'in:archive folder:' WHEN 15 THEN 'subject:"' || a
    WHEN 16 THEN 'to:u' || (k % 40) || ' -in:drafts -in:spam' WHEN 17 THEN 'unread: attachments: newer_than:1month'
    WHEN 18 THEN '12:30 "" -unread:false' ELSE '' END AS search_text FROM w)"""


def words(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


UNITS = """CASE WHEN unit IN ('h','hr','hrs','hour','hours') THEN {now} - to_hours(amount)
  WHEN unit IN ('d','day','days') THEN {now} - to_days(amount::INTEGER) WHEN unit IN ('w','wk','week','weeks') THEN {now} - to_days((amount * 7)::INTEGER)
  WHEN unit IN ('m','mo','mon','month','months') THEN date_trunc('month', {now}) - to_months(amount::INTEGER) + to_days(19)
  WHEN unit IN ('y','yr','year','years') THEN date_trunc('month', {now}) - to_years(amount::INTEGER) + to_days(19)
  WHEN regexp_matches(v, '^\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}$') THEN try_cast(replace(v, '/', '-') AS TIMESTAMP) END""".format(now=NOW)

TERMS = f"""x AS (SELECT search_id, regexp_extract_all(search_text, {lit(TERM)}) AS r FROM s),
  y AS (SELECT search_id, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS term_no FROM x),
  z AS (SELECT search_id, term_no, length(raw) > 1 AND raw LIKE '-%' AS neg,
    CASE WHEN length(raw) > 1 AND raw LIKE '-%' THEN substr(raw, 2) ELSE raw END AS body FROM y),
  q AS (SELECT *, lower(regexp_extract(body, '^([A-Za-z_]\\w*):', 1)) AS field, regexp_replace(body, '^[A-Za-z_]\\w*:', '') AS given,
    regexp_matches(body, '^(?:[A-Za-z_]\\w*:)?"[^"]*\\z') AS open FROM z),
  r1 AS (SELECT *, given LIKE '"%' AS quoted, {strip("replace(given, chr(34), '')")} AS v FROM q),
  r2 AS (SELECT *, lower(v) AS lv, CASE WHEN open THEN 'error' WHEN field IN ('','subject','sender','from','recipient','to','snippet','body') THEN 'text'
    WHEN field IN ('unread','read','flagged','starred','attachments','attachment') THEN 'flag'
    WHEN field IN ('after','since','newer','newer_than','before','until','older','older_than') THEN 'date'
    WHEN field IN ('in','folder') THEN 'folder' ELSE 'error' END AS kind,
    try_cast(regexp_extract(v, '^([0-9]+)\\s*[A-Za-z]+$', 1) AS BIGINT) AS amount, lower(regexp_extract(v, '^[0-9]+\\s*([A-Za-z]+)$', 1)) AS unit
    FROM r1 WHERE field <> '' OR v <> '' OR open),
  r3 AS (SELECT *, CASE WHEN kind = 'date' THEN {UNITS} END AS cutoff_ts FROM r2),
  r4 AS (SELECT *, CASE WHEN open THEN 'unterminated quote in query' WHEN kind = 'error' THEN 'unknown field: "' || field || '"'
    WHEN kind = 'text' AND v = '' THEN 'field "' || field || '" requires a value'
    WHEN kind = 'flag' AND lv NOT IN {words(TRUE_WORDS + FALSE_WORDS)} THEN field || ': invalid boolean value "' || v || '"'
    WHEN kind = 'date' AND v = '' THEN field || ': requires a date or duration value'
    WHEN kind = 'date' AND cutoff_ts IS NULL THEN field || ': invalid date or duration "' || v || '"'
    WHEN kind = 'folder' AND v = '' THEN field || ' requires a folder (inbox, sent, drafts, trash, spam)'
    WHEN kind = 'folder' AND lv NOT IN ('inbox','sent','drafts','trash','spam')
      THEN 'unknown folder "' || lv || '" (want inbox, sent, drafts, trash, spam)' END AS error,
    NOT quoted AND length(v) > 1 AND v LIKE '%*' AS star FROM r3),
  terms AS (SELECT search_id, term_no, kind, neg AND kind IN ('text', 'folder') AS negated,
    CASE WHEN error IS NULL AND kind = 'text' THEN CASE field WHEN 'subject' THEN 1 WHEN 'sender' THEN 6 WHEN 'from' THEN 6 WHEN 'recipient' THEN 8
      WHEN 'to' THEN 8 WHEN 'snippet' THEN 16 WHEN 'body' THEN 32 ELSE 63 END END::BIGINT AS columns,
    CASE WHEN error IS NULL AND kind = 'text' THEN trim(replace({pad("v")}, '  ', ' ')) END AS phrase,
    coalesce(error IS NULL AND kind = 'text' AND star, false) AS prefix,
    CASE WHEN error IS NULL AND kind = 'flag' THEN CASE WHEN field IN ('unread','read') THEN 'is_read'
      WHEN field IN ('flagged','starred') THEN 'is_flagged' ELSE 'has_attachments' END END AS flag_column,
    CASE WHEN error IS NULL AND kind = 'flag' THEN CASE WHEN ((lv IN {words(TRUE_WORDS)}) <> neg) <> (field = 'unread') THEN 1 ELSE 0 END
      END::BIGINT AS flag_value,
    CASE WHEN error IS NULL AND kind = 'date' THEN CASE WHEN (field IN ('after','since','newer','newer_than')) <> neg THEN '>=' ELSE '<' END END AS date_op,
    CASE WHEN error IS NULL THEN cutoff_ts END AS cutoff_ts, CASE WHEN error IS NULL AND kind = 'folder' THEN lv END AS folder, error FROM r4)"""
SQL["saved_terms"] = f"""WITH {searches('documents', 'doc_id')}, {TERMS} SELECT search_id, term_no, kind, negated, columns, phrase, prefix,
  flag_column, flag_value, date_op, strftime(cutoff_ts, '%Y-%m-%d %H:%M:%S') AS cutoff, folder, error FROM terms"""

HOLDS = " OR ".join(
    f"(columns & {bit} <> 0 AND contains(p_{c}, ' ' || replace(phrase, ' ', '  ') || CASE WHEN prefix THEN '' ELSE ' ' END))"
    for bit, c in ((2**k, c) for k, c in enumerate(TEXT_COLUMNS))
)
MATCHES = f"""{WITH}, {searches('benchmark', 'item_id')}, {TERMS},
  tokf AS (SELECT tok.*, f.type AS ftype FROM tok LEFT JOIN f ON f.id = tok.folder_id),
  sat AS (SELECT search_id, rowid, count(*) AS held FROM terms, tokf WHERE CASE kind
      WHEN 'text' THEN (phrase <> '' AND ({HOLDS})) <> negated
      WHEN 'flag' THEN CASE flag_column WHEN 'is_read' THEN is_read WHEN 'is_flagged' THEN is_flagged ELSE has_attachments END = flag_value
      WHEN 'date' THEN CASE WHEN date_op = '>=' THEN ts >= cutoff_ts ELSE ts < cutoff_ts END
      WHEN 'folder' THEN (coalesce(ftype, '') = folder) <> negated ELSE false END GROUP BY 1, 2),
  need AS (SELECT s.search_id, count(t.term_no) AS terms, count(t.error) AS errors FROM s LEFT JOIN terms t USING (search_id) GROUP BY 1),
  hits AS (SELECT need.search_id, m.rowid FROM need CROSS JOIN m LEFT JOIN sat ON sat.search_id = need.search_id AND sat.rowid = m.rowid
    WHERE errors = 0 AND coalesce(held, 0) = need.terms)"""
SQL["saved_matches"] = f"{MATCHES} SELECT search_id, rowid FROM hits"
SQL["saved_matches_rarest"] = SQL["saved_matches"]
SQL["saved_hit_counts"] = f"""{MATCHES}, n AS (SELECT s.search_id, count(h.rowid) AS hits FROM s LEFT JOIN hits h USING (search_id) GROUP BY 1)
  SELECT search_id, hits, CASE WHEN hits = 1 THEN '1 message' ELSE hits || ' messages' END AS shown FROM n"""


# --- streams ------------------------------------------------------------------------------------------


def watch(hits: str, known: bool = False, newest: int = 0, window: int = 0) -> str:
    """Batch 0 holds even rows, batch 1 odd rows and every sixth row again with its read mark changed."""
    top = f"QUALIFY row_number() OVER (PARTITION BY batch ORDER BY date DESC, id DESC) <= {newest}" if newest else ""
    looked = f"QUALIFY row_number() OVER (PARTITION BY batch ORDER BY date DESC, id DESC) <= {window}" if window else ""
    return f"""{WITH}, b AS (SELECT rowid % 2 AS batch, * FROM tok UNION ALL
      SELECT 1, * REPLACE (1 - is_read AS is_read) FROM tok WHERE rowid % 6 = 0),
    h AS (SELECT * FROM b WHERE {hits} {looked}),
    fresh AS (SELECT * FROM h WHERE (batch = 0 OR id NOT IN (SELECT id FROM h WHERE batch = 0)) {'AND batch = 1' if known else ''}),
    e AS (SELECT * FROM fresh {top})"""


SQL["watch_fresh"] = watch("is_read = 0") + " SELECT batch, id FROM e"
SQL["watch_fire_existing"] = watch("true") + f" SELECT batch, id, CASE WHEN is_read = 0 THEN '1' ELSE '0' END AS unread FROM e"
SQL["watch_baseline"] = watch("is_read = 0", known=True) + " SELECT batch, id FROM e"
SQL["watch_silent"] = SQL["watch_baseline"]
SQL["watch_query"] = watch(f"{has(' the ', ('subject',))} AND NOT {IN.format('spam')}") + " SELECT batch, id FROM e"
SQL["watch_capped"] = watch("is_read = 0", newest=7) + " SELECT batch, id FROM e"
SQL["watch_window"] = watch("is_read = 0", window=20) + " SELECT batch, id FROM e"
SQL["watch_events"] = (
    watch("has_attachments = 1")
    + f" SELECT batch, 'new-message' AS name, 'attachments:' AS query, 'mail' AS source, id, {MARKS}, {payload(False)} AS payload FROM e"
)


# --- synthetic mailboxes ------------------------------------------------------------------------------


def chance(row: str, purpose: str) -> str:
    return f"(('0x' || substr(md5('7:' || {row} || ':{purpose}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def pick(row: str, purpose: str, values: tuple[str, ...]) -> str:
    return f"([{', '.join(values)}])[floor({chance(row, purpose)} * {len(values)})::BIGINT + 1]"


POOLS = Pools()
PEOPLE = tuple(f"struct_pack(name := {lit(n)}, address := {lit(a)})" for n, a in POOLS.people)
SENDERS = PEOPLE + tuple(f"struct_pack(name := {lit(n)}, address := {lit(a)})" for n, a in POOLS.others)
ME = f"struct_pack(name := {lit(POOLS.me[0])}, address := {lit(POOLS.me[1])})"

PLAN = f"""{WITH}, bf AS ({BY_FOLDER}),
  pf AS (SELECT row_number() OVER (ORDER BY messages DESC, folder_id) - 1 AS pos, CASE WHEN folder_id = 'f-all' THEN 'archive' ELSE type END AS kind,
    messages, unread FROM bf),
  plan AS (SELECT printf('f-%03d', pos) AS id, pos, kind, messages, unread,
    coalesce(sum(messages) OVER (ORDER BY kind = 'archive', pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row FROM pf)"""
MADE = f"""{PLAN},
  st AS (SELECT count(*) AS total, count(DISTINCT nullif(message_id, '')) AS ids, min(date)::TIMESTAMP AS d0, max(date)::TIMESTAMP AS d1,
    sum(is_flagged) AS flagged, sum(has_attachments) AS att, count(*) FILTER (coalesce(body_html, '') <> '') AS html,
    count(*) FILTER (coalesce(body_text, '') <> '') AS txt FROM m),
  pool AS (SELECT sum(messages) FILTER (kind <> 'archive')::BIGINT AS n, sum(messages) FILTER (kind = 'archive')::BIGINT AS arch FROM plan),
  g AS (SELECT first_row + i AS rowid, id AS folder_id, kind AS own, (i > unread)::INTEGER AS is_read
    FROM plan, unnest(range(1, messages + 1)) AS u(i)),
  g1 AS (SELECT g.*, st.*, CASE WHEN own = 'archive' AND {chance('g.rowid', 'copy')} < least((total - ids) / arch::DOUBLE, 1)
      THEN floor({chance('g.rowid', 'origin')} * n)::BIGINT + 1 ELSE g.rowid END AS src FROM g, st, pool),
  g2 AS (SELECT g1.*, CASE WHEN src = rowid THEN own ELSE (SELECT kind FROM plan p WHERE p.first_row < src AND src <= p.first_row + p.messages) END AS kind FROM g1),
  g3 AS (SELECT *, CASE WHEN kind IN ('sent', 'drafts') THEN {ME} ELSE {pick('src', 'sender', SENDERS)} END AS frm,
      CASE WHEN kind IN ('sent', 'drafts') THEN {pick('src', 'recipient', PEOPLE)} ELSE {ME} END AS rcpt,
      replace({pick('src', 'subject', tuple(lit(s) for s in POOLS.subjects))}, '%d', (floor({chance('src', 'number')} * 9000)::BIGINT + 1000)::VARCHAR) AS subject,
      {pick('src', 'body', tuple(lit(s) for s in POOLS.bodies))} AS text FROM g2),
  made AS (SELECT printf('msg-%06d', rowid) AS id, folder_id, printf('<gen-%06d@example.com>', src) AS message_id, frm.address AS from_address,
    '[{{"name":' || to_json(rcpt.name) || ',"address":' || to_json(rcpt.address) || '}}]' AS to_addresses, subject, {snip('text')} AS snippet,
    CASE WHEN {chance('src', 'text')} < txt / total::DOUBLE THEN text END AS body_text, {chance('src', 'html')} < html / total::DOUBLE AS has_html,
    strftime(d0 + to_seconds(floor({chance('src', 'date')} * (epoch(d1) - epoch(d0)))::BIGINT), '%Y-%m-%d %H:%M:%S') AS date, is_read,
    ({chance('src', 'flagged')} < flagged / total::DOUBLE)::INTEGER AS is_flagged,
    ({chance('src', 'attachments')} < att / total::DOUBLE)::INTEGER AS has_attachments, (kind = 'drafts')::INTEGER AS is_draft FROM g3)"""
LABEL = """CASE kind WHEN 'inbox' THEN 'INBOX' WHEN 'sent' THEN 'Sent' WHEN 'drafts' THEN 'Drafts' WHEN 'trash' THEN 'Trash'
  WHEN 'spam' THEN 'Spam' WHEN 'archive' THEN 'All Mail' ELSE """
SQL["synth_folders"] = f"""{PLAN} SELECT id, 'acc-1' AS account_id, {LABEL} 'Folder ' || pos END AS name, {LABEL} 'Folder/' || pos END AS path,
  CASE kind WHEN 'archive' THEN 'custom' WHEN '(null)' THEN NULL ELSE kind END AS type FROM plan"""
SQL["synth_counts"] = f"{PLAN} SELECT id AS folder_id, messages, unread, first_row + 1 AS first_row FROM plan WHERE messages > 0"
SQL["synth_messages"] = f"{MADE} SELECT * FROM made"
SQL["synth_dups"] = f"{MADE} SELECT message_id, count(*) AS copies, min(id) AS first_id FROM made GROUP BY 1"
