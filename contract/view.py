"""The mailbox the driver's tables are read as: documents are messages, labels are flags, pages are HTML."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.functions.display import snippet
from mailspark.operators.postings import Postings, read_postings, write_postings
from mailspark.scratch import scratch_dir

NOW = datetime(2024, 1, 20)

FOLDER_ROWS = [
    ("f-inbox", "INBOX", "inbox"),
    ("f-sent", "Sent", "sent"),
    ("f-trash", "Trash", "trash"),
    ("f-spam", "Spam", "spam"),
    ("f-drafts", "Drafts", "drafts"),
    ("f-all", "All Mail", "custom"),
    ("f-none", "My Drafts", None),
    ("f-empty", "Empty", "custom"),
]

# side table -> driver table; "settings" is left out on purpose, missing tables are skipped
SIDE = {
    "contacts": "customer",
    "blocked_senders": "supplier",
    "trusted_senders": "part",
    "sender_stats": "orders",
    "trust_activity_log": "events",
    "outbox_messages": "conversations",
    "deferred_sync_queue": "lineitem",
    "search_history": "benchmark",
    "inbox_rules": "nation",
    "aliases": "labels",
    "account_canonical_folders": "region",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folders(spark: SparkSession, archive: bool = False) -> DataFrame:
    rows = [(i, n, "archive" if archive and i == "f-all" else t) for i, n, t in FOLDER_ROWS]
    values = ", ".join(f"('{i}', '{n}', " + (f"'{t}')" if t else "NULL)") for i, n, t in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS folders(id, name, type)")


def two_mailboxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages and folders of two mailboxes that use the same row, folder and message ids; in the second, spam is another folder."""
    mail, box = messages(spark, sf_dir), folders(spark)
    second = mail.filter("rowid % 7 <> 3").withColumn("is_read", F.when(F.col("rowid") % 3 == 0, 0).otherwise(F.col("is_read")))
    other = F.when(F.col("id") == "f-spam", "custom").when(F.col("id") == "f-all", "spam").otherwise(F.col("type"))
    both = [(mail, box), (second, box.withColumn("type", other))]
    (m1, f1), (m2, f2) = [[t.withColumn("mailbox", F.lit(name)) for t in pair] for name, pair in zip(("one", "two"), both)]
    return m1.unionByName(m2), f1.unionByName(f2)


def messages(spark: SparkSession, sf_dir: str, flags: bool = True, html: bool = False) -> DataFrame:
    """Messages with only the joins a query needs: ``flags`` brings in labels, ``html`` pages."""
    d = table(spark, sf_dir, "documents")
    if flags:
        d = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    if html:
        pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
        d = d.join(pages, "doc_id", "left")
    n = F.col("doc_id")
    per = lambda k, r=0: n % k == r
    number = lambda x: x.cast("string")
    folder = F.when(per(10, 4), "f-none").when(per(10, 5), "f-sent").when(per(10, 6), "f-trash").when(per(10, 7), "f-spam")
    folder = folder.when(per(10, 8), "f-drafts").when(per(10, 9), "f-all").otherwise("f-inbox")
    identity = F.when(per(17), F.lit(None)).when(per(19), "").otherwise(F.concat(F.lit("<"), F.md5("text"), F.lit("@x>")))
    thread = F.when(per(23), F.lit(None)).when(per(29, 1), "")
    thread = thread.otherwise(F.concat(F.lit("<t"), number(F.floor(n / 4)), F.lit(">")))
    user = number(n % 40)
    to = F.concat(F.lit('[{"name":"User '), user, F.lit('","address":"u'), user, F.lit('@example.com"}]'))
    cc = F.concat(F.lit('[{"name":"Team '), user, F.lit('","address":"team@x.example"},{"address":"c'), user, F.lit('@x.example"}]'))
    ts = F.timestamp_seconds(F.lit(1704067200) + n * 3600)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(n / 24).cast("int"))
    columns = {
        "rowid": n,
        "id": F.format_string("msg-%06d", n),
        "account_id": F.concat(F.lit("acc-"), "lang"),
        "folder_id": folder,
        "message_id": identity,
        "thread_id": thread,
        "from_address": F.concat("source", F.lit("@"), "lang", F.lit(".example")),
        "from_name": F.when(~per(13), F.concat(F.lit("Sender "), "source")),
        "to_addresses": to,
        "cc_addresses": F.when(per(3), cc),
        "bcc_addresses": F.when(per(11), "n/a").when(per(7), "[]"),
        "subject": F.when(~per(37, 5), F.substring(F.substring_index("text", "\n", 1), 1, 60)),
        "snippet": snippet(F.col("text")),
        "body_text": F.when(~per(29), F.col("text")),
        "body_html": F.col("html") if html else None,
        "ts": ts,
        "date": F.concat(day.cast("string"), F.lit(" "), F.lpad((n % 24).cast("string"), 2, "0"), F.lit(":00:00")),
        "is_read": F.coalesce("quality", F.lit(0)) if flags else None,
        "is_flagged": F.coalesce("toxic", F.lit(0)) if flags else None,
        "has_attachments": (F.col("n_chars") % 7 == 0).cast("int"),
        "is_draft": per(10, 8).cast("int"),
        "uid": n,
    }
    return d.select(*[c.alias(k) for k, c in columns.items() if c is not None])


def stored_index(spark: SparkSession, sf_dir: str) -> Postings:
    """The text index of the mailbox, written for the query that asks: what a query costs and finds does not depend on those before it."""
    path = scratch_dir(spark, "postings")
    write_postings(messages(spark, sf_dir, flags=False), path)
    return read_postings(spark, path)


def last_words(text: str = "text") -> tuple:
    """The pair of neighbouring words of the whole text that sorts last."""
    pair = r"(\p{L}+)[^\p{L}]+(\p{L}+)"
    last = F.coalesce(F.array_max(F.regexp_extract_all(text, F.lit(pair), F.lit(0))), F.lit(""))
    return F.regexp_extract(last, pair, 1), F.regexp_extract(last, pair, 2)


def saved_searches(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A search string made from two words of every row of a table, covering every term kind and error."""
    a, b = last_words()
    shapes = [
        F.concat_ws(" ", a, b),
        F.concat(F.lit("subject:"), a, F.lit(" unread:")),
        F.concat(F.lit("-"), a),
        F.concat(F.lit('"'), a, F.lit(" "), b, F.lit('" -in:trash')),
        F.concat(F.lit("from:src"), (F.col(key) % 20).cast("string"), F.lit("  -Flagged:no")),
        F.lit("in:inbox newer:10d"),
        F.lit("in:SPAM"),
        F.concat(F.lit('body:"'), a, F.lit(" "), b, F.lit('" older:1w')),
        F.concat(F.substring(a, 1, 2), F.lit("* read:true")),
        F.concat(F.lit("snippet:"), a, F.lit(" -flagged:true")),
        F.lit("after:2024-01-05 before:2024-01-20"),
        F.concat(F.lit("foo:"), a),
        F.lit("unread:maybe older:"),
        F.lit("after:soon subject:\"\""),
        F.lit("in:archive folder:"),
        F.concat(F.lit('subject:"'), a),
        F.concat(F.lit('to:u'), (F.col(key) % 40).cast("string"), F.lit(" -in:drafts -in:spam")),
        F.lit("unread: attachments: newer_than:1month"),
        F.lit('12:30 "" -unread:false'),
        F.lit(""),
    ]
    shape = F.element_at(F.array(*shapes), (F.col(key) % len(shapes) + 1).cast("int"))
    return table(spark, sf_dir, name).select(F.col(key).alias("search_id"), shape.alias("search_text"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One settings row per customer's mailbox; some without a version, some with an odd one."""
    n = F.col("c_custkey")
    value = F.when(n % 5 == 0, " 13 ").when(n % 5 == 1, "13").when(n % 5 == 2, "12").when(n % 5 == 3, "x13").otherwise("14")
    key = F.when(n % 7 == 0, "theme").otherwise("schema_version")
    return table(spark, sf_dir, "customer").select(n.alias("mailbox"), key.alias("key"), value.alias("value"))


def profile_tables(spark: SparkSession, sf_dir: str, archive: bool = False) -> dict[str, DataFrame]:
    tables = {name: table(spark, sf_dir, source) for name, source in SIDE.items()}
    regions = table(spark, sf_dir, "region")
    tables["settings"] = regions.select(
        F.when(F.col("r_regionkey") == 0, "schema_version").otherwise(F.col("r_name")).alias("key"), F.lit("13").alias("value")
    )
    path = scratch_dir(spark, "mail")
    messages(spark, sf_dir, html=True).write.parquet(path)
    mail = spark.read.parquet(path)
    tables |= {"messages": mail, "folders": folders(spark, archive), "accounts": mail.select(F.col("account_id").alias("id")).distinct()}
    return tables


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates and deletes of messages made from the documents; some rows change more than once."""
    mail = messages(spark, sf_dir)
    first = mail.filter(F.col("rowid") % 3 == 0).select(
        F.lit("update").alias("op"), (F.col("rowid") * 4 + 1).alias("seq"), "*"
    ).withColumn("subject", F.concat(F.lit("Changed "), F.col("id")))
    second = mail.filter(F.col("rowid") % 6 == 0).select(
        F.lit("update").alias("op"), (F.col("rowid") * 4 + 2).alias("seq"), "*"
    ).withColumn("from_name", F.lit("Last Writer"))
    gone = mail.filter(F.col("rowid") % 5 == 1).select(F.lit("delete").alias("op"), (F.col("rowid") * 4 + 3).alias("seq"), "*")
    added = mail.filter(F.col("rowid") % 4 == 2).select(
        F.lit("insert").alias("op"), (F.col("rowid") * 4).alias("seq"), "*"
    ).withColumn("rowid", F.col("rowid") + 1000000000)
    return first.unionByName(second).unionByName(gone).unionByName(added)


def read_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One insert, delete or read-mark update per message, in row order."""
    mail = messages(spark, sf_dir)
    kind = F.col("rowid") % 4
    op = F.when(kind == 0, "insert").when(kind == 1, "delete").otherwise("update")
    return mail.select(
        F.col("rowid").alias("seq"),
        op.alias("op"),
        "folder_id",
        "is_draft",
        F.when(kind == 2, 1 - F.col("is_read")).when(kind != 0, F.col("is_read")).alias("old_is_read"),
        "is_read",
    )
