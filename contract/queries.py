"""The registered queries, one per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import view as V
from mailspark.functions import bodies, dates, display
from mailspark.operators import counters, events, index, postings, profile, rank, rollup
from mailspark.operators import search as S
from mailspark.operators.terms import before, flag, folder, since, text
from mailspark.plans import saved, synth
from mailspark.schemas import schema_status
from mailspark.scratch import scratch_dir
from mailspark.sources import mailbox
from mailspark.streaming import upkeep, watch

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


def found(*terms, **options) -> Query:
    """All list rows matching the terms."""
    def build(spark: SparkSession, sf: str) -> DataFrame:
        mail = V.messages(spark, sf, **options)
        return S.list_rows(S.filtered(mail, terms, V.folders(spark), V.NOW))

    return build


def looked_up(*terms) -> Query:
    """The same rows out of the stored index."""
    def build(spark: SparkSession, sf: str) -> DataFrame:
        mail = V.messages(spark, sf)
        return S.list_rows(S.filtered_stored(V.stored_index(spark, sf), mail, terms, V.folders(spark), V.NOW))

    return build


def viewed(*terms, **options) -> Query:
    """All list rows of the mailbox view."""
    def build(spark: SparkSession, sf: str) -> DataFrame:
        view = S.search_view(V.messages(spark, sf), V.folders(spark), terms, now=V.NOW, limit=0, **options)
        return view.drop("score")

    return build


REGISTRY |= {
    "list_rows": found(),
    "text_any_column": looked_up(text("the")),
    "text_subject": looked_up(text("the", field="subject")),
    "text_sender": looked_up(text("src1", field="sender")),
    "text_recipient": looked_up(text("u7@example.com", field="to")),
    "text_body": looked_up(text("of", field="body")),
    "text_phrase": looked_up(text("of the", phrase=True)),
    "text_prefix": looked_up(text("th*", field="snippet")),
    "text_and_flag": looked_up(text("the"), text("que"), flag("flagged", False)),
    "text_minus_text": looked_up(text("the"), ~text("of the"), ~text("src3", field="from")),
    "text_only_negated": looked_up(~text("the"), ~text("que")),
    "scan_text_any_column": found(text("the")),
    "scan_text_minus_text": found(text("the"), ~text("of the"), ~text("src3", field="from")),
    "flag_unread": found(flag("unread")),
    "flag_flagged_attach": found(flag("starred"), ~flag("attachment", False)),
    "date_range": found(since("2024-01-05"), before("2024-01-07 12:30")),
    "date_relative": found(since("1month"), ~since("36h")),
    "date_absolute": found(since("2024/01/03"), ~since("2024-01-09T06:00:01")),
    "folder_in": found(folder("sent")),
    "folder_not_in": found(~folder("trash"), ~folder("spam")),
    "search_view": viewed(),
    "search_view_with_spam": viewed(include_spam=True),
    "view_in_spam": viewed(folder("spam")),
    "view_not_in_spam": viewed(~folder("spam"), text("the")),
    "view_in_inbox": viewed(folder("inbox")),
}


@query
def scan_messages(spark, sf):
    path = scratch_dir(spark, "mail")
    mailbox.write_indexed(V.messages(spark, sf), path)
    stored = mailbox.read_indexed(spark, path)
    return stored.select("rowid", "id", "folder_id", "subject", "date", "month", "is_read", "doc_len")


@query
def search_text(spark, sf):
    return index.search_text(V.messages(spark, sf, flags=False))


@query
def token_stats(spark, sf):
    return index.token_stats(V.messages(spark, sf, flags=False))


@query
def search_text_after_changes(spark, sf):
    current = index.search_text(V.messages(spark, sf, flags=False))
    changed = V.changes(spark, sf)
    texts = changed.select("op", "seq", "rowid", *[index.text_column(changed, c).alias(c) for c in index.TEXT_COLUMNS])
    return index.apply_changes(current, texts)


@query
def index_after_changes(spark, sf):
    """The stored index after the same changes have come in as a stream."""
    base = scratch_dir(spark, "upkeep")
    changed = V.changes(spark, sf)
    upkeep.write_buckets(index.index_table(V.messages(spark, sf, flags=False)), f"{base}/index")
    changed.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(changed.schema).parquet(f"{base}/in")
    upkeep.follow_changes(stream, f"{base}/index", f"{base}/state").awaitTermination()
    return upkeep.read_buckets(spark, f"{base}/index").select("rowid", "pad_subject", "pad_from_name", "doc_len")


@query
def result_json(spark, sf):
    newest = S.search(V.messages(spark, sf), [flag("unread")], columns=("id", "date", "is_read", "subject"))
    return events.result_json(newest, S.NEWEST, 50)


@query
def event_payload(spark, sf):
    return events.to_events(V.messages(spark, sf, html=True), "unread:", "mail").select(
        "name", "query", "source", "id", "unread", "flagged", "attachments", "payload"
    )


@query
def event_roundtrip(spark, sf):
    sent = events.to_events(V.messages(spark, sf), "unread:", "mail")
    message = F.col("message")
    return events.decode_events(sent).select(
        "name", "query", *[message[c].alias(c) for c in ("id", "date", "is_read", "has_attachments", "subject", "body_text")]
    )


@query
def schema_gate(spark, sf):
    return schema_status(V.settings(spark, sf), by="mailbox")


@query
def load_message(spark, sf):
    wanted = V.table(spark, sf, "labels").filter("toxic = 1").select(F.format_string("msg-%06d", "doc_id").alias("id"))
    return S.load(V.messages(spark, sf, html=True), wanted)


@query
def date_unreadable(spark, sf):
    """Rows with an unreadable date fail both date filters and are still listed."""
    mail = V.messages(spark, sf).drop("ts")
    mail = mail.withColumn("date", F.when(F.col("has_attachments") == 1, "no date").otherwise(F.replace("date", F.lit(" "), F.lit("T"))))
    mail = mailbox.with_instant(mail)
    early = S.filtered(mail, [before("2024-01-10")]).select("id", F.lit("before").alias("list"))
    late = S.filtered(mail, [since("2024-01-10")]).select("id", F.lit("since").alias("list"))
    return early.unionByName(late).unionByName(S.filtered(mail, []).select("id", F.lit("all").alias("list")))


@query
def search_all(spark, sf):
    return S.search(V.messages(spark, sf))


@query
def search_joined(spark, sf):
    """Token table kept apart from the messages and joined by row id."""
    mail = V.messages(spark, sf)
    tokens = index.index_table(V.messages(spark, sf, flags=False))
    joined = mail.join(tokens, "rowid")
    return S.list_rows(S.filtered(joined, [text("the"), text("que*"), flag("unread")]))


@query
def view_hide_spam(spark, sf):
    return S.list_rows(S.hide_spam(V.messages(spark, sf), V.folders(spark)))


@query
def view_dedup(spark, sf):
    return S.list_rows(S.dedup(V.messages(spark, sf)))


@query
def dup_representatives(spark, sf):
    return S.dup_representatives(V.messages(spark, sf, flags=False))


@query
def corpus_stats(spark, sf):
    terms = [text("the"), text("of the"), text("th*", field="subject")]
    stats = rank.corpus_stats(index.with_index(V.messages(spark, sf, flags=False)), terms)
    return stats.withColumn("mean_len", F.round("mean_len", 6))


def _ranked(spark, sf, terms, **options):
    page = S.search_stored(V.stored_index(spark, sf), V.messages(spark, sf), terms, now=V.NOW, **options)
    numbered = S.with_position(page, S.BEST, options["limit"], options.get("offset", 0))
    return numbered.select("position", "id", "subject", F.round("score", 6).alias("score"))


@query
def search_ranked(spark, sf):
    return _ranked(spark, sf, [text("of the"), text("and"), flag("unread")], limit=50)


@query
def search_ranked_column(spark, sf):
    return _ranked(spark, sf, [text("th*", field="subject"), text("the the"), ~text("que")], limit=40, offset=5)


@query
def search_scores(spark, sf):
    """Scores of every hit, no limit."""
    hits = postings.ranked_rows(V.stored_index(spark, sf), [text("the"), text("of the", field="body")])
    return hits.select(F.format_string("msg-%06d", "rowid").alias("id"), F.round("score", 6).alias("score"))


@query
def scan_scores(spark, sf):
    """The same scores without a stored index."""
    mail = index.with_index(V.messages(spark, sf, flags=False))
    terms = [text("the"), text("of the", field="body")]
    hits = S.filtered(mail, terms)
    return hits.select("id", F.round(rank.bm25(hits, terms, rank.corpus_stats(mail, terms)), 6).alias("score"))


@query
def kept_totals(spark, sf):
    """Corpus totals and document frequencies that the index keeps."""
    stored = V.stored_index(spark, sf)
    counts = [postings.holding(stored, t).scalar().alias(f"hits_{i}") for i, t in enumerate((text("the"), text("of the"), text("th*", field="subject")))]
    return postings.corpus_totals(stored).select("messages", F.round("mean_len", 6).alias("mean_len"), *counts)


@query
def token_frequencies(spark, sf):
    """Messages holding each token, as kept."""
    kept = V.stored_index(spark, sf).tokens
    return kept.groupBy("token").agg(F.sum("holding").alias("holding"))


def _changed_index(spark, sf):
    """The index after the changes have come in two batches, later ones first for some rows."""
    path = scratch_dir(spark, "postings")
    postings.write_postings(V.messages(spark, sf, flags=False), path)
    changed = V.changes(spark, sf)
    for some in (changed.filter("seq % 4 <> 1"), changed.filter("seq % 4 <= 1")):
        postings.add_changes(spark, path, some)
    return path


def _scores(stored):
    found = postings.ranked_rows(stored, [text("the"), ~text("que", field="subject")])
    return found.select("rowid", F.round("score", 6).alias("score"))


@query
def postings_after_changes(spark, sf):
    return _scores(postings.read_postings(spark, _changed_index(spark, sf)))


@query
def postings_compacted(spark, sf):
    path = _changed_index(spark, sf)
    postings.compact(spark, path)
    return _scores(postings.read_postings(spark, path))


@query
def postings_stream(spark, sf):
    """The index after the changes have come in as a stream."""
    base = scratch_dir(spark, "follow")
    postings.write_postings(V.messages(spark, sf, flags=False), f"{base}/index")
    changed = V.changes(spark, sf)
    changed.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(changed.schema).parquet(f"{base}/in")
    upkeep.follow_postings(stream, f"{base}/index", f"{base}/state").awaitTermination()
    return _scores(postings.read_postings(spark, f"{base}/index"))


@query
def search_skipping(spark, sf):
    """The best few of very many hits; blocks that cannot hold one of them are skipped."""
    return _ranked(spark, sf, [text("the")], limit=10)

@query
def search_limit(spark, sf):
    return S.search(V.messages(spark, sf), limit=25)


@query
def search_page(spark, sf):
    return S.search(V.messages(spark, sf), [flag("unread")], limit=30, offset=60)


@query
def search_offset(spark, sf):
    return S.search(V.messages(spark, sf), limit=0, offset=100)


@query
def search_offset_deep(spark, sf):
    """Rows after the first half, the place found by counting."""
    rows = S.list_rows(V.messages(spark, sf))
    return S.skip(rows, S.NEWEST, rows.count() // 2, block=100)


@query
def view_two_mailboxes(spark, sf):
    mail, folders = V.two_mailboxes(spark, sf)
    return S.search_view(mail, folders, columns=("mailbox", "id", "subject"))


@query
def hide_spam_two_mailboxes(spark, sf):
    mail, folders = V.two_mailboxes(spark, sf)
    return S.hide_spam(mail, folders).select("mailbox", "id")


@query
def folders_two_mailboxes(spark, sf):
    mail, folders = V.two_mailboxes(spark, sf)
    return S.search(mail, [folder("spam")], folders=folders, columns=("mailbox", "id"))


@query
def unread_two_mailboxes(spark, sf):
    return counters.folder_unread(*V.two_mailboxes(spark, sf))


@query
def profile_two_mailboxes(spark, sf):
    return profile.folder_profile(*V.two_mailboxes(spark, sf))


@query
def search_keyset_page(spark, sf):
    rows = S.list_rows(V.messages(spark, sf))
    return S.keyset_page(rows, 40, ("2024-01-08 00:00:00", "msg-000168"))


@query
def profile_messages(spark, sf):
    return profile.profile_messages(V.messages(spark, sf, html=True))


@query
def profile_distinct(spark, sf):
    return profile.profile_distinct(V.messages(spark, sf, flags=False))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def profile_lengths(spark, sf):
    return _rounded(profile.profile_lengths(V.messages(spark, sf, flags=False)))


@query
def profile_recipients(spark, sf):
    return _rounded(profile.profile_recipients(V.messages(spark, sf, flags=False)))


@query
def folder_profile(spark, sf):
    return profile.folder_profile(V.messages(spark, sf), V.folders(spark))


@query
def per_month(spark, sf):
    return profile.per_month(V.messages(spark, sf, flags=False))


@query
def table_rows(spark, sf):
    return profile.table_rows({name: V.table(spark, sf, source) for name, source in V.SIDE.items()})


@query
def profile_document(spark, sf):
    """The profile document written and read back, flattened to the fields a check can compare."""
    path = scratch_dir(spark, "profile")
    synth.write_profile(profile.profile_document(V.profile_tables(spark, sf)), path)
    p = synth.read_profile(spark, path)
    m = F.col("messages")
    return p.select(
        F.col("schema_version").cast("long").alias("schema_version"),
        "accounts",
        F.to_json("folders").alias("folders"),
        *[m[c].alias(c) for c in ("total", "distinct_message_id", "first_date", "last_date", "unread", "with_html")],
        F.to_json(m["per_month"]).alias("per_month"),
        F.round(m["subject_len"]["avg"], 6).alias("subject_avg"),
        F.round(m["recipients"]["cc_avg"], 6).alias("cc_avg"),
        F.to_json("table_rows").alias("table_rows"),
    )


def _rollup(spark, sf):
    """A stored rollup of the even rows, merged with one of the odd rows."""
    path = scratch_dir(spark, "rollup")
    mail = V.messages(spark, sf, html=True)
    halves = [rollup.mailbox_rollup(mail.filter(F.col("rowid") % 2 == n)) for n in (0, 1)]
    for n, half in enumerate(halves):
        rollup.write_rollup(half, f"{path}/{n}")
    return rollup.merge_rollups(*[spark.read.parquet(f"{path}/{n}") for n in (0, 1)])


@query
def profile_rollup(spark, sf):
    cells = _rollup(spark, sf)
    return cells.select("folder_id", "month", *[F.col(c).cast("long").alias(c) for c in rollup.SUMS], *rollup.LEAST, *rollup.MOST)


@query
def profile_rollup_totals(spark, sf):
    return _rounded(rollup.totals(_rollup(spark, sf)).drop(*rollup.DISTINCT))


@query
def profile_sketches(spark, sf):
    """Exact distinct counts by folder, and whether the merged sketches come within 3 % (or one value) of them."""
    estimates = rollup.totals(_rollup(spark, sf), "folder_id").select("folder_id", *rollup.DISTINCT)
    mail = V.messages(spark, sf, flags=False).withColumnsRenamed({"folder_id": "folder"})
    exact = mail.groupBy("folder").agg(
        F.count_distinct(F.nullif("message_id", F.lit(""))).alias("ids"),
        F.count_distinct(F.nullif("thread_id", F.lit(""))).alias("threads"),
        F.count_distinct("from_address").alias("senders"),
    )
    pairs = (("distinct_message_id", "ids"), ("distinct_thread_id", "threads"), ("distinct_senders", "senders"))
    near = [F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), 0.03 * F.col(b)) for a, b in pairs]
    joined = estimates.join(exact, F.col("folder_id") == F.col("folder"))
    return joined.select("folder_id", "ids", "threads", "senders", *[c.alias(f"{b}_near") for c, (_, b) in zip(near, pairs)])


@query
def folder_unread(spark, sf):
    return counters.folder_unread(V.messages(spark, sf), V.folders(spark))


@query
def folder_unread_after_changes(spark, sf):
    start = counters.folder_unread(V.messages(spark, sf), V.folders(spark))
    start = start.withColumn("unread_count", F.col("unread_count") % 3)
    return counters.after_changes(start, counters.unread_deltas(V.read_changes(spark, sf), V.folders(spark)))


@query
def folder_unread_stream(spark, sf):
    """Unread counters kept by a stream of changes in several batches, from a start and with a floor of zero."""
    base = scratch_dir(spark, "unread")
    changed, start = V.read_changes(spark, sf), counters.folder_unread(V.messages(spark, sf), V.folders(spark))
    start.withColumn("unread_count", F.col("unread_count") % 3).write.parquet(f"{base}/start")
    for part in range(3):  # files are read in the order they were written in
        bounds = changed.agg((F.max("seq") * part / 3).alias("low"), (F.max("seq") * (part + 1) / 3).alias("high")).select(F.struct("*")).scalar()
        some = changed.filter((F.col("seq") > bounds["low"]) | F.lit(part == 0)).filter(F.col("seq") <= bounds["high"])
        some.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(changed.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    started = spark.read.parquet(f"{base}/start")
    upkeep.follow_unread(stream, V.folders(spark), started, f"{base}/out", f"{base}/state").awaitTermination()
    return upkeep.latest_unread(spark, f"{base}/out")


@query
def listing(spark, sf):
    return V.messages(spark, sf).select(*display.listing_columns())


@query
def snippet(spark, sf):
    both = V.table(spark, sf, "documents").select(F.col("doc_id").alias("rowid"), "text")
    return both.select("rowid", display.snippet(F.col("text")).alias("snippet"), dates.truncate(F.col("text"), 30).alias("cut"))


@query
def html_to_text(spark, sf):
    pages = V.table(spark, sf, "pages")
    return pages.select("page_id", bodies.html_to_text(F.col("html")).alias("body"))


@query
def clean_plain(spark, sf):
    documents = V.table(spark, sf, "documents")
    return documents.select("doc_id", bodies.clean_plain(F.col("text")).alias("body"))


@query
def readable_body(spark, sf):
    mail = V.messages(spark, sf, flags=False, html=True)
    return mail.select("id", bodies.readable_body(F.col("body_text"), F.col("body_html"), F.col("snippet")).alias("body"))


@query
def saved_terms(spark, sf):
    searches = V.saved_searches(spark, sf, "documents", "doc_id")
    terms = saved.parse_searches(searches, V.NOW)
    return terms.select(
        "search_id",
        F.col("term_no").cast("long").alias("term_no"),
        "kind",
        "negated",
        F.col("columns").cast("long").alias("columns"),
        "phrase",
        "prefix",
        "flag_column",
        F.col("flag_value").cast("long").alias("flag_value"),
        "date_op",
        dates.utc_text(F.col("cutoff")).alias("cutoff"),
        "folder",
        "error",
    )


def _matches(spark, sf, frequencies=None):
    searches = V.saved_searches(spark, sf, "benchmark", "item_id")
    path = scratch_dir(spark, "saved")
    saved.parse_searches(searches, V.NOW).write.parquet(f"{path}/terms")
    index.with_index(V.messages(spark, sf)).write.parquet(f"{path}/mail")
    terms, mail = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/mail")
    return searches, saved.match_searches(searches, terms, mail, V.folders(spark), frequencies)


@query
def saved_matches(spark, sf):
    return _matches(spark, sf)[1]


@query
def saved_matches_rarest(spark, sf):
    """The same, phrases looked up by the token that the index knows as the rarest."""
    return _matches(spark, sf, V.stored_index(spark, sf).tokens)[1]


@query
def saved_hit_counts(spark, sf):
    return saved.hit_counts(*_matches(spark, sf))


# --- streams: even rows first, then odd rows together with changed even rows -------------------------


def _watch(spark, sf, terms, known=False, **options):
    base = scratch_dir(spark, "watch")
    mail = V.messages(spark, sf)
    even, odd = mail.filter("rowid % 2 = 0"), mail.filter("rowid % 2 = 1")
    changed = even.filter("rowid % 6 = 0").withColumn("is_read", 1 - F.col("is_read"))
    even.write.mode("append").parquet(f"{base}/in")
    if known:
        watch.baseline(even, terms, V.folders(spark), V.NOW).write.parquet(f"{base}/known")
        options["known"] = spark.read.parquet(f"{base}/known")

    def run():
        stream = spark.readStream.schema(mail.schema).parquet(f"{base}/in")
        watch.start_watch(
            stream, terms, f"{base}/events", f"{base}/state", folders=V.folders(spark), now=V.NOW, **options
        ).awaitTermination()

    run()
    odd.unionByName(changed).write.mode("append").parquet(f"{base}/in")
    run()
    return watch.read_events(spark, f"{base}/events").withColumn("batch", F.col("batch").cast("long"))


@query
def watch_fresh(spark, sf):
    return _watch(spark, sf, [flag("unread")]).select("batch", "id")


@query
def watch_fire_existing(spark, sf):
    return _watch(spark, sf, []).select("batch", "id", "unread")


@query
def watch_baseline(spark, sf):
    return _watch(spark, sf, [flag("unread")], known=True).select("batch", "id")


@query
def watch_silent(spark, sf):
    """The first batch is remembered without events."""
    return _watch(spark, sf, [flag("unread")], silent=True).select("batch", "id")


@query
def watch_query(spark, sf):
    return _watch(spark, sf, [text("the", field="subject"), ~folder("spam")]).select("batch", "id")


@query
def watch_capped(spark, sf):
    return _watch(spark, sf, [flag("unread")], cap=7).select("batch", "id")


@query
def watch_window(spark, sf):
    return _watch(spark, sf, [flag("unread")], window=20).select("batch", "id")


@query
def watch_events(spark, sf):
    sent = _watch(spark, sf, [flag("attachments")], query="attachments:", source="mail")
    return sent.select("batch", "name", "query", "source", "id", "unread", "flagged", "attachments", "payload")


# --- synthetic mailboxes --------------------------------------------------------------------------


SEED = 7


def _profile(spark, sf):
    path = scratch_dir(spark, "profile")
    synth.write_profile(profile.profile_document(V.profile_tables(spark, sf, archive=True)), path)
    return synth.read_profile(spark, path)


@query
def synth_folders(spark, sf):
    return synth.synth_folders(_profile(spark, sf))


@query
def synth_counts(spark, sf):
    rows = synth.synth_rows(_profile(spark, sf), tasks=8)
    return rows.groupBy("folder_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("is_read") == 0).alias("unread"), F.min("rowid").alias("first_row")
    )


@query
def synth_messages(spark, sf):
    rows = synth.synth_messages(_profile(spark, sf), SEED, V.NOW, tasks=8)
    return rows.select(
        "id", "folder_id", "message_id", "from_address", "to_addresses", "subject", "snippet", "body_text",
        (F.length(F.coalesce("body_html", F.lit(""))) > 0).alias("has_html"), "date", "is_read", "is_flagged",
        "has_attachments", "is_draft",
    )


@query
def synth_dups(spark, sf):
    rows = synth.synth_messages(_profile(spark, sf), SEED, V.NOW, tasks=8)
    return rows.groupBy("message_id").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))


@query
def synth_roundtrip(spark, sf):
    """Profile of the made mailbox beside the profile it was made from."""
    wanted = _profile(spark, sf)
    path = scratch_dir(spark, "made")
    synth.synth_messages(wanted, SEED, V.NOW, tasks=8).write.parquet(path)
    made = {"messages": spark.read.parquet(path), "folders": synth.synth_folders(wanted)}
    names = ("total", "distinct_message_id", "unread", "flagged", "has_attachments", "with_html", "with_text")

    def numbers(p):
        sizes = F.transform("folders", lambda f: F.struct(f["messages"].alias("n"), f["unread"].alias("unread")))
        return p.select(*[F.col("messages")[c].alias(c) for c in names], F.to_json(F.array_sort(sizes)).alias("folders"))

    old, new = numbers(wanted), numbers(profile.profile_document(made))
    return old.withColumn("side", F.lit("wanted")).unionByName(new.withColumn("side", F.lit("made")))
