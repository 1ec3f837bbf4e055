import random

from pyspark.sql import functions as F

from mailspark.operators import profile, rollup


def one(frame):
    return frame.collect()[0].asDict(True)


def box(mail):
    rng = random.Random(3)
    pick = lambda *v: rng.choice(v)
    return mail(*[
        {"message_id": pick(None, "", "<a>", "<b>", "<c>"), "thread_id": pick(None, "", "t1", "t2"), "from_address": pick(None, "", "x", "y"),
         "folder_id": pick("f1", "f2", None), "date": pick("2024-01-05 00:00:00", "2024-02-05 00:00:00", None, "junk"),
         "subject": pick(None, "", "äö", "long subject"), "body_text": pick(None, "", "t" * 5000), "body_html": pick(None, "", "<p>"),
         "snippet": pick(None, "s"), "to_addresses": pick(None, "broken", "[]", '[{"address":"x"},{"address":"y"}]'),
         "is_read": pick(None, 0, 1), "is_flagged": pick(None, 1), "is_draft": pick(None, 1)}
        for _ in range(120)
    ])


def test_merged_parts_say_what_one_scan_says(mail):
    rows = box(mail)
    parts = [rollup.mailbox_rollup(rows.filter(F.col("rowid") % 3 == n)) for n in range(3)]
    got = one(rollup.totals(rollup.merge_rollups(*parts)))
    want = one(profile.profile_messages(rows)) | one(profile.profile_lengths(rows)) | one(profile.profile_recipients(rows))
    want |= one(profile.profile_distinct(rows))
    assert {k: round(v, 6) if isinstance(v, float) else v for k, v in got.items()} == {
        k: round(v, 6) if isinstance(v, float) else v for k, v in want.items()}


def test_cells_by_month_and_folder(mail):
    rows = box(mail)
    cells = rollup.mailbox_rollup(rows)
    months = {r.month: r.total for r in rollup.rolled_up(cells, "month").collect()}
    assert months == {r.month: r.messages for r in profile.per_month(rows).collect()}
    assert {r.folder_id for r in cells.collect()} == {"f1", "f2", None}


def test_nothing_to_roll_up(mail):
    none = mail({}).limit(0)
    assert rollup.mailbox_rollup(none).count() == 0
    got = one(rollup.totals(rollup.mailbox_rollup(none)))
    assert (got["total"], got["first_date"], got["subject_avg"], got["distinct_senders"]) == (0, "", 0.0, 0)
    assert one(profile.profile_distinct(none)) == {"distinct_message_id": 0, "distinct_thread_id": 0, "distinct_senders": 0}


def test_mailboxes_and_clashing_columns(mail):
    rows = box(mail).withColumn("mailbox", (F.col("rowid") % 2).cast("string")).withColumns({"total": F.lit("x"), "month": F.lit("y"), "value": F.lit(1)})
    cells = rollup.mailbox_rollup(rows)
    assert {r.mailbox: r.total for r in rollup.totals(cells, "mailbox").collect()} == {"0": 60, "1": 60}
    assert profile.profile_distinct(rows).collect()[0].distinct_message_id == 3


def test_sketches_come_close_over_many_cells(spark):
    ids = spark.range(60000).select(
        F.concat(F.lit("<"), (F.col("id") % 40000).cast("string")).alias("message_id"), F.lit("t").alias("thread_id"),
        F.lit("a").alias("from_address"), (F.col("id") % 30).cast("string").alias("folder_id"),
    )
    cells = ids.groupBy("folder_id").agg(F.hll_sketch_agg("message_id", rollup.SKETCH_BITS).alias("s"))
    estimate = cells.agg(F.hll_sketch_estimate(F.hll_union_agg("s"))).collect()[0][0]
    assert abs(estimate - 40000) < 0.03 * 40000
    assert abs(profile.profile_distinct(ids, approximate=True).collect()[0].distinct_message_id - 40000) < 0.03 * 40000


def test_exact_distinct_has_no_expand(mail):
    plan = profile.profile_distinct(box(mail))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
