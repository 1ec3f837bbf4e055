import pytest
from helpers import ids

from mailspark.operators import events
from mailspark.operators.index import index_table
from mailspark.operators.terms import flag, text
from mailspark.sources.mailbox import with_instant
from mailspark.streaming import upkeep, watch


@pytest.fixture
def box(spark, mail, tmp_path):
    """Append messages to a folder, then let the watch run over what is new; gives the ids that fired."""

    class Box:
        path = str(tmp_path)

        def add(self, *rows):
            for row in rows:
                row.setdefault("date", f"2026-01-{int(row['id'][1:]):02} 10:00:00")
            with_instant(mail(*rows)).write.mode("append").parquet(f"{self.path}/in")

        def run(self, terms=(), name="w", **options):
            before = self.fired(name)
            schema = spark.read.parquet(f"{self.path}/in").schema
            stream = spark.readStream.schema(schema).parquet(f"{self.path}/in")
            watch.start_watch(stream, terms, f"{self.path}/{name}", f"{self.path}/{name}-state", **options).awaitTermination()
            return [i for i in self.fired(name) if i not in before]

        def fired(self, name="w"):
            try:
                rows = watch.read_events(spark, f"{self.path}/{name}").collect()
            except Exception:
                return []
            return [r.id for r in sorted(rows, key=lambda r: (r.batch, r.id))]

    return Box()


def test_only_new_ids_fire(box):
    box.add({"id": "m01"}, {"id": "m02"})
    assert box.run() == ["m01", "m02"]
    box.add({"id": "m03"}, {"id": "m02", "is_read": 1}, {"id": "m03", "is_read": 1})
    assert box.run() == ["m03"]
    assert box.run() == []


def test_baseline_is_silent(spark, box):
    box.add({"id": "m01"}, {"id": "m02"})
    existing = spark.read.parquet(f"{box.path}/in")
    watch.baseline(existing).write.parquet(f"{box.path}/known")
    known = spark.read.parquet(f"{box.path}/known")
    assert box.run(known=known) == []
    box.add({"id": "m03"}, {"id": "m01"})
    assert box.run(known=known) == ["m03"]


def test_baseline_is_compared_with_the_first_batch_only(spark, box):
    """Mail and baseline come in one batch; later the ids are known by the state, and a hot id counts once."""
    known = spark.createDataFrame([("m01",), ("m09",), (None,)], "id string")
    box.add({"id": "m01"}, *[{"id": "m02"} for _ in range(500)])
    assert box.run(known=known) == ["m02"]
    box.add({"id": "m09"}, {"id": "m03"}, {"id": "m02"}, {"id": "m01"})
    assert box.run(known=known) == ["m03"]
    box.add({"id": "m09"})
    assert box.run(known=known) == []


def test_first_batch_can_be_silent(box):
    box.add({"id": "m01"}, {"id": "m02"})
    assert box.run(silent=True) == []
    box.add({"id": "m02"}, {"id": "m03"})
    assert box.run(silent=True) == ["m03"]


def test_window_remembers_ids_of_many_batches(spark, box):
    for n in range(1, 8):
        box.add({"id": f"m{n:02}"}, {"id": "m09"}, {"id": "m00", "date": "2020-01-01 00:00:00"})
        assert box.run(window=2) == ([f"m{n:02}"] if n > 1 else ["m01", "m09"])
    assert [watch._runs(n) for n in (0, 1, 6)] == [[], [(0, 1)], [(0, 4), (4, 6)]]
    assert spark.read.parquet(f"{box.path}/w_seen/4-6").count() == 3


def test_no_events_before_the_first_batch(spark, tmp_path):
    assert watch.read_events(spark, str(tmp_path / "none")).count() == 0


def test_one_exchange_holds_the_ids(spark, mail):
    def exchanges(frame):
        return frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange hashpartitioning")

    assert exchanges(watch.fresh(with_instant(mail({"id": "m1"})))) == 1


def test_cap_keeps_the_newest_and_drops_the_rest_for_good(box):
    box.add(*[{"id": f"m0{n}"} for n in range(1, 6)])
    assert box.run(cap=2) == ["m04", "m05"]
    box.add({"id": "m01", "is_read": 1})
    assert box.run(cap=2) == []


def test_query_scope_and_first_match_later(box):
    box.add({"id": "m01", "subject": "Invoice"}, {"id": "m02", "is_read": 1, "subject": "invoice"})
    terms = [text("invoice", field="subject"), flag("unread")]
    assert box.run(terms) == ["m01"]
    box.add({"id": "m02", "is_read": 0, "subject": "invoice"})
    assert box.run(terms) == ["m02"]


def test_a_new_query_has_its_own_baseline(spark, box):
    box.add({"id": "m01"}, {"id": "m02", "is_read": 1})
    assert box.run([flag("unread")]) == ["m01"]
    watch.baseline(spark.read.parquet(f"{box.path}/in"), [flag("read")]).write.parquet(f"{box.path}/known")
    assert box.run([flag("read")], name="w2", known=spark.read.parquet(f"{box.path}/known")) == []


def test_bounded_state(box):
    box.add({"id": "m01"}, {"id": "m02"}, {"id": "m02"})
    assert box.run(keep="30 days") == ["m01", "m02"]


def test_hook_sees_events(box):
    box.add({"id": "m02"}, {"id": "m01"})
    calls = []
    box.run(query="x", on_events=lambda frame, batch: calls.append((batch, ids(frame.coalesce(1)))))
    assert [sorted(c[1]) for c in calls] == [["m01", "m02"]]


def test_payload_fields(spark, mail):
    rows = mail({"id": "m1", "subject": "Hi", "is_flagged": 1, "to_addresses": "", "body_text": "t"})
    row = events.to_events(rows, "q", "s").collect()[0]
    assert (row.name, row.query, row.source, row.unread, row.flagged, row.attachments) == ("new-message", "q", "s", "1", "1", "0")
    assert '"body_text":"t"' in row.payload and "to_addresses" not in row.payload and "body_html" not in row.payload
    assert '"from_name":""' in row.payload
    assert events.decode_events(events.to_events(rows, "q")).collect()[0].message.subject == "Hi"


def test_bad_and_blank_payloads(spark, mail):
    sent = events.to_events(mail({"id": "m1", "is_read": 1}), "q")
    from pyspark.sql import functions as F

    bad, blank = sent.withColumn("payload", F.lit("{oops")), sent.withColumn("payload", F.lit(" "))
    with pytest.raises(Exception):
        events.decode_events(bad).collect()
    assert events.decode_events(bad, strict=False).collect()[0].message["_corrupt"] == "{oops"
    message = events.decode_events(blank).collect()[0].message
    assert (message.id, message.is_read, message.is_flagged) == ("m1", True, False)


def test_index_upkeep(spark, mail, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "index")
    upkeep.write_buckets(index_table(mail(*[{"subject": f"word{n}"} for n in range(1, 21)])), path, bucket_rows=6)
    changes = mail({"rowid": 3, "subject": "new"}, {"rowid": 3, "subject": "newest"}, {"rowid": 4}, {"rowid": 99, "subject": "added"})
    changes = changes.withColumn("seq", F.monotonically_increasing_id()).withColumn("op", F.when(F.col("rowid") == 4, "delete").otherwise("update"))
    changes = changes.withColumn("seq", F.when(F.col("subject") == "newest", 1000000).otherwise(F.lit(1)))
    for _ in range(2):  # a rerun of the same change set changes nothing
        upkeep.upsert(spark, path, changes, "one", bucket_rows=6)
        got = {r.rowid: r.pad_subject.strip() for r in upkeep.read_buckets(spark, path).collect()}
        assert got == {n: f"word{n}" for n in range(1, 21) if n not in (3, 4)} | {3: "newest", 99: "added"}
    gone = mail(*[{"rowid": n} for n in got]).withColumn("seq", F.lit(1)).withColumn("op", F.lit("delete"))
    upkeep.upsert(spark, path, gone, "two", bucket_rows=6)
    assert upkeep.read_buckets(spark, path).count() == 0


def test_a_bucket_is_shared_by_tasks(spark, mail, tmp_path):
    """Rows of one bucket come from several tasks, in the first table and after changes."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        upkeep.write_buckets(index_table(mail(*[{"subject": f"word{n}"} for n in range(1, 41)])), path)
        files = lambda: {r.f for r in upkeep.read_buckets(spark, path).select(F.input_file_name().alias("f")).collect()}
        assert len(files()) > 1
        changes = mail({"rowid": 3, "subject": "new"}).withColumn("seq", F.lit(1)).withColumn("op", F.lit("update"))
        upkeep.upsert(spark, path, changes, "one")
        assert len(files()) > 1 and upkeep.read_buckets(spark, path).count() == 40
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_unread_counters_over_several_batches(spark, tmp_path):
    folders = spark.createDataFrame([("a", "A", "inbox"), ("b", "B", None), ("c", "C", "drafts")], "id string, name string, type string")
    start = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2)], "folder_id string, unread_count bigint")
    schema = "seq bigint, op string, folder_id string, is_draft int, old_is_read int, is_read int"
    # a: 1 -1 -1 (held at zero) +1, then -1; b: held at zero, then +2; c counts drafts only
    batches = [
        [(1, "delete", "a", 0, 0, None), (2, "delete", "a", 0, 0, None), (3, "insert", "a", 0, None, 0), (4, "delete", "b", 0, 0, None), (5, "insert", "c", 0, None, 0)],
        [(6, "update", "a", 0, 0, 1), (7, "insert", "b", 0, None, 0), (8, "insert", "b", 0, None, 0), (9, "update", "c", 1, 0, 1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upkeep.follow_unread(stream, folders, start, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {r.folder_id: r.unread_count for r in upkeep.latest_unread(spark, str(tmp_path / "out")).collect()}
    assert found == {"a": 0, "b": 2, "c": 1}
