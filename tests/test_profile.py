import random

import pytest

from mailspark.operators import counters, profile
from mailspark.plans import synth
from mailspark.schemas import require_version, schema_status


def one(frame):
    return frame.collect()[0]


@pytest.fixture
def tables(spark, mail):
    rows = mail(
        {"message_id": "<1>", "date": "2024-01-01 09:00:00", "body_html": "<p>", "body_text": "t", "subject": "abc",
         "to_addresses": '[{"address":"x"},{"address":"y"}]'},
        {"message_id": "<2>", "date": "2024-02-01 09:00:00", "is_read": 1, "body_text": "t", "cc_addresses": "broken"},
        {"message_id": "<3>", "date": "2024-03-01 09:00:00", "is_read": 1, "body_text": "t", "has_attachments": 1, "from_address": "b@x"},
        {"message_id": "<4>", "date": "2024-04-01 09:00:00", "folder_id": "fs", "body_text": "tttt", "thread_id": ""},
    )
    return {
        "messages": rows,
        "folders": spark.createDataFrame([("fi", "inbox"), ("fs", "spam"), ("fe", None)], "id string, type string"),
        "accounts": spark.createDataFrame([("a",)], "id string"),
        "settings": spark.createDataFrame([("schema_version", " 13 "), ("x", "y")], "key string, value string"),
    }


def test_profile(tables):
    p = one(profile.profile_document(tables))
    m = p.messages
    assert (p.schema_version, p.accounts, p.table_rows) == (13, 1, {"settings": 2})
    assert [(f.type, f.messages, f.unread) for f in p.folders] == [("inbox", 3, 1), ("spam", 1, 1), ("(null)", 0, 0)]
    assert (m.total, m.distinct_message_id, m.distinct_thread_id, m.distinct_senders) == (4, 4, 0, 2)
    assert (m.read, m.unread, m.has_attachments, m.with_html, m.with_text) == (2, 2, 1, 1, 4)
    assert m.per_month == {"2024-01": 1, "2024-02": 1, "2024-03": 1, "2024-04": 1}
    assert (m.first_date, m.last_date) == ("2024-01-01 09:00:00", "2024-04-01 09:00:00")
    assert (m.body_text_len.min, m.body_text_len.max, m.body_text_len.avg) == (1, 4, 1.75)
    assert (m.recipients.to_avg, m.recipients.cc_avg) == (0.5, 0.0)


def test_empty_profile(tables, mail):
    m = one(profile.profile_document({"messages": mail({}).limit(0), "folders": tables["folders"].limit(0)}))
    assert (m.messages.total, m.folders, m.messages.first_date, m.messages.per_month) == (0, [], "", {})


def test_null_read_mark_counts_as_unread_only_in_the_total(mail, tables):
    rows = mail({"is_read": None}, {"is_read": 0})
    assert one(profile.profile_messages(rows)).unread == 2
    assert {r.folder_id: r.unread for r in profile.folder_profile(rows, tables["folders"]).collect()}["fi"] == 1


def test_profile_file_roundtrip(spark, tables, tmp_path):
    document = profile.profile_document(tables)
    synth.write_profile(document, str(tmp_path / "p"))
    assert one(synth.read_profile(spark, str(tmp_path / "p"))).asDict(True) == one(document).asDict(True)


def test_version_gate(spark):
    def settings(*rows):
        return spark.createDataFrame(list(rows) or [("a", "b")], "key string, value string")

    assert one(schema_status(settings(("schema_version", "13")))).ok
    assert one(require_version(settings(("schema_version", " 13")))).ok
    assert one(schema_status(settings(("schema_version", "x")))).found is False
    with pytest.raises(Exception, match="unsupported schema version 12"):
        require_version(settings(("schema_version", "12"))).collect()
    with pytest.raises(Exception, match="could not determine"):
        require_version(settings()).collect()


def test_unread_rules(spark, mail):
    folders = spark.createDataFrame(
        [("d", "Entwürfe", "drafts"), ("n", "My DRAFTS", "custom"), ("u", "draft box", None), ("i", "INBOX", "inbox")],
        "id string, name string, type string",
    )
    rows = mail(*[{"folder_id": f, "is_draft": d} for f in "dnui" for d in (1, 1, 0, None)], {"folder_id": "i", "is_read": 1})
    got = {r.folder_id: r.unread_count for r in counters.folder_unread(rows, folders).collect()}
    assert got == {"d": 2, "n": 2, "u": 4, "i": 2}


def test_unread_changes_never_go_below_zero(spark, monkeypatch):
    monkeypatch.setattr(counters, "BLOCK", 5)
    rng = random.Random(5)
    folders = spark.createDataFrame([(f, f, "inbox") for f in "abc"], "id string, name string, type string")
    start = {"a": 0, "b": 2, "c": 1}
    steps, want = [], dict(start)
    for seq in range(120):
        f, op, old, new = rng.choice("aab"), rng.choice(["insert", "update", "delete"]), rng.choice([0, 1]), rng.choice([0, 1])
        steps.append((seq, op, f, 0, old, new))
        if op == "insert":
            step = new == 0
        elif op == "delete":
            step = -(old == 0)
        else:
            step = (old == 1 and new == 0) - (old == 0 and new == 1)
        want[f] = max(0, want[f] + step)
    changes = spark.createDataFrame(steps, "seq long, op string, folder_id string, is_draft int, old_is_read int, is_read int")
    counts = spark.createDataFrame(list(start.items()), "folder_id string, unread_count long")
    after = counters.after_changes(counts, counters.unread_deltas(changes, folders))
    assert {r.folder_id: r.unread_count for r in after.collect()} == want
