from datetime import datetime

import pytest

from mailspark.operators import profile
from mailspark.plans import synth

NOW = datetime(2024, 6, 1)


def make(spark, folders, **stats):
    base = dict.fromkeys(
        ("total", "distinct_message_id", "distinct_thread_id", "distinct_senders", "read", "unread", "flagged", "has_attachments",
         "with_html", "with_text", "drafts"), 0)
    empty = {"min": 0, "max": 0, "avg": 0.0}
    messages = base | {"first_date": "", "last_date": "", "per_month": {}, "subject_len": empty, "body_text_len": empty,
                       "snippet_len": empty, "recipients": {"to_avg": 0.0, "cc_avg": 0.0, "bcc_avg": 0.0}} | stats
    listed = [{"type": t, "messages": n, "unread": u} for t, n, u in folders]
    return spark.createDataFrame([(13, 1, listed, messages, {})], synth.PROFILE)


def made(spark, p, tmp_path, seed=1):
    path = str(tmp_path / f"made{seed}")
    synth.synth_messages(p, seed, NOW, tasks=3).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    return rows, profile.profile_document({"messages": rows, "folders": synth.synth_folders(p)}).collect()[0]


def test_counts_and_ratios(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(synth, "CHUNK", 37)
    folders = [("archive", 400, 10), ("inbox", 390, 100), ("drafts", 10, 0), ("(null)", 0, 0), ("(null)", 3, 3)]
    p = make(spark, folders, total=803, distinct_message_id=763, with_text=80, flagged=40, first_date="2024-01-01 00:00:00",
             last_date="2024-12-31T00:00:00.000Z")
    rows, got = made(spark, p, tmp_path)
    assert sorted((f.type, f.messages, f.unread) for f in got.folders) == sorted(
        ("custom" if t == "archive" else t, n, u) for t, n, u in folders)
    m = got.messages
    assert m.total == 803 and abs((803 - m.distinct_message_id) - 40) / 803 < 0.04
    assert abs(m.with_text - 80) / 803 < 0.04 and abs(m.flagged - 40) / 803 < 0.04
    assert m.snippet_len.avg > 0 and "2024-01-01" <= m.first_date <= m.last_date <= "2024-12-31 00:00:00"
    assert rows.select("id").distinct().count() == 803
    copies = rows.groupBy("message_id").agg({"subject": "collect_set", "date": "collect_set", "from_address": "collect_set"})
    assert all(len(v) == 1 for r in copies.collect() for v in list(r)[1:])


def test_same_seed_same_mail(spark, tmp_path):
    p = make(spark, [("inbox", 50, 5), ("archive", 20, 0)], total=70, distinct_message_id=60, with_html=35)
    one, two, other = (synth.synth_messages(p, s, NOW, tasks=t) for s, t in ((1, 2), (1, 5), (2, 2)))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
    assert {tuple(r) for r in one.collect()} != {tuple(r) for r in other.collect()}
    dates = [r.date for r in one.collect()]
    assert "2023-06-01" <= min(dates) and max(dates) <= "2024-06-01 00:00:00"


@pytest.mark.parametrize("folders", [[("archive", 5, 5)], [("inbox", 0, 0)]])
def test_edges(spark, tmp_path, folders):
    n = folders[0][1]
    p = make(spark, folders, total=n, distinct_message_id=0)
    rows, got = made(spark, p, tmp_path)
    assert got.messages.total == n == got.messages.distinct_message_id
