"""Several mailboxes with the same ids, and deep places in long lists."""

import random

import pytest
from pyspark.sql import functions as F

from mailspark.operators import counters, index, profile
from mailspark.operators import search as S
from mailspark.operators.terms import folder


@pytest.fixture
def two(spark, mail):
    """Mailbox a: a mail in the inbox and in spam. Mailbox b: the same mail twice, in folders that are no spam there."""
    a = mail({"message_id": "<x>", "folder_id": "f1"}, {"message_id": "<x>", "folder_id": "f2"}, {"message_id": "<y>", "folder_id": "f1"})
    b = mail({"message_id": "<x>", "folder_id": "f2"}, {"message_id": "<x>", "folder_id": "f1", "is_read": 1}, {"message_id": "", "folder_id": "f1"})
    box = [("a", "f1", "In", "inbox"), ("a", "f2", "Junk", "spam"), ("b", "f1", "In", "inbox"), ("b", "f2", "Sent", "sent")]
    both = a.withColumn("mailbox", F.lit("a")).unionByName(b.withColumn("mailbox", F.lit("b")))
    return both, spark.createDataFrame(box, "mailbox string, id string, name string, type string")


def keys(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_each_mailbox_has_its_own_copies_and_spam(two):
    mail, folders = two
    assert keys(S.search_view(mail, folders, columns=("mailbox", "id")), "mailbox", "id") == [("a", "3"), ("b", "1"), ("b", "3")]
    assert keys(S.hide_spam(mail, folders), "mailbox", "id") == [("a", "3"), ("b", "1"), ("b", "2"), ("b", "3")]
    assert keys(S.dup_representatives(mail), "mailbox", "message_id", "rowid") == [("a", "<x>", 1), ("a", "<y>", 3), ("b", "<x>", 1)]
    assert keys(S.search(mail, [folder("sent")], folders=folders, columns=("mailbox", "id")), "mailbox", "id") == [("b", "1")]
    assert keys(S.search(mail, [~folder("sent")], folders=folders, columns=("mailbox", "id")), "mailbox", "id") == [
        ("a", "1"), ("a", "2"), ("a", "3"), ("b", "2"), ("b", "3")]


def test_pages_of_two_mailboxes_lose_nothing(two):
    mail, _ = two
    pages = [keys(S.search(mail, limit=2, offset=n, columns=("mailbox", "id")), "mailbox", "id") for n in (0, 2, 4)]
    assert sorted(sum(pages, [])) == keys(mail, "mailbox", "id")
    assert S.search(mail, offset=5).count() == 1


def test_counters_by_mailbox(spark, two):
    mail, folders = two
    assert keys(counters.folder_unread(mail, folders), "mailbox", "folder_id", "unread_count") == [
        ("a", "f1", 2), ("a", "f2", 1), ("b", "f1", 1), ("b", "f2", 1)]
    assert keys(profile.folder_profile(mail, folders), "mailbox", "folder_id", "messages", "unread") == [
        ("a", "f1", 2, 2), ("a", "f2", 1, 1), ("b", "f1", 2, 1), ("b", "f2", 1, 1)]
    steps = [("a", 1, "delete", "f1", 0, 0, None), ("b", 2, "insert", "f1", 0, None, 0)]
    changes = spark.createDataFrame(steps, "mailbox string, seq long, op string, folder_id string, is_draft int, old_is_read int, is_read int")
    after = counters.after_changes(counters.folder_unread(mail, folders), counters.unread_deltas(changes, folders))
    assert keys(after, "mailbox", "folder_id", "unread_count") == [("a", "f1", 1), ("a", "f2", 1), ("b", "f1", 2), ("b", "f2", 1)]


def test_changes_reach_their_own_mailbox(two):
    mail, _ = two
    rows = mail.select("mailbox", "rowid", "subject")
    changes = rows.filter("rowid = 1 AND mailbox = 'b'").select(F.lit("delete").alias("op"), F.lit(1).alias("seq"), "*")
    assert keys(index.apply_changes(rows, changes), "mailbox", "rowid") == [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3)]


def test_folders_of_several_mailboxes_need_messages_that_name_theirs(two):
    mail, folders = two
    with pytest.raises(ValueError, match="no mailbox column"):
        S.search(mail.drop("mailbox"), [folder("sent")], folders=folders)


@pytest.mark.parametrize("up", [True, False])
def test_deep_places(spark, up, monkeypatch):
    monkeypatch.setattr(S, "PIVOTS", 4)
    rng = random.Random(8)
    values = [(rng.choice("aab") + str(rng.randrange(40)), rng.randrange(3)) for _ in range(300)] + [("hot", 1)] * 200
    order = (("date", up), ("id", up))
    rows = spark.createDataFrame(values, "date string, id int").repartition(5).cache()
    want = sorted(values, reverse=not up)
    for count in (1, 99, 260, 499):
        assert sorted(map(tuple, S.skip(rows, order, count, block=10).collect())) == sorted(want[count:])
    assert sorted(map(tuple, S.skip(rows, order, 260).collect())) == sorted(want[260:])
    assert S.skip(rows, order, 500, block=10).count() == S.skip(rows, order, 501, block=10).count() == S.skip(rows, order, 501).count() == 0


def test_rows_without_a_date_come_last(spark, mail):
    rows = mail({"date": None}, {"date": "2024-01-01 00:00:00"}, {"date": "2023-01-01 00:00:00"})
    assert [r.id for r in S.search(rows, offset=1).collect()] == ["3", "1"]
    assert S.skip(spark.createDataFrame([], "date string, id string"), S.NEWEST, 5, block=2).count() == 0
