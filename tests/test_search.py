import random
import sqlite3
from datetime import datetime

import pytest
from helpers import ids

from mailspark.operators import rank
from mailspark.operators import search as S
from mailspark.operators.index import with_index
from mailspark.operators.terms import before, flag, folder, since, text
from mailspark.sources.mailbox import read_indexed, write_indexed

NOW = datetime(2024, 3, 15, 12)


@pytest.fixture
def harbour(mail):
    """1: unread timetable with file, 2: read and starred repair, 3: unread cancellation, 4: old read letter."""
    ferry = {"from_name": "North Ferries", "from_address": "desk@ferries.example", "to_addresses": '[{"name":"Ines","address":"ines@home.example"}]'}
    return mail(
        ferry | {"subject": "Summer timetable", "snippet": "all sailings at a glance", "body_text": "The first boat leaves at dawn.",
                 "has_attachments": 1, "date": "2024-01-20 07:15:00"},
        {"subject": "Engine repair", "from_name": "Tomas Quay", "from_address": "tomas@yard.example", "snippet": "the boat is dry again",
         "to_addresses": '[{"name":"crew","address":"crew@yard.example"}]', "body_text": "New seals and oil", "is_read": 1, "is_flagged": 1,
         "date": "2024-02-10 18:00:00"},
        ferry | {"subject": "Sailing cancelled", "snippet": "no boat on friday", "body_text": "Storm over the sound", "date": "2024-03-10 00:00:00"},
        {"subject": "Lighthouse tour", "from_name": "Ada Holm", "from_address": "ada@light.example", "snippet": "thanks for coming",
         "body_text": "Stairs and a lamp", "is_read": 1, "date": "2022-08-01 12:00:00"},
    )


CASES = [
    ([], "1234"),
    ([text("sailing", field="subject")], "3"),
    ([text("sail*")], "13"),
    ([text("boat")], "123"),
    ([text("boat"), ~text("friday")], "12"),
    ([~text("boat")], "4"),
    ([text("the boat", phrase=True)], "2"),
    ([text("ferries", field="sender")], "13"),
    ([text("holm", field="from")], "4"),
    ([text("crew", field="recipient")], "2"),
    ([text("lamp", field="body")], "4"),
    ([text("friday", field="snippet")], "3"),
    ([text("sai*", phrase=True)], ""),
    ([text("submarine", field="subject")], ""),
    ([text("tomas@yard.example")], "2"),
    ([text("...")], ""),
    ([~text("...")], "1234"),
    ([flag("attachments")], "1"),
    ([flag("starred")], "2"),
    ([flag("read")], "24"),
    ([~flag("unread", False)], "13"),
    ([text("boat"), flag("unread")], "13"),
    ([since("2024-02-10 18:00")], "23"),
    ([before("2024-02-10 18:00")], "14"),
    ([since("2024-01-20"), before("2024-03-10")], "12"),
    ([since("6d")], "3"),
    ([since("2months")], "123"),
    ([~since("5 weeks")], "14"),
    ([before("1yr")], "4"),
    ([text("boat", field="snippet"), before("1month")], "2"),
]


def test_filters(harbour):
    for terms, wanted in CASES:
        assert "".join(sorted(ids(S.search(harbour, terms, now=NOW)))) == wanted, terms


def test_order_and_limits(harbour):
    assert ids(S.search(harbour)) == ["3", "2", "1", "4"]
    assert ids(S.search(harbour, limit=3)) == ["3", "2", "1"]
    assert ids(S.search(harbour, limit=2, offset=1)) == ["2", "1"]
    for skipped in (2, 4, 9):
        assert ids(S.search(harbour, offset=skipped)) == ["3", "2", "1", "4"][skipped:]
    assert ids(S.search(harbour, [text("boat")], offset=1)) == ids(S.search(harbour, [text("boat")]))[1:]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo", "Australia/Lord_Howe"])
def test_dates_in_sessions_of_any_zone(spark, mail, zone, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = mail({"date": "2024-03-10 02:30:00"}, {"date": "2024-03-31T23:30:00-02:00"}, {"date": "2024-04-01"}, {"date": "never"})
        write_indexed(rows, str(tmp_path / "mail"))
        stored = read_indexed(spark, str(tmp_path / "mail"))
        assert {r.id: str(r.month) for r in stored.select("id", "month").collect()} == {"1": "2024-03", "2": "2024-04", "3": "2024-04", "4": "none"}
        for frame in (rows, stored):
            find = lambda *terms: "".join(sorted(ids(S.search(frame, terms, now=NOW))))  # noqa: B023, E731
            assert find(since("2024-03-10 02:30")) == "123" and find(before("2024-03-10 02:31")) == "1"
            assert find(since("2024-04-01")) == "23" and find(since("2024-04-01 00:01")) == "2" and find(before("1d")) == "1"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rejected_terms():
    for call in (lambda: text("x", field="foo"), lambda: text("", field="subject"), lambda: flag("maybe"), lambda: since("soon"),
                 lambda: since(""), lambda: folder("archive"), lambda: folder("")):
        with pytest.raises(ValueError):
            call()


def test_null_flags_match_neither_side(mail):
    rows = mail({"is_read": None}, {"is_read": 1})
    assert ids(S.search(rows, [flag("unread")])) == []
    assert ids(S.search(rows, [flag("read")])) == ["2"]


def test_folders(spark, mail):
    folders = spark.createDataFrame([("fi", "inbox"), ("fs", "sent"), ("fn", None)], "id string, type string")
    rows = mail({"subject": "Inbox hello"}, {"folder_id": "fs", "subject": "Sent reply"}, {"folder_id": "fs", "subject": "Sent invoice"}, {"folder_id": "fn"})
    find = lambda *terms: "".join(sorted(ids(S.search(rows, terms, folders=folders))))
    assert find(folder("sent")) == "23"
    assert find(folder("inbox")) == "1"
    assert find(~folder("sent")) == "14"
    assert find(folder("sent"), text("invoice", field="subject")) == "3"
    assert find(folder("sent"), folder("inbox")) == ""


def test_view(spark, mail):
    folders = spark.createDataFrame([("in", "inbox"), ("junk", "spam"), ("keep", "archive")], "id string, type string")
    rows = mail(
        {"id": "lottery1", "message_id": "<lottery>", "folder_id": "junk", "subject": "you won"},
        {"id": "lottery2", "message_id": "<lottery>", "folder_id": "keep", "subject": "you won"},
        {"id": "lunch1", "message_id": "<lunch>", "folder_id": "keep"},
        {"id": "lunch2", "message_id": "<lunch>", "folder_id": "in"},
        {"id": "lunch3", "message_id": "<lunch>", "folder_id": "keep"},
        {"id": "bare", "message_id": None, "folder_id": "junk"},
        {"id": "blank", "message_id": "", "folder_id": "junk"},
        {"id": "alone", "message_id": "<alone>", "folder_id": "in"},
    )
    view = lambda *terms, **o: sorted(ids(S.search_view(rows, folders, terms, **o)))
    assert view() == ["alone", "bare", "blank", "lunch1"]
    assert view(include_spam=True) == ["alone", "bare", "blank", "lottery1", "lunch1"]
    assert view(text("won")) == []
    assert view(folder("spam")) == ["bare", "blank", "lottery1"]
    assert view(~folder("spam")) == ["alone", "lunch1"]
    assert view(folder("inbox")) == ["alone", "lunch2"]
    assert sorted(ids(S.hide_spam(rows, folders))) == ["alone", "bare", "blank", "lunch1", "lunch2", "lunch3"]
    assert sorted(ids(S.dedup(rows))) == ["alone", "bare", "blank", "lottery1", "lunch1"]
    # the copy that stands for a mail is chosen before filtering
    late = mail({"message_id": "<a>", "subject": "x"}, {"message_id": "<a>", "subject": "match"})
    assert ids(S.search_view(late, folders, [text("match")])) == []


def test_pages_cover_the_list_once(mail):
    rows = mail(*[{"id": f"m{n:02}", "date": f"2024-01-{1 + n // 3:02} 00:00:00"} for n in range(30)])
    everything = ids(S.search(rows, limit=0))
    assert [i for k in range(0, 35, 7) for i in ids(S.page(rows, 7, k))] == everything
    seen, last = [], None
    while True:
        page = S.keyset_page(rows, 7, last).collect()
        seen += [r.id for r in page]
        if len(page) < 7:
            break
        last = (page[-1].date, page[-1].id)
    assert seen == everything


def test_lookup(mail):
    rows = mail({"id": "a", "body_text": "hello", "subject": None}, {"id": "b"})
    assert S.load_one(rows, "a").collect()[0].body_text == "hello"
    with pytest.raises(Exception, match="no such message"):
        S.load_one(rows, "zz").collect()
    assert ids(S.load(rows, rows.filter("id = 'b'").select("id"))) == ["b"]


def lite_index(rows):
    lite = sqlite3.connect(":memory:")
    lite.execute("CREATE VIRTUAL TABLE t USING fts5(subject, body_text)")
    lite.executemany("INSERT INTO t(rowid, subject, body_text) VALUES (?, ?, ?)", rows)
    return lite


def test_scores_equal_the_text_index(mail):
    rng = random.Random(11)
    words = ["the", "of", "invoice", "inv", "café", "pay", "x", "the"]
    texts = [(n, " ".join(rng.choices(words, k=rng.randint(0, 6))), " ".join(rng.choices(words, k=rng.randint(0, 15)))) for n in range(1, 41)]
    lite = lite_index(texts)
    rows = with_index(mail(*[{"subject": s, "body_text": b, "from_address": "", "rowid": n} for n, s, b in texts]))
    searches = [
        ("invoice", [text("invoice")]),
        ("subject : pay", [text("pay", field="subject")]),
        ('"the of"', [text("the of")]),
        ('"the the"', [text("the the")]),
        ("inv *", [text("inv*")]),
        ("cafe AND x NOT (of)", [text("cafe"), text("x"), ~text("of")]),
        ('"---" AND invoice', [text("---"), text("invoice")]),
        ('invoice NOT ("---" OR x)', [text("invoice"), ~text("---"), ~text("x")]),
    ]
    for query, terms in searches:
        wanted = {r: round(s, 6) for r, s in lite.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (query,))}
        got = {int(r.id): round(r.score, 6) for r in S.search(rows, terms, limit=0).collect()}
        assert got == wanted, query


def test_known_scores(mail):
    texts = [("Invoice 2024", "please pay the invoice invoice"), ("Réunion café", "agenda and invoices"), ("Invoice reminder", "second notice"),
             ("x", "y z"), ("w", "long text here about nothing at all really")]
    rows = with_index(mail(*[{"subject": a, "body_text": b, "from_address": ""} for a, b in texts]))
    def scores(*terms):
        return {int(r.id): r.score for r in S.search(rows, terms).collect()}
    assert scores(text("invoice")) == {1: -0.5018568953, 3: -0.3810053268}
    assert scores(text("pay the")) == {1: -0.9966791897}
    assert scores(text("2024 please")) == {}


def test_plan_pushes_filters_and_reads_few_columns(spark, mail, tmp_path):
    write_indexed(mail({"subject": "a b"}, {"date": "2024-03-01 00:00:00"}, {"date": "bad"}), str(tmp_path / "m"))
    stored = read_indexed(spark, str(tmp_path / "m"))
    found = S.list_rows(S.filtered(stored, [text("a", field="subject"), flag("unread"), since("2024-01-01")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "body_text" not in plan and "regexp_replace" not in plan
    assert "PushedFilters: [" in plan and "EqualTo(is_read,0)" in plan
    assert "month" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert ids(found) == ["1"]
    assert sorted(ids(S.search(stored))) == ["1", "2", "3"]


def test_stats_count_the_whole_corpus(mail):
    rows = with_index(mail({"subject": "a a"}, {"subject": "b"}))
    row = rank.corpus_stats(rows, [text("a", field="subject"), text("zz")]).collect()[0]
    assert (row.messages, row.hits_0, row.hits_1) == (2, 1, 0)


def test_view_with_one_message_id_on_a_third_of_the_rows(spark, mail):
    folders = spark.createDataFrame([("in", "inbox"), ("sp", "spam"), ("all", "custom")], "id string, type string")
    rng = random.Random(9)
    rows = []
    for n in range(1, 301):
        identity = "<hot>" if n % 3 == 0 else rng.choice([None, "", f"<{n % 40}>"])
        rows.append({"id": f"m{n:03}", "rowid": n, "message_id": identity, "folder_id": "sp" if n % 37 == 0 and identity != "<hot>" else rng.choice(["in", "all"])})
    spam = {r["message_id"] for r in rows if r["folder_id"] == "sp" and r["message_id"]}
    kept, seen = [], set()
    for row in rows:
        if row["message_id"] and (row["message_id"] in spam or row["message_id"] in seen):
            continue
        seen.add(row["message_id"])
        kept.append(row["id"])
    frame = mail(*rows)
    assert sorted(ids(S.search_view(frame, folders, limit=0))) == kept
    visible = [r["id"] for r in rows if not r["message_id"] or r["message_id"] not in spam]
    assert sorted(ids(S.hide_spam(frame, folders))) == visible
