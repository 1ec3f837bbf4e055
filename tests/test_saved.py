from datetime import datetime

from helpers import ids

from mailspark.operators import search as S
from mailspark.operators.terms import before, flag, folder, since, text
from mailspark.plans import saved

NOW = datetime(2024, 3, 15, 12)


def parse(spark, *strings):
    rows = spark.createDataFrame(list(enumerate(strings)), "search_id int, search_text string")
    found = {n: [] for n in range(len(strings))}
    for row in saved.parse_searches(rows, NOW).orderBy("search_id", "term_no").collect():
        found[row.search_id].append(row)
    return list(found.values())


def test_term_shapes(spark):
    strings = {
        "invoice": [(63, "invoice", False)],
        '  subject:invoice   unread:  bob ': [(1, "invoice", False), None, (63, "bob", False)],
        "Subject:Hello": [(1, "hello", False)],
        '"quick brown"': [(63, "quick brown", False)],
        'subject:"hi there"from:x': [(1, "hi there", False), (6, "x", False)],
        "12:30": [(63, "12 30", False)],
        "-from:bob": [(6, "bob", True)],
        "--x": [(63, "x", True)],
        'subject:say"hi': [(1, "say hi", False)],
        "from:bob@example.com": [(6, "bob example com", False)],
        '"" " "': [],
        "- a": [(63, "", False), (63, "a", False)],
    }
    for got, (string, want) in zip(parse(spark, *strings), strings.items()):
        assert [(r.columns, r.phrase, r.negated) if r.kind == "text" else None for r in got] == want, string


def test_prefixes(spark):
    got = parse(spark, "inv*", '"inv*"', "*", "a-b*")
    assert [(r[0].phrase, r[0].prefix) for r in got] == [("inv", True), ("inv", False), ("", False), ("a b", True)]


def test_errors(spark):
    cases = {
        "foo:bar": 'unknown field: "foo"',
        'subject:""': 'field "subject" requires a value',
        "unread:maybe": 'unread: invalid boolean value "maybe"',
        "after:soon": 'after: invalid date or duration "soon"',
        "newer:": "newer: requires a date or duration value",
        "in:archive": 'unknown folder "archive" (want inbox, sent, drafts, trash, spam)',
        "in:": "in requires a folder (inbox, sent, drafts, trash, spam)",
        'subject:"unterminated': "unterminated quote in query",
        'a "b c': "unterminated quote in query",
        '-"b': "unterminated quote in query",
    }
    for got, (string, want) in zip(parse(spark, *cases), cases.items()):
        assert [r.error for r in got if r.error] == [want], string


def test_flags_and_dates(spark):
    got = [r[0] for r in parse(spark, "unread:", "-unread:false", "starred:no", "older:2months", "-newer:2024-01-05", "read:YES")]
    assert [(r.flag_column, r.flag_value) for r in got] == [
        ("is_read", 0), ("is_read", 0), ("is_flagged", 0), (None, None), (None, None), ("is_read", 1)]
    assert [(r.date_op, r.cutoff) for r in got[3:5]] == [("<", datetime(2024, 1, 15, 12)), ("<", datetime(2024, 1, 5))]


def test_all_searches_at_once_equal_single_searches(spark, mail, tmp_path, monkeypatch):
    folders = spark.createDataFrame([("fi", "inbox"), ("fs", "sent"), ("fn", None), ("fp", "spam")], "id string, type string")
    rows = mail(*[
        {"rowid": n, "id": str(n), "subject": ["Invoice due", "hello a a b", "the invoice of may", "café"][n % 4], "folder_id": ["fi", "fs", "fn", "fp", "fi"][n % 5],
         "from_name": ["Bob", None, "Ann Lee"][n % 3], "body_text": "pay the invoice" if n % 7 == 0 else None, "is_read": [0, 1, None][n % 3],
         "is_flagged": n % 2, "date": "no date" if n % 11 == 0 else f"2024-{1 + n % 3:02}-{1 + n % 28:02} 10:00:00",
         "to_addresses": '[{"name":"Team X","address":"t@x.example"}]'}
        for n in range(1, 61)])
    cases = {
        "": [],
        "invoice": [text("invoice")],
        "the invoice -café": [text("the"), text("invoice"), ~text("café")],
        '"the invoice"': [text("the invoice")],
        "subject:inv* unread:": [text("inv*", field="subject"), flag("unread")],
        "a-a": [text("a a")],
        '"hello a"': [text("hello a", phrase=True)],
        "-invoice": [~text("invoice")],
        "-invoice flagged: in:inbox": [~text("invoice"), flag("flagged"), folder("inbox")],
        "in:sent -in:spam": [folder("sent"), ~folder("spam")],
        "in:sent in:inbox": [folder("sent"), folder("inbox")],
        "-in:spam to:team": [~folder("spam"), text("team", field="to")],
        "unread: read:": [flag("unread"), flag("read")],
        "newer:1month": [since("1month")],
        "after:2024-01-10 older:2024-02-10 unread:": [since("2024-01-10"), before("2024-02-10"), flag("unread")],
        "invoice invoice before:2024-02-01": [text("invoice"), text("invoice"), before("2024-02-01")],
        '"---"': [text("---")],
        '"---" invoice': [text("---"), text("invoice")],
        "---": [~text("--")],
        "from:nobody": [text("nobody", field="from")],
        "before:1990-01-01": [before("1990-01-01")],
    }
    searches = spark.createDataFrame(list(enumerate(list(cases) + ["invoice foo:x"])), "search_id int, search_text string")
    saved.parse_searches(searches, NOW).write.parquet(str(tmp_path / "terms"))
    hits = saved.match_searches(searches, spark.read.parquet(str(tmp_path / "terms")), S.with_instant(rows), folders)
    got = {n: set() for n in range(len(cases) + 1)}
    pairs = hits.collect()
    kept = spark.createDataFrame([("the", 30), ("the", 9), ("invoice", 25), ("a", 0)], "token string, holding long")  # some are missing
    monkeypatch.setattr(saved, "FILTER_BITS", 64)  # so few that unwanted tokens come through
    rarest = saved.match_searches(searches, spark.read.parquet(str(tmp_path / "terms")), S.with_instant(rows), folders, kept)
    assert sorted(rarest.collect()) == sorted(pairs)
    for row in pairs:
        got[row.search_id].add(str(row.rowid))
    assert len(pairs) == sum(map(len, got.values()))
    every = {n: set(ids(S.search(rows, terms, folders=folders, now=NOW, limit=0))) for n, terms in enumerate(cases.values())}
    for n, string in enumerate(cases):
        wanted = every[n]
        assert got[n] == wanted, string
    assert got[len(cases)] == set()
    counts = {r.search_id: (r.hits, r.shown) for r in saved.hit_counts(searches, hits).collect()}
    assert counts[1][0] == len(got[1]) and counts[len(cases)] == (0, "0 messages")


def test_terms_are_parted_by_white_space_of_any_script(spark):
    for blank in ("\u00a0", "\u3000", "\u2003", "\x85", "\u2028", " \u00a0\t"):
        (rows,) = parse(spark, f"invoice{blank}unread:{blank}from:bob")
        assert [(r.kind, r.phrase) for r in rows] == [("text", "invoice"), ("flag", None), ("text", "bob")], repr(blank)


def test_pairs_are_dealt_by_the_number_of_messages(spark, mail, monkeypatch, tmp_path):
    monkeypatch.setattr(saved, "ROWS_A_TASK", 3)
    rows = S.with_instant(mail(*[{"subject": "one two" if n % 2 else "one", "is_read": n % 2} for n in range(20)]))
    searches = spark.createDataFrame([(1, "one two"), (2, "one -two"), (3, "unread:yes -two")], "search_id int, search_text string")
    saved.parse_searches(searches, NOW).write.parquet(str(tmp_path / "terms"))
    folders = spark.createDataFrame([("fi", "Inbox", "inbox")], "id string, name string, type string")
    hits = saved.match_searches(searches, spark.read.parquet(str(tmp_path / "terms")), rows, folders)
    assert "rowid#" in (shown := hits._jdf.queryExecution().executedPlan().toString()) and ", 7), REPARTITION_BY_NUM" in shown
    found = sorted((r.search_id, r.rowid) for r in hits.collect())
    odd, even = range(2, 21, 2), range(1, 21, 2)
    assert found == [(1, n) for n in odd] + [(2, n) for n in even] + [(3, n) for n in even]
