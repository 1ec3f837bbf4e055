import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_a_check_or_is_known_to_have_none():
    assert set(contract.REGISTRY) - set(contract.SQL) == {"synth_roundtrip"}
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["search_view", "search_offset", "profile_document", "schema_gate", "scan_messages", "watch_capped"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    lite = duckdb.connect()
    for table in ("documents", "labels", "pages", "customer", "supplier", "part", "orders", "events", "conversations", "lineitem",
                  "benchmark", "nation", "region"):
        lite.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    frame = contract.queries()[name](spark, SMALL)
    cursor = lite.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    theirs = sorted(tuple(map(repr, row)) for row in cursor.fetchall())
    assert sorted(tuple(map(repr, row)) for row in frame.select(*columns).collect()) == theirs


def test_synthetic_mail_follows_its_profile(spark):
    rows = {r.side: r for r in contract.queries()["synth_roundtrip"](spark, SMALL).collect()}
    want, made = rows["wanted"], rows["made"]
    assert (want.total, want.unread, want.folders) == (made.total, made.unread, made.folders)
    for name in ("distinct_message_id", "flagged", "has_attachments", "with_html", "with_text"):
        assert abs(want[name] - made[name]) / want.total < 0.1


def test_a_search_indexes_the_tables_as_they_are(spark, tmp_path):
    """A second query in the session does the same work as the first and sees rows that have come since."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = []
    for most in (20, 40):
        documents.filter(f"doc_id < {most}").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        found.append(contract.queries()["kept_totals"](spark, str(tmp_path)).first().messages)
    assert found == [documents.filter(f"doc_id < {most}").count() for most in (20, 40)] and found[0] < found[1]
