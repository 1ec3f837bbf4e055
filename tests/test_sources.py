import sqlite3

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.types import LongType, StructField, StructType

from mailspark.schemas import MESSAGES
from mailspark.sources import sqlite
from mailspark.sources.mailbox import read_messages


@pytest.fixture
def mail_files(tmp_path):
    for box, size in (("a", 300), ("b", 5), ("empty", 0)):
        lite = sqlite3.connect(tmp_path / f"{box}.db")
        lite.execute("CREATE TABLE messages (id TEXT PRIMARY KEY, folder_id TEXT, subject TEXT, date TEXT, is_read INTEGER)")
        lite.executemany("INSERT INTO messages VALUES (?, 'f', ?, '2024-01-01 00:00:00', ?)",
                         [(f"{box}{n}", f"subject {n}", n % 2) for n in range(size)])
        lite.execute("DELETE FROM messages WHERE rowid = 2")
        lite.commit()
        lite.close()
    return str(tmp_path / "*.db")


def test_ingest_in_ranges(spark, mail_files, tmp_path):
    sqlite.ingest(spark, mail_files, "messages", MESSAGES, str(tmp_path / "out" / "messages"), range_bytes=4096)
    rows = read_messages(spark, str(tmp_path / "out")).collect()
    assert len(rows) == 303 and len({r.id for r in rows}) == 303
    first = next(r for r in rows if r.id == "a0")
    assert (first.rowid, first.subject, first.body_text, first.ts.year) == (1, "subject 0", None, 2024)


def test_ranges_cover_rows_once(mail_files):
    reader = sqlite.MailFileReader(StructType([StructField("rowid", LongType())]), {"path": mail_files, "rangebytes": "4096"})
    ranges = reader.partitions()
    assert len(ranges) > 3
    seen = [row for r in ranges for row in reader.read(r)]
    assert len(seen) == 299 + 4


def test_missing_input(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_messages(spark, str(tmp_path / "nowhere"))
    with pytest.raises(FileNotFoundError):
        sqlite.MailFileReader(StructType([]), {"path": str(tmp_path / "*.db")}).partitions()
