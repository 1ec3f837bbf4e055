import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.maxMetadataStringLength", "4000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()


MAIL = (
    "rowid bigint, id string, folder_id string, message_id string, thread_id string, from_address string, from_name string,"
    " to_addresses string, cc_addresses string, bcc_addresses string, subject string, snippet string, body_text string,"
    " body_html string, date string, is_read int, is_flagged int, has_attachments int, is_draft int"
)
DEFAULTS = {
    "folder_id": "fi", "from_address": "a@x.example", "to_addresses": "[]", "subject": "", "date": "2024-01-01 00:00:00",
    "is_read": 0, "is_flagged": 0, "has_attachments": 0, "is_draft": 0,
}


@pytest.fixture(scope="session")
def mail(spark):
    """Messages from dicts; row ids count up and missing fields get plain values."""

    def build(*rows):
        names = [part.strip().split(" ")[0] for part in MAIL.split(",")]
        full = [DEFAULTS | {"rowid": n, "id": str(n)} | row for n, row in enumerate(rows, 1)]
        return spark.createDataFrame([tuple(r.get(c) for c in names) for r in full], MAIL)

    return build
