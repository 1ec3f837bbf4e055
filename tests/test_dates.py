from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mailspark.functions import dates, display

NOW = datetime(2024, 3, 31, 8, 30, 15)
RELATIVE = {
    "36h": datetime(2024, 3, 29, 20, 30, 15), "1 hour": datetime(2024, 3, 31, 7, 30, 15), "7d": datetime(2024, 3, 24, 8, 30, 15),
    "2weeks": datetime(2024, 3, 17, 8, 30, 15), "1month": datetime(2024, 3, 2, 8, 30, 15), "2 Months": datetime(2024, 1, 31, 8, 30, 15),
    "1yr": datetime(2023, 3, 31, 8, 30, 15), "13mo": datetime(2023, 3, 3, 8, 30, 15),
}
ABSOLUTE = {
    "2024-01-31": datetime(2024, 1, 31), "2024/01/31": datetime(2024, 1, 31), "2024-01-31 7:05": datetime(2024, 1, 31, 7, 5),
    "2024-01-31T10:20": datetime(2024, 1, 31, 10, 20), "2024-01-31 10:20:30": datetime(2024, 1, 31, 10, 20, 30),
    "2024-01-31T10:20:30.75": datetime(2024, 1, 31, 10, 20, 30),
}
BAD = ["soon", "", "1fortnight", "2024-02-30", "2024/01/31 10:00", "d", "2024-1-5"]


def test_cutoffs_of_values():
    for text, wanted in (RELATIVE | ABSOLUTE).items():
        assert dates.cutoff(text, NOW) == wanted, text
    for text in BAD:
        with pytest.raises(ValueError):
            dates.cutoff(text, NOW)
    zone = timezone(timedelta(hours=9))
    assert dates.cutoff("1h", NOW.replace(tzinfo=timezone.utc).astimezone(zone)) == datetime(2024, 3, 31, 7, 30, 15)


def test_cutoffs_of_columns(spark):
    wanted = RELATIVE | ABSOLUTE | dict.fromkeys(BAD)
    rows = spark.createDataFrame([(t,) for t in wanted], "t string")
    got = {r.t: r.c for r in rows.select("t", dates.cutoff_column(F.col("t"), NOW).alias("c")).collect()}
    assert got == wanted


def test_instants_and_display(spark):
    cases = {
        "2024-01-02 03:04:05": (datetime(2024, 1, 2, 3, 4, 5), "2024-01-02 03:04"),
        "2015-03-20T00:00:00.000Z": (datetime(2015, 3, 20), "2015-03-20 00:00"),
        "2024-01-02T03:04:05+02:00": (datetime(2024, 1, 2, 1, 4, 5), "2024-01-02 03:04"),
        "2024-01-02": (datetime(2024, 1, 2), "2024-01-02 00:00"),
        "no date at all, really": (None, "no date at all,…"),
        "": (None, ""),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: (r.i, r.d) for r in rows.select("t", dates.instant(F.col("t")).alias("i"), dates.display_date(F.col("t")).alias("d")).collect()}
    assert got == cases


def test_listing(mail):
    rows = mail(
        {"from_name": "Bob", "from_address": "b@x", "subject": "  ", "is_flagged": 1, "snippet": "s" * 120},
        {"from_name": None, "from_address": "b@x", "subject": "S" * 80, "is_read": 1, "has_attachments": 1},
    )
    one, two = rows.select(*display.listing_columns()).orderBy("id").collect()
    assert (one.badge, one.sender, one.shown_subject, len(one.shown_snippet)) == ("[U* ]", "Bob <b@x>", "(no subject)", 100)
    assert (two.badge, two.sender, len(two.log_subject), two.log_subject[-1]) == ("[  @]", "b@x", 72, "…")


def test_snippet(spark):
    rows = spark.createDataFrame([(" a\nb ",), ("x" * 141,), (" \n ",), (None,)], "t string").select(display.snippet(F.col("t")).alias("s"))
    assert [r.s for r in rows.collect()] == ["a b", "x" * 139 + "…", None, None]
