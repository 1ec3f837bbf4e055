from pyspark.sql import functions as F

from mailspark.functions.bodies import clean_plain, html_to_text, readable_body

HTML = {
    "Shopping:<ol><li>rye bread<li>salt</li></ol>Bye": "Shopping:\n\n• rye bread\n• salt\n\nBye",
    "<h2>Menu</h2>soup of the day<blockquote>served warm</blockquote>": "Menu\n\nsoup of the day\n\nserved warm",
    "train \t leaves\r\n  at  nine": "train leaves at nine",
    "seat&#xA0;12&thinsp;B": "seat 12 B",
    "<table><tr><th>Day</th><th>Hours</th></tr><tr><td>Mon</td><td>9-5</td></tr></table>": "Day Hours\nMon 9-5",
    "<b>fare</b> paid<!-- draft <i>note</i> --> today": "fare paid today",
    "never closed <!-- <p>rest": "never closed",
    "plat\u00adform\u2060 four\ufeff": "platform four",
    "<p> <br> </p>": "",
    "<title>Receipt</title>Total<STYLE media=print>p{margin:0}</STYLE> 5": "Total 5",
    "cut <script>if (a<b) {}": "cut",
    "1 &lt; 2 &amp;&amp; na&iuml;ve &#8364;3 &amp;lt;": "1 < 2 && naïve €3 &lt;",
    "north<br>south<HR/>east<article>west</article>": "north\nsouth\neast\nwest",
    "open end <a href=": "open end",
}


def test_html(spark):
    rows = spark.createDataFrame([(h,) for h in HTML], "h string")
    got = {r.h: r.t for r in rows.select("h", html_to_text(F.col("h")).alias("t")).collect()}
    assert got == HTML


def test_plain(spark):
    cases = {
        "Dear all,\r\rgate\u200b 7 opens \t\r\n\n\n\n  soon": "Dear all,\n\ngate 7 opens\n\n  soon",
        "\u2060\t \n": "",
        "five\u2003 tickets\u0007": "five  tickets",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.c for r in rows.select("t", clean_plain(F.col("t")).alias("c")).collect()} == cases


def test_best_body(spark):
    cases = [
        ("\nSee you there \n", "<i>other</i>", "short", "See you there"),
        (None, "<h1>Gate</h1>seven", "short", "Gate\n\nseven"),
        ("\u200b", None, " short\u00ad form ", "short form"),
        ("", "<hr><!-- x -->", None, ""),
        ("\u0301", "<p>a &amp; b", "short", "\u0301"),
        (" \u2060", "<p>a &amp; b", "short", "a & b"),
        ("€", "<p>a &amp; b", "short", "€"),
        ("", "<p>a and b", "x &amp; y", "a and b"),
    ]
    rows = spark.createDataFrame(cases, "t string, h string, s string, want string")
    for row in rows.withColumn("got", readable_body(F.col("t"), F.col("h"), F.col("s"))).collect():
        assert row.got == row.want
