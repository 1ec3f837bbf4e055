import random
import sqlite3

from pyspark.sql import functions as F

from mailspark.functions import text as T


def test_values_fold_like_the_text_index():
    """Tokens of single letters equal those of SQLite's default text tokenizer."""
    letters = [c for c in list(range(0xA0, 0x250)) + list(range(0x300, 0x332)) + list(range(0x1E00, 0x1F00)) + [0x3C2, 0x3D1]]
    lite = sqlite3.connect(":memory:")
    lite.execute("CREATE VIRTUAL TABLE t USING fts5(a)")
    lite.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    lite.executemany("INSERT INTO t(rowid, a) VALUES (?, ?)", [(c, f"x{chr(c)}y") for c in letters])
    wanted = {}
    for term, row in lite.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        wanted.setdefault(row, []).append(term)
    assert {c: T.fold_value(f"x{chr(c)}y") for c in letters} == wanted


def test_columns_tokenize_like_values(spark):
    values = ["Réunion café X²y", "ß foo_bar 日本語", "---", "", " été ", "a½b, c", "İstanbul ÅÄÖ ǖ", "bob@example.com"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.pad(F.col("v")).alias("p"))
    for row in rows.select("v", T.token_array(F.col("p")).alias("t"), T.token_count(F.col("p")).alias("n")).collect():
        assert row.t == T.fold_value(row.v)
        assert row.n == len(row.t)


def test_occurrences_match_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "ab", "b", "abc"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    rows = spark.createDataFrame([(v,) for v in texts], "v string").withColumn("p", T.pad(F.col("v")))
    for words, prefix in [(["a"], False), (["a", "a"], False), (["a", "b", "a"], False), (["ab", "a"], True), (["a"], True), (["a", "a"], True)]:
        wanted = T.needle(words, prefix)
        for row in rows.select("v", T.occurrences(F.col("p"), wanted).alias("n")).collect():
            tokens = row.v.split()
            hits = 0
            for i in range(len(tokens) - len(words) + 1):
                part = tokens[i : i + len(words)]
                last = part[-1].startswith(words[-1]) if prefix else part[-1] == words[-1]
                hits += part[:-1] == words[:-1] and last
            assert row.n == hits, (row.v, wanted)
