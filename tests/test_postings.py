import random
import shutil
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailspark.operators import postings as P
from mailspark.operators import search as S
from mailspark.operators.index import apply_changes, search_text
from mailspark.operators.terms import flag, text

NOW = datetime(2024, 3, 15, 12)
WORDS = ["the", "of", "cat", "Ünder", "2024", "co-op", "日本", "then", "their", "a", "x1"]
TERMS = [
    [text("the")], [text("of the")], [text("the*")], [text("the", field="subject")], [text("th*", field="body")], [text("of the", field="body"), text("cat")],
    [text("the the")], [text("of th*")], [text("the"), ~text("cat")], [text("the"), ~text("of the"), ~text("2024", field="subject")], [text("日本")], [text("日*")],
    [text("under")], [text("co-op")], [text("---")], [text("the"), ~text("---")], [text("zebra")], [text("the"), text("a"), text("of cat")],
    [text("the"), flag("unread")], [~text("the")], [flag("unread"), ~text("cat*")],
]


def sentence(pick, most):
    return " ".join(pick.choice(WORDS) for _ in range(pick.randint(0, most)))


def random_mail(mail, count, seed, first=1):
    pick = random.Random(seed)
    rows = []
    for n in range(first, first + count):
        rows.append({
            "rowid": n * 37, "id": f"m{n:04d}", "subject": pick.choice([None, sentence(pick, 4)]), "from_name": sentence(pick, 2), "snippet": sentence(pick, 3),
            "body_text": sentence(pick, 25), "is_read": n % 2,
        })
    return mail(*rows)


@pytest.fixture(scope="module")
def written(spark, mail, tmp_path_factory):
    """Messages and their index, which tests only read."""
    path = str(tmp_path_factory.mktemp("postings") / "index")
    was, P.BLOCK_ROWS = P.BLOCK_ROWS, 256
    messages = random_mail(mail, 120, 1).cache()
    P.write_postings(messages, path)
    yield messages, path
    P.BLOCK_ROWS = was


@pytest.fixture
def indexed(written, tmp_path):
    """The same with an index of its own."""
    shutil.copytree(written[1], tmp_path / "index")
    return written[0], str(tmp_path / "index")


def rows_of(frame):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.collect()]


@pytest.fixture(autouse=True)
def few_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("number", range(len(TERMS)))
def test_same_rows_as_a_scan(spark, written, number):
    messages, path = written
    terms, index = TERMS[number], P.read_postings(spark, path)
    for limit, offset in [(0, 0) if number % 3 else (5, 3)]:
        want = S.search(messages, terms, now=NOW, limit=limit, offset=offset)
        got = S.search_stored(index, messages, terms, now=NOW, limit=limit, offset=offset)
        assert rows_of(got) == rows_of(want)


def explained(frame, capsys):
    frame.explain("formatted")
    return capsys.readouterr().out


def test_a_search_reads_the_folder_and_row_groups_of_its_tokens(spark, written, capsys):
    _, path = written
    index = P.read_postings(spark, path)
    hits = P.term_hits(index, text("cat"))
    shown = explained(hits, capsys)
    assert "(lead#" in shown.split("PartitionFilters")[1].splitlines()[0] and "= c)" in shown
    assert "EqualTo(token,cat)" in shown and "Exchange" not in shown
    assert "places" not in shown.split("ReadSchema")[1].splitlines()[0]
    files = {r.f for r in index.blocks_of("cat").select(F.input_file_name().alias("f")).collect()}
    assert files and all("/lead=c/" in f for f in files)
    prefixed = explained(P.term_hits(index, text("th*")), capsys)
    assert "StringStartsWith(token,th)" in prefixed


def test_a_phrase_search_reads_places_and_no_text(spark, written, capsys):
    _, path = written
    shown = explained(P.term_hits(P.read_postings(spark, path), text("of the")), capsys)
    assert "places" in shown and "pad_" not in shown and "body_text" not in shown and "subject" not in shown


def test_overlapping_phrases_count_each(spark, mail, tmp_path):
    messages = mail({"subject": "a a a a", "body_text": "a b a b a"}, {"subject": "a", "body_text": "a"})
    P.write_postings(messages, str(tmp_path / "i"))
    index = P.read_postings(spark, str(tmp_path / "i"))
    assert rows_of(P.term_hits(index, text("a a")).select("rowid", "n")) == [(1, 3)]
    assert rows_of(P.term_hits(index, text("a b a")).select("rowid", "n")) == [(1, 2)]
    # a phrase does not run over from one column to the next
    assert rows_of(P.term_hits(index, text("a a a a a"))) == []


def test_blocks_that_cannot_matter_are_skipped(spark, mail, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 10)
    monkeypatch.setattr(P, "SEED_BLOCKS", 2)
    rows = [{"rowid": n, "id": f"m{n:03d}", "subject": "word " * (9 if n in (55, 57, 140) else 1), "body_text": "filler " * (n % 7 + 5)} for n in range(200)]
    rows += [{"rowid": n, "id": f"m{n:03d}", "subject": "nothing", "body_text": "here"} for n in range(200, 800)]
    messages = mail(*rows)
    P.write_postings(messages, str(tmp_path / "i"))
    index = P.read_postings(spark, str(tmp_path / "i"))
    terms = [text("word")]
    known = P.weights(index, terms)
    worst = P.worst_kept(index, terms, known, 3)
    everything = {r.block for r in index.blocks_of("word").collect()}
    kept = {r.block for r in P.candidate_blocks(index, terms, known, worst).collect()}
    assert len(everything) == 20 and kept == {5, 14}
    assert rows_of(S.search_stored(index, messages, terms, limit=3)) == rows_of(S.search(messages, terms, limit=3))


def test_bounds_hold_for_every_message(spark, written):
    messages, path = written
    index = P.read_postings(spark, path)
    for terms in ([text("the")], [text("of the"), text("cat")], [text("th*"), text("a", field="body")]):
        known = P.weights(index, terms)
        bounds = {r.block: r.bound for r in P.block_bounds(index, terms, known).collect()}
        for row in P.scored_rows(index, terms, known).collect():
            assert row.score >= bounds[row.rowid // P.BLOCK_ROWS] - 1e-9


def test_postings_are_made_without_a_row_for_each_token(spark, written, capsys):
    _, path = written
    shown = explained(P._posting_blocks(P._stored(spark, path, "forward", 0)), capsys)
    assert "Generate" not in shown and "collect_list" not in shown and shown.count("Exchange (") == 1


def test_tasks_in_small_portions_lose_no_place(monkeypatch):
    """Repeated rows are one message, rows without row id too; portions end where a message, or a block that is not too heavy, ends."""
    pick = random.Random(3)
    rows = [[n, -1, True, 7, n // 8, *["  " + "".join(f"{pick.choice('abcde')}  " for _ in range(pick.randint(0, 4))) for _ in P.PADS]] for n in range(40)]
    rows = [[None, -1, True, 7, None, "  a  ", *["  "] * 5], [None, -1, True, 7, None, "  a  b  ", *["  "] * 5]] + [r for n, r in enumerate(rows) for _ in range(1 + (n % 9 == 0))]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.string()] * 6]
    names = [*P.KEYS, "block", *P.PADS]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 5]], kinds[k]) for k in range(11)], names=names) for i in range(0, len(rows), 5)]
    want = {}
    for r in rows:
        for k, padded in enumerate(r[5:]):
            for i, token in enumerate(padded.split()):
                want.setdefault((r[4], token, r[0]), []).append(k * P.COLUMN_STEP + i)
    for text_at_once, entries_at_once in ((1, 1), (200, 30), (1 << 20, 1 << 20)):
        monkeypatch.setattr(P, "TEXT_AT_ONCE", text_at_once)
        monkeypatch.setattr(P, "ENTRIES_AT_ONCE", entries_at_once)
        found = {}
        for block in [b for batch in P.block_postings_task(iter(batches)) for b in batch.to_pylist()]:
            assert block["most"] == max(d["n"] for d in block["docs"]) and block["shortest"] == 7
            for d in block["docs"]:
                assert d["n"] == len(d["places"]) and d["bits"] == sum({1 << (p // P.COLUMN_STEP) for p in d["places"]})
                assert (block["block"], block["token"], d["rowid"]) not in found
                found[block["block"], block["token"], d["rowid"]] = d["places"]
        assert found == {key: sorted(places) for key, places in want.items()}


def test_messages_of_a_block_are_lists_of_numbers_and_come_by_token(spark, written):
    """No structure for each message; a task's portion is a sorted run, and places are found by their start."""
    _, path = written
    index = P.read_postings(spark, path)
    assert dict(index.postings.dtypes)["docs"].startswith("struct<rowid:array<bigint>,n:array<int>")
    for row in index.postings.collect():
        docs = row.docs
        assert row.holding == len(docs.rowid) == len(docs.start) and docs.start == [sum(docs.n[:i]) for i in range(len(docs.n))]
        assert len(docs.places) == sum(docs.n)
    forward = P._stored(spark, path, "forward", 0).withColumn("block", F.floor(F.col("rowid") / P.BLOCK_ROWS)).orderBy("block", *P.KEYS)
    batches = [pa.RecordBatch.from_pandas(forward.toPandas(), preserve_index=False)]
    tokens = [t for batch in P.stored_blocks_task(iter(batches)) for t in batch.column("token").to_pylist()]
    assert len(set(tokens)) < len(tokens) and tokens == sorted(tokens, key=str.encode)


def test_tokens_that_changes_take_back_are_counted_without_a_row_for_each(spark, written, capsys, monkeypatch):
    _, path = written
    forward = P._stored(spark, path, "forward", 0)
    assert "Generate" not in explained(P._token_holding(forward), capsys)
    kept = {r.token: r.holding for r in P.read_postings(spark, path).tokens.collect()}
    rows = forward.unionByName(forward.filter("rowid % 2 = 0")).orderBy(*P.KEYS).toPandas()
    batches = [pa.RecordBatch.from_pandas(rows[i : i + 7], preserve_index=False) for i in range(0, len(rows), 7)]
    for most in (1, 300, 1 << 20):
        monkeypatch.setattr(P, "TEXT_AT_ONCE", most)
        found = {}
        for batch in P.holding_task(iter(batches)):
            for r in batch.to_pylist():
                found[r["token"]] = found.get(r["token"], 0) + r["holding"]
        assert found == kept


def test_texts_are_made_once_and_lie_in_ranges_of_row_ids(spark, mail, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    monkeypatch.setattr(P, "RANGE_ROWS", 10)
    made = spark.sparkContext.accumulator(0)

    def counted(value):
        made.add(1)
        return value

    rows = [{"rowid": n * 3 if n % 10 else None, "subject": f"cat {n}", "body_text": "the"} for n in range(80)]
    P.write_postings(mail(*rows).withColumn("body_text", F.udf(counted, "string")("body_text")), str(tmp_path / "i"))
    assert made.value == len(rows)
    forward = P._stored(spark, str(tmp_path / "i"), "forward", 0)
    spans = forward.groupBy(F.input_file_name()).agg(F.min("rowid").alias("low"), F.max("rowid").alias("high")).orderBy("low").collect()
    assert len(spans) == 4 and all(a.high < b.low for a, b in zip(spans, spans[1:]))
    index = P.read_postings(spark, str(tmp_path / "i"))
    assert sorted(r.rowid for r in P.term_hits(index, text("the")).collect() if r.rowid is not None) == [n * 3 for n in range(80) if n % 10]


@pytest.mark.parametrize("rowid", [7, None])
def test_equal_row_ids_and_none(spark, mail, tmp_path, monkeypatch, rowid):
    monkeypatch.setattr(P, "RANGE_ROWS", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    P.write_postings(mail(*[{"rowid": rowid, "subject": f"cat {n}"} for n in range(9)]), str(tmp_path / "i"))
    assert P._stored(spark, str(tmp_path / "i"), "forward", 0).count() == 9


def test_numbers_of_postings_are_stored_as_differences(written):
    import glob

    import pyarrow.parquet as pq

    for file in glob.glob(f"{written[1]}/postings/gen=0/*/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = [group.column(k) for k in range(group.num_columns)]
        assert all("DELTA_BINARY_PACKED" in c.encodings for c in columns if c.physical_type in ("INT32", "INT64"))


def test_forward_rows_are_stored_small(written):
    import glob

    import pyarrow.parquet as pq

    files = glob.glob(f"{written[1]}/forward/gen=0/*.parquet")
    assert files and {pq.ParquetFile(f).metadata.row_group(0).column(k).compression for f in files for k in range(10)} == {"ZSTD"}


@pytest.mark.parametrize("count", [1, 2, 3, 10, 599])
def test_the_range_of_a_row_is_found_among_few_ends(spark, count, capsys):
    ends = sorted(random.Random(count).sample(range(-5000, 5000), count))
    rows = spark.createDataFrame([(n,) for n in (*range(-5001, 5002, 7), *ends, None)], "rowid long")
    numbered = rows.select("rowid", P._below("rowid", [float(e) for e in ends]).alias("range"))
    for row in numbered.collect():
        assert row.range == sum(row.rowid is not None and row.rowid > e for e in ends)
    # one list to choose a step by and slices of one step, no filter over all ends
    assert count < 4 or f"filter([{float(ends[0])},{float(ends[1])}" not in explained(numbered, capsys).replace(", ", ",")


# --- changes


def change_rows(spark, mail, count, seed):
    old = random_mail(mail, count, seed + 100)
    op = F.element_at(F.array(F.lit("update"), F.lit("delete"), F.lit("insert")), (F.col("rowid") % 3 + 1).cast("int"))
    return old.select(op.alias("op"), (F.col("rowid") * 10 + seed).alias("seq"), "*")


def state(spark, path):
    index = P.read_postings(spark, path)
    found = {}
    for word in ("the", "cat", "2024", "a"):
        found[word] = sorted(rows_of(P.term_hits(index, text(word))))
    found["phrase"] = sorted(rows_of(P.term_hits(index, text("of the"))))
    found["scores"] = sorted(rows_of(P.ranked_rows(index, [text("the"), ~text("cat")])))
    found["totals"] = rows_of(P.corpus_totals(index))
    found["tokens"] = sorted(rows_of(index.tokens.groupBy("token").agg(F.sum("holding").alias("n")).filter("n <> 0")))
    return found


def test_changes_and_compaction_equal_an_index_of_the_result(spark, mail, indexed, tmp_path):
    messages, path = indexed
    first, second = change_rows(spark, mail, 60, 5), change_rows(spark, mail, 150, 6).filter("rowid % 5 > 0")
    P.add_changes(spark, path, first)
    P.add_changes(spark, path, second)
    current = search_text(messages)
    both = first.unionByName(second).groupBy("rowid").agg(F.max_by(F.struct("*"), "seq").alias("r")).select("r.*")
    after = apply_changes(current, search_text(both).join(both.select("rowid", "op", "seq"), "rowid"))
    fresh = str(tmp_path / "fresh")
    P.write_postings(after, fresh)
    want = state(spark, fresh)
    assert state(spark, path) == want
    P.compact(spark, path)
    assert P.read_postings(spark, path).gone is None
    assert state(spark, path) == want
    P.add_changes(spark, path, change_rows(spark, mail, 1, 9).filter("false"))
    assert state(spark, path) == want


def test_older_and_repeated_changes_do_nothing(spark, mail, indexed):
    messages, path = indexed
    newer = messages.filter("rowid = 37").select(F.lit("update").alias("op"), F.lit(9).cast("long").alias("seq"), "*").withColumn("subject", F.lit("fresh cat"))
    P.add_changes(spark, path, newer, "one")
    want = state(spark, path)
    P.add_changes(spark, path, newer, "one")
    assert P.read_postings(spark, path).gen == 1
    older = newer.withColumns({"seq": F.lit(3).cast("long"), "subject": F.lit("stale")})
    P.add_changes(spark, path, older)
    assert state(spark, path) == want
    gone = newer.withColumns({"seq": F.lit(20).cast("long"), "op": F.lit("delete")})
    P.add_changes(spark, path, gone)
    P.add_changes(spark, path, newer.withColumn("seq", F.lit(15).cast("long")))
    assert not [r for r in state(spark, path)["cat"] if r[0] == 37]


def test_a_generation_cut_off_is_not_seen_and_written_again(spark, mail, indexed, monkeypatch):
    messages, path = indexed
    want = state(spark, path)
    changes = change_rows(spark, mail, 20, 7)
    with monkeypatch.context() as broken:
        broken.setattr(P, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            P.add_changes(spark, path, changes)
    assert state(spark, path) == want
    P.add_changes(spark, path, changes)
    assert state(spark, path) != want


def test_a_batch_reads_only_forward_rows_of_its_range(spark, written, capsys):
    _, path = written
    index = P.read_postings(spark, path)
    shown = explained(P._current_forward(spark, index, F.col("rowid").between(100, 200)), capsys)
    assert "GreaterThanOrEqual(rowid,100)" in shown and "LessThanOrEqual(rowid,200)" in shown


def test_empty_mailbox(spark, mail, tmp_path):
    P.write_postings(random_mail(mail, 3, 1).filter("false"), str(tmp_path / "i"))
    index = P.read_postings(spark, str(tmp_path / "i"))
    assert P.ranked_rows(index, [text("the")], 5).count() == 0
    assert P.corpus_totals(index).first().messages in (0, None)
