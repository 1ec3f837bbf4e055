"""The stored text index: where each token stands, clustered by token, kept current by generations.

A *posting block* is one row for a token and a range of row ids: the messages holding the token with its places in them, the highest number of
occurrences and the smallest message length of the block. Blocks lie in folders by the token's first character and are sorted by token inside, so a
search for a token reads one folder and, by the files' statistics, the pages of that token. Each file covers its own blocks: postings are written by the
task that makes them, and what is shuffled is text. Places are numbers in which neighbouring words of one
column differ by one, so a phrase is an intersection of shifted places and never looks at text.

Tables under the index path, each in folders by generation (``gen``):

* ``postings`` (lead, token, block, docs, most, shortest, holding): posting blocks
* ``forward`` (rowid, seq, live, doc_len, pad_*): by row id, what the postings are made from and a later change has to take back
* ``gone`` (rowid): rows of earlier generations that this one replaces or deletes
* ``tokens`` (lead, token, holding) and ``totals`` (messages, length): differences that add up to document frequencies and corpus totals
* ``commits`` (gen, base, change_set): written last; a reader sees the generations from ``base`` to the last one committed

Changes only add a generation; ``compact`` writes all of them as a new base.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import isqrt, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.functions.text import TEXT_COLUMNS
from mailspark.operators.index import newest_changes, search_text, text_column, with_index
from mailspark.operators.rank import B, FLOOR_IDF, K1
from mailspark.operators.terms import Text
from mailspark.schemas import mailbox_key

#: Row ids of a posting block. Bounds are per block, so smaller blocks skip more and cost more rows.
BLOCK_ROWS = 1024
#: Blocks with the highest bounds, whose scores say which other blocks cannot matter.
SEED_BLOCKS = 8
#: Places of the columns of a message are this far apart.
COLUMN_STEP = 1 << 32
COLUMN_BITS = {c: 1 << i for i, c in enumerate(TEXT_COLUMNS)}
ALL_BITS = sum(COLUMN_BITS.values())


# --- building ------------------------------------------------------------------------------------------------


def lead_of(token: Column) -> Column:
    """The folder of a token: its first character if that is a-z or 0-9, else ``~``."""
    first = F.substring(token, 1, 1)
    return F.when(first.between("a", "z") | first.between("0", "9"), first).otherwise(F.lit("~"))


#: Equal rows of these columns are one message.
KEYS = ("rowid", "seq", "live", "doc_len")
PADS = tuple(f"pad_{c}" for c in TEXT_COLUMNS)
KEY_COLUMNS = "rowid bigint, seq bigint, live boolean, doc_len bigint"
FORWARD = ", ".join([KEY_COLUMNS, *(f"{c} string" for c in PADS)])
#: Stored blocks: the messages of a block in lists of their own, places one list after another from ``start`` on; ``holding`` counts the messages.
DOCS = "rowid:array<bigint>,n:array<int>,bits:array<int>,len:array<bigint>,start:array<int>,places:array<bigint>"
BLOCKS = f"token string, block bigint, docs struct<{DOCS}>, most int, shortest bigint, holding int"
#: Tokens whose postings a task makes and sorts; while cores are idle, a task may have as few as LEAST_TOKENS.
TASK_TOKENS, LEAST_TOKENS = 1 << 22, 1 << 19
#: Least rows of a range of row ids.
RANGE_ROWS = 1 << 10
#: Row ids, counts, lengths and places are stored as differences, which costs less time than looking each number up in a dictionary and reads faster.
#: Padded text shrinks by another third with zstd, in the same time.
LAYOUT = {
    "postings": {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"},
    "forward": {"compression": "zstd"},
}
#: Bytes of padded text that a task turns into arrays at once, and entries (of a token in a message) that it hands on at once.
TEXT_AT_ONCE, ENTRIES_AT_ONCE = 8 << 20, 1 << 20


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether each row differs from the row before in one of the keys; nulls are equal."""
    new = np.zeros(len(table), dtype=bool)
    new[:1] = True
    for key in keys:
        values = table[key].combine_chunks()
        differ = pc.not_equal(values[1:], values[:-1]).fill_null(False)
        unlike = pc.xor(values.is_null()[1:], values.is_null()[:-1])
        new[1:] |= pc.or_(differ, unlike).to_numpy(zero_copy_only=False)
    return new


def _text_weight(table: pa.Table) -> np.ndarray:
    return sum(pc.binary_length(table[c]).to_numpy().astype(np.int64) for c in PADS)


def _portions(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Forward rows in portions of about TEXT_AT_ONCE, cut where a key changes, or inside a run of one key that is heavier; no message is cut."""
    held, load = [], 0

    def cut(last: bool) -> Iterator[pa.Table]:
        nonlocal held, load
        table = pa.concat_tables(held)
        at = len(table)
        if not last:
            at = int(np.flatnonzero(_starts(table, keys))[-1]) or int(np.flatnonzero(_starts(table, KEYS))[-1])
        if at:
            yield table.slice(0, at)
        held = [table.slice(at)] if at < len(table) else []
        load = _text_weight(held[0]).sum() if held else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        reach = np.cumsum(_text_weight(table))
        begin = 0
        while begin < len(table):
            done = reach[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(reach, done + TEXT_AT_ONCE, side="right")))
            held.append(table.slice(begin, end - begin))
            load += reach[min(end, len(table)) - 1] - done
            begin = end
            if load >= TEXT_AT_ONCE:
                yield from cut(False)
    if held:
        yield from cut(True)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place, code) of each token of forward rows, column by column, and the tokens that the codes stand for, in their order."""
    # a padded column begins and ends with a gap of two blanks, as there are between its tokens
    parts = [pc.split_pattern(table[c].combine_chunks().cast(pa.large_string()), "  ") for c in PADS]
    coded = pa.chunked_array([p.flatten() for p in parts]).combine_chunks().dictionary_encode()
    ordered = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(ordered), dtype=np.int64)
    rank[ordered] = np.arange(len(ordered))
    codes, blank = rank[coded.indices.to_numpy()], 0  # the empty token sorts first
    rows, places, real, begin = [], [], [], 0
    for k, part in enumerate(parts):
        sizes = pc.list_value_length(part).to_numpy().astype(np.int64)
        code = codes[begin : begin + sizes.sum()]
        begin += len(code)
        kept = code != blank
        row = np.repeat(np.arange(len(sizes)), sizes)[kept]
        counts = np.bincount(row, minlength=len(sizes))
        rows.append(row)
        places.append(np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + k * COLUMN_STEP)
        real.append(code[kept])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(real), coded.dictionary.take(pa.array(ordered)).cast(pa.string())


def _order(key: np.ndarray) -> np.ndarray:
    """The places of the keys in their order; equal ones stay as they are."""
    bits = max(1, int(len(key)).bit_length())
    if len(key) and int(key.max()).bit_length() + bits > 62:
        return np.argsort(key, kind="stable")
    # numbers without ties sort much faster than their places do
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def _changes(*values: np.ndarray) -> np.ndarray:
    """Where one of the values differs from the one before, the first place included."""
    return np.flatnonzero(np.concatenate([[True], reduce(np.logical_or, [v[1:] != v[:-1] for v in values])]))


def block_postings_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward rows with their block, in order of block and keys, to posting blocks; a block that is heavy or lies apart is given in several pieces.

    Those of a portion come in order of token, so that Spark's sort only merges a few runs.
    """
    for table in _portions(batches, ["block"]):
        first = _starts(table, KEYS)
        row, place, code, tokens = _tokens(table)
        if not len(row):
            continue
        message = (np.cumsum(first) - 1)[row]
        key = code * len(table) + message
        # places of a message given by one row come in order
        order = _order(key) if first.all() else np.lexsort((place, key))
        message, code, place = message[order], code[order], place[order]
        new = _changes(code, message)
        message, code = message[new], code[new]
        n = np.diff(np.append(new, len(place)))
        bits = np.bitwise_or.reduceat(1 << (place // COLUMN_STEP), new)
        rows = np.flatnonzero(first)
        begins = _changes(code, (np.cumsum(_starts(table, ["block"])) - 1)[rows][message])
        held, at = np.diff(np.append(begins, len(code))), pa.array(rows[message])
        length = table["doc_len"].combine_chunks().take(at)
        docs = {
            "rowid": table["rowid"].combine_chunks().take(at),
            "n": pa.array(n, pa.int32()),
            "bits": pa.array(bits, pa.int32()),
            "len": length,
            "places": pa.ListArray.from_arrays(pa.array(np.append(new, len(place)), pa.int32()), pa.array(place)),
        }
        blocks = pa.table({
            "token": tokens.take(pa.array(code[begins])),
            "block": table["block"].combine_chunks().take(at.take(pa.array(begins))),
            "docs": pa.ListArray.from_arrays(pa.array(np.append(begins, len(code)), pa.int32()), pa.StructArray.from_arrays(list(docs.values()), names=list(docs))),
            "most": pa.array(np.maximum.reduceat(n, begins), pa.int32()),
            "shortest": pa.array(np.minimum.reduceat(length.to_numpy(), begins)),
            "holding": pa.array(held, pa.int32()),
        })
        done = 0
        while done < len(begins):
            end = max(done + 1, int(np.searchsorted(begins, begins[done] + ENTRIES_AT_ONCE, side="right")) - 1)
            end = len(begins) if len(code) - begins[done] <= ENTRIES_AT_ONCE else end
            yield from blocks.slice(done, end - done).to_batches()
            done = end


def stored_blocks_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with the messages of a block in lists of numbers, which Spark sorts and writes at far less cost than a structure for each message."""
    for batch in block_postings_task(batches):
        lists = batch.column("docs")
        entry, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        places = entry.field("places")
        starts = places.offsets.to_numpy() - places.offsets[0].as_py()
        begins = np.repeat(starts[offsets[:-1]], np.diff(offsets))
        fields = {f: (offsets, entry.field(f)) for f in ("rowid", "n", "bits", "len")}
        fields |= {"start": (offsets, pa.array(starts[:-1] - begins, pa.int32())), "places": (starts[offsets], places.flatten())}
        docs = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in fields.values()], names=list(fields))
        yield batch.set_column(batch.schema.get_field_index("docs"), "docs", docs)


def holding_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward rows, equal keys side by side, to tokens with the number of messages that hold them, a row for each portion of the rows."""
    for table in _portions(batches, KEYS):
        row, _, code, tokens = _tokens(table)
        pairs = np.unique(code * len(table) + (np.cumsum(_starts(table, KEYS)) - 1)[row])
        counts = np.bincount(pairs // len(table), minlength=len(tokens))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([tokens.take(pa.array(held)), pa.array(counts[held])], names=["token", "holding"])


def _in_ranges(texts: DataFrame) -> DataFrame:
    """Rows in ranges of row ids whose ends come from the row ids alone; Spark's own sampling would make every text twice."""
    ids = texts.select("rowid")
    most = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, ids.count() // RANGE_ROWS))
    ends = sorted(set(ids.approxQuantile("rowid", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    if not ends:
        return texts.repartition(1)
    return texts.repartitionById(len(ends) + 1, _below("rowid", ends))


def _below(column: str, ends: list) -> Column:
    """How many of the sorted ends lie below a number, 0 for null; looks at every ``step``-th end and then at one step, so that more ranges hardly cost a row more."""
    step = isqrt(len(ends))
    lower = lambda some: F.coalesce(F.size(F.filter(some, lambda end: F.col(column) > end)), F.lit(0))
    begin = lower(F.lit(ends[step - 1 :: step])) * step
    return begin + lower(F.slice(F.lit(ends), begin + 1, F.lit(step)))


def _forward(texts: DataFrame) -> DataFrame:
    """Forward rows, made from ranges of row ids; ``texts`` has rowid, seq, live and the text columns. Texts are shuffled before they are padded."""
    empty = F.lit(0).cast("long"), F.lit("  ")
    indexed = with_index(texts)
    live = {c: F.when(F.col("live"), F.col(c)).otherwise(empty[c != "doc_len"]) for c in ("doc_len", *PADS)}
    return indexed.withColumns(live).select(*KEYS, *PADS).sortWithinPartitions("rowid")


def _token_holding(forward: DataFrame) -> DataFrame:
    """(token, holding) of forward rows, in parts that add up."""
    return forward.repartition("rowid").sortWithinPartitions(*KEYS).mapInArrow(holding_task, "token string, holding bigint")


def _posting_blocks(forward: DataFrame) -> DataFrame:
    """Posting blocks of stored forward rows, each task's in order of folder and token.

    Only padded text is shuffled, to tasks of whole blocks with about TASK_TOKENS tokens: no token of a message ever is a row of its own.
    """
    tokens = forward.agg(F.coalesce(F.sum("doc_len"), F.lit(0))).first()[0]
    cores = forward.sparkSession.sparkContext.defaultParallelism
    tasks = max(tokens // TASK_TOKENS + 1, min(cores, tokens // LEAST_TOKENS + 1))
    rows = forward.withColumn("block", F.floor(F.col("rowid") / BLOCK_ROWS)).repartition(tasks, "block")
    blocks = rows.sortWithinPartitions("block", *KEYS).mapInArrow(stored_blocks_task, BLOCKS)
    return blocks.withColumn("lead", lead_of(F.col("token"))).sortWithinPartitions("lead", "token", "block")


def _write(frame: DataFrame, path: str, table: str, gen: int, *by: str) -> None:
    writer = frame.write.mode("overwrite").options(**LAYOUT.get(table, {}))
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{table}/gen={gen}")


def _stored(spark: SparkSession, path: str, table: str, gen: int) -> DataFrame:
    """A table of one generation, committed or not."""
    rows = spark.read.schema(SCHEMAS[table]).option("basePath", f"{path}/{table}").parquet(f"{path}/{table}/gen={gen}")
    return rows.drop("gen")


def _write_generation(rows: DataFrame, path: str, gen: int) -> None:
    """Forward rows as given and from them the postings; rows that are not live have none."""
    _write(rows, path, "forward", gen)
    _write(_posting_blocks(_stored(rows.sparkSession, path, "forward", gen)), path, "postings", gen, "lead")


def _length_totals(forward: DataFrame, sign: int) -> DataFrame:
    amounts = F.count(F.lit(1)) * sign, F.coalesce(F.sum("doc_len"), F.lit(0)) * sign
    return forward.filter("live").select(*KEYS).distinct().agg(amounts[0].alias("messages"), amounts[1].alias("length"))


def _write_totals(spark: SparkSession, old: DataFrame | None, path: str, gen: int) -> None:
    """Differences of document frequencies and corpus totals: what the generation's rows add and ``old`` ones took back."""
    holding = F.sum("holding").alias("holding")
    counts, lengths = _stored(spark, path, "postings", gen).groupBy("token").agg(holding), _length_totals(_stored(spark, path, "forward", gen), 1)
    if old is not None:
        taken = _token_holding(old).groupBy("token").agg((-F.sum("holding")).alias("holding"))
        counts = counts.unionByName(taken).groupBy("token").agg(F.sum("holding").alias("holding")).filter("holding <> 0")
        lengths = lengths.unionByName(_length_totals(old, -1))
    counts = counts.withColumn("lead", lead_of(F.col("token")))
    _write(counts.repartitionByRange("lead", "token").sortWithinPartitions("lead", "token"), path, "tokens", gen, "lead")
    _write(lengths.agg(F.sum("messages").alias("messages"), F.sum("length").alias("length")), path, "totals", gen)


def _commit(spark: SparkSession, path: str, gen: int, base: int, change_set: str = "") -> None:
    row = spark.range(1).select(F.lit(base).cast("long").alias("base"), F.lit(change_set).alias("change_set"))
    row.write.mode("overwrite").parquet(f"{path}/commits/gen={gen}")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("base bigint, change_set string, gen bigint").option("basePath", f"{path}/commits").parquet(f"{path}/commits")


def write_postings(messages: DataFrame, path: str) -> None:
    """Index all ``messages`` as generation 0 of a new index."""
    spark = messages.sparkSession
    rows = search_text(messages).withColumns({"seq": F.lit(-1).cast("long"), "live": F.lit(True)})
    _write_generation(_forward(_in_ranges(rows)), path, 0)
    _write_totals(spark, None, path, 0)
    _commit(spark, path, 0, 0)


# --- reading -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Postings:
    """The tables of an index as of one committed generation."""

    path: str
    base: int
    gen: int
    postings: DataFrame
    tokens: DataFrame
    totals: DataFrame
    gone: DataFrame | None

    def blocks_of(self, token: str, prefix: bool = False) -> DataFrame:
        """Posting blocks of one token, or of all tokens that begin so."""
        return self.postings.filter(_wanted(token, prefix))


SCHEMAS = {
    "postings": f"{BLOCKS}, gen bigint, lead string",
    "forward": f"{FORWARD}, gen bigint",
    "tokens": "token string, holding bigint, gen bigint, lead string",
    "totals": "messages bigint, length bigint, gen bigint",
    "gone": "rowid bigint, gen bigint",
}


def _table(spark: SparkSession, path: str, table: str, base: int, gen: int) -> DataFrame:
    rows = spark.read.schema(SCHEMAS[table]).option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    return rows.filter(F.col("gen").between(base, gen))


def read_postings(spark: SparkSession, path: str) -> Postings:
    """The index at ``path`` as of its last committed generation."""
    base, gen = _commits(spark, path).agg(F.max_by("base", "gen"), F.max("gen")).first()
    held = {t: _table(spark, path, t, base, gen) for t in ("postings", "tokens", "totals")}
    gone = _table(spark, path, "gone", base + 1, gen) if gen > base else None
    return Postings(path, base, gen, held["postings"], held["tokens"], held["totals"], gone)


def _wanted(token: str, prefix: bool) -> Column:
    """Filters on folder and token that reach the scan."""
    first = token[:1]
    lead = first if first.isascii() and (first.islower() or first.isdigit()) else "~"
    match = F.startswith(F.col("token"), F.lit(token)) if prefix else F.col("token") == token
    return (F.col("lead") == lead) & match


def _without_gone(index: Postings, docs: DataFrame) -> DataFrame:
    """``docs`` (rowid, gen, ..) without those a later generation has replaced."""
    if index.gone is None:
        return docs
    last = index.gone.groupBy(F.col("rowid").alias("gone_row")).agg(F.max("gen").alias("gone_gen"))
    return docs.join(last, (docs["rowid"] == last["gone_row"]) & (docs["gen"] < last["gone_gen"]), "left_anti")


def _parts(term: Text) -> tuple[list[str], bool]:
    """(tokens, whether the last is a prefix) of a term's padded text."""
    return term.wanted.split(), bool(term.wanted) and not term.wanted.endswith(" ")


def _mask(term: Text) -> int:
    return sum(COLUMN_BITS[c] for c in term.columns)


def _some(index: Postings, token: str, prefix: bool, blocks: DataFrame | None) -> DataFrame:
    rows = index.blocks_of(token, prefix)
    return rows if blocks is None else rows.join(blocks.select("block"), "block", "left_semi")


def term_hits(index: Postings, term: Text, blocks: DataFrame | None = None) -> DataFrame:
    """(rowid, n, len): messages that hold the term, how often, and their length; ``blocks`` restricts the search to some of them.

    Only postings of the term's own tokens are read. One token needs no shuffle; a phrase is put together by row id.
    """
    tokens, prefix = _parts(term)
    mask = _mask(term)
    bounds = [(k * COLUMN_STEP, (k + 1) * COLUMN_STEP) for k, c in enumerate(TEXT_COLUMNS) if COLUMN_BITS[c] & mask]

    def inside(places: Column) -> Column:
        if mask == ALL_BITS:
            return places
        return F.filter(places, lambda place: reduce(Column.__or__, [(place >= a) & (place < b) for a, b in bounds]))

    def docs(token: str, is_prefix: bool, *fields: str) -> DataFrame:
        # fields are taken out of the blocks one by one, so that the scan reads no others
        wanted = ["rowid", "len", *(["n", "start"] if "places" in fields else fields)] + (["bits"] if mask != ALL_BITS else [])
        taken = [F.col(f"docs.{f}").alias(f) for f in (*wanted, *(f for f in fields if f == "places"))]
        rows = _some(index, token, is_prefix, blocks).select("gen", *taken)
        zipped = F.arrays_zip(*wanted)
        if "places" in fields:
            zipped = F.transform(zipped, lambda d: F.struct(*[d[f].alias(f) for f in wanted], F.slice("places", d["start"] + 1, d["n"]).alias("places")))
        rows = rows.select("gen", F.explode(zipped).alias("d")).select("gen", *[f"d.{f}" for f in wanted if f != "start"], *(f"d.{f}" for f in fields if f == "places"))
        return _without_gone(index, rows if mask == ALL_BITS else rows.filter(F.col("bits").bitwiseAND(mask) != 0))

    if not tokens:
        return index.postings.limit(0).select(F.col("block").alias("rowid"), F.lit(0).cast("long").alias("n"), F.col("shortest").alias("len"))
    if len(tokens) == 1:
        if mask == ALL_BITS:
            found = docs(tokens[0], prefix, "n").select("rowid", F.col("n").cast("long").alias("n"), "len")
        else:
            found = docs(tokens[0], prefix, "places").select("rowid", F.size(inside(F.col("places"))).cast("long").alias("n"), "len")
        return found.groupBy("rowid").agg(F.sum("n").alias("n"), F.first("len").alias("len")) if prefix else found

    parts = []
    for offset, token in enumerate(tokens):
        is_prefix = prefix and offset == len(tokens) - 1
        # where the phrase would begin; columns are far apart, so a start lies in the column of its words
        starts = _moved(inside(F.col("places")), offset)
        parts.append(docs(token, is_prefix, "places").select("rowid", "len", F.lit(offset).alias("offset"), starts.alias("starts")))
    by_offset = [F.flatten(F.collect_list(F.when(F.col("offset") == k, F.col("starts")))).alias(f"starts_{k}") for k in range(len(tokens))]
    joined = reduce(DataFrame.unionByName, parts).groupBy("rowid").agg(F.first("len").alias("len"), *by_offset)
    together = reduce(F.array_intersect, [F.col(f"starts_{k}") for k in range(len(tokens))])
    return joined.select("rowid", F.size(together).cast("long").alias("n"), "len").filter("n > 0")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - F.lit(by)) if by else places


def corpus_totals(index: Postings) -> DataFrame:
    """One row: messages and their mean length, summed from the kept differences."""
    return index.totals.agg(F.sum("messages").alias("messages"), F.try_divide(F.sum("length"), F.sum("messages")).alias("mean_len"))


def holding(index: Postings, term: Text) -> DataFrame:
    """One row: number of messages that hold the term. For one token in any column it is kept; else the term's own postings are counted."""
    tokens, prefix = _parts(term)
    if len(tokens) == 1 and not prefix and _mask(term) == ALL_BITS:
        kept = index.tokens.filter(_wanted(tokens[0], False))
        return kept.agg(F.coalesce(F.sum("holding"), F.lit(0)).alias("holding"))
    return term_hits(index, term).agg(F.count(F.lit(1)).alias("holding"))


# --- searching -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """What ranking needs to know of the corpus: the idf of each positive term and the mean message length."""

    idf: tuple[float, ...]
    mean: float

    def gain(self, term: int | Column, n: Column, length: Column) -> Column:
        """What a term adds to a score (its number may be a column)."""
        share = n * (K1 + 1) / (n + K1 * ((1 - B) + B * length / F.lit(self.mean)))
        if isinstance(term, int):
            return F.lit(self.idf[term]) * share
        return F.element_at(F.array(*map(F.lit, self.idf)), term + 1) * share


def weights(index: Postings, terms: list[Text]) -> Weights | None:
    """From kept totals and the terms' own postings, in one job that returns one row; None for an empty corpus."""
    found = corpus_totals(index).select("messages", "mean_len", *[holding(index, t).scalar().alias(f"n{k}") for k, t in enumerate(t for t in terms if not t.negated)])
    total, mean, *holders = found.first()
    if not total:
        return None
    raw = [log((total - n + 0.5) / (n + 0.5)) for n in holders]
    return Weights(tuple(x if x > 0 else FLOOR_IDF for x in raw), mean)


def matching_rows(index: Postings, terms: list[Text]) -> DataFrame:
    """Row ids of messages that hold all terms that are not negated; at least one is needed. Messages holding a negated one are left out."""
    return scored_rows(index, terms, None).select("rowid")


def scored_rows(index: Postings, terms: list[Text], known: Weights | None, blocks: DataFrame | None = None) -> DataFrame:
    """(rowid, score) of the messages that match; lower is better. Without weights the score is 0."""
    positive = [t for t in terms if not t.negated]
    parts = []
    for k, term in enumerate(positive):
        gain = F.lit(0.0) if known is None else known.gain(k, F.col("n").cast("double"), F.col("len"))
        parts.append(term_hits(index, term, blocks).select("rowid", F.lit(k).alias("term"), gain.alias("gain")))
    if len(parts) == 1:
        found = parts[0].select("rowid", "gain")
    else:
        # terms add up in their order, so that equal messages have equal scores
        gains = [F.max(F.when(F.col("term") == k, F.col("gain"))).alias(f"gain_{k}") for k in range(len(parts))]
        found = reduce(DataFrame.unionByName, parts).groupBy("rowid").agg(F.count(F.lit(1)).alias("terms"), *gains)
        found = found.filter(F.col("terms") == len(parts)).select("rowid", sum((F.col(f"gain_{k}") for k in range(1, len(parts))), F.col("gain_0")).alias("gain"))
    for term in terms:
        if term.negated and term.wanted:
            found = found.join(term_hits(index, term, blocks).select("rowid"), "rowid", "left_anti")
    return found.select("rowid", F.round(-F.col("gain"), 10).alias("score"))


def block_bounds(index: Postings, terms: list[Text], known: Weights) -> DataFrame:
    """(block, bound): blocks that hold all tokens of all positive terms, with a score that none of their messages can be better than.

    Reads tokens, block numbers and the two bounds of posting blocks, not the postings. In a block a phrase occurs at most as often as the
    rarest of its words, in messages no shorter than any of them allows.
    """
    parts, needed = [], 0
    for k, term in enumerate(t for t in terms if not t.negated):
        tokens, prefix = _parts(term)
        for offset, token in enumerate(tokens):
            rows = index.blocks_of(token, prefix and offset == len(tokens) - 1)
            own = rows.groupBy("block").agg(F.sum("most").alias("most"), F.min("shortest").alias("shortest"))
            parts.append(own.select("block", F.lit(k).alias("term"), "most", "shortest"))
            needed += 1
    per_term = reduce(DataFrame.unionByName, parts).groupBy("block", "term").agg(
        F.count(F.lit(1)).alias("words"), F.min("most").cast("double").alias("most"), F.max("shortest").alias("shortest")
    )
    gain = known.gain(F.col("term"), F.col("most"), F.col("shortest"))
    found = per_term.groupBy("block").agg(F.sum("words").alias("words"), F.sum(gain).alias("gain"))
    return found.filter(F.col("words") == needed).select("block", (-F.col("gain")).alias("bound"))


def worst_kept(index: Postings, terms: list[Text], known: Weights, limit: int, allowed: DataFrame | None = None) -> float | None:
    """A score that the ``limit`` best messages are no worse than, None if none is known.

    It is the last of the ``limit`` best among the messages of the SEED_BLOCKS most promising blocks.
    """
    seeds = block_bounds(index, terms, known).orderBy("bound", "block").limit(SEED_BLOCKS)
    first = scored_rows(index, terms, known, seeds)
    if allowed is not None:
        first = first.join(allowed.select("rowid"), "rowid", "left_semi")
    count, worst = first.select("score").orderBy("score").limit(limit).agg(F.count(F.lit(1)), F.max("score")).first()
    return worst if count >= limit else None


def candidate_blocks(index: Postings, terms: list[Text], known: Weights, worst: float) -> DataFrame:
    """Blocks that may hold a message with a score of ``worst`` or better; the others are skipped."""
    # scores are rounded to ten places, bounds are not
    return block_bounds(index, terms, known).filter(F.col("bound") <= worst + 1e-9)


def ranked_rows(index: Postings, terms: list[Text], limit: int = 0, allowed: DataFrame | None = None) -> DataFrame:
    """(rowid, score) of matching messages; lower BM25 scores are better. With a ``limit``, only those that may be among the best ``limit`` ones.

    ``allowed`` restricts the result to its row ids. Corpus totals and frequencies of single tokens are kept numbers; nothing scans the corpus.
    """
    possible = all(t.wanted for t in terms if not t.negated)
    known = weights(index, terms) if possible else None
    if known is None:
        return scored_rows(index, terms, None)
    worst = worst_kept(index, terms, known, limit, allowed) if limit else None
    if worst is None:
        found = scored_rows(index, terms, known)
    else:
        found = scored_rows(index, terms, known, candidate_blocks(index, terms, known, worst)).filter(F.col("score") <= worst)
    return found if allowed is None else found.join(allowed.select("rowid"), "rowid", "left_semi")


# --- changes -------------------------------------------------------------------------------------------------


def add_changes(spark: SparkSession, path: str, changes: DataFrame, change_set: str = "") -> None:
    """Add a generation with message changes (``op``, ``seq``, message columns); nothing that is stored is rewritten.

    Of several changes to a row the highest ``seq`` counts, also against what is stored already. What the rows held before is looked
    up by the least and greatest row id of the changes, so only the files of those rows are read. A generation that was cut off is
    not seen and is overwritten by the next one; a named ``change_set`` that is in already is not added again. One writer at a time.
    """
    index = read_postings(spark, path)
    if change_set and _commits(spark, path).filter(F.col("change_set") == change_set).limit(1).count():
        return
    gen = index.gen + 1
    low, high = changes.agg(F.min("rowid"), F.max("rowid")).first()
    if low is None:
        return
    given = changes.filter(F.col("rowid").isNotNull())
    texts = [text_column(changes, c).alias(c) for c in TEXT_COLUMNS]
    newest = newest_changes(given.select(*mailbox_key(changes), "rowid", "seq", (F.col("op") != "delete").alias("live"), *texts))
    before = _current_forward(spark, index, F.col("rowid").between(low, high))
    old = before.select(F.col("rowid").alias("old_row"), F.col("seq").alias("old_seq"))
    fresh = newest.join(old, newest["rowid"] == old["old_row"], "left").filter(F.coalesce(F.col("seq") > F.col("old_seq"), F.lit(True)))
    # the changes are shuffled already, so Spark's sampling makes no text again
    _write_generation(_forward(fresh.select("rowid", "seq", "live", *TEXT_COLUMNS).repartitionByRange("rowid")), path, gen)
    replaced = before.join(_stored(spark, path, "forward", gen).select("rowid"), "rowid", "left_semi")
    _write(replaced.select("rowid"), path, "gone", gen)
    _write_totals(spark, replaced, path, gen)
    _commit(spark, path, gen, index.base, change_set)


def _current_forward(spark: SparkSession, index: Postings, where: Column | None = None) -> DataFrame:
    """The last forward row of every row id; the filter reaches the scan."""
    rows = _table(spark, index.path, "forward", index.base, index.gen)
    rows = rows if where is None else rows.filter(where)
    if index.gone is None:
        return rows.drop("gen")
    # only row ids and generations are grouped
    last = rows.groupBy(F.col("rowid").alias("last_row")).agg(F.max("gen").alias("last_gen"))
    return rows.join(last, (rows["rowid"] == last["last_row"]) & (rows["gen"] < last["last_gen"]), "left_anti").drop("gen")


def compact(spark: SparkSession, path: str) -> None:
    """Write all generations as one new base. Readers see it when it is complete; earlier folders may then be removed."""
    index = read_postings(spark, path)
    if index.gone is None:
        return
    gen = index.gen + 1
    forward = _current_forward(spark, index)
    _write_generation(forward.repartitionByRange("rowid").sortWithinPartitions("rowid"), path, gen)
    counts = index.tokens.groupBy("token", "lead").agg(F.sum("holding").alias("holding")).filter("holding <> 0")
    _write(counts.repartitionByRange("lead", "token").sortWithinPartitions("lead", "token"), path, "tokens", gen, "lead")
    _write(index.totals.agg(F.sum("messages").alias("messages"), F.sum("length").alias("length")), path, "totals", gen)
    _write(spark.range(0).toDF("rowid"), path, "gone", gen)
    _commit(spark, path, gen, gen)
