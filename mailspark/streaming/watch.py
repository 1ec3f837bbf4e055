"""New-message events from a stream of messages.

A message counts as new the first time its id appears among the hits of the watched search. Ids seen
are kept in Spark's state store under the query's checkpoint, so a restarted watch goes on where it
stopped; ids never expire unless a watermark is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailspark.operators.events import to_events
from mailspark.operators.search import NEWEST, filtered, take
from mailspark.operators.terms import Term
from mailspark.schemas import LIST_COLUMNS, MESSAGES


def watched(
    stream: DataFrame, terms: Iterable[Term] = (), folders: DataFrame | None = None, now: datetime | None = None
) -> DataFrame:
    """Messages of the stream matching the search."""
    return filtered(stream, terms, folders, now)


def fresh(stream: DataFrame, keep: str | None = None) -> DataFrame:
    """First row of every id; one exchange, and one entry of state per id.

    An id repeated very often is first reduced where it is read, within each Arrow batch. ``keep`` (for example
    ``"30 days"``) bounds the state: repeats older than that by ``ts`` may count as new again. Rows without an id are one id.
    """
    fewer = stream.mapInArrow(_first_rows, stream.schema)
    return fewer.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["id"]) if keep else fewer.dropDuplicates(["id"])


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch.column("id").dictionary_encode(null_encoding="encode").indices
        first = np.unique(codes.to_numpy(zero_copy_only=False), return_index=True)[1]
        yield batch.take(pa.array(np.sort(first)))


def without_baseline(stream: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drop messages whose id was there before the watch began."""
    return stream.join(baseline.select("id").distinct(), "id", "left_anti")


def baseline(
    messages: DataFrame, terms: Iterable[Term] = (), folders: DataFrame | None = None, now: datetime | None = None
) -> DataFrame:
    """Ids that match already; store them and pass them to ``start_watch`` for a silent start."""
    return filtered(messages, terms, folders, now).select("id").distinct()


def newest_first_window(messages: DataFrame, limit: int) -> DataFrame:
    """Only the newest ``limit`` rows of a batch, for watches that should look no deeper."""
    return take(messages, NEWEST, limit)


def start_watch(
    stream: DataFrame,
    terms: Iterable[Term],
    sink: str,
    checkpoint: str,
    *,
    query: str = "",
    source: str = "",
    known: DataFrame | None = None,
    silent: bool = False,
    folders: DataFrame | None = None,
    now: datetime | None = None,
    cap: int = 0,
    window: int = 0,
    keep: str | None = None,
    trigger: dict | None = None,
    on_events: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Write one event per new matching message to ``sink`` (Parquet, one folder per batch).

    ``known`` holds ids that must not fire; give it again at each start. They are stored beside the checkpoint and enter the state with
    the first batch, so only that one is compared with them (with ``keep`` or ``window`` every batch is). ``silent`` lets the first
    batch go into the state without events. With ``cap`` only the newest messages of a batch fire (0 = all), oldest
    first; the others count as seen. ``window`` looks at the newest rows of a batch only, and ``on_events`` is called with
    the events of each batch. A repeated batch overwrites its own folder, so no event is stored twice. A changed search needs a new checkpoint
    and a new baseline.
    """
    terms = list(terms)
    hits = watched(stream, terms, folders, now)
    stored = None
    if known is not None and (window or keep):
        hits = without_baseline(hits, known)
    elif known is not None:
        stored = f"{checkpoint.rstrip('/')}-known"
        if not _has_begun(stream, checkpoint):
            known.select("id").distinct().write.mode("overwrite").parquet(stored)
        ids = stream.sparkSession.readStream.schema("id string").parquet(stored)
        hits = hits.unionByName(ids, allowMissingColumns=True)
    # With a window, rows outside it stay unseen, so ids are remembered per batch instead of in the state store.
    new = hits if window else fresh(hits, keep)

    def deliver(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if window:
            rows = newest_first_window(batch, window).dropDuplicates(["id"]).persist()
            rows = _unseen(rows, f"{sink}_seen", batch_id)
        elif stored and batch_id == 0:
            ids = spark.read.parquet(stored).withColumnRenamed("id", "_known")
            rows = rows.join(ids, rows["id"].eqNullSafe(ids["_known"]), "left_anti")
        if silent and batch_id == 0:
            rows.select("id").write.format("noop").mode("overwrite").save()  # the state is kept only of a batch that is read
            rows = rows.limit(0)
        capped = take(rows, NEWEST, cap) if cap else rows
        ordered = capped.select(*LIST_COLUMNS).orderBy("date", "id")
        to_events(ordered, query, source).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        if on_events:
            on_events(spark.read.parquet(f"{sink}/batch={batch_id}"), batch_id)

    writer = new.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _has_begun(stream: DataFrame, checkpoint: str) -> bool:
    """Whether a query was started with this checkpoint; its baseline was complete by then and must stay."""
    try:
        return not stream.sparkSession.read.text(f"{checkpoint}/metadata").isEmpty()
    except AnalysisException:
        return False


def _runs(batch_id: int) -> list[tuple[int, int]]:
    """The stretches of batches whose seen ids are stored together, for all batches before this one: one per binary digit."""
    runs, start = [], 0
    for size in (1 << n for n in reversed(range(batch_id.bit_length()))):
        if batch_id & size:
            runs.append((start, start + size))
            start += size
    return runs


def _unseen(rows: DataFrame, seen: str, batch_id: int) -> DataFrame:
    """Rows of a window whose ids no earlier batch had; their ids are stored.

    Ids of earlier batches lie in as many sorted tables as the batch number has binary digits set; of these only row groups that may hold one of
    the window's ids are read. Ids of a window come to the driver, as many as the watch was told to look at.
    """
    spark = rows.sparkSession
    ids = [r.id for r in rows.select("id").collect()]
    runs = _runs(batch_id)

    def stored(run: tuple[int, int]) -> DataFrame:
        return spark.read.parquet(f"{seen}/{run[0]}-{run[1]}")

    unseen = rows
    for run in runs:
        unseen = unseen.join(stored(run).filter(F.col("id").isin(ids)), "id", "left_anti")
    new = next(run for run in reversed(_runs(batch_id + 1)))
    together = rows.select("id")
    for run in runs:
        if run[0] >= new[0]:
            together = together.unionByName(stored(run))
    together.distinct().repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{seen}/{new[0]}-{new[1]}")
    return unseen


def read_events(spark: SparkSession, sink: str) -> DataFrame:
    """All events with their batch; none before the first batch."""
    none = to_events(spark.createDataFrame([], MESSAGES).select(*LIST_COLUMNS), "", "").withColumn("batch", F.lit(0))
    try:
        return spark.read.option("basePath", sink).schema(none.schema).parquet(sink)
    except AnalysisException:
        return none
