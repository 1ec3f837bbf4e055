"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of (source, language, topic). The cells' token counts are raked: each margin in turn is scaled to its target
shares until all margins fit. A cell's weight is its raked share over its own share of the tokens; documents are kept with a
probability proportional to it, the largest being 1, so the kept tokens have the target shares on average. The draw is a hash of the
document, so a run repeated after lost executors draws alike.

The texts are read once for the counts and once for the sample. Everything between works on cells, which are summed before they
are shuffled; they may be many (one source per site) and never come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import stored

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
#: Topics by marks that a text has anywhere; the first that fits counts.
TOPICS = (("tables", " | "), ("contacts", "@"), ("licences", "icense"), ("notices", "!!"), ("symbols", "***"))
ROUNDS = 100
FIT = 1e-6


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, mark in reversed(TOPICS):
        topic = F.when(F.coalesce(F.contains(text, F.lit(mark)), F.lit(False)), name).otherwise(topic)
    return topic


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def cell_columns() -> dict[str, Column]:
    plain = {name: F.coalesce(F.col(name).cast("string"), F.lit(NONE)) for name in ("source", "lang")}
    return {f"_mix_{name}": column for name, column in (plain | {"topic": topic_of(F.col("text"))}).items()}


def target_shares(spark: SparkSession, cells: DataFrame, name: str, given: dict[str, float], power: float) -> DataFrame:
    """(value, target) of one margin: given shares, and what is left for the other values in proportion to tokens ** power."""
    sums = cells.groupBy(F.col(f"_mix_{name}").alias("value")).agg(F.sum("n").alias("n"))
    named = spark.createDataFrame(list(given.items()), "value string, given double") if given else spark.createDataFrame([], "value string, given double")
    rows = sums.join(named, "value", "left").withColumn("free", F.when(F.col("given").isNull(), F.pow("n", F.lit(power))).otherwise(0.0))
    total = rows.agg(F.sum("given").alias("given"), F.sum("free").alias("free")).first()
    taken, free = float(total["given"] or 0), float(total["free"] or 0)
    left = max(0.0, 1.0 - taken) if free else 0.0
    whole = (taken + left) or 1.0
    target = (F.coalesce("given", F.lit(0.0)) + (F.col("free") * (left / free) if free else F.lit(0.0))) / whole
    return rows.select("value", target.alias("target"))


def raked(spark: SparkSession, cells: DataFrame, targets: dict[str, DataFrame], fit: float = FIT, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with ``w``, their share of the tokens after raking. Stops when every margin is within ``fit`` of its target.

    Where no weights can meet all targets (an empty combination is needed), it stops after ``rounds`` with the last margin met.
    Every step is written, so that the next one is planned from the size of its rows alone and not from the plans of all steps before.
    """
    total = cells.agg(F.sum("n")).first()[0] or 0
    current = cells.withColumn("w", F.col("n") / F.lit(float(total or 1)))
    for name, target in targets.items():
        current = current.join(target.select(F.col("value").alias(f"_mix_{name}"), F.col("target").alias(f"_mix_target_{name}")), f"_mix_{name}")
    current = stored(spark, current.withColumn("off", F.lit(0.0)), "mix-step")
    for _ in range(rounds if total else 0):
        for k, name in enumerate(targets):
            sums = current.groupBy(f"_mix_{name}").agg(F.sum("w").alias("sum"))
            factor = F.when(F.col("sum") > 0, F.col(f"_mix_target_{name}") / F.col("sum")).otherwise(0.0)
            miss = F.when(F.col("w") * factor > 0, F.abs(factor - 1)).otherwise(0.0)
            step = current.join(sums, f"_mix_{name}").withColumns({"w": F.col("w") * factor, "off": miss if k == 0 else F.greatest("off", miss)}).drop("sum")
            current = stored(spark, step, "mix-step")
        if current.agg(F.max("off")).first()[0] <= fit:
            break
    return current.select(*cells.columns, "w")


def cell_probabilities(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]], power: dict[str, float]) -> DataFrame:
    """(cell columns, weight, probability) of every cell of ``docs``."""
    rows = docs.select(*(column.alias(name) for name, column in cell_columns().items()), token_count(F.col("text")).alias("n"))
    names = [f"_mix_{name}" for name in MARGINS]
    cells = stored(spark, rows.groupBy(*names).agg(F.sum("n").alias("n")), "mix-cells")
    shares = {name: stored(spark, target_shares(spark, cells, name, targets.get(name, {}), power.get(name, 1.0)), "mix-targets") for name in MARGINS}
    total = float(cells.agg(F.sum("n")).first()[0] or 1)
    # a cell without tokens can't move any margin; its documents are kept
    fitted = raked(spark, cells, shares).withColumn("weight", F.when(F.col("n") > 0, F.col("w") / (F.col("n") / total)))
    largest = float(fitted.agg(F.max("weight")).first()[0] or 1.0)
    return stored(spark, fitted.select(*names, "weight", F.coalesce(F.col("weight") / largest, F.lit(1.0)).alias("probability")), "mix-probabilities")


def draw(seed: int) -> Column:
    """A number from 0 up to 1 that depends on id and text alone."""
    bits = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    return F.pmod(bits, F.lit(1 << 53)) / F.lit(float(1 << 53))


def mixed_documents(
    spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: dict[str, float] | None = None, seed: int = 1
) -> DataFrame:
    """All columns of ``docs`` with _mix_source, _mix_lang, _mix_topic, _mix_tokens, _mix_weight, _mix_probability and _mix_kept.

    targets: {margin: {value: share}}; the other values of a margin share the rest in proportion to tokens ** power[margin] (1: as they are).
    Null source or lang is the value "(none)"; a null text has no tokens. Rows of the same id and text are kept or dropped together.
    An empty table gives no rows.
    """
    chances = cell_probabilities(spark, docs, targets or {}, power or {}).withColumnsRenamed({"weight": "_mix_weight", "probability": "_mix_probability"})
    marked = docs.withColumns(cell_columns()).join(chances, [f"_mix_{name}" for name in MARGINS])
    return marked.withColumns({"_mix_tokens": token_count(F.col("text")), "_mix_kept": draw(seed) < F.col("_mix_probability")})


def sampled(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, that the draw keeps."""
    marked = mixed_documents(spark, docs, targets, power, seed)
    return marked.filter("_mix_kept").select(*(F.col(f"`{name}`") for name in docs.columns))


def mix_table(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept for each row of ``docs`` (doc_id, text, source, lang)."""
    marked = mixed_documents(spark, docs.select("doc_id", "text", "source", "lang"), targets, power, seed)
    named = {f"_mix_{name}": name for name in MARGINS} | {"_mix_tokens": "n_tokens", "_mix_weight": "weight", "_mix_probability": "probability", "_mix_kept": "kept"}
    return marked.select("doc_id", *(F.col(old).alias(new) for old, new in named.items()))
