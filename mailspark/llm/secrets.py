"""Secret scan in DataFrame operations only: fixed patterns, and runs of characters with high windowed entropy.

A candidate is a run of 20 or more of ``A-Za-z0-9+/_=-`` that has a digit and a letter. Its class is hex, alphanumeric or base64, each
with a window length and a least entropy. While a window slides over the run, the count of the character that enters and of the one
that leaves change, and with them the sum of c * log2(c) over the window's counts; a window's Shannon entropy is
log2(w) - sum / w. The sum is kept in whole millionths, so it doesn't drift. A run is reported if any window reaches the class's least
entropy, unless an allow-list entry fits it or a pattern's span overlaps it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, regular expression, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: kind, what the whole run must match, window, least entropy in bits. The first that fits is the run's class.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", 20, 3.0),
    ("entropy_alnum", r"^[0-9A-Za-z]+$", 20, 3.7),
    ("entropy_base64", r"^", 20, 3.7),
)
#: Runs that look random but aren't secrets: identifiers in UUID form, numbers with separators, stand-ins.
ALLOWED = (r"^(?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$", r"^[0-9+/_=-]+$", r"(?i)example|placeholder|x{6,}|0123456789|abcdefghij")
SCALE = 1_000_000
#: Matches whose places are summed together.
BLOCK = 256
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def weight(count: int) -> int:
    """count * log2(count) in millionths."""
    return round(count * math.log2(count) * SCALE) if count else 0


def most_allowed(window: int, least: float) -> int:
    """The sum of weights that a window of the least entropy has."""
    return math.floor(window * (math.log2(window) - least) * SCALE)


def located(text: Column, pattern: str, group: int) -> Column:
    """All matches, leftmost first: struct(start, end, run), in code points, end exclusive; run is the group's text.

    Places are summed in blocks of ``BLOCK`` matches and the blocks' lengths after that: appending to an array copies it, so one sum
    over all matches would take the square of their number.
    """
    kind = "array<struct<start:int,end:int,run:string>>"
    rows = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("run"),
    )

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.coalesce(F.length(row["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), row["run"].alias("run"))
        # behind the last match there is a gap alone
        more = F.when(row["whole"].isNull(), F.array().cast(kind)).otherwise(F.array(span))
        return F.struct(end.alias("at"), F.concat(state["spans"], more).alias("spans"))

    def within(rows: Column) -> Column:
        """(length, spans counted from the block's beginning) of each block."""
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
        firsts = F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK))
        return F.transform(firsts, lambda first: F.aggregate(F.slice(rows, first, F.lit(BLOCK)), empty, step))

    def joined(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda sums, block: F.concat(sums, F.array(F.element_at(sums, -1) + block["at"])))
        moved = lambda pair: F.transform(pair["block"]["spans"], lambda s: F.struct(
            (pair["begin"] + s["start"]).alias("start"), (pair["begin"] + s["end"]).alias("end"), s["run"].alias("run")
        ))
        pairs = F.arrays_zip(blocks.alias("block"), F.slice(begins, F.lit(1), F.size(blocks)).alias("begin"))
        return F.flatten(F.transform(pairs, moved))

    return F.when(text.rlike(pattern), once(once(rows, within), joined)).otherwise(F.array().cast(kind))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a one-element array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def least_weight(run: Column, window: int) -> Column:
    """Smallest sum of weights of any window of the run, that of the largest entropy; the run has ``window`` characters at least."""
    weights = F.array(*(F.lit(weight(c)).cast("bigint") for c in range(window + 1)))
    # split into characters: a substring by place would walk from the run's beginning each time
    codes = F.transform(F.split(run, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(1 << 60).cast("bigint").alias("least")
    )

    def step(state: Column, move: Column) -> Column:
        came, left = move["came"], move["left"]
        at = lambda code: F.get(state["counts"], code - 1)
        change = lambda old, new: F.get(weights, new) - F.get(weights, old)
        gone = F.when(left > 0, change(at(left), at(left) - 1)).otherwise(F.lit(0).cast("bigint"))
        total = state["sum"] + F.when(came == left, F.lit(0).cast("bigint")).otherwise(change(at(came), at(came) + 1) + gone)
        counts = F.transform(state["counts"], lambda c, k: c + (k + 1 == came).cast("int") - (k + 1 == left).cast("int"))
        least = F.when(move["full"], F.least(state["least"], total)).otherwise(state["least"])
        return F.struct(counts.alias("counts"), total.alias("sum"), least.alias("least"))

    def slide(codes: Column) -> Column:
        moves = F.transform(codes, lambda c, k: F.struct(
            c.alias("came"), F.when(k >= window, F.get(codes, k - window)).otherwise(F.lit(0)).alias("left"), (k + 1 >= window).alias("full")
        ))
        return F.aggregate(moves, start, step)["least"]

    return once(codes, slide)


def named(kind: str, number: int, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda m: F.length(m["run"]) >= least)


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def is_random(run: Column, classes: tuple = CLASSES) -> Column:
    """Whether a window of the run reaches the least entropy of the run's class."""
    verdict = F.lit(False)
    for _, shape, window, least in reversed(classes):
        verdict = F.when(run.rlike(shape), least_weight(run, window) <= most_allowed(window, least)).otherwise(verdict)
    return verdict


def class_of(run: Column, classes: tuple = CLASSES) -> tuple[Column, Column]:
    kind, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k in reversed(range(len(classes))):
        fits = run.rlike(classes[k][1])
        kind, number = F.when(fits, F.lit(classes[k][0])).otherwise(kind), F.when(fits, F.lit(len(PATTERNS) + k)).otherwise(number)
    return kind, number


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``spans``: arrays of struct(start, kind_no, end, kind) in order of start and kind.

    ``base`` has the fixed patterns' spans, ``spans`` also those of high entropy. Null and empty texts have none. Rows are handled one
    by one, so repeated rows, null ids and other columns change nothing; columns of docs named base, spans or starting with
    ``_found_`` are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {f"_found_{kind}": located(text, pattern, group) for kind, pattern, group, _ in PATTERNS} | {"_found_runs": located(text, RUN, 0)}
    rows = docs.withColumns(found)
    base = F.concat(*(named(kind, k, long_enough(F.col(f"_found_{kind}"), least)) for k, (kind, _, _, least) in enumerate(PATTERNS)))
    rows = rows.withColumn("base", F.array_sort(base.cast(SPANS)))

    def kept(m: Column) -> Column:
        run = m["run"]
        plain = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
        for pattern in allowed:
            plain = plain & ~run.rlike(pattern)
        clear = ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
        return F.when(plain & clear, is_random(run)).otherwise(F.lit(False))

    def span(m: Column) -> Column:
        kind, number = class_of(m["run"])
        return F.struct(m["start"].alias("start"), number.alias("kind_no"), m["end"].alias("end"), kind.alias("kind"))

    extra = F.transform(F.filter("_found_runs", kept), span)
    return rows.withColumn("spans", F.array_sort(F.concat(F.col("base"), extra.cast(SPANS)))).drop(*found)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs`` (doc_id, text)."""
    found = scan(docs.select("doc_id", "text"))
    counts = [F.size(of_kind("base", kind)).cast("bigint").alias(f"n_{kind}") for kind, *_ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
