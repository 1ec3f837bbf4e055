"""Relevance: BM25 over the whole corpus, equal weight for every text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.functions.text import occurrences
from mailspark.operators.index import doc_length, padded
from mailspark.operators.terms import Text

# BM25 constants, and the weight of a term found in more than half of the messages.
K1, B, FLOOR_IDF = 1.2, 0.75, 1e-6


def matches(messages: DataFrame, term: Text) -> Column:
    """Whether one of the term's columns holds the wanted tokens. Never null; ignores negation."""
    if not term.wanted:
        return F.lit(False)
    hits = [F.contains(padded(messages, c), F.lit(term.wanted)) for c in term.columns]
    return reduce(Column.__or__, hits)


def frequency(messages: DataFrame, term: Text) -> Column:
    """Occurrences of the term over its columns."""
    if not term.wanted:
        return F.lit(0).cast("long")
    return reduce(Column.__add__, [occurrences(padded(messages, c), term.wanted) for c in term.columns])


def corpus_stats(messages: DataFrame, terms: list[Text]) -> DataFrame:
    """One row: number of messages, mean length, and for each term the messages holding it."""
    hits = [F.count_if(matches(messages, t)).alias(f"hits_{i}") for i, t in enumerate(terms)]
    return messages.agg(F.count(F.lit(1)).alias("messages"), F.avg(doc_length(messages)).alias("mean_len"), *hits)


def bm25(messages: DataFrame, terms: list[Text], stats: DataFrame) -> Column:
    """Score of a message for the positive terms; lower is better. ``stats`` is read as a scalar subquery."""
    corpus = stats.select(F.struct("*")).scalar()
    total, mean = corpus["messages"].cast("double"), corpus["mean_len"]
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        holding = corpus[f"hits_{i}"].cast("double")
        raw = F.ln((total - holding + 0.5) / (holding + 0.5))
        idf = F.when(raw > 0, raw).otherwise(F.lit(FLOOR_IDF))
        found = frequency(messages, term).cast("double")
        length = (1 - B) + B * doc_length(messages) / mean
        score = score - idf * found * (K1 + 1) / (found + K1 * length)
    return F.round(score, 10)
